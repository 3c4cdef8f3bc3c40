"""Line dedup: lines that many documents hold stay in one document only.

Lines are exploded and their normalised keys hashed to 128 bits; the documents of each
hash are counted in two levels (hash and document, then hash), so a line that a third of
all documents hold is summed before it is shuffled. Only hashes and positions travel; the
texts are shuffled once, to meet the positions that they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import ascii_lower, held, id_or_least, stripped
from terrakit.session import written


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines``, ``n_dropped``.

    A line's key is the line without white space at both ends and with A-Z lower-cased.
    Keys of at least ``min_chars`` code points that ``min_docs`` documents hold lose all
    their lines except in the largest ``doc_id`` holding them.

    - Null or empty text: one empty line; the text comes out empty.
    - Rows that share a ``doc_id`` are one document; all rows of the largest one keep the line.
    - A null ``doc_id`` is one document, smaller than any other.
    - All lines lost: empty text. Empty table: empty result.
    - Other columns stay; columns named like the two results are replaced.
    """
    rows = docs.withColumns({
        "__ld_id": id_or_least(F.col("doc_id")),
        "__ld_text": F.coalesce("text", F.lit("")),
    }).withColumn("__ld_hash", F.xxhash64("__ld_text"))
    lines = rows.select(
        "__ld_id", "__ld_hash", F.posexplode(F.split("__ld_text", "\n")).alias("pos", "line")
    ).withColumn("line", stripped(F.col("line")))
    # Letters keep their number when they are folded, so only lines that stay are.
    key = ascii_lower(F.col("line"))
    keys = lines.filter(F.char_length("line") >= min_chars).select(
        "__ld_id", "__ld_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")
    )
    # Read twice, to count and to find the lines again: hashes are far smaller than the texts they are made of.
    keys = written(keys, "line-keys")
    repeated = (
        keys.groupBy("h1", "h2", "__ld_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("held_by"), F.max("__ld_id").alias("keeper"))
        .filter(F.col("held_by") >= min_docs).select("h1", "h2", "keeper")
    )
    # From files, so that the join shuffles both sides itself and the engine can split a common line's rows.
    repeated = written(repeated, "repeated-lines")
    lost = (
        keys.join(repeated, ["h1", "h2"]).filter(F.col("__ld_id") != F.col("keeper"))
        .groupBy("__ld_id", "__ld_hash").agg(F.sort_array(F.collect_set("pos")).alias("__ld_lost"))
    )
    joined = rows.join(lost, ["__ld_id", "__ld_hash"], "left")
    joined = joined.withColumn("__ld_lost", F.coalesce("__ld_lost", F.array().cast("array<int>")))
    joined = joined.withColumn("__ld_lines", held(F.split("__ld_text", "\n")))
    # The kept lines are the runs between neighbouring lost positions.
    before = F.concat(F.array(F.lit(-1)), "__ld_lost")
    after = F.concat("__ld_lost", F.array(F.size("__ld_lines")))
    joined = joined.withColumn("__ld_runs", held(F.arrays_zip(before.alias("b"), after.alias("a"))))
    lines = F.col("__ld_lines")
    kept = F.flatten(F.transform("__ld_runs", lambda r: F.slice(lines, r["b"] + 2, r["a"] - r["b"] - 1)))
    return joined.withColumns({
        "text": F.when(F.size("__ld_lost") == 0, F.col("__ld_text")).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("__ld_lines").cast("long"),
        "n_dropped": F.size("__ld_lost").cast("long"),
    }).drop("__ld_id", "__ld_text", "__ld_hash", "__ld_lost", "__ld_lines", "__ld_runs")
