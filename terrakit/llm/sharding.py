"""Sharding by extendible hashing.

A directory of hash prefixes: a bucket that is over the byte limit, and only such a one,
is split on the next bit of the hash until each fits. Bytes are summed per long prefix
before anything is shuffled, and the levels of the directory are sums over that small
table. Rows that one hash value alone carries over the limit go to numbered pages of
their bucket, as overflow pages do in a hash file.

The directory grows with the data, so no join broadcasts it: narrow rows (id, bytes, two
hashes) are shuffled to it instead, and never a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import id_or_least
from terrakit.operators.ordered import ranked, running_total
from terrakit.session import written

LIMIT = 4 << 20
BITS = 63

#: Bits looked at beyond those that an even spread needs, per pass.
SPARE = 6


def _prefix(value: Column, bits) -> Column:
    """The leading bits of a 63-bit hash as a number."""
    return F.expr(f"shiftright(__hash, {BITS} - {bits})") if isinstance(bits, str) else F.shiftright(value, BITS - bits)


def _bits_of(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def sharded(docs: DataFrame, limit: int = LIMIT, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, shard, depth, page, shard_bytes``.

    ``shard`` holds the hash bits of the bucket (no bits: everything fits in one), ``depth``
    their number. The bytes of a (shard, page) are at most ``limit``, but for a document
    that is longer than that, which has a page to itself.

    - Null text has no bytes; a null ``doc_id`` is hashed as the least id.
    - Rows of one ``doc_id`` share a shard; if they are over the limit together they get
      pages along their order in size, ties by text hash.
    - Empty table: empty result. Other columns do not take part, but for ``row``, the
      name of one that comes out as it is.
    """
    names = [row] if row else []
    rows = docs.select(
        *names, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64("text").alias("__text"),
        F.shiftrightunsigned(F.xxhash64(id_or_least(F.col("doc_id"))), 1).alias("__hash"),
    )
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SPARE)
    todo, found = rows, []
    while True:
        leaves, over = _levels(todo, limit, low, high)
        found.append((high, leaves))
        if high == BITS or over.isEmpty():
            break
        # Only rows of buckets that are still too large look at more bits.
        todo = todo.withColumn("__p", _prefix(F.col("__hash"), high)).join(
            over.select(F.col("prefix").alias("__p")).hint("merge"), "__p", "left_semi"
        ).drop("__p")
        low, high = high + 1, min(BITS, high + 10)
    parts = []
    left = rows
    for bits, leaves in found:
        parts.append(left.withColumn("__p", _prefix(F.col("__hash"), bits)).join(
            leaves.withColumnRenamed("long_prefix", "__p").hint("merge"), "__p"
        ).drop("__p"))
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.unionByName(part)
    placed = placed.withColumn("page", F.lit(0).cast("long"))
    if found[-1][0] == BITS and not over.isEmpty():
        placed = placed.unionByName(_pages(todo, over, limit).select(*placed.columns))
    return placed.select(
        *names, "doc_id", "n_bytes", _bits_of(F.col("prefix"), F.col("depth")).alias("shard"),
        F.col("depth").cast("int").alias("depth"), "page", "shard_bytes",
    )


def _levels(rows: DataFrame, limit: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Leaves between two depths, one row per long prefix; and what is over at the last."""
    sums = written(
        rows.groupBy(_prefix(F.col("__hash"), high).alias("long_prefix")).agg(F.sum("n_bytes").alias("b")), "shard-sums"
    )
    levels = sums.select("long_prefix", "b", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(long_prefix, {high} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"))
    sized = written(buckets, "shard-buckets")
    fits = sized.filter(F.col("shard_bytes") <= limit)
    above = sized.filter((F.col("shard_bytes") > limit) & (F.col("depth") < high)).select(
        (F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
    )
    roots = fits.filter(F.col("depth") == low)
    leaves = fits.join(above.hint("merge"), ["depth", "prefix"], "left_semi").unionByName(roots)
    placed = levels.select("long_prefix", "depth", "prefix").join(leaves.hint("merge"), ["depth", "prefix"])
    return placed, sized.filter((F.col("depth") == high) & (F.col("shard_bytes") > limit))


def _pages(rows: DataFrame, over: DataFrame, limit: int) -> DataFrame:
    """Rows of single hash values that are over the limit, in pages along a running sum."""
    over = over.select(F.col("prefix").alias("__p"), "prefix", "depth")
    work = rows.withColumn("__p", _prefix(F.col("__hash"), BITS)).join(over.hint("merge"), "__p").drop("__p")
    order = [F.col("n_bytes"), F.col("__text")]
    work = ranked(work, ["prefix"], F.col("n_bytes"), order, "__at", F.shiftright("__text", 44))
    whole = work.filter(F.col("n_bytes") >= limit).withColumn("page", F.col("__at"))
    small = work.filter(F.col("n_bytes") < limit)
    most = small.groupBy("prefix").agg(F.max("n_bytes").alias("__most")).withColumnRenamed("prefix", "__q")
    small = running_total(small, ["prefix"], "__at", F.col("n_bytes"), "__sum")
    small = small.join(most.hint("merge"), F.col("prefix") == F.col("__q")).drop("__q")
    # Pages of (limit - most) started bytes hold at most limit bytes.
    step = F.lit(limit) - F.col("__most") + 1
    small = small.withColumn("page", -1 - F.floor((F.col("__sum") - F.col("n_bytes")) / step))
    both = small.drop("__most", "__sum", "chunk").unionByName(whole)
    sums = both.groupBy("prefix", "page").agg(F.sum("n_bytes").alias("shard_bytes")).select(
        F.col("prefix").alias("__q"), F.col("page").alias("__g"), "shard_bytes"
    )
    both = both.join(sums.hint("merge"), (F.col("prefix") == F.col("__q")) & (F.col("page") == F.col("__g")))
    return both.withColumn("page", F.col("page").cast("long"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the rows of ``docs``, one folder per shard and page, each within ``limit``
    bytes of text but for a longer document in a page of its own.

    Rows are numbered in a written table, so each goes to the page that was planned for
    it, also where rows share an id, or an id and a text. Columns named ``shard`` or
    ``page`` are replaced. Null ids and texts and empty tables are as in :func:`sharded`.
    """
    rows = written(docs.drop("shard", "page").withColumn("__row", F.monotonically_increasing_id()), "shard-input")
    plan = sharded(rows.select("__row", "doc_id", "text"), limit, "__row").select("__row", "shard", "page")
    placed = rows.join(plan, "__row").drop("__row")
    placed.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
