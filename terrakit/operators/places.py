"""Place search over folded name variants, and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.functions.attrs import cell_label, fold, names_of

MAX_MATCHES, NAMED = 50, 12
# Population bands, lowest first; anything else ranks -1.
POPULATION_BANDS = [
    "< 20", "20 bis 49", "50 bis 99", "100 bis 999", "1'000 bis 1'999", "2'000 bis 9'999",
    "10'000 bis 49'999", "50'000 bis 100'000", "> 100'000",
]
c = F.col


def population_rank(band: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(b) for b in POPULATION_BANDS]), band)
    return F.coalesce(found - 1, F.lit(-1)).cast("int")


def with_variants(places: DataFrame) -> DataFrame:
    """Store the folded variants beside each place (id, name, population_rank)."""
    return places.withColumn("folded", F.transform(names_of(c("name")), fold))


def search(places: DataFrame, wants: DataFrame, limit: int = MAX_MATCHES) -> DataFrame:
    """(want, id, matched, rank): the best places for each folded prefix ``want``.

    Variants are joined on their first character and length-bounded prefix, an equi-join
    on the prefix text itself: each variant offers all its prefixes up to the longest
    query. Ranked by population band, one more for an exact name, then exact, then short.
    """
    lengths = wants.filter("want <> ''").groupBy(F.length("want").alias("len")).agg(F.count(F.lit(1)).alias("k"))
    known = lengths.agg(F.sort_array(F.collect_list("len")).alias("lens"))
    variants = places.select("id", "population_rank", F.posexplode("folded").alias("pos", "f"))
    # The distinct query lengths are a scalar subquery.
    offered = variants.withColumn("lens", known.scalar()).select(
        "id", "population_rank", "pos", "f",
        F.explode(F.transform(F.filter("lens", lambda n: n <= F.length("f")), lambda n: F.substr("f", F.lit(1), n))).alias("want"))
    hits = offered.join(wants, "want").groupBy("want", "id", "population_rank").agg(F.min_by("f", "pos").alias("matched"))
    exact = c("matched") == c("want")
    score = c("population_rank") + exact.cast("int")
    order = Window.partitionBy("want").orderBy(score.desc(), exact.desc(), F.length("matched"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= limit).select("want", "id", "matched", "rank")


def missing_tile_warning(cells: DataFrame) -> DataFrame:
    """One row, one sentence: how many cells lack a tile, the first twelve by name.

    Only a count and the twelve lowest cells meet in the last step.
    """
    total = cells.agg(F.count(F.lit(1))).scalar()
    first = cells.orderBy("e_km", "n_km").limit(NAMED).agg(
        F.array_sort(F.collect_list(F.struct("e_km", "n_km"))).alias("first"))
    names = F.array_join(F.transform("first", lambda x: cell_label(x["e_km"], x["n_km"])), ", ")
    rest = c("total") - F.size("first")
    tail = F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise("")
    text = F.concat(c("total").cast("string"), F.lit(" km cells without elevation: "), names, tail)
    return first.withColumn("total", total).select(text.alias("warning"))
