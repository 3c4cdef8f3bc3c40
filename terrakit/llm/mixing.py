"""Mixing sources to target weights by entropy balancing.

Each source gets a token target. Every document starts with rate 1 and may be taken up to
twice; the rates nearest to that start in (bounded) entropy that meet their source's
target are exponential tilts of a document's size:

    rate = 2 / (1 + exp(-lambda * size / scale))

with one dual variable ``lambda`` per source. Newton's method solves all duals at once,
as joins and sums over the table of distinct (source, size) cells with their counts, in
which documents of equal size are one row. Rates become whole copies by cumulative
rounding along the sizes; what a source is then off by is moved by its shortest documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.llm.common import id_or_least, words_of
from terrakit.operators.ordered import ranked
from terrakit.session import written

WEIGHTS = (5, 2, 1)
MOST = 2
STEPS = 2
ROUNDS = 30

#: Single copies that are moved at the end, in each source.
MOVES = 4


def word_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``size``, the number of words; null text has none."""
    return docs.select("doc_id", "source", F.size(words_of(F.coalesce("text", F.lit("")))).cast("long").alias("size"))


def source_targets(sizes: DataFrame, share: float = 1.5) -> DataFrame:
    """``source``, ``source_size``, ``target`` for each source, the null source included.

    Weights 5, 2, 1 repeat along the sources in code point order, null last. A target
    stops at twice its source's size; what is over is shared anew by weight among the
    others until none is above. Only one number of each round reaches the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    lead = F.coalesce(F.hex(F.substring("source", 1, 2)), F.lit("~"))
    placed = ranked(sums, [], lead, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int"))
    table = written(placed.select("source", "source_size", weight.alias("weight")), "mix-sources")
    limit = F.col("source_size") * float(MOST)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    full, rate = F.lit(False), 0.0
    fixed = None
    while True:
        row = table.agg(
            F.sum(F.when(full, limit)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == fixed or not row["open"]:
            break
        fixed = row["n"]
        rate = (share * total - (row["full"] or 0.0)) / row["open"]
        full = full | (F.col("weight") * rate >= limit)
    return table.select(
        "source", "source_size", F.when(full, limit).otherwise(F.col("weight") * rate).alias("target")
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _with(cells: DataFrame, side: DataFrame) -> DataFrame:
    """Each cell with its source's row; a null source meets the null source."""
    side = side.withColumnRenamed("source", "__source")
    return cells.join(side, _same(F.col("source"), F.col("__source"))).drop("__source")


def solve_tilts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``scale``, ``tilt``: the dual of each source.

    A bracket that the sign of the gradient narrows guards each Newton step, so a step
    that would leave it becomes a bisection. Sums are decimals, exact in any order, so
    reruns agree to the last digit. A source whose target is its limit takes every
    document twice and needs no tilt; nor does one without words.
    """
    scales = cells.groupBy("source").agg(
        (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale")
    )
    state = _with(targets, scales).withColumns({
        "scale": F.greatest("scale", F.lit(1e-9)),
        "tilt": F.lit(0.0), "low": F.lit(-60.0), "high": F.lit(60.0), "off": F.lit(1.0),
    })
    state = written(state, "mix-duals")
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            state = _newton_step(cells, state)
        state = written(state, "mix-duals")
        if not (state.agg(F.max("off")).first()[0] or 0.0) > 1e-7:
            break
    else:
        raise ValueError(f"the tilts of some source do not meet its target after {ROUNDS * STEPS} steps")
    return state.select("source", "source_size", "target", "scale", F.round("tilt", 9).alias("tilt"))


def _rate() -> Column:
    power = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -F.col("tilt") * F.col("size") / F.col("scale")))
    return F.when(
        F.col("target") >= F.col("source_size") * float(MOST), F.lit(float(MOST))
    ).otherwise(MOST / (1.0 + F.exp(power)))


def _newton_step(cells: DataFrame, state: DataFrame) -> DataFrame:
    rated = _with(cells, state.select("source", "source_size", "target", "scale", "tilt")).withColumn("rate", _rate())
    mass = F.col("n") * F.col("size")
    slope = mass * F.col("size") / F.col("scale") * F.col("rate") * (1.0 - F.col("rate") / MOST)
    sums = rated.groupBy("source").agg(
        F.sum((mass * F.col("rate")).cast("decimal(38,6)")).cast("double").alias("__taken"),
        F.sum(slope.cast("decimal(38,6)")).cast("double").alias("__slope"),
    )
    joined = _with(state, sums)
    gap = F.col("__taken") - F.col("target")
    low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
    moved = joined.withColumns({
        "low": low, "high": high, "off": F.abs(gap) / F.greatest("target", F.lit(1.0)),
        "__next": F.col("tilt") - gap / F.greatest("__slope", F.lit(1e-12)),
    })
    inside = (F.col("__next") > F.col("low")) & (F.col("__next") < F.col("high"))
    # A target at the limit has no finite dual: those sources count as met.
    capped = F.col("target") >= F.col("source_size") * float(MOST)
    return moved.withColumns({
        "tilt": F.when(capped | (F.col("off") == 0), F.col("tilt")).when(inside, F.col("__next")).otherwise(
            (F.col("low") + F.col("high")) / 2
        ),
        "off": F.when(capped | (F.col("high") - F.col("low") < 1e-12), 0.0).otherwise(F.col("off")),
    }).select(*state.columns)


def cell_copies(cells: DataFrame, duals: DataFrame) -> DataFrame:
    """``source``, ``size``, ``n``, ``copies`` of each cell, and its source's columns.

    Copies follow the rounded running sum of rates along the sizes. What the source is
    then off by goes to (or comes from) its shortest documents while it fits. Windows run
    over distinct sizes of a source, a number that the longest document bounds.
    """
    rated = _with(cells, duals).withColumn("rate", _rate())
    by_size = Window.partitionBy("source").orderBy("size")
    upto = by_size.rowsBetween(Window.unboundedPreceding, 0)
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    run = F.sum((F.col("n") * F.col("rate")).cast("decimal(38,9)"))
    half = F.lit(0.5).cast("decimal(38,9)")
    rounded = rated.withColumn(
        "copies",
        (F.floor(run.over(upto) + half) - F.floor(F.coalesce(run.over(before), F.lit(0).cast("decimal(38,9)")) + half)).cast("long"),
    )
    rounded = rounded.withColumn("copies", F.least("copies", F.col("n") * MOST))
    rounded = rounded.withColumn(
        "__short", F.round(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)).cast("long")
    )
    room = F.when(F.col("__short") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
    rounded = rounded.withColumn("__room", F.when(F.col("size") > 0, room).otherwise(0).cast("long"))
    used = F.coalesce(F.sum(F.col("__room") * F.col("size")).over(before), F.lit(0))
    fits = F.round((F.abs("__short") - used) / F.greatest("size", F.lit(1))).cast("long")
    moved = F.least("__room", F.greatest(F.lit(0), fits)) * F.signum("__short").cast("long")
    rounded = rounded.withColumn("copies", F.col("copies") + moved).drop("__short", "__room")
    for _ in range(MOVES):
        rounded = _best_move(rounded, whole)
    return rounded


def _best_move(cells: DataFrame, whole) -> DataFrame:
    """One copy more or less in each source, the one that brings it nearest to its target."""
    short = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole)
    cells = cells.withColumn("__short", short)
    more = (F.col("__short") > 0) & (F.col("copies") < F.col("n") * MOST)
    fewer = (F.col("__short") < 0) & (F.col("copies") > 0)
    off = F.abs(F.abs("__short") - F.col("size"))
    cells = cells.withColumn("__off", F.when((more | fewer) & (off < F.abs("__short")), F.struct(off.alias("off"), "size")))
    best = F.col("__off") == F.min("__off").over(whole)
    step = F.when(F.coalesce(best, F.lit(False)), F.signum("__short").cast("long")).otherwise(F.lit(0).cast("long"))
    return cells.withColumn("copies", F.col("copies") + step).drop("__short", "__off")


def mixed(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """Copies of each document: ``doc_id, source, size, source_size, target, copies, taken``.

    All sizes times ``share`` are spread over the sources, see :func:`source_targets`.

    - Null or empty text has size 0 and takes part with 0 words.
    - The null source is a source of its own, the last.
    - A source without words has target 0. Empty table: empty result.
    - Repeated rows each get their own copies; ties in size are settled by a hash of the
      id, the id and the row's place among equal rows, so reruns agree.
    """
    sizes = written(word_sizes(docs), "mix-sizes")
    cells = written(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    plan = written(cell_copies(cells, solve_tilts(cells, source_targets(sizes, share))), "mix-plan")
    keyed = sizes.withColumn("__key", F.xxhash64(id_or_least(F.col("doc_id"))))
    # Only cells whose copies differ among their documents need places.
    uneven = plan.filter(F.col("copies") % F.col("n") != 0)
    cell = (_same(F.col("source"), F.col("__s")) & (F.col("size") == F.col("__z")))
    names = uneven.select(F.col("source").alias("__s"), F.col("size").alias("__z"))
    split = keyed.join(names, cell, "left_semi")
    placed = ranked(
        split, ["source", "size"], F.shiftright("__key", 52), [F.col("__key"), F.col("doc_id")], "__place",
        F.shiftright("__key", 36),
    )
    rest = keyed.join(names, cell, "left_anti").withColumn("__place", F.lit(0).cast("long"))
    every = placed.unionByName(rest)
    side = plan.select(
        F.col("source").alias("__s"), F.col("size").alias("__z"), "n", "source_size", "target", F.col("copies").alias("cell")
    )
    joined = every.join(side, cell)
    least = F.floor(F.col("cell") / F.col("n"))
    extra = (F.col("__place") > 0) & (F.col("__place") <= F.col("cell") - least * F.col("n"))
    joined = joined.withColumn("copies", (least + extra.cast("int")).cast("long"))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame, share: float = 1.5) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, with the columns of ``docs``.

    Rows meet their copies by id, source and size. Rows that agree in all three get the
    mean number of copies of their like, dealt out by their order in text.
    """
    plan = written(mixed(docs, share), "mix-copies").groupBy("doc_id", "source", "size").agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("copies").alias("__copies")
    ).select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), "__rows", "__copies"
    )
    rows = docs.withColumn("__size", F.size(words_of(F.coalesce("text", F.lit("")))).cast("long"))
    same = _same(F.col("doc_id"), F.col("__d")) & _same(F.col("source"), F.col("__s")) & (F.col("__size") == F.col("__z"))
    joined = rows.join(plan, same)
    like = joined.filter(F.col("__rows") > 1)
    place = ranked(
        like, ["__d", "__s", "__z"], F.shiftright(F.xxhash64("text"), 52), [F.xxhash64("text")], "__at",
        F.shiftright(F.xxhash64("text"), 36),
    )
    alone = joined.filter(F.col("__rows") == 1).withColumn("__at", F.lit(1).cast("long"))
    every = alone.unionByName(place)
    least = F.floor(F.col("__copies") / F.col("__rows"))
    times = least + (F.col("__at") <= F.col("__copies") - least * F.col("__rows")).cast("int")
    every = every.withColumn("__times", times.cast("int")).filter(F.col("__times") > 0)
    return every.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
