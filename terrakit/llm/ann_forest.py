"""Nearest neighbours by a forest of hash strings.

Every tree gives a vector a long string of symbols; a symbol is the axis, with its sign,
that a random projection of the vector is nearest to. The first symbol tells many axes
apart, all others a few, so that one step of the ascent widens a range only some times. A
tree is the sorted array of its strings. A query goes into each tree with ``PROBES``
strings, which start with the axes that it is nearest to, in order; they descend to their
longest prefix matches, and all strings of all trees then ascend together, one symbol at a
time, until the prefix ranges hold enough rows; those are scored exactly. How many are
enough is measured on each table: some queries are answered by a scan of all rows, and the
least number of candidates with which the forest finds ``RECALL`` of their neighbours
holds for all queries, ``min_candidates`` at least. Where no number does, and for queries
whose ranges hold less than ``k`` rows, all rows are scanned, once.

Largest inner product becomes nearest angle by one more coordinate that brings all
vectors to the same norm. Equal vectors are one row of the index. Rows are dealt out to
parts, each with its share of all trees' arrays; a query meets each part once, with all its
strings, and takes the best of all its ranges there. In a dimension with more rows than
``ROOT_PARTS`` parts hold, that would copy queries too often: there a tree's array is cut
into blocks of rows that share leading symbols, as many as a query asks for up to what an
even spread of the dimension needs, and a block that is still large into parts; a block's
queries meet each of its parts, so no task holds a whole tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrakit.session import written

TREES = 16
PROBES = 5  # strings of a query in a tree
AXES = (128, *[4] * 12)  # of each symbol
SYMBOLS = len(AXES)
WIDTHS = [axes.bit_length() for axes in AXES]  # bits of a symbol: an axis and a sign
LEFT = [sum(WIDTHS[s:]) for s in range(SYMBOLS + 1)]  # bits behind the first s symbols
MIN_CANDIDATES = 0
BLOCK_ROWS = 65_536
RECALL = 0.94  # of the measured queries; the error of that measure is kept from 0.9
MEASURED = 256  # queries per dimension
ROOT_PARTS, ROOT_ROWS = 16, 1_024  # whole trees are cut finer: their parts have to fill all cores
SALTS = 16
SEED = 11
HASHED = ["rep", "dim", "asks", "v", "codes", "strings"]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole & F.exists("v", lambda x: x != 0)
    )


def _hasher(trees: int, greatest: dict[int, float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            sizes = frame["v"].map(len)
            for dim, part in frame.groupby(sizes):
                dim = int(dim)
                if dim not in greatest:
                    yield part.assign(codes=None, strings=None)[HASHED]
                    continue
                if dim not in planes:
                    planes[dim] = np.random.default_rng(SEED).standard_normal((dim + 1, trees * sum(AXES)))
                v = np.stack(part["v"].to_numpy())
                rest = np.sqrt(np.maximum(0.0, greatest[dim] - (v * v).sum(1)))
                for start in range(0, len(v), 256):
                    some = np.column_stack([v[start : start + 256], rest[start : start + 256]])
                    own = part.iloc[start : start + 256]
                    codes, strings = _strings((some @ planes[dim]).reshape(len(some), trees, -1))
                    strings = [x if asks else None for x, asks in zip(strings, own["asks"])]
                    yield own.assign(codes=list(codes), strings=strings)[HASHED]

    return run


def _strings(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree) strings of projections (row, tree, axis), and the (row, probe x tree)
    strings with which a row asks: the nearest first axes, then its own symbols."""
    rows, trees, _ = projected.shape
    code, at = np.zeros((rows, trees), np.int64), 0
    for axes, width in zip(AXES, WIDTHS):
        some = projected[:, :, at : at + axes]
        signed = np.stack([-some, some], 3).reshape(rows, trees, 2 * axes)
        if at == 0:
            first = np.argsort(-signed, 2, kind="stable")[:, :, :PROBES].astype(np.int64)
        symbol = first[:, :, 0] if at == 0 else signed.argmax(2)
        code, at = (code << width) | symbol, at + axes
    tail = code & ((1 << LEFT[1]) - 1)
    asking = (first << LEFT[1]) | tail[:, :, None]
    return code, asking.transpose(0, 2, 1).reshape(rows, PROBES * trees)


def _ends(codes: np.ndarray, asked: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The two ends of the ranges of a sorted array that agree with the asked strings but
    for the last ``left`` bits."""
    low = (asked >> left) << left
    return np.stack([np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << left))])


def _counts(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """How many rows of this part share at least each number of symbols with each query."""
    codes = np.sort(index["code"].to_numpy(np.int64))
    low, high = _ends(codes, asked["code"].to_numpy(np.int64)[:, None], np.array(LEFT)[None, :])
    out = pd.DataFrame({
        "rep": np.repeat(asked["rep"].to_numpy(), SYMBOLS + 1), "depth": np.tile(np.arange(SYMBOLS + 1, dtype=np.int32), len(asked)),
        "n": (high - low).ravel(),
    })
    # Rows that share less than the block does are in other blocks, too.
    out = out[out["depth"].to_numpy() >= np.repeat(asked["lead"].to_numpy(), SYMBOLS + 1)]
    return out.groupby(["rep", "depth"], as_index=False)["n"].sum()


def _root_counts(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """How many rows of this part share at least each number of symbols with each query,
    summed over the trees."""
    if not len(index) or not len(asked):
        return pd.DataFrame({"rep": [], "depth": [], "n": []})
    codes = np.sort(np.stack(index["codes"].to_numpy()), 0)
    strings = np.stack(asked["strings"].to_numpy()).reshape(len(asked), -1, codes.shape[1])
    n = np.zeros((len(asked), SYMBOLS + 1), np.int64)
    for tree in range(codes.shape[1]):
        low, high = _ends(codes[:, tree], strings[:, :, tree, None], np.array(LEFT)[None, None, :])
        n += (high - low).sum(1)
    depths = np.tile(np.arange(SYMBOLS + 1, dtype=np.int32), len(asked))
    return pd.DataFrame({"rep": np.repeat(asked["rep"].to_numpy(), SYMBOLS + 1), "depth": depths, "n": n.ravel()})


def _k_best(rough: np.ndarray, among: np.ndarray, names: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and exact scores of the k best rows, nearest first."""
    near = np.arange(len(rough))
    if len(rough) > k:
        # Rounding of the product must not decide what is exactly scored.
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        near = np.flatnonzero(rough >= least - 1e-9 * (1 + np.abs(rough).max()))
    score = (among[near] * wanted).sum(1)
    best = np.lexsort([names[near], -score])[:k]
    return names[near][best], score[best]


def _listed(out: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    reps = np.repeat([rep for rep, _, _ in out], [len(names) for _, names, _ in out]) if out else np.zeros(0, np.int64)
    names, scores = ([np.zeros(0, kind), *(row[at] for row in out)] for at, kind in ((1, np.int64), (2, float)))
    return pd.DataFrame({"rep": reps, "found": np.concatenate(names), "score": np.concatenate(scores)})


def _root_finder(k: int):
    def run(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The k best of this part's rows in all of each query's ranges."""
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(index) and len(asked):
            vectors, reps = np.stack(index["v"].to_numpy()), index["rep"].to_numpy()
            depth, asking, wanted = asked["depth"].to_numpy(), asked["rep"].to_numpy(), np.stack(asked["v"].to_numpy())
            whole, deep = np.flatnonzero(depth == 0), np.flatnonzero(depth > 0)
            some = max(1, (4 << 20) // len(reps))
            for start in range(0, len(whole), some):
                group = whole[start : start + some]
                for q, rough in zip(group, wanted[group] @ vectors.T):
                    out.append((asking[q], *_k_best(rough, vectors, reps, wanted[q], k)))
            if len(deep):
                codes = np.stack(index["codes"].to_numpy())
                orders = [np.argsort(codes[:, tree], kind="stable") for tree in range(codes.shape[1])]
                sorted_codes = [codes[order, tree] for tree, order in enumerate(orders)]
            for start in range(0, len(deep), 1024):
                group = deep[start : start + 1024]
                strings = np.stack(asked["strings"].to_numpy()[group]).reshape(len(group), -1, len(orders))
                left = np.array(LEFT)[depth[group]][:, None]
                ends = [_ends(own, strings[:, :, tree], left) for tree, own in enumerate(sorted_codes)]
                for at, q in enumerate(group):
                    met = np.zeros(len(reps), bool)
                    for order, (low, high) in zip(orders, ends):
                        for a, b in zip(low[at].tolist(), high[at].tolist()):
                            met[order[a:b]] = True
                    met = np.flatnonzero(met)
                    among = vectors[met]
                    out.append((asking[q], *_k_best(among @ wanted[q], among, reps[met], wanted[q], k)))
        return _listed(out)

    return run


def _finder(k: int):
    def run(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The k best of this part's rows in each query's range."""
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(index) and len(asked):
            order = np.argsort(index["code"].to_numpy(np.int64), kind="stable")
            codes, reps = index["code"].to_numpy(np.int64)[order], index["rep"].to_numpy()[order]
            vectors = np.stack(index["v"].to_numpy())[order]
            ends = _ends(codes, asked["code"].to_numpy(np.int64), np.array(LEFT)[asked["depth"].to_numpy()]).T
            ranges, own = np.unique(ends, axis=0, return_inverse=True)
            asking, wanted = asked["rep"].to_numpy(), np.stack(asked["v"].to_numpy())
            for at, (low, high) in enumerate(ranges):
                among, names = vectors[low:high], reps[low:high]
                mine = np.flatnonzero(own.ravel() == at)
                some = max(1, (4 << 20) // max(1, high - low))
                for start in range(0, len(mine), some):
                    group = mine[start : start + some]
                    for q, rough in zip(group, wanted[group] @ among.T):
                        out.append((asking[q], *_k_best(rough, among, names, wanted[q], k)))
        return _listed(out)

    return run


def _renewed(side: DataFrame) -> DataFrame:
    """New names for columns that the other side of a join has from the same table."""
    return side.select(*[F.col(c).alias(c) for c in side.columns])


def _leading(code: Column, symbols: Column) -> Column:
    return F.call_function("shiftright", code, F.element_at(F.array(*[F.lit(bits) for bits in LEFT]), symbols.cast("int") + 1))


class _Forest:
    """The index of one table; tables that more than one step reads are written."""

    def __init__(self, classes: DataFrame, k: int, trees: int, floor: int, block_rows: int):
        self.classes, self.k, self.trees, self.block_rows = classes, k, trees, block_rows
        # So many rows of all trees are k + 1 different ones in some tree.
        self.floor = max(floor, trees * (k + 1))
        norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
        facts = classes.groupBy("dim").agg(
            F.max(norm).alias("most"), F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")
        )
        large = F.col("n") > self.floor
        # Blocks share leading symbols: as many as an even spread of the dimension needs.
        most = [block_rows * max(ROOT_PARTS, 1 << (LEFT[0] - LEFT[s])) for s in range(SYMBOLS)]
        lead = sum((F.col("n") > rows).cast("int") for rows in most)
        parts = F.greatest(F.ceil(F.col("n") / block_rows), F.least(F.lit(ROOT_PARTS), F.ceil(F.col("n") / ROOT_ROWS)))
        facts = facts.withColumns({"large": large, "lead": F.when(large, lead).otherwise(0), "parts": parts.cast("int")})
        self.facts = written(facts, "ann-facts")
        known = self.facts.filter("large").select("dim", "most", "lead", "n").collect()
        self.lead = max([row["lead"] for row in known], default=0)
        self.most = max([row["n"] for row in known], default=0)
        greatest = {row["dim"]: row["most"] for row in known}
        self.rows = classes.select("rep", "dim", "asks", "v")
        if known:
            self.rows = written(self.rows.mapInPandas(
                _hasher(trees, greatest), "rep long, dim int, asks boolean, v array<double>, codes array<long>, strings array<long>"
            ), "ann-rows")
        else:
            none = F.lit(None).cast("array<long>")
            self.rows = self.rows.withColumns({"codes": none, "strings": none})
        self.known = bool(known)
        if self.lead:
            far = self.rows.join(self.facts.filter("lead > 0").select("dim", "lead"), "dim")
            self.places = written(far.select("rep", "dim", "lead", F.posexplode("codes").alias("tree", "code")), "ann-places")
            asking = far.filter("asks").select("rep", "dim", "lead", F.posexplode("strings").alias("at", "code"))
            self.strings = written(asking.select(
                "rep", "dim", "lead", (F.col("at") % trees).alias("tree"), F.floor(F.col("at") / trees).cast("int").alias("probe"), "code"
            ), "ann-strings")

    def dealt(self, index: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Rows and queries (dim, tree, level, block, rep, ...) with the parts they meet in."""
        key = ["dim", "tree", "level", "block"]
        rows = F.count(F.lit(1))
        sizes = index.groupBy(*key).agg(F.ceil(rows / self.block_rows).cast("int").alias("parts")).join(_renewed(asked.groupBy(*key).agg(F.ceil(rows / self.block_rows).cast("int").alias("askers"))), key)
        sizes = written(sizes, "ann-blocks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mixed = F.xxhash64("rep", "tree")
        salt = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(SALTS)).cast("int")
        index = index.withColumn("salt", salt).join(sizes, [*key, "salt"]).withColumns({
            "part": F.pmod(mixed, "parts").cast("int"),
            "asker": F.explode(F.sequence(F.lit(0), F.col("askers") - 1)),
        })
        asked = asked.withColumn("salt", salt).join(_renewed(sizes), [*key, "salt"]).withColumns({
            "asker": F.pmod(mixed, "askers").cast("int"),
            "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
        })
        return index, asked, [*key, "part", "asker"]

    def at_root(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Rows with all their strings, and queries (rep, depth) with all of theirs, with the
        parts they meet in; a row is in one part for each full part of the queries."""
        asked = asked.join(self.rows.select("rep", "dim", "v", "strings"), "rep")
        askers = F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int")
        sizes = asked.groupBy("dim").agg(askers.alias("askers")).join(self.facts.select("dim", "parts"), "dim")
        sizes = written(sizes, "ann-parts")
        mixed = F.xxhash64("rep", F.lit(5))
        index = self.rows.select("rep", "dim", "v", "codes").join(sizes, "dim").withColumns({
            "part": F.pmod(mixed, "parts").cast("int"),
            "asker": F.explode(F.sequence(F.lit(0), F.col("askers") - 1)),
        })
        asked = asked.join(_renewed(sizes), "dim").withColumns({
            "asker": F.pmod(mixed, "askers").cast("int"),
            "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
        })
        return index, asked, ["dim", "part", "asker"]

    def totals(self) -> DataFrame:
        """``rep, depth, n``: rows that share at least so many symbols with each query of a
        large dimension, summed over the trees."""
        near = self.rows.filter("asks").join(self.facts.filter("large and lead = 0").select("dim"), "dim", "left_semi")
        index, asked, full = self.at_root(near.select("rep", F.lit(0).alias("depth")))
        counts = index.select(*full, "codes").groupBy(*full).cogroup(
            _renewed(asked.select(*full, "rep", "strings")).groupBy(*full)
        ).applyInPandas(_root_counts, "rep long, depth int, n long")
        if self.lead:
            counts = counts.unionByName(self.block_totals())
        return written(counts.groupBy("rep", "depth").agg(F.sum("n").alias("n")), "ann-counts")

    def block_totals(self) -> DataFrame:
        """The same of each tree, where trees are cut into blocks."""
        def blocked(side: DataFrame, level: Column) -> DataFrame:
            return side.withColumns({"level": level, "block": _leading(F.col("code"), level)})

        lead = F.col("lead")
        index, asked, full = self.dealt(blocked(self.places, lead), blocked(self.strings, lead))
        counts = index.select(*full, "rep", "code").groupBy(*full).cogroup(
            _renewed(asked.select(*full, "rep", "code", "lead")).groupBy(*full)
        ).applyInPandas(_counts, "rep long, depth int, n long")
        for depth in range(1, self.lead):
            short, asking = (blocked(x.filter(lead > depth), F.lit(depth)) for x in (self.places, self.strings))
            sums = short.groupBy("dim", "tree", "block").agg(F.count(F.lit(1)).alias("n"))
            met = _renewed(asking.select("dim", "tree", "block", "rep")).join(sums, ["dim", "tree", "block"])
            counts = counts.unionByName(met.select("rep", F.lit(depth).alias("depth"), "n"))
        return counts

    def enough(self, totals: DataFrame) -> DataFrame:
        """``dim, enough``: the candidates with which the measured queries of each large
        dimension have ``RECALL``; null where only all rows are enough."""
        ladder = [self.floor]
        while ladder[-1] < self.trees * PROBES * self.most:
            ladder.append(2 * ladder[-1])
        every = F.greatest(F.lit(1), F.floor(F.col("asking") / MEASURED))
        some = self.classes.filter("asks").join(self.facts.filter("large"), "dim")
        some = some.filter(F.pmod(F.xxhash64("rep", F.lit(7)), every) == 0).select("rep", "dim")
        some = written(some, "ann-measured")
        exact = self.found(some.select("rep", F.lit(0).alias("depth"))).groupBy("rep", "found").agg(F.max("score").alias("score"))
        best = Window.partitionBy("rep").orderBy(F.desc("score"), "found")
        exact = exact.filter("rep <> found").withColumn("at", F.row_number().over(best)).filter(F.col("at") <= self.k)
        pairs = exact.select("rep", "found").join(self.rows.select("rep", "strings"), "rep").join(
            self.rows.select(F.col("rep").alias("found"), F.flatten(F.array_repeat("codes", PROBES)).alias("others")), "found"
        )

        def shared(a: Column, b: Column) -> Column:
            return sum((F.shiftright(a.bitwiseXOR(b), LEFT[s]) == 0).cast("int") for s in range(1, SYMBOLS + 1))

        pairs = pairs.select("rep", F.array_max(F.zip_with("strings", "others", shared)).alias("shared"))
        depths = some.join(totals, "rep", "left").groupBy("rep", "dim").agg(*[
            F.coalesce(F.max(F.when(F.col("n") >= m, F.col("depth"))), F.lit(0)).alias(f"d{at}") for at, m in enumerate(ladder)
        ])
        recall = pairs.join(depths, "rep").groupBy("dim").agg(*[
            F.avg((F.col("shared") >= F.col(f"d{at}")).cast("double")).alias(f"r{at}") for at in range(len(ladder))
        ])
        first = F.coalesce(*[F.when(F.col(f"r{at}") >= RECALL, F.lit(m)) for at, m in enumerate(ladder)])
        return written(recall.select("dim", first.cast("long").alias("enough")), "ann-enough")

    def depths(self) -> DataFrame:
        """``rep, depth`` of each query: its longest prefixes that hold enough rows."""
        asks = self.classes.filter("asks").select("rep", "dim")
        if not self.known:
            return asks.select("rep", F.lit(0).alias("depth"))
        self.counted = self.totals()
        asks = asks.join(self.enough(self.counted), "dim", "left").join(self.counted, "rep", "left")
        deep = F.max(F.when(F.col("n") >= F.col("enough"), F.col("depth")))
        return written(asks.groupBy("rep").agg(F.coalesce(deep, F.lit(0)).alias("depth")), "ann-depths")

    def found(self, depths: DataFrame) -> DataFrame:
        """``rep, found, score``: the best of each part that the queries' prefixes meet."""
        if self.lead:
            far = self.rows.join(self.facts.filter("lead > 0").select("dim"), "dim", "left_semi").select("rep", F.lit(True).alias("far"))
            depths = depths.join(far, "rep", "left").withColumn("far", F.coalesce("far", F.lit(False)) & (F.col("depth") > 0))
            met = depths.filter("not far").select("rep", "depth")
        index, asked, full = self.at_root(met if self.lead else depths)
        found = index.select(*full, "rep", "v", "codes").groupBy(*full).cogroup(
            _renewed(asked.select(*full, "rep", "v", "strings", "depth")).groupBy(*full)
        ).applyInPandas(_root_finder(self.k + 1), "rep long, found long, score double")
        return found.unionByName(self.found_in_blocks(depths.filter("far").select("rep", "depth"))) if self.lead else found

    def found_in_blocks(self, depths: DataFrame) -> DataFrame:
        """The same of queries whose prefixes are looked up in the blocks of each tree."""
        asked = self.strings.join(depths, "rep").withColumn("level", F.least("depth", "lead"))
        asked = asked.withColumn("block", _leading(F.col("code"), F.col("level")))
        index = self.places.withColumn("level", F.explode(F.sequence(F.lit(1), F.col("lead"))))
        index = index.withColumn("block", _leading(F.col("code"), F.col("level")))
        index, asked, full = self.dealt(index, asked)
        own = self.classes.select("rep", "v")
        return index.select(*full, "rep", "code").join(own, "rep").groupBy(*full).cogroup(
            _renewed(asked.select(*full, "rep", "code", "depth").join(own, "rep")).groupBy(*full)
        ).applyInPandas(_finder(self.k + 1), "rep long, found long, score double")

    def best(self) -> DataFrame:
        """``rep, found, score`` with a full list for each query."""
        depths = self.depths()
        pair = F.max("score").alias("score")
        found = written(self.found(depths).groupBy("rep", "found").agg(pair), "ann-found")
        if not self.known:
            return found
        counts = found.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
        short = depths.filter("depth > 0").join(counts, "rep", "left").filter(F.coalesce("n", F.lit(0)) <= self.k)
        short = written(short.select("rep", F.lit(0).alias("depth")), "ann-short")
        if short.isEmpty():
            return found
        return found.unionByName(self.found(short)).groupBy("rep", "found").agg(pair)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES,
    min_candidates: int = MIN_CANDIDATES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found for each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates are all
    other rows with as many components. Order: largest score, then smallest ``vec_id``.

    - Null, zero and empty vectors, such with null or non-finite components, and rows
      without ``vec_id`` take no part.
    - Equal vectors share one place in the index; the k + 1 smallest ids among them are
      all that can be in a list.
    - Rows that repeat a ``vec_id`` with the same vector are one row; with different
      vectors each counts, and the best one is listed.
    - Fewer than k candidates: all of them. Empty table: empty result.
    - A dimension of at most ``trees * (k + 1)``, or ``min_candidates``, different vectors
      is scanned whole: that many rows are the least that its ranges must hold.
    """
    keyed = usable(vectors).distinct().select(
        "*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim")
    )
    members = written(keyed.select("vec_id", "h1", "h2"), "ann-members")
    classes = keyed.groupBy("h1", "h2", "dim").agg(
        F.min("vec_id").alias("first"), F.min_by("v", "vec_id").alias("v"),
        F.max(F.col("vec_id") % every == 0).alias("asks"),
    ).withColumn("rep", F.xxhash64("h1", "h2"))
    classes = written(classes, "ann-classes")
    forest = _Forest(classes, k, trees, min_candidates, block_rows)
    best = forest.best().join(classes.select(F.col("rep").alias("found"), "first", "h1", "h2"), "found")
    ordered = Window.partitionBy("rep").orderBy(F.desc("score"), "first")
    best = best.withColumn("at", F.row_number().over(ordered)).filter(F.col("at") <= k + 1)
    small = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = members.withColumn("at", F.row_number().over(small)).filter(F.col("at") <= k + 1).drop("at")
    listed = best.select("rep", "h1", "h2", "score").join(few, ["h1", "h2"]).groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("at", F.row_number().over(by_score)).filter(F.col("at") <= k + 1).drop("at")
    asks = members.filter(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("h1", "h2").alias("rep")
    )
    lists = asks.join(listed, "rep").filter(F.col("vec_id") != F.col("query_id"))
    lists = lists.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
