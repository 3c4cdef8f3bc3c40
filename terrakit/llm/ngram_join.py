"""N-gram Jaccard join with adaptive multi-match prefixes.

Equal shingle sets are one class, and one row of each class takes part. All classes put
their shingles in one global order; two sets whose Jaccard similarity reaches the
threshold share one of their first ``p = n - needed + 1`` shingles, and ``m`` of the first
``p + m - 1``. Each class chooses its ``m`` (how far to lengthen its prefix) by what its
candidates would cost; a pair must share as many prefix shingles as the smaller of its
two choices before it is verified on whole texts.

The global order comes in two tiers, so that little but prefixes is shuffled:

1. Shingles in more than ``CROWD`` classes' regions (the lowest hashes of a set, a little
   more than its prefix) come last, the others go by hash.
2. Classes with too few uncrowded shingles in their region (large groups of near copies,
   texts made of common passages) are joined among themselves in the exact order of
   document frequency, where a text's own shingles come first and bound what a pair can
   share.

In a large group all copies are verified against the one with the fewest shingles of its
own. Only pairs that are not in one component by then are enumerated, outsiders of a
posting against all of it, so a group of g copies costs about g pairs and no link between
different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import free_worker_store, held, id_or_least, passing, raw_texts, sieve, steps, stripped
from terrakit.llm.components import components
from terrakit.session import dealt, written

WORDS = 3
PERCENT = 90
CROWD = 64
LONGEST = 4

#: Cost of verifying a pair, in units of meeting one posting.
VERIFY_COST = 8.0

_random = np.random.default_rng(20240229)
BYTE_KEYS = _random.integers(0, 1 << 63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a buffer that ends with white space."""
    blank = IS_BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = LOWER[data[~blank]]
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(offsets, lengths)
    keys = BYTE_KEYS[place & 63, letters]
    if lengths.max() > 64:
        far = place >= 64
        keys[far] = _mixed(keys[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return starts, _mixed(np.add.reduceat(keys, offsets) + lengths.astype(np.uint64))


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, from the words' hashes."""
    n = len(hashes) - width + 1
    if not width or n < 1:
        return np.zeros(0, np.uint64)
    joint = np.full(n, width, np.uint64)
    for k in range(width):
        joint = _mixed(joint * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return joint


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``words`` words.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    for low, high in steps(np.array([len(t) for t in texts], np.int64)):
        part = texts[low:high]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        starts, hashes = _word_hashes(data)
        bounds = np.cumsum([len(t) + 1 for t in part])
        cuts = np.searchsorted(starts, bounds)
        # Of all texts of the step at once: what begins in one text and ends in another is not taken.
        joint = _shingles(hashes, words)
        first = 0
        for stop in cuts.tolist():
            whole = stop - first >= words
            yield np.unique(joint[first : stop - words + 1] if whole else _shingles(hashes[first:stop], stop - first))
            first = stop


def _prefix_size(n: np.ndarray | int, percent: int):
    """Elements of which a similar set must share one: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def _class_key(shingles: np.ndarray, salt: int) -> int:
    return int(_mixed(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))


def _described(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_store()
        for batch in batches:
            sizes, one, two, regions = [], [], [], []
            for s in shingle_sets(list(raw_texts(batch.column(1))), words):
                n = len(s)
                p = _prefix_size(n, percent) if n else 0
                sizes.append(n)
                one.append(_class_key(s, 0x5851F42D4C957F2D))
                two.append(_class_key(s, 0x14057B7EF767814F))
                regions.append(s[: p + p // 4 + LONGEST].view(np.int64))
            lengths = np.cumsum([0, *map(len, regions)]).astype(np.int32)
            flat = np.concatenate(regions) if regions else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                ],
                ["doc_id", "hash", "n", "cls", "cls2", "region"],
            )

    return run


def text_hash() -> Column:
    """Tells the texts of one id apart; null is the empty text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _all_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_store()
        for batch in batches:
            expected = batch.column(0).to_pylist()
            for key, s in zip(expected, shingle_sets(list(raw_texts(batch.column(1))), words)):
                if _class_key(s, 0x5851F42D4C957F2D) == key:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(s), key, np.int64)), pa.array(s.view(np.int64)),
                            pa.array(np.arange(1, len(s) + 1)),
                        ],
                        ["cls", "token", "pos"],
                    )

    return run


def _verified(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_store()
        for batch in batches:
            kept: tuple[list, list, list, list] = ([], [], [], [])
            sizes = [batch.column(c).cast(pa.large_binary()).nbytes for c in (2, 3)]
            some = max(1, batch.num_rows * (8 << 20) // max(1, sum(sizes)))
            for start in range(0, batch.num_rows, some):
                part = batch.slice(start, some)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                texts = {(k, t) for c, keys in ((2, a), (3, b)) for k, t in zip(keys, raw_texts(part.column(c)))}
                ordered = sorted(texts)
                # Another text of a repeated id is not the class that was asked for.
                sets = {
                    key: s for (key, _), s in zip(ordered, shingle_sets([t for _, t in ordered], words))
                    if _class_key(s, 0x5851F42D4C957F2D) == key
                }
                for x, y in zip(a, b):
                    if x in sets and y in sets:
                        p, q = sets[x], sets[y]
                        shared = len(np.intersect1d(p, q, assume_unique=True))
                        linked = 100 * shared >= percent * (len(p) + len(q) - shared)
                        for column, value in zip(kept, (x, y, shared, linked)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(kept, kinds)], ["a", "b", "shared", "linked"])

    return run


class _Join:
    """The steps of one join; tables that more than one step reads are written."""

    def __init__(self, docs: DataFrame, words: int, percent: int, crowd: int):
        self.words, self.percent, self.crowd = words, percent, crowd
        self.docs = docs.select("doc_id", "text", text_hash().alias("hash"))
        described = self.docs.mapInArrow(
            _described(words, percent), "doc_id long, hash long, n long, cls long, cls2 long, region array<long>"
        )
        # Regions are most of what is written; they go as soon as the next step has them.
        described, drop_described = passing(described, "join-described")
        self.rows = written(described.drop("region"), "join-rows")
        classes = described.filter("n > 0").withColumn("id", id_or_least(F.col("doc_id")))
        classes = classes.groupBy("cls", "cls2").agg(
            F.min(F.struct("id", "hash")).alias("least"), F.first("n").alias("n"), F.first("region").alias("region")
        )
        classes = classes.select("cls", "cls2", F.col("least.id").alias("node"), "least.hash", "n", "region")
        p = F.expr(f"n - cast(ceil(n * {percent} / 100) as long) + 1")
        self.regions, self.drop_regions = passing(classes.withColumn("p", p), "join-regions")
        drop_described()
        self.classes = written(
            self.regions.select("cls", "cls2", "node", "hash", "n", "p", F.size("region").alias("r")), "join-classes"
        )

    def could_reach(self, shared: Column, n: Column, m: Column) -> Column:
        """False where sets of n and m elements sharing at most ``shared`` are too far apart."""
        return F.lit(100) * shared >= F.lit(self.percent) * (n + m - shared)

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``cls, text`` for wanted classes, by their smallest document. An id can be null or
        repeated with unlike texts, so a text is found by its id and its hash."""
        own = written(wanted.join(self.classes.select("cls", "node", "hash"), "cls").distinct(), "join-wanted")
        rows = self.docs.withColumn("node", id_or_least(F.col("doc_id"))).drop("doc_id")
        rows = rows.filter(sieve(own, F.col("node"), F.col("node")))
        return rows.join(own, ["node", "hash"]).select("cls", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes with what they share and whether that links them, from whole texts."""
        pairs = written(pairs.distinct(), "join-pairs")
        wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        found = self.texts(wanted).withColumn("h", F.xxhash64("text")).dropDuplicates(["cls", "h"]).drop("h")
        joined = pairs.select("a", "b").join(
            found.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a"
        ).join(found.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        joined = joined.select("a", "b", "text_a", "text_b")
        found = joined.mapInArrow(_verified(self.words, self.percent), "a long, b long, shared long, linked boolean")
        return written(found.distinct(), "join-links")

    def matches(self, postings: str, most: Column) -> Column:
        """How many matches a class asks for, from its array of (token, f, rank).

        ``f`` is the length of the token's list and ``most`` how many matches the class
        has ranks for. Meeting the lists costs their lengths; at most hits / m pairs can
        share m tokens and so need verifying.
        """
        priced = []
        for m in range(1, LONGEST + 1):
            reached = F.filter(postings, lambda x, m=m: x["rank"] < F.col("p") + m)
            hits = F.aggregate(reached, F.lit(0).cast("long"), lambda total, x: total + x["f"] - 1)
            cost = F.when(F.lit(m) > most, F.lit(float("inf"))).otherwise(hits * (1 + VERIFY_COST / m))
            priced.append(F.struct(cost.alias("cost"), F.lit(m).alias("m")))
        return F.array_min(F.array(*priced))["m"]

    def met(self, left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
        """Pairs that share enough prefix tokens; ``extra`` speaks of the sides l and r."""
        l, r = left.alias("l"), right.alias("r")
        m = F.least("l.m", "r.m")
        near = (F.col("l.rank") < F.col("l.p") + m) & (F.col("r.rank") < F.col("r.p") + m)
        size = F.least("l.n", "r.n")
        close = self.could_reach(size, F.col("l.n"), F.col("r.n"))
        pairs = l.join(r, (F.col("l.token") == F.col("r.token")) & near & close & extra)
        pairs = pairs.groupBy(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")).agg(
            F.countDistinct("l.token").alias("shared"), F.min(m).alias("asked")
        )
        return pairs.filter(F.col("shared") >= F.col("asked")).select("a", "b")

    def first_tier(self) -> tuple[DataFrame, DataFrame]:
        """Links over uncrowded tokens, and the classes that have too few of those.

        A region is a prefix for ``r - p + 1`` matches in plain hash order. A class with p
        uncrowded tokens in its region has at most ``r - p`` crowded ones there, so any set
        similar to it shares an uncrowded token of its region with it, rich or poor.
        """
        region = self.regions.select("cls", F.posexplode("region").alias("pos", "token"))
        counts = region.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
        lists = region.join(counts, "token").groupBy("cls").agg(F.collect_list(F.struct("pos", "token", "f")).alias("list"))
        lists = lists.join(self.classes.select("cls", "n", "p", "r"), "cls")
        crowded = F.filter("list", lambda x: x["f"] > self.crowd)
        lists = lists.withColumn("skipped", held(F.transform(crowded, lambda x: x["pos"])))
        uncrowded = F.transform(
            F.filter("list", lambda x: x["f"] <= self.crowd),
            lambda x: F.struct(
                x["token"].alias("token"), x["f"].alias("f"),
                (x["pos"] + 1 - F.size(F.filter("skipped", lambda s: s < x["pos"]))).cast("long").alias("rank"),
            ),
        )
        left = F.col("r") - F.size("skipped") - F.col("p")
        lists = lists.withColumn("open", held(uncrowded)).select(
            "cls", "n", "p", (left < 0).alias("poor"), self.matches("open", left + 1).alias("m"), "open"
        )
        lists = written(lists, "join-lists")
        self.drop_regions()
        poor = lists.filter("poor").select("cls")
        every = lists.select("cls", "n", "p", "m", "poor", F.inline("open"))
        rich = every.filter(~F.col("poor") & (F.col("rank") < F.col("p") + F.col("m")))
        pairs = self.met(rich, rich, F.col("l.cls") < F.col("r.cls"))
        # Rows of a poor class count as rank 0, which any number of matches allows.
        every = every.withColumns({"m": F.lit(1), "rank": F.lit(0).cast("long")})
        across = self.met(every.filter("poor"), every.filter("not poor"), F.lit(True))
        return self.verified(pairs.unionByName(across)).filter("linked").select("a", "b"), poor

    def second_tier(self, poor: DataFrame, links: DataFrame) -> DataFrame:
        """Links among the classes that share crowded tokens, added to ``links``."""
        if poor.isEmpty():
            return links
        tokens = written(dealt(self.texts(poor)).mapInArrow(
            _all_shingles(self.words), "cls long, token long, pos long"
        ).select("cls", "token").distinct(), "join-tokens")
        counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
        listed = tokens.join(counts, "token").groupBy("cls").agg(
            F.sort_array(F.collect_list(F.struct("f", "token"))).alias("shared")
        ).join(self.classes.select("cls", "n", "p"), "cls")
        own = F.col("n") - F.size("shared")
        # A class whose own tokens fill its prefix, and any that no partner could reach, is out.
        listed = listed.withColumn("own", own).filter(self.could_reach(F.col("n") - F.col("own"), F.col("n"), F.col("n") - F.col("own")))
        reach = F.greatest(F.lit(0), F.col("p") + LONGEST - 1 - F.col("own")).cast("int")
        ranked = F.transform(
            F.slice("shared", 1, reach),
            lambda x, at: F.struct(x["token"].alias("token"), x["f"].alias("f"), (F.col("own") + at + 1).alias("rank")),
        )
        listed = listed.select("cls", "n", "p", "own", held(ranked).alias("open"))
        listed = listed.withColumn("m", self.matches("open", F.col("n") - F.col("p") + 1))
        postings = listed.select("cls", "n", "p", "own", "m", F.inline("open"))
        postings = written(postings.filter(F.col("rank") < F.col("p") + F.col("m")), "join-prefixes")

        # Every class against the most central one that it shares most lists with.
        centre = postings.groupBy("token").agg(F.min(F.struct("own", "cls")).alias("c"))
        stars = postings.join(centre, "token").filter(F.col("cls") != F.col("c.cls"))
        stars = stars.groupBy("cls", F.col("c.cls").alias("centre")).agg(F.count(F.lit(1)).alias("k"))
        stars = stars.groupBy("cls").agg(F.max(F.struct("k", "centre")).alias("best"))
        stars = stars.select(F.col("cls").alias("a"), F.col("best.centre").alias("b"))
        arms = self.verified(stars)
        links = links.unionByName(arms.filter("linked").select("a", "b"))

        roots = components(links)
        placed = postings.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(
            arms.select(F.col("a").alias("cls"), F.col("b").alias("centre"), "shared"), "cls", "left"
        )
        # Of a class: what it has of its centre, and what else it has that is not its own.
        placed = placed.withColumns({
            "centre": F.coalesce("centre", "cls"), "kept": F.coalesce("shared", F.col("n") - F.col("own")),
        }).withColumn("more", F.col("n") - F.col("own") - F.col("kept")).drop("shared")
        placed = written(placed.withColumn("root", F.coalesce("root", "cls")), "join-placed")
        by_root = placed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
        lists = by_root.groupBy("token").agg(
            F.max(F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.min("least").alias("least")
        ).filter("roots > 1").select("token", F.col("main.root").alias("main"), "least")
        open_rows = placed.join(lists, "token").filter(
            self.could_reach(F.col("n") - F.col("own"), F.col("n"), F.col("least"))
        )
        others = open_rows.filter(F.col("root") != F.col("main"))
        both_other = F.col("r.root") != F.col("r.main")
        shared = F.least(F.col("l.n") - F.col("l.own"), F.col("r.n") - F.col("r.own"))
        extra = (F.col("l.root") != F.col("r.root")) & (~both_other | (F.col("l.cls") < F.col("r.cls")))
        # Two classes with one centre share at most what both have of it, and their other
        # tokens. Where the first alone is too little, they share one of those others.
        same = F.col("l.centre") == F.col("r.centre")
        of_centre = F.least("l.kept", "r.kept")
        shared = F.when(same, F.least(shared, of_centre)).otherwise(shared)
        pairs = self.met(others, open_rows, extra & self.could_reach(shared, F.col("l.n"), F.col("r.n")))
        around = of_centre + F.least("l.more", "r.more")
        beside = self.beside(tokens, placed, ~self.could_reach(of_centre, F.col("l.n"), F.col("r.n"))
                             & self.could_reach(around, F.col("l.n"), F.col("r.n")))
        found = self.verified(pairs.unionByName(beside)).filter("linked")
        return links.unionByName(found.select("a", "b"))

    def beside(self, tokens: DataFrame, placed: DataFrame, close: Column) -> DataFrame:
        """Pairs of one centre and different roots that share a token that is not the centre's."""
        names = ["cls", "n", "root", "centre", "kept", "more"]
        some = placed.filter("more > 0").select(*names).distinct()
        theirs = tokens.select(F.col("cls").alias("centre"), "token")
        rows = some.join(tokens, "cls").join(theirs, ["centre", "token"], "left_anti")
        by_root = rows.groupBy("centre", "token", "root").agg(F.count(F.lit(1)).alias("k"))
        lists = by_root.groupBy("centre", "token").agg(
            F.max(F.struct("k", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")
        ).filter("roots > 1").drop("roots")
        rows = written(rows.join(lists, ["centre", "token"]), "join-beside")
        l, r = rows.filter("root <> main").alias("l"), rows.alias("r")
        both_other = F.col("r.root") != F.col("r.main")
        extra = (F.col("l.root") != F.col("r.root")) & (~both_other | (F.col("l.cls") < F.col("r.cls")))
        match = (F.col("l.centre") == F.col("r.centre")) & (F.col("l.token") == F.col("r.token"))
        pairs = l.join(r, match & extra & close)
        return pairs.select(F.least("l.cls", "r.cls").alias("a"), F.greatest("l.cls", "r.cls").alias("b")).distinct()

    def rooted(self) -> DataFrame:
        """The classes with the ``root`` of their component."""
        links, poor = self.first_tier()
        roots = components(self.second_tier(poor, links)).withColumnRenamed("node", "cls")
        return self.classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def jaccard_components(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, crowd: int = CROWD
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two texts are linked when 100 * shared >= percent * union over their shingle sets;
    ``component_id`` is the smallest ``doc_id`` that links reach, itself included.

    - Null, empty and blank texts have no shingles and are linked with nothing.
    - Texts with fewer than ``words`` words have one shingle, the whole sequence.
    - Repeated rows have equal sets and so share a component.
    - A null ``doc_id`` is smaller than any other; a component with one has a null id.
    - Other columns do not take part. Empty table: empty result.

    Shingles are compared by 64-bit hashes and equal sets by 128 bits of them.
    """
    join = _Join(docs, words, percent, crowd)
    least = join.rooted()
    smallest = least.groupBy("root").agg(F.min("node").alias("component_id"))
    known = least.select("cls", "cls2", "root").join(smallest, "root").select("cls", "cls2", "component_id")
    rows = join.rows.select("doc_id", F.col("n").alias("n_shingles"), "cls", "cls2")
    joined = rows.join(known, ["cls", "cls2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("component_id") != id_or_least(F.lit(None).cast("long")), F.col("component_id"))
    )
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: one of each group stays.

    Texts without shingles all stay. Unlike texts that share an id or have none are
    different components and each keeps a row.
    """
    first = F.min(F.struct("node", "cls", "cls2", "hash")).alias("first")
    stays = _Join(docs, words, percent, CROWD).rooted().groupBy("root").agg(first).select(
        F.col("first.node").alias("__node"), F.col("first.hash").alias("__hash")
    )
    keys = ["__node", "__hash"]
    full = docs.withColumns({"__node": id_or_least(F.col("doc_id")), "__hash": text_hash()})
    full = full.join(stays, keys).dropDuplicates(keys)
    blank = docs.filter(stripped(F.coalesce("text", F.lit(""))) == "")
    return full.select(*docs.columns).unionByName(blank)
