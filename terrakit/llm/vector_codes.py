"""Vector codes by exact integer product quantisation, with pivot distances as bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook.
Pivots are chosen once per position, from the first codebook, and every part's distance to
them is computed once and kept. In each round the difference of a part's and an entry's
distance to one pivot bounds their own distance from below. Entries are looked at in the
order of those bounds, and a part is done when the next bound is beyond what it has; only
entries that are looked at cost an exact integer evaluation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from terrakit.session import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
SCALE = 256

#: Rows that one vectorised step looks at.
STEP_ROWS = 2048

#: Kept distances are rounded to 32 bits; bounds give way by more than that.
SLACK = np.float32(2.0**-21)

Codebooks = np.ndarray  # parts x entries x width of a part, int64


def _limit(width: int) -> int:
    """The largest component whose squared distances still add up in 64 bits."""
    return min(2**31 - 1, int(np.sqrt(2.0**60 / max(1, width))))


def _prepared(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Kept rows with their components as whole numbers, and the width of a vector."""
    rows = vectors.select(
        F.col("vec_id").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v")
    ).filter(
        "v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    longest = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    width = max(1, -(-longest // parts)) * parts
    limit = float(_limit(width))
    whole = F.transform(
        "v", lambda x: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), x * SCALE))).cast("int")
    )
    padded = F.slice(F.concat(whole, F.array_repeat(F.lit(0), width)), 1, width)
    return rows.select("vec_id", "label", padded.alias("whole")), width


def first_codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """Each position's part of the vectors with the smallest ids; at most ``entries`` rows."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    table = np.array([r["whole"] for r in first], np.int64).reshape(len(first), parts, width // parts)
    return np.ascontiguousarray(table.swapaxes(0, 1))


def chosen_pivots(codebooks: Codebooks, pivots: int = PIVOTS) -> Codebooks:
    """Entries far from one another: the first, then always the one farthest from those."""
    chosen = []
    for book in codebooks:
        at = [0]
        least = ((book - book[0]) ** 2).sum(1)
        while len(at) < min(pivots, len(book)):
            at.append(int(least.argmax()))
            least = np.minimum(least, ((book - book[at[-1]]) ** 2).sum(1))
        chosen.append(book[at])
    return np.stack(chosen)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every point to every pivot, in 32 bits."""
    return np.sqrt(((points[:, None, :] - pivots[None]) ** 2).sum(2).astype(np.float64)).astype(np.float32)


def nearest_entries(
    points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, entry_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each point's nearest entry, ties to the lower index,
    and how many exact evaluations that took.

    A bound is the largest difference over the pivots, less the rounding of both sides.
    """
    n = len(points)
    bounds = np.zeros((n, len(book)), np.float32)
    for p in range(entry_pivots.shape[1]):
        own, theirs = to_pivots[:, p, None], entry_pivots[None, :, p]
        np.maximum(bounds, np.abs(own - theirs) - SLACK * (own + theirs), out=bounds)
    index = np.zeros(n, np.int64)
    best = np.full(n, np.iinfo(np.int64).max)
    reach = np.full(n, np.inf)
    alive = np.arange(n)
    evaluated = 0
    for _ in range(len(book)):
        entry = bounds[alive].argmin(1)
        bound = bounds[alive, entry].astype(np.float64)
        near = bound * bound <= reach[alive]
        alive, entry = alive[near], entry[near]
        if not len(alive):
            break
        bounds[alive, entry] = np.inf
        exact = ((points[alive] - book[entry]) ** 2).sum(1)
        evaluated += len(alive)
        better = (exact < best[alive]) | ((exact == best[alive]) & (entry < index[alive]))
        hit = alive[better]
        index[hit], best[hit] = entry[better], exact[better]
        reach[hit] = exact[better]
    return index, best, evaluated


def _fixed(column: pa.Array, kind: str) -> np.ndarray:
    """The values of all rows' arrays, one after another."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind, copy=False)


def _with_pivots(pivots: Codebooks):
    parts, count, width = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _fixed(batch.column("whole"), "i8").reshape(-1, parts, width)
            near = np.stack([distances(whole[:, j], pivots[j]) for j in range(parts)], 1).reshape(batch.num_rows, -1)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, near.size + 1, parts * count, dtype=np.int32)), pa.array(near.ravel())
            )
            names = [*batch.schema.names, "to_pivots"]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names)

    return run


def _assigned(codebooks: Codebooks, pivots: Codebooks):
    """A function from a batch to its (rows x parts) indexes and squared distances."""
    parts, _, width = codebooks.shape
    entry_pivots = [distances(codebooks[j], pivots[j]) for j in range(parts)]

    def of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        whole = _fixed(batch.column("whole"), "i8").reshape(-1, parts, width)
        near = _fixed(batch.column("to_pivots"), "f4").reshape(len(whole), parts, pivots.shape[1])
        for at in range(0, len(whole), STEP_ROWS):
            some, kept = whole[at : at + STEP_ROWS], near[at : at + STEP_ROWS]
            found = [nearest_entries(some[:, j], kept[:, j], codebooks[j], entry_pivots[j])[:2] for j in range(parts)]
            yield at, some, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    return of


def _sums(codebooks: Codebooks, pivots: Codebooks):
    """Per task the component sums and the counts of every entry in use."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _assigned(codebooks, pivots)
        total = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, some, index, _ in of(batch):
                for j in range(parts):
                    count[j] += np.bincount(index[:, j], minlength=entries)
                    for k in range(width):  # fewer than 2^53 in size: exact
                        total[j, :, k] += np.bincount(index[:, j], some[:, j, k], entries).astype(np.int64)
        used = np.flatnonzero(count.ravel())
        slot = np.repeat(used, width)
        place = np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(place), pa.array(total.reshape(-1, width)[used].ravel()),
             pa.array(np.repeat(count.ravel()[used], width))],
            ["slot", "place", "total", "count"],
        )

    return run


def _next_codebooks(rows: DataFrame, codebooks: Codebooks, pivots: Codebooks) -> Codebooks:
    """One round: entries become the floored mean of their parts, unused ones stay."""
    sums = rows.select("whole", "to_pivots").mapInArrow(
        _sums(codebooks, pivots), "slot long, place long, total long, count long"
    )
    wide = "decimal(38,0)"
    new = codebooks.reshape(-1, codebooks.shape[2]).copy()
    grouped = sums.groupBy("slot", "place").agg(
        F.sum(F.col("total").cast(wide)).alias("total"), F.sum("count").alias("count")
    )
    for r in grouped.collect():  # at most one row a component of the codebooks
        new[r["slot"], r["place"]] = int(r["total"]) // r["count"]
    return new.reshape(codebooks.shape)


def _codes(codebooks: Codebooks, pivots: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _assigned(codebooks, pivots)
        for batch in batches:
            for at, some, index, far in of(batch):
                own = batch.slice(at, len(some))
                code = [row.tobytes().hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("label"), pa.array(code, pa.string()), pa.array(far.sum(1), pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def codebook_text(codebooks: Codebooks) -> str:
    """All components by part, entry and position, with commas between."""
    return ",".join(map(str, codebooks.ravel().tolist()))


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every kept vector, and the last codebooks.

    Null vectors and those with null or non-finite components are left out. Vectors
    shorter than the longest, or than the next multiple of ``parts``, are padded with
    zeros, to one component a part at least. A component whose squared distances would leave 64 bits counts as the largest
    that does not (beyond about half a million for usual widths). Repeated ids are rows of their own; where one stands at the
    end of the first codebook's ids the smaller vector comes first, and null ids come
    last. With fewer kept vectors than ``entries`` the codebooks have that many. Other
    columns do not matter. Empty table, or none kept: no rows and empty codebooks.

    The whole numbers and pivot distances are written once; every round reads that table
    and shuffles only sums, one row a task and component. What the driver holds is the
    codebooks, whatever the size of the table.
    """
    if entries > 256:
        raise ValueError("an entry's index has two hex digits")
    rows, width = _prepared(vectors, parts)
    books = first_codebooks(rows, width, parts, entries)
    if not books.shape[1]:
        return rows.selectExpr("vec_id", "label", "'' as code", "0L as error").limit(0), books
    fixed = chosen_pivots(books, pivots)
    wider = StructType([*rows.schema.fields, StructField("to_pivots", ArrayType(FloatType()))])
    table = written(rows.mapInArrow(_with_pivots(fixed), wider), "vector-parts")
    for _ in range(rounds):
        books = _next_codebooks(table, books, fixed)
    kinds = dict(rows.dtypes)
    coded = table.mapInArrow(
        _codes(books, fixed), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    )
    return coded, books


def with_label_errors(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Adds ``label_error``, the error summed over equal labels, nulls together, and the
    hash of the codebooks.

    Errors are summed before the shuffle. The join back is an equi-join whose large side
    the engine can split where one label holds many rows.
    """
    coded = written(coded, "vector-codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.drop("__label").withColumn("codebooks_sha256", F.lit(digest))
