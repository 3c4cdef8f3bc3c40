"""Helpers that several text operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.session import shared_path

# The white space that separates words, and the letters that are folded.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
STEP_BYTES = 1 << 20

NO_ID = -(1 << 63)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only. Pure ASCII text takes the built-in's fast path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def id_or_least(column: Column) -> Column:
    """A null id counts as one document that is smaller than any other."""
    return F.coalesce(column, F.lit(NO_ID))


def held(column: Column) -> Column:
    """The value as a generated column. A lambda that uses it then reads the value, where
    a plain projection could be folded into the lambda and run once per element."""
    return F.explode(F.array(column))


def words_of(text: Column) -> Column:
    """The runs of other characters than white space, in order."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def sieve(wanted: DataFrame, wanted_column: Column, column: Column, bits: int = 1 << 18) -> Column:
    """A test that every wanted value of ``column`` passes and most others do not.

    One bit per hash of a wanted value, in a table of a fixed number of bits. An exact join
    follows it; rows that the sieve stops need not be shuffled for that join. With far more
    wanted values than bits it lets everything pass, which costs time only.
    """
    bit = F.pmod(F.xxhash64(wanted_column), F.lit(bits))
    words = dict(
        wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).collect()
    )
    table = F.from_json(F.lit(str([words.get(i, 0) for i in range(bits >> 6)])), "array<bigint>")
    own = F.pmod(F.xxhash64(column), F.lit(bits))
    word = F.element_at(table, (F.shiftright(own, 6) + 1).cast("int"))
    return F.call_function("getbit", word, (own.bitwiseAND(63)).cast("int")) == 1


def passing(df: DataFrame, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a table below the shared folder, and what deletes that table.

    To be deleted once all that was made of it is written: no later step can need it then,
    not even one that is run again after a loss.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(df.schema).parquet(path), lambda: files.delete(place, True)


def _worker_values() -> dict[str, object]:
    return sys.modules.setdefault("_text_worker_store", types.ModuleType("_text_worker_store")).__dict__


def worker_store(name: str, make: Callable[[], object]) -> object:
    """A value that tasks of one Python worker share, until a step that has no use for it
    runs there."""
    store = _worker_values()
    if name not in store:
        store[name] = make()
    return store[name]


def free_worker_store() -> None:
    """Drops what earlier steps keep in this Python worker."""
    _worker_values().clear()


def steps(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes each, never splitting a row."""
    start = 0
    while start < len(sizes):
        stop, total = start, 0
        while stop < len(sizes) and (stop == start or total + sizes[stop] <= most):
            total += int(sizes[stop])
            stop += 1
        yield start, stop
        start = stop


def raw_texts(column: pa.Array) -> Iterable[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""
