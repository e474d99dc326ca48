"""Helpers that the training-data operators share: staged tables and text buffers.

Operators take a DataFrame and the names of its columns, read only those
columns (so further columns of any name are harmless) and return new columns.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Text bytes that one NumPy step works on; its temporaries are about ten times that.
STEP_BYTES = 2 << 20

#: ``[\x20\x09-\x0D]`` as a table over bytes.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: The same set, for Spark's and DuckDB's regular expressions.
SPACES, WORD = "[ \\t-\\r]+", "[^ \\t-\\r]+"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share; when the application has ended, it can go as a whole. Where none is named, local mode takes a temporary folder and a cluster raises ValueError."""
    named, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/firegrid-{app}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="firegrid-")
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: At most so many keys count as hot, so a table of them may be broadcast.
MOST_HOT = 10_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row per ``key`` that knows how many rows its key has at most, of ``total`` in all.

    Keys with over a ``MOST_HOT``-th of all rows are hot. There can't be more than
    ``MOST_HOT``, so they are broadcast and their rows stay where they are; the
    others are shuffled by key.
    """
    names = [c for c in table.columns if c not in (key, count)]
    hot = table.where(F.col(count) > max(total // MOST_HOT, 1000)).select(key, F.struct(*names).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    # A hot row meets nothing below: its key there is a number that no other key has, dealt over all tasks.
    other = table.select(F.col(key).alias("_of"), F.struct(*names).alias("_usual"))
    marked = marked.withColumn("_deal", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))))
    found = marked.join(other.withColumn("_none", F.lit(0)), (F.col(key) == F.col("_of")) & (F.col("_deal") == F.col("_none")), "left")
    found = found.withColumn("_found", F.coalesce("_hot", "_usual")).where("_found is not null")
    return found.select(*rows.columns, *(F.col(f"_found.{n}").alias(n) for n in names))


def text_steps(column: pa.Array, limit: int = STEP_BYTES):
    """Yield ``(i, j, data, offsets)`` for rows ``i:j`` of a string column, about ``limit`` bytes at a time (one longer text makes its own step). Nulls count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive ``offsets``; empty segments give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mixer (splitmix64's, a published fixed form)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word ``[^\\x20\\x09-\\x0D]+`` and, for each text, the index of its first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begins = offsets[:-1][(offsets[:-1] < offsets[1:])]
    first[begins] = ~space[begins]
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that begins at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    index = np.arange(len(data), dtype=np.int64)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = index - np.maximum.accumulate(begin)
    place[: starts[0]] = 0
    rng = np.random.default_rng(20240117)
    of_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    of_byte[IS_SPACE] = 0
    powers = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mix64(np.add.reduceat(of_byte[data] * powers[place], starts))
