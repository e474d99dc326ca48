"""Reversible line de-duplication: sharded cuckoo filters before exact tables of references.

An index keeps, for every line key, which documents hold it. Its tables only
grow: inserting a batch of documents appends rows with sign 1, deleting
documents appends the same rows with sign -1, and reference counts are sums. A
cuckoo filter per shard of the keys' hashes says which keys of a batch were never
seen; only the others meet the tables. When a key's last reference goes, its
fingerprint leaves the filter, so inserting and deleting a batch gives back the
index as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, mix64, shared_dir, stage

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3

#: Slots of a bucket, the load at which a filter is rebuilt twice as large, keys that a shard is meant for.
SLOTS, FULL, PER_SHARD = 4, 0.9, 250_000


# --- lines ------------------------------------------------------------------


def line_key(line: bytes) -> bytes | None:
    """The MD5 of a line's key, or None if the key is too short to count."""
    key = line.strip(BLANKS).lower()  # of bytes: A-Z only
    if len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS):
        return None
    return hashlib.md5(key).digest()


def _keys(batches):
    names = ["key", "_id", "digest"]
    for batch in batches:
        texts, out, held = batch.column("_text").cast(pa.large_binary()), [[], [], []], 0
        ids = batch.column("_id")
        for at, text in enumerate(texts):
            data = (text.as_py() if text.is_valid else None) or b""
            keys = {line_key(x) for x in data.split(b"\n")} - {None}
            out[0] += keys
            out[1] += [at] * len(keys)
            out[2] += [hashlib.md5(data).digest()] * len(keys)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), ids.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.binary())], names)
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), ids.take(pa.array(out[1], pa.int64())), pa.array(out[2], pa.binary())], names)


def line_keys(docs: DataFrame) -> DataFrame:
    """``key, _id, digest``: the distinct keys of each row of ``_id, _text``, with the MD5 of its text."""
    return docs.mapInArrow(_keys, f"key binary, _id {docs.schema['_id'].dataType.simpleString()}, digest binary")


def _strip(batches):
    names = ["_id", "n_lines", "n_dropped", "kept"]
    for batch in batches:
        texts, out = batch.column("_text").cast(pa.large_binary()), [[], [], []]
        for text, drops in zip(texts, batch.column("drops"), strict=True):
            lines = ((text.as_py() if text.is_valid else None) or b"").split(b"\n")
            gone = set(drops.as_py() or ())
            stay = [x for x in lines if line_key(x) not in gone] if gone else lines
            for column, value in zip(out, (len(lines), len(lines) - len(stay), b"\n".join(stay)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string())], names)


# --- cuckoo filters ---------------------------------------------------------


class Cuckoo:
    """A filter over distinct 16-byte keys: a 16-bit fingerprint of each lies in one of two buckets of four slots. It never misses a key that it holds."""

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 64
        while buckets * SLOTS * FULL * 0.9 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _other(self, at: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return at ^ (mix64(print_) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys, given as rows of two 64-bit numbers."""
        print_ = np.maximum(keys[:, 0] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        at = (keys[:, 1] & np.uint64(len(self.slots) - 1)).astype(np.int64)
        return print_, at, self._other(at, print_)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        return ((self.slots[one] == print_[:, None]) | (self.slots[two] == print_[:, None])).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Put in keys that it doesn't hold; False if they find no room, and the filter must be built anew."""
        if (self.slots != 0).sum() + len(keys) > self.slots.size * FULL:
            return False
        print_, at, _ = self._places(keys)
        rng = np.random.default_rng(7)
        for _ in range(rounds):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            print_, at = print_[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            taken = self.slots[at] != 0
            room = SLOTS - taken.sum(1)
            fits = rank < room
            self.slots[at[fits], np.argsort(taken[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]] = print_[fits]
            first = rank == room  # of a bucket's leftover, one pushes out what is there; the others try their other bucket
            slot = rng.integers(0, SLOTS, int(first.sum()))
            pushed = self.slots[at[first], slot]
            self.slots[at[first], slot] = print_[first]
            rest = ~fits & ~first
            print_, at = np.concatenate((pushed, print_[rest])), np.concatenate((at[first], at[rest]))
            at = self._other(at, print_)
        return not len(at)

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that it holds, one fingerprint for each."""
        print_, one, two = self._places(keys)
        low, high = np.minimum(one, two), np.maximum(one, two)
        while len(low):
            _, now = np.unique(np.stack((low, print_.astype(np.int64)), 1), axis=0, return_index=True)
            here = (self.slots[low[now]] == print_[now, None]).any(1)
            at = np.where(here, low[now], high[now])
            hit = self.slots[at] == print_[now, None]
            self.slots[at[hit.any(1)], hit.argmax(1)[hit.any(1)]] = 0
            left = np.ones(len(low), bool)
            left[now] = False
            low, high, print_ = low[left], high[left], print_[left]


def _numbers(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)


_PROBED = "shard int, key binary, seen boolean, data binary, full boolean"


def _probe(old: pa.Table, new: pa.Table) -> pa.Table:
    """Which keys of a shard its filter may hold, then the filter with the others put in, or the word that it is full."""
    shard = (new if len(new) else old).column("shard")[0].as_py()
    keys = new.column("key").combine_chunks()
    numbers = _numbers(keys)
    cuckoo = Cuckoo.load(old.column("data")[0].as_py()) if len(old) else Cuckoo.sized(len(keys))
    seen = cuckoo.contains(numbers)
    full = not cuckoo.insert(numbers[~seen])
    n = len(keys)
    return pa.table(
        {
            "shard": pa.array([shard] * (n + 1), pa.int32()), "key": pa.array([*keys.to_pylist(), None], pa.binary()), "seen": pa.array([*seen.tolist(), None], pa.bool_()),
            "data": pa.array([None] * n + [None if full else cuckoo.dump()], pa.binary()), "full": pa.array([None] * n + [full], pa.bool_()),
        }
    )


def _build(table: pa.Table) -> pa.Table:
    """A shard's filter of all its keys."""
    keys, size = _numbers(table.column("key").combine_chunks()), len(table)
    while not (cuckoo := Cuckoo.sized(size)).insert(keys):
        size *= 2
    return pa.table({"shard": table.column("shard").slice(0, 1), "data": pa.array([cuckoo.dump()], pa.binary())})


def _forget(old: pa.Table, gone: pa.Table) -> pa.Table:
    """A shard's filter without some keys."""
    cuckoo = Cuckoo.load(old.column("data")[0].as_py())
    if len(gone):
        cuckoo.remove(_numbers(gone.column("key").combine_chunks()))
    return pa.table({"shard": old.column("shard"), "data": pa.array([cuckoo.dump()], pa.binary())})


# --- the index --------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """Postings ``key, _id, sign``, references ``key, n`` and filters ``shard, data``, as folders of Parquet files.

    Every operation writes new folders and returns a new index; the old one stays
    valid, so a failed or repeated operation changes nothing.
    """

    spark: SparkSession
    path: str
    shards: int
    kind: str = "bigint"
    postings_at: tuple[str, ...] = field(default=())
    refs_at: tuple[str, ...] = field(default=())
    filters_at: str | None = None

    def _read(self, paths: tuple[str, ...], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _with(self, postings: DataFrame, filters: DataFrame) -> LineIndex:
        """The index with more postings and new filters."""
        at = self._write(postings, "postings")
        refs = self._write(self._read((at,), self._postings).groupBy("key").agg(F.sum("sign").alias("n")), "refs")
        return LineIndex(self.spark, self.path, self.shards, self.kind, (*self.postings_at, at), (*self.refs_at, refs), self._write(filters, "filters"))

    @property
    def _postings(self) -> str:
        return f"key binary, _id {self.kind}, sign int"

    def postings(self) -> DataFrame:
        """``key, _id``: the live references."""
        return self._read(self.postings_at, self._postings).groupBy("key", "_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def refs(self) -> DataFrame:
        """``key, n``: the number of documents that hold each key."""
        return self._read(self.refs_at, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")

    def filters(self) -> DataFrame:
        return self._read((self.filters_at,) if self.filters_at else (), "shard int, data binary")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key")

    def _probed(self, keys: DataFrame) -> DataFrame:
        by = self.filters().groupBy("shard").cogroup(self._sharded(keys).groupBy("shard"))
        return stage(by.applyInArrow(_probe, _PROBED), "probed")

    def insert(self, keys: DataFrame) -> LineIndex:
        """The index with documents' keys (``key, _id``; further columns aside); references that it has already are not counted again."""
        new = stage(keys.select("key", "_id").distinct(), "new")
        counted = stage(new.groupBy("key").agg(F.count("*").alias("m")), "counted")
        probed = self._probed(counted.select("key"))
        # References to keys that the filters may hold; hot keys are told to their rows, and these meet the tables by key and document.
        seen = counted.join(probed.where("seen").select("key"), "key").withColumn("_in", F.lit(True))
        asked = stage(join_counted(new, seen, "key", "m", new.count()).select(F.col("key").alias("_k"), F.col("_id").alias("_i")), "asked")
        same = (F.col("key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i"))
        held = self._read(self.postings_at, self._postings).join(asked, same, "left_semi")
        known = held.groupBy("key", "_id").agg(F.sum("sign").alias("s")).where("s > 0").select(F.col("key").alias("_k"), F.col("_id").alias("_i"))
        fresh = new.join(known, same, "left_anti")
        fresh = stage(fresh.withColumn("sign", F.lit(1)), "fresh")
        kept = probed.where("full = false").select("shard", "data")
        over = probed.where("full").select("shard")
        if not over.isEmpty():  # these shards are built anew from the tables
            all_ = self._sharded(self.refs().select("key").unionByName(fresh.select("key")).distinct()).join(over, "shard", "left_semi")
            kept = kept.unionByName(all_.groupBy("shard").applyInArrow(_build, "shard int, data binary"))
        return self._with(fresh, kept)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``_id``; ids that it doesn't have change nothing."""
        some = ids.select(F.col("_id").alias("_i")).distinct()
        gone = self.postings().join(some, F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
        gone = stage(gone.withColumn("sign", F.lit(-1)), "gone")
        lost = gone.groupBy("key").agg(F.count("*").alias("lost")).join(self.refs(), "key").where("n = lost").select("key")
        by = self.filters().groupBy("shard").cogroup(self._sharded(lost).groupBy("shard"))
        return self._with(gone, by.applyInArrow(_forget, "shard int, data binary"))

    def may_hold(self, keys: DataFrame) -> DataFrame:
        """``key, seen``: what the filters say of distinct keys; never false for a key that the index holds."""
        return self._probed(keys.select("key").distinct()).where("key is not null").select("key", "seen")

    def crowded(self, least: int = LEAST_DOCS) -> DataFrame:
        """``key, n, holder``: keys that ``least`` documents hold, with the largest id of these."""
        many = stage(self.refs().where(F.col("n") >= least), "crowded")
        rows = self._read(self.postings_at, self._postings)
        # Hot keys are told where their postings lie, then these are dealt by key and document.
        live = join_counted(rows, many.withColumn("_in", F.lit(True)), "key", "n", rows.count()).groupBy("key", "_id").agg(F.sum("sign").alias("s")).where("s > 0")
        return many.join(live.groupBy("key").agg(F.max("_id").alias("holder")), "key")

    def clean(self, docs: DataFrame, keys: DataFrame | None = None, least: int = LEAST_DOCS) -> DataFrame:
        """``_id, n_lines, n_dropped, kept``: each row of ``_id, _text`` without the lines whose keys are crowded and held by a larger id. ``keys``: their staged :func:`line_keys`, if there are any."""
        keys = stage(line_keys(docs), "line-keys") if keys is None else keys
        crowded = stage(self.crowded(least).select("key", "n", "holder"), "holders")
        hit = join_counted(keys, crowded, "key", "n", keys.count()).where(~F.col("_id").eqNullSafe(F.col("holder")))
        drops = hit.groupBy(F.col("_id").alias("_i"), "digest").agg(F.collect_set("key").alias("drops"))  # no more than a text has lines
        own = docs.select("_id", "_text", F.unhex(F.md5(F.coalesce("_text", F.lit("")))).alias("_d"))
        met = own.join(drops, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_d") == F.col("digest")), "left")
        return met.select("_id", "_text", "drops").mapInArrow(_strip, f"_id {docs.schema['_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, least: int = LEAST_DOCS) -> DataFrame:
    """One row per input row: ``<id_col>, n_lines, n_dropped, kept``.

    Texts are split at line feeds; null and empty texts are one empty line. A
    line's key is the line without blanks at its ends, A-Z lower-cased, known by
    its MD5. Keys of 20 code points in ``least`` different documents lose all their
    lines but those of the largest id. Rows that repeat an id are one document; a
    null id is one document too, smaller than all others. The rows enter the index
    in ``batches`` by their ids' hash. An empty table gives an empty result.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    keys = stage(line_keys(docs), "line-keys")
    index = LineIndex(spark, shared_dir(spark), max(1, -(-keys.count() // PER_SHARD)), docs.schema["_id"].dataType.simpleString())
    for k in range(batches):
        index = index.insert(keys.where(F.pmod(F.xxhash64("_id"), F.lit(batches)) == k))
    return index.clean(docs, keys, least).withColumnRenamed("_id", id_col)
