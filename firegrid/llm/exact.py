"""Exact de-duplication by composable polynomial fingerprints.

A text is normalised, cut into chunks and each chunk hashed as a polynomial in
its bytes modulo two primes. Fingerprints of neighbouring chunks combine by
shifting the left one by the right one's length, so the chunks of a huge
document are hashed in parallel tasks. Of rows whose fingerprint and length
agree, the chunks are then dealt out by fingerprint and part of the group and
compared place by place as they stream through a task; that comparison, not the
fingerprint, decides. A huge text is held whole only as the string that Spark
reads: one pass in NumPy normalises it step by step, feeds its SHA-256 and deals
out its chunks, and everything after works on chunks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, STEP_BYTES, stage, text_steps

#: Two primes below 2**31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1588635695)

#: Bytes in a chunk; 2**16 products of 39 bits fit a signed 64-bit sum.
CHUNK = 1 << 16


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for k in range(n.bit_length()):
        done = 1 << k
        if done >= n:
            break
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(base, done, prime) % prime
    return out


_POWERS: list[np.ndarray] = []


def combine(left: int, right: int, right_length: int, which: int) -> int:
    """Fingerprint of two joined strings from those of its halves."""
    prime = PRIMES[which]
    return (left * pow(BASES[which], int(right_length), prime) + right) % prime


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both polynomials of each string in a buffer; the empty string has 0 and 0."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES, strict=True))
    lengths = np.diff(offsets)
    parts = np.maximum(1, -(-lengths // CHUNK))
    first = np.cumsum(parts) - parts
    starts = np.repeat(offsets[:-1], parts) + CHUNK * (np.arange(parts.sum()) - np.repeat(first, parts))
    ends = np.minimum(starts + CHUNK, np.repeat(offsets[1:], parts))
    full = ends > starts
    after = np.repeat(ends[full], (ends - starts)[full]) - 1 - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
    out = []
    for which in (0, 1):
        of_part = np.zeros(len(starts), np.int64)
        if len(data):
            of_part[full] = np.add.reduceat((data.astype(np.int64) + 1) * _POWERS[which][after], starts[full]) % PRIMES[which]
        of_text = of_part[first].copy()
        for i in np.flatnonzero(parts > 1):
            h = 0
            for k in range(first[i], first[i] + parts[i]):
                h = combine(h, int(of_part[k]), int(ends[k] - starts[k]), which)
            of_text[i] = h
        out.append(of_text)
    return out[0], out[1]


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each run of white space within a text by one space."""
    space = IS_SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[begins] = True
    data = np.where(space, np.uint8(32), data)[keep]
    kept = np.concatenate(([0], np.cumsum(keep)))
    return data, kept[offsets]


def _marks(batches):
    """Both fingerprints, the length and the SHA-256 of each normalised text."""
    for batch in batches:
        for i, j, data, offsets in text_steps(batch.column("_text")):
            data, offsets = normalise(data, offsets)
            one, two = fingerprints(data, offsets)
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(one), pa.array(two), pa.array(np.diff(offsets)), pa.array(digests, pa.string())], ["_id", "fp1", "fp2", "bytes", "sha"])


def _chunk_marks(batches):
    for batch in batches:
        marks: list[list] = [[] for _ in range(5)]
        for chunk in batch.column("chunk"):
            data = np.frombuffer(chunk.as_buffer(), np.uint8) if chunk.is_valid else np.zeros(0, np.uint8)
            one, two = fingerprints(data, np.array([0, len(data)]))
            for column, value in zip(marks, (one[0], two[0], *(pow(b, len(data), p) for b, p in zip(BASES, PRIMES, strict=True)), len(data)), strict=True):
                column.append(int(value))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "row", "place", "sha")), *(pa.array(m, pa.int64()) for m in marks)], ["_id", "row", "place", "sha", "h1", "h2", "s1", "s2", "n"])


def streamed_chunks(data: np.ndarray):
    """Yield the chunks of one text's normalised bytes, then the hex SHA-256 of them all: steps of the text are normalised as they come, and what does not fill a chunk waits for the next."""
    digest, held, ended, made = hashlib.sha256(), b"", False, 0
    for a in range(0, len(data), STEP_BYTES):
        piece = data[a : a + STEP_BYTES]
        space = IS_SPACE[piece]
        keep = np.ones(len(piece), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        keep[0] = not (ended and space[0])
        ended = bool(space[-1])
        body = np.where(space, np.uint8(32), piece)[keep].tobytes()
        digest.update(body)
        held += body
        full = len(held) // CHUNK * CHUNK
        for k in range(0, full, CHUNK):
            made += 1
            yield held[k : k + CHUNK]
        held = held[full:]
    if held or not made:
        yield held
    yield digest.hexdigest()


def _huge_chunks(batches):
    """A row per chunk of each text, then one with its SHA-256; some chunks at a time."""
    from pyspark import TaskContext

    task, row, names = TaskContext.get().partitionId() << 33, 0, ["_id", "row", "place", "chunk", "sha"]
    for batch in batches:
        for at, text in enumerate(batch.column("_text")):
            out: list[list] = [[], [], []]

            def rows(out=out, at=at, row=row, batch=batch):
                n = len(out[0])
                return pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array([at] * n, pa.int64())), pa.array([task + row] * n, pa.int64()), pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], names)

            for place, x in enumerate(streamed_chunks(np.frombuffer(text.as_buffer(), np.uint8))):
                last = isinstance(x, str)
                for column, value in zip(out, (-1 if last else place, None if last else x, x if last else None), strict=True):
                    column.append(value)
                if len(out[0]) == 64:
                    yield rows()
                    for column in out:
                        column.clear()
            yield rows()
            row += 1


def huge_parts(docs: DataFrame, huge_chars: int) -> DataFrame:
    """``_id, row, place, chunk, sha`` of the texts of over ``huge_chars`` characters, dealt over all tasks: a row per chunk of the normalised text, and one of place -1 with its SHA-256. (That is sequential: the task that reads a text streams it through the digest once, chunk after chunk.)"""
    huge = docs.where(F.length("_text") > huge_chars)
    parts = huge.mapInArrow(_huge_chunks, f"_id {docs.schema['_id'].dataType.simpleString()}, row long, place int, chunk binary, sha string")
    return parts.repartition("row", "place")


def usual_marks(docs: DataFrame, huge_chars: int) -> DataFrame:
    """``_id, fp1, fp2, bytes, sha`` of each row of ``_id, _text`` that is not huge, hashed where it is read."""
    kind = docs.schema["_id"].dataType.simpleString()
    return _usual(docs, huge_chars).mapInArrow(_marks, f"_id {kind}, fp1 long, fp2 long, bytes long, sha string")


def huge_marks(parts: DataFrame) -> DataFrame:
    """``row, _id, fp1, fp2, bytes, sha`` of huge texts, combined from their chunks, which are hashed in parallel."""
    kind = parts.schema["_id"].dataType.simpleString()
    marks = parts.mapInArrow(_chunk_marks, f"_id {kind}, row long, place int, sha string, h1 long, h2 long, s1 long, s2 long, n long")
    fold = "aggregate(array_sort(collect_list(struct(place, h{k}, s{k})) FILTER (WHERE place >= 0)), 0L, (a, x) -> (a * x.s{k} + x.h{k}) % {p}L)"
    whole = marks.groupBy("row", "_id").agg(F.expr(fold.format(k=1, p=PRIMES[0])).alias("fp1"), F.expr(fold.format(k=2, p=PRIMES[1])).alias("fp2"), F.sum("n").alias("bytes"), F.max("sha").alias("sha"))
    return whole.select("row", "_id", "fp1", "fp2", "bytes", "sha")


def fingerprint_rows(df: DataFrame, id_col: str, text_col: str, huge_chars: int = 8 << 20) -> DataFrame:
    """``_id, fp1, fp2, bytes, sha`` of each row's normalised text, huge ones by their parts."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return usual_marks(docs, huge_chars).unionByName(huge_marks(huge_parts(docs, huge_chars)).drop("row"))


def _usual(docs: DataFrame, huge_chars: int) -> DataFrame:
    """The rows whose text is not huge."""
    return docs.where(F.coalesce(F.length("_text"), F.lit(0)) <= huge_chars)


def _chunks(batches):
    """A row per chunk: the text's fingerprints and length, a number of the row within its task, the chunk's place and bytes. An empty text has one empty chunk."""
    from pyspark import TaskContext

    task, row = TaskContext.get().partitionId() << 33, 0
    names = ["fp1", "fp2", "bytes", "_id", "row", "place", "chunk"]
    for batch in batches:
        for i, j, data, offsets in text_steps(batch.column("_text")):
            data, offsets = normalise(data, offsets)
            one, two = fingerprints(data, offsets)
            lengths = np.diff(offsets)
            parts = np.maximum(1, -(-lengths // CHUNK))
            of = np.repeat(np.arange(j - i), parts)
            place = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = offsets[of] + CHUNK * place
            cuts = np.append(starts, offsets[-1])
            chunk = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(np.ascontiguousarray(cuts.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
            take = pa.array(of + i)
            yield pa.RecordBatch.from_arrays([pa.array(one[of]), pa.array(two[of]), pa.array(lengths[of]), batch.column("_id").take(take), pa.array(task + row + of), pa.array(place, pa.int32()), chunk], names)
            row += j - i


_RESULT = "fp1 long, fp2 long, bytes long, part long, cls long, _id {id}, sha string, again boolean, lead boolean"


def tell_apart(batches):
    """Tell texts apart chunk by chunk. Rows come sorted by key, part, place, id and row.

    At each place a row's class is split by the bytes of its chunk. Held are the
    chunks of the current place that differ, a running SHA-256 for each, and a
    class for each row of the group's part. When that ends, every row comes out
    with its class and its text's digest, whether it repeats an earlier row's id
    and text, and whether it is the first of its class.
    """
    names = ["fp1", "fp2", "bytes", "part", "cls", "_id", "sha", "again", "lead"]
    key, rows, place, seen, before, after = None, {}, None, {}, [], []
    done: dict[tuple[int, int], str] = {}
    out: list[list] = [[] for _ in names]

    def close():
        number, ids = {}, set()
        for at, cls, id_ in rows.values():
            lead = (at, cls) not in number
            k = number.setdefault((at, cls), len(number))
            for column, value in zip(out, (*key, k, id_, done[at, cls], (id_, k) in ids, lead), strict=True):
                column.append(value)
            ids.add((id_, k))

    def end_place():
        done.update({(place, k): h.hexdigest() for k, h in enumerate(after)})

    types = [pa.int64()] * 5 + [None, pa.string(), pa.bool_(), pa.bool_()]
    for batch in batches:
        types[5] = batch.column("_id").type
        columns = [batch.column(c).to_pylist() for c in ("fp1", "fp2", "bytes", "part", "_id", "row", "place")]
        chunks = batch.column("chunk")
        for k, (*now, id_, row, at) in enumerate(zip(*columns, strict=True)):
            if now != key or at != place:
                if key is not None:
                    end_place()
                if now != key:
                    if rows:
                        close()
                    key, rows, done, after = now, {}, {}, [hashlib.sha256()]
                place, seen, before, after = at, {}, after, []
            last = rows[row][1] if row in rows else 0
            chunk = chunks[k].as_py()
            cls = seen.get((last, chunk))
            if cls is None:
                cls = seen[last, chunk] = len(seen)
                digest = before[last].copy()
                digest.update(chunk)
                after.append(digest)
            rows[row] = (at, cls, id_)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
        out = [[] for _ in names]
    if rows:
        end_place()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 5000, huge_chars: int = 8 << 20, most_hot: int = 100_000) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after each run of ``[\\x20\\x09-\\x0D]`` is
    replaced by one space; a null text counts as empty, so all empty and null
    texts form one group. The smallest id of a group stays. A null id never
    beats another id; in a group of null ids one row stays. Of repeated rows
    (same id, same text) exactly one stays. An empty table gives an empty one.

    Groups of over ``rows_per_salt`` rows, and over a ``most_hot``-th of all rows,
    are dealt into parts before any text moves (there can't be more than
    ``most_hot`` of them, so their keys are broadcast); then one text of each
    class of each part is compared with the others'. Texts of over ``huge_chars``
    characters go in chunks through fingerprints and comparison.
    """
    key = ["fp1", "fp2", "bytes"]
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    result = _RESULT.format(id=kind)
    huge = stage(huge_parts(docs, huge_chars), "huge")
    whole = stage(huge_marks(huge), "huge-fingerprints")
    marks = stage(usual_marks(docs, huge_chars).unionByName(whole.drop("row")), "fingerprints")
    total = marks.count()
    groups = stage(marks.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1"), "groups")
    single = marks.join(groups, key, "left_anti").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    hot = stage(groups.where(F.col("rows") > max(rows_per_salt, total // most_hot)).select(*key, F.ceil(F.col("rows") / rows_per_salt).alias("parts")), "hot")

    def chunks(some: DataFrame) -> DataFrame:
        """Chunk rows of the usual texts of ``some``, and of all huge ones."""
        made = _usual(some, huge_chars).mapInArrow(_chunks, f"fp1 long, fp2 long, bytes long, _id {kind}, row long, place int, chunk binary")
        return made.unionByName(huge.where("place >= 0").drop("_id", "sha").join(whole.drop("sha"), "row").select(*key, "_id", (-F.col("row") - 1).alias("row"), "place", "chunk"))

    def compare(rows: DataFrame) -> DataFrame:
        return rows.repartition(*key, "part").sortWithinPartitions(*key, "part", "place", "_id", "row").mapInArrow(tell_apart, result)

    dealt = chunks(docs).join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.xxhash64("_id"), F.coalesce("parts", F.lit(1)))).drop("parts")  # at most most_hot rows
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    wanted = groups.join(hot, key, "left").select(*key, parts)
    compared = stage(compare(dealt.join(wanted, [*key, "part"], "left_semi")), "compared")
    if hot.isEmpty():
        classed = compared.withColumn("text", F.col("cls"))
    else:
        leads = compared.where("lead").join(F.broadcast(hot.select(key)), key, "left_semi").select(*key, "part", "cls", F.col("_id").alias("lead_id"), F.col("sha").alias("lead_sha"))
        ids = leads.select(*key, "lead_id").distinct()
        read = chunks(docs.join(ids.select("lead_id").distinct(), F.col("_id").eqNullSafe(F.col("lead_id")), "left_semi"))
        of = lambda t: [read[c] == t[c] for c in key]
        read = read.join(ids, [*of(ids), read["_id"].eqNullSafe(ids["lead_id"])], "left_semi").withColumn("part", F.lit(0).cast("long"))
        texts = compare(read).select(*(F.col(c).alias(f"_{c}") for c in key), F.col("_id").alias("_of"), F.col("sha").alias("_sha"), F.col("cls").alias("text")).distinct()
        named = leads.join(texts, [*(F.col(c) == F.col(f"_{c}") for c in key), F.col("lead_id").eqNullSafe(F.col("_of")), F.col("lead_sha") == F.col("_sha")]).select(*key, "part", "cls", "text")
        classed = stage(compared.join(named, [*key, "part", "cls"], "left").withColumn("text", F.coalesce("text", "cls")), "classed")
    kept = classed.groupBy(*key, "text").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")).join(F.broadcast(hot), key, "left").select(*key, "text", "keep_id", "group_size", parts)
    many = classed.join(kept, [*key, "part", "text"]).select("_id", "keep_id", "group_size", (F.col("_id").eqNullSafe(F.col("keep_id")) & ~F.col("again")).alias("kept"), "sha")
    return single.unionByName(many).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
