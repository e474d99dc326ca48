"""Best-fit packing by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` counts, whatever the
size of the corpus) reaches the driver. Large lengths are grouped into classes
of equal cardinality and rounded up to each class's longest; a linear programme
over those few sizes finds how often to use each configuration; actual lengths
take the rounded ones' places; what rounding to whole uses leaves over and the
small pieces go best-fit into the remaining room. The plan says, for every length,
which run of its pieces goes to which run of sequences at which offset, so the
pieces themselves are placed in parallel by length and rank.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# --- tokens -----------------------------------------------------------------


#: Bytes of ASCII letters and of the two-byte letters from U+00C0 to U+017F (whose range also holds two signs, and a capital whose lower case is two characters).
_LETTERS = bytes([*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)])
_SIGNS = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")
_PLAIN = _LETTERS + b"0123456789 ,.\n"
#: The byte-level alphabet's characters for bytes that don't stand for themselves (a fixed rule of byte-level BPE).
_BYTE_CHARS = {b: 256 + 33 + k for k, b in enumerate([*range(0x7F, 0xA1), 0xAD])}


class WordIds:
    """Ids of a tokenizer that never joins across ASCII white space, word by word with a bounded cache.

    A word of letters goes straight to the tokenizer's BPE model, which is what
    its normaliser and splitter would hand on; all others take the whole path.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.limit, self.known, self.older = self.tokenizer.model, limit, {}, {}

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.limit:  # two generations: words in use move on to the younger
            self.known, self.older, new = {}, self.known, words
        odd, known, older, tokenize = [], self.known, self.older, self.model.tokenize
        for w in new:
            ids = older.get(w)
            if ids is not None:
                known[w] = ids
            elif w.translate(None, _LETTERS) or not w.isascii() and any(x in w for x in _SIGNS):
                odd.append(w)
            else:
                chars = w.decode("ascii").lower() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = [t.id for t in tokenize(chars)]
                known[w] = struct.pack(f"<{len(ids)}I", *ids)
        for k in range(0, len(odd), 2000):
            some = odd[k : k + 2000]
            enc = self.tokenizer.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(enc.ids, "<u4"), np.array([-1 if w is None else w for w in enc.word_ids], np.int64)
            cuts = (np.searchsorted(of, np.arange(len(some) + 1)) * 4).tolist()
            raw = ids.tobytes()
            known.update((w, raw[cuts[i] : cuts[i + 1]]) for i, w in enumerate(some))

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        # Lower-casing ASCII letters first cannot change ids unless a combining mark (lead bytes CC and CD) follows one or they make a special token.
        if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            text = text.lower()
        # In a text of letters, digits and single full stops and commas, these are tokens of their own.
        if not text.translate(None, _PLAIN) and not any(x in text for x in (b"..", b",.", b".,", b",,", *_SIGNS)):
            for mark in (b", ", b". ", b",\n", b".\n"):
                text = text.replace(mark, b" " + mark)
        return text.split()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_WORDS: dict[str, WordIds] = {}


def _steps(texts: list[bytes], limit: int = 4 << 20):
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def token_pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``_id, piece, start, length, ids_crc32``: a document's ids, then ``end_id``, cut every ``capacity`` ids. A null text counts as empty."""

    def run(batches):
        if tokenizer_path not in _WORDS:
            _WORDS[tokenizer_path] = WordIds(tokenizer_path)
        words, end, step = _WORDS[tokenizer_path], np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            at = 0
            texts = pc.fill_null(batch.column("_text"), "").cast(pa.binary()).to_pylist()
            for some in _steps(texts):
                out = [[], [], [], [], []]
                for k, ids in enumerate(words.encode(some), at):
                    ids += end
                    for piece, a in enumerate(range(0, len(ids), step)):
                        part = ids[a : a + step]
                        for column, value in zip(out, (k, piece, a // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                at += len(some)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["_id", "piece", "start", "length", "ids_crc32"])

    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# --- plan -------------------------------------------------------------------


@dataclass
class Plan:
    """Runs ``(length, first rank, pieces, first sequence, offset)``: the k-th piece of a run goes to the k-th sequence from the first."""

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def patterns(sizes: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """All ways to put up to ``most`` of ``sizes`` into a sequence: copies of each size, a row per way."""
    s = np.append(sizes, 0)  # the last stands for none
    chosen = np.arange(len(s))[:, None]
    for _ in range(most - 1):
        more = np.tile(np.arange(len(s)), len(chosen))[:, None]
        chosen = np.hstack((np.repeat(chosen, len(s), 0), more))
        chosen = chosen[(chosen[:, -1] >= chosen[:, -2]) & (s[chosen].sum(1) <= capacity)]
    out = np.zeros((len(chosen), len(s)), np.int64)
    for k in range(chosen.shape[1]):
        np.add.at(out, (np.arange(len(chosen)), chosen[:, k]), 1)
    return out[s[chosen].sum(1) > 0, :-1]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Fractional cutting-stock optimum over ``sizes`` by the revised simplex method: configurations and how often each is used."""
    every = patterns(sizes, capacity, most)
    chosen = np.diag(np.minimum(capacity // sizes, most))
    for _ in range(rounds):
        basis = chosen.T.astype(float)
        worth = every @ np.linalg.solve(basis.T, np.ones(len(sizes)))
        best = int(worth.argmax())
        if worth[best] <= 1 + 1e-9:
            break
        now, move = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, every[best].astype(float))
        chosen[int(np.where(move > 1e-9, np.maximum(now, 0) / np.where(move > 1e-9, move, 1), np.inf).argmin())] = every[best]
    return chosen, np.maximum(np.linalg.solve(chosen.T.astype(float), demand.astype(float)), 0)


def whole_times(chosen: np.ndarray, used: np.ndarray, demand: np.ndarray) -> np.ndarray:
    """Whole numbers of uses: rounded down, then one more by largest remainder where the demand still has all of a configuration."""
    times = np.floor(used + 1e-9).astype(np.int64)
    rest = demand - times @ chosen
    for j in np.argsort(times - used, kind="stable"):
        if used[j] - times[j] > 1e-9 and (chosen[j] <= rest).all():
            times[j] += 1
            rest = rest - chosen[j]
    return times


class _Room:
    """Runs of open sequences by the room left in them: ``(first sequence, how many)``."""

    def __init__(self, plan: Plan, capacity: int, taken: dict[int, int]):
        self.plan, self.capacity, self.taken, self.open = plan, capacity, taken, defaultdict(list)

    def place(self, length: int, sequence: int, n: int, room: int) -> None:
        self.plan.runs.append((length, self.taken[length], n, sequence, self.capacity - room))
        self.taken[length] += n

    def add(self, room: int, sequence: int, n: int) -> None:
        if n and room > 0:
            self.open[room].append((sequence, n))

    def best_fit(self, length: int, n: int) -> None:
        """Put ``n`` pieces where they leave the least room, several to a sequence where that fits, else into new sequences."""
        rooms = sorted(r for r, runs in self.open.items() if runs and r >= length)
        for room in [*rooms, 0]:
            while n and (room == 0 or self.open[room]):
                if room:
                    sequence, have = self.open[room].pop()
                    left = room
                else:
                    sequence, have, left = self.plan.sequences, -(-n // (self.capacity // length)), self.capacity
                    self.plan.sequences += have
                each = left // length
                full = min(have, n // each)
                for k in range(each):
                    if full:
                        self.place(length, sequence, full, left - k * length)
                n -= full * each
                self.add(left - each * length, sequence, full)
                sequence, have = sequence + full, have - full
                if have and n:
                    some = min(n, each)
                    for k in range(some):
                        self.place(length, sequence, 1, left - k * length)
                    n -= some
                    self.add(left - some * length, sequence, 1)
                    sequence, have = sequence + 1, have - 1
                self.add(left, sequence, have)
                if not room and not n:
                    break
            if not n:
                return


def plan_packing(counts: dict[int, int], capacity: int, groups: int = 128, most: int = 2) -> Plan:
    """Pack ``counts`` pieces of each length into sequences of ``capacity``.

    Lengths of which at most ``most`` fit into a sequence are large; they form
    ``groups`` of equal cardinality (fewer where a group would have under eight
    pieces). The others go best-fit, the longest first, into what the large ones
    leave.
    """
    plan, taken = Plan(), defaultdict(int)
    rooms = _Room(plan, capacity, taken)
    left = {length: n for length, n in counts.items() if n}
    large = np.array(sorted((x for x in left if capacity < x * (most + 1) and x < capacity), reverse=True), np.int64)
    if len(large):
        ends = np.cumsum([left[x] for x in large])
        starts, total = np.append(0, ends[:-1]), int(ends[-1])
        cuts = np.arange(0, total, -(-total // min(groups, max(1, total // 8))))
        sizes, first = np.unique(-large[np.searchsorted(ends, cuts, "right")], return_index=True)
        sizes, cuts = -sizes, np.append(cuts[first], total)  # groups of one length are one
        members = [[[int(x), int(min(e, b) - max(s, a))] for x, s, e in zip(large, starts, ends, strict=True) if min(e, b) > max(s, a)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        demand = np.diff(cuts)
        chosen, used = configurations(sizes, demand, capacity, most)
        for copies, times in zip(chosen, whole_times(chosen, used, demand).tolist(), strict=True):
            ranges = [(plan.sequences, times, capacity)] if times else []
            plan.sequences += times
            for group in (members[g] for g in np.repeat(np.arange(len(sizes)), copies)):
                after = []
                for sequence, have, room in ranges:
                    while have and group:  # actual lengths take the rounded one's places
                        length, there = group[0]
                        some = min(have, there)
                        rooms.place(length, sequence, some, room)
                        left[length] -= some
                        group[0][1] -= some
                        if not group[0][1]:
                            group.pop(0)
                        after.append((sequence, some, room - length))
                        sequence, have = sequence + some, have - some
                    if have:
                        after.append((sequence, have, room))
                ranges = after
            for sequence, have, room in ranges:
                rooms.add(room, sequence, have)
    for length in sorted(left, reverse=True):
        if left[length]:
            rooms.best_fit(length, left[length])
    return plan


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = "", capacity: int = 2048, end_id: int = 0, rows_per_range: int = 4000) -> DataFrame:
    """One row per piece: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset``.

    Ids are those of the tokenizer with its defaults and without added special
    tokens; a special token's name in a text is that token.
    Every row of the input is a document, repeated ids included; null and empty
    texts are documents of one token. Pieces of equal length may take each
    other's places, so ties are settled by id, piece and checksum. An empty
    table gives an empty result.
    """
    pieces = stage(token_pieces(df, id_col, text_col, tokenizer_path, capacity, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_packing(counts, capacity)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    first_of = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def seat(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for x in np.unique(length):
                some = length == x
                a, b = first_of[x], first_of[x + 1]
                at[some] = a + np.searchsorted(runs[a:b, 1], rank[some], "right") - 1
            seat_of = runs[at, 3] + rank - runs[at, 1] if len(at) else at
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "piece", "start", "length", "ids_crc32")), pa.array(seat_of), pa.array(runs[at, 4] if len(at) else at)], ["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    of_length = df.sparkSession.createDataFrame([(length, -(-n // rows_per_range)) for length, n in counts.items()], "length long, ranges long")
    keyed = pieces.join(F.broadcast(of_length), "length")  # at most `capacity` rows
    keyed = keyed.withColumn("range", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.col("ranges"))).drop("ranges")
    before = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("length", "range").agg(F.count("*").alias("n")).select("length", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("length", "range").orderBy("_id", "piece", "ids_crc32")
    ranked = keyed.join(totals, ["length", "range"]).withColumn("rank", F.col("base") + F.row_number().over(inner) - 1).drop("range", "base")
    kind = pieces.schema["_id"].dataType.simpleString()
    seated = ranked.mapInArrow(seat, f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return seated.withColumnRenamed("_id", id_col)
