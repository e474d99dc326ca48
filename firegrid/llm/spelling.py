"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One edit changes a word's letter counts by at most two: a replaced letter takes
one away and adds another, an inserted or deleted one makes a difference of one
between words of lengths L and L + 1. Words of each length lie in a k-d tree over
their letter counts. A first tree, fitted on a bounded sample, deals all words
out to cells; a word is sent as a query to every cell of its own and the next
length whose box is near enough. Within a cell a second tree does the same, down
to small buckets, and the letters of what is left are compared in order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, stage

#: Runs of A-Z, a-z and U+00C0-U+00FF in lower-cased UTF-8, where the latter are C3 and one more byte.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
LEAST_LETTERS, LEAST_SEEN, ONE_IN = 7, 2, 31

#: Letters a to z have a dimension each, all others share one; counts end at CLIP. Both keep distances from growing.
DIMENSIONS, CLIP = 27, 15

#: Bits of a word's code: "at least once" and "at least twice" for each letter, "thrice" for common ones, and others.
_STEPS = [*((d, 1) for d in range(26)), *((d, 2) for d in range(26)), *((ord(c) - 97, 3) for c in "aeinorst"), *((26, k) for k in (1, 2, 3, 4))]

#: Rows that leave a task's counter at a time.
FLUSH = 100_000


# --- words ------------------------------------------------------------------


def without_one(run: bytes, h: int) -> bytes:
    """The run without its code point at ``h`` modulo its length."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _count(batches):
    total: Counter = Counter()

    def rows():
        words = list(total)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column("_id"), batch.column("_text").cast(pa.large_binary()), strict=True):
            if not text.is_valid:
                continue
            data, start = text.as_py().lower(), zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
            runs = RUN.findall(data) if len(data) < STEP_BYTES else (m.group() for m in RUN.finditer(data))
            for run, n in Counter(r for r in runs if len(r) >= LEAST_LETTERS).items():
                h = zlib.crc32(run, start)
                total[run if h % ONE_IN else without_one(run, h)] += n
            if len(total) >= FLUSH:
                yield rows()
    yield rows()


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n, length`` of the words: runs of letters, some with a letter taken out by their document's and their own checksum, of enough code points and occurrences. Counted within tasks before they are shuffled."""
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counted = docs.mapInArrow(_count, "word string, n long").where(F.length("word") >= LEAST_LETTERS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN).withColumn("length", F.length("word"))


# --- letter counts and trees ------------------------------------------------


def letters_of(words: pa.Array, length: int) -> np.ndarray:
    """Code points of words of one length, a row per word."""
    raw = "".join(words.to_pylist()).encode("utf-16-le")
    return np.frombuffer(raw, np.uint16).reshape(-1, length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts by dimension of each row of letters, clipped."""
    n, length = letters.shape
    dim = np.where((letters >= 97) & (letters <= 122), letters - 97, 26).astype(np.int64)
    flat = np.bincount((np.arange(n)[:, None] * DIMENSIONS + dim).ravel(), minlength=n * DIMENSIONS)
    return np.minimum(flat.reshape(n, DIMENSIONS), CLIP).astype(np.int8)


def codes_of(counts: np.ndarray) -> np.ndarray:
    """Counts as 64 bits, so that the number of different bits never exceeds the distance."""
    code = np.zeros(len(counts), np.uint64)
    for bit, (d, least) in enumerate(_STEPS):
        code |= (counts[:, d] >= least).astype(np.uint64) << np.uint64(bit)
    return code


class Tree:
    """A k-d tree over letter counts. Inner nodes hold a dimension, a threshold and how far their box reaches in that dimension; leaves are numbered."""

    def __init__(self, counts: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple | int] = []
        self.members: list[np.ndarray] = []
        self.depth = 0
        self._split(counts, np.arange(len(counts)), max(leaf, 1), [(0, CLIP)] * DIMENSIONS, 0)

    def _split(self, counts: np.ndarray, rows: np.ndarray, leaf: int, box: list[tuple[int, int]], depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(len(self.members))
        self.depth = max(self.depth, depth)
        if len(rows) > leaf:
            some = counts[rows]
            share = np.stack([(some >= t).mean(0) for t in range(1, 5)])
            t, d = np.unravel_index(np.abs(share - 0.5).argmin(), share.shape)
            if 0 < share[t, d] < 1:
                (lo, hi), up = box[d], some[:, d] > t
                left = self._split(counts, rows[~up], leaf, [*box[:d], (lo, int(t)), *box[d + 1 :]], depth + 1)
                right = self._split(counts, rows[up], leaf, [*box[:d], (int(t) + 1, hi), *box[d + 1 :]], depth + 1)
                self.nodes[at] = (int(d), int(t) + 1, lo, hi, left, right)
                return at
        self.members.append(rows)
        return at

    def search(self, counts: np.ndarray, radius: int):
        """Yield ``(leaf, rows)``: the rows of ``counts`` that are within ``radius`` of the leaf's box; of radius 0, each row with its own leaf."""
        todo = [(0, np.arange(len(counts)), np.zeros(len(counts), np.int8))]
        while todo:
            at, rows, far = todo.pop()
            if not len(rows):
                continue
            if isinstance(self.nodes[at], int):
                yield self.nodes[at], rows
                continue
            d, t, lo, hi, left, right = self.nodes[at]
            c = counts[rows, d]
            low, high = np.maximum(lo - c, 0), np.maximum(c - hi, 0)
            for child, further in ((left, far - high + np.maximum(c - (t - 1), 0)), (right, far - low + np.maximum(t - c, 0))):
                near = further <= radius
                todo.append((child, rows[near], further[near]))


# --- letter order -----------------------------------------------------------


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b`` is ``a`` with one letter put in: the common start and the common end cover ``a``."""
    head = np.cumprod(a == b[:, :-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], 1, dtype=np.int8).sum(1, dtype=np.int64)
    return head + tail >= a.shape[1]


POINT, SAME, SHORTER = 0, 1, 2

#: Candidates whose letters are compared in one step.
PAIRS = 1 << 16


def _search_cell(bucket: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        role, words, ns = table.column("role").to_numpy(), table.column("word").combine_chunks(), table.column("n").to_numpy()
        length = table.column("length")[0].as_py()
        own = np.flatnonzero(role == POINT)
        of: list[list] = [[], []]
        if len(own):
            letters = letters_of(words.take(pa.array(own)), length)
            counts = letter_counts(letters)
            tree, codes = Tree(counts, bucket), codes_of(counts)
            for kind, size, radius, check in ((SAME, length, 2, one_replaced), (SHORTER, length - 1, 1, one_inserted)):
                asked = np.flatnonzero(role == kind)
                if not len(asked):
                    continue
                q_letters = letters_of(words.take(pa.array(asked)), size)
                q_counts = letter_counts(q_letters)
                q_codes = codes_of(q_counts)
                held, n_held = [], 0

                def compare(held, q_letters=q_letters, asked=asked, check=check):
                    q, p = (np.concatenate(x) for x in zip(*held, strict=True))
                    good = check(q_letters[q], letters[p])
                    of[0].append(asked[q[good]])
                    of[1].append(own[p[good]])

                step = max(1, min(PAIRS, (32 << 20) // length))
                for leaf, rows in tree.search(q_counts, radius):
                    mine = tree.members[leaf]
                    for a in range(0, len(rows), max(1, step // len(mine))):
                        some = rows[a : a + max(1, step // len(mine))]
                        q, p = np.nonzero(np.bitwise_count(q_codes[some, None] ^ codes[None, mine]) <= radius)
                        held.append((some[q], mine[p]))
                        n_held += len(q)
                        if n_held >= step:
                            compare(held)
                            held, n_held = [], 0
                if held:
                    compare(held)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in of)
        pairs = pa.table({"a": words.take(pa.array(a)), "na": pa.array(ns[a]), "b": words.take(pa.array(b)), "nb": pa.array(ns[b])})
        # Words of one length find each other from both sides.
        return pairs.filter(pc.or_(pa.array(role[a] == SHORTER), pc.less(pairs["a"], pairs["b"])))

    return run


# --- the search over all words ----------------------------------------------


def _masks(words: DataFrame) -> DataFrame:
    """``mask, word, n``: each word with a place blanked, with a place left out, and as it is. Words are near if and only if they share a mask: two blanked ones, or one left out and one as it is."""
    places = F.explode(F.sequence(F.lit(1), F.col("length"))).alias("i")
    cut = words.select("word", "n", "length", places).withColumns({"head": F.expr("substring(word, 1, i - 1)"), "tail": F.expr("substring(word, i + 1)")})
    both = F.explode(F.array(F.concat("head", F.lit("*"), "tail"), F.concat(F.lit("-"), "head", "tail"))).alias("mask")
    return cut.select(both, "word", "n").unionByName(words.select(F.concat(F.lit("-"), "word").alias("mask"), "word", "n")).distinct()


def near_by_masks(some: DataFrame, words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: near pairs with an end in ``some``, by equi-join on masks. A mask stands for one more letter, in one place or any, so no key is hot."""
    names = {"word": "b", "n": "nb"}
    pairs = _masks(some).withColumnsRenamed({"word": "a", "n": "na"}).join(_masks(words).withColumnsRenamed(names), "mask").where("a <> b")
    near = F.when(F.length("a") == F.length("b"), F.col("mask").contains("*")).otherwise(F.abs(F.length("a") - F.length("b")) == 1)
    return pairs.where(near).select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def near_pairs(words: DataFrame, cell: int = 16_384, bucket: int = 48, sample: int = 100_000, most_equal: int = 2_000) -> DataFrame:
    """``a, na, b, nb``: each pair of ``word, n, length`` one edit apart, once.

    The tree that deals words to cells of about ``cell`` words is fitted on at most
    ``sample`` of them, with eight sampled words in a cell at least, so it has at
    most ``sample / 8`` leaves and goes to all tasks. Every word is searched.
    Letters in other orders have equal counts, which no tree can part: words of
    which over ``most_equal`` share length and counts are found by masks instead.
    """
    alike = F.array_join(F.array_sort(F.split("word", "")), "")
    crowd = words.groupBy("length", alike.alias("alike")).agg(F.count("*").alias("m")).where(F.col("m") > most_equal).select("alike")
    crowded = not crowd.isEmpty()
    rest = words
    if crowded:
        marked = words.withColumn("alike", alike).join(crowd.withColumn("_c", F.lit(True)), "alike", "left").drop("alike")
        marked = stage(marked, "crowded")
        rest, some = marked.where("_c is null").drop("_c"), marked.where("_c").drop("_c")
    sizes = {r["length"]: r["k"] for r in rest.groupBy("length").agg(F.count("*").alias("k")).collect()}  # a row per length of a word
    total = sum(sizes.values())
    if not total:
        return near_by_masks(some, words) if crowded else words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("word").alias("b"), F.col("n").alias("nb")).limit(0)
    # By hash: a share of the hash's range, cut by the limit on what reaches the driver.
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * sample / total))
    taken: dict[int, list[str]] = {}
    for r in rest.where(share).select("word", "length").limit(sample).collect():
        taken.setdefault(r["length"], []).append(r["word"])
    trees, first, cells = {}, {}, 0
    for length in sorted(sizes):
        fit = taken.get(length, [])
        counts = letter_counts(letters_of(pa.array(fit, pa.string()), length)) if fit else np.zeros((0, DIMENSIONS), np.int8)
        size = min(cell, max(1, (64 << 20) // length))
        trees[length], first[length] = Tree(counts, max(8, round(len(fit) * size / sizes[length]))), cells
        cells += len(trees[length].members)
        trees[length].members = []
    reach = {n: t.depth for n, t in trees.items()}
    parts = {n: -(-(2 + 2 * d + d * (d - 1) // 2) // 8) for n, d in reach.items()}

    def route(batches):
        names = ["cell", "part", "role", "word", "n", "length"]
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                step = max(1, (32 << 20) // length)
                for at in range(0, len(rows), step):
                    some = batch.take(pa.array(rows[at : at + step]))
                    counts = letter_counts(letters_of(some.column("word"), length))
                    turn = np.array([zlib.crc32(w.encode()) for w in some.column("word").to_pylist()])
                    for role, of, radius in ((POINT, length, 0), (SAME, length, 2), (SHORTER, length + 1, 1)):
                        if of not in trees:
                            continue
                        for leaf, found in trees[of].search(counts, radius):
                            n = parts[of] if role == POINT else 1
                            part = np.tile(np.arange(n), len(found)) if role == POINT else turn[found] % parts[of]
                            found = np.repeat(found, n)
                            take = pa.array(found)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), first[of] + leaf)), pa.array(part.astype(np.int64)), pa.array(np.full(len(found), role, np.int8)), some.column("word").take(take), some.column("n").take(take), pa.array(np.full(len(found), of, np.int32))], names)

    routed = rest.select("word", "n", "length").mapInArrow(route, "cell long, part long, role byte, word string, n long, length int")
    pairs = routed.groupBy("cell", "part").applyInArrow(_search_cell(bucket), "a string, na long, b string, nb long")
    return pairs.unionByName(near_by_masks(some, words)) if crowded else pairs


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10, **search) -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF in whole texts, with A-Z
    lower-cased; where 31 divides h, the unsigned crc32 of ``<id>:<run>`` in UTF-8,
    the run's code point h modulo its length is left out. They count from 7 code
    points and 2 occurrences. ``n_near``: words one edit away; ``form``: of these
    the most frequent (ties: the first in code-point order) if it has ``ratio``
    times the word's occurrences; ``root``: where following forms ends.

    A null text has no words, a null id stands for no characters; repeated rows
    count as often as they occur. Rows without words, or an empty table, give an
    empty result. Other columns are not read.
    """
    words = stage(word_counts(df, id_col, text_col), "words")
    pairs = near_pairs(words, **search)
    other = F.struct((-F.col("no")).alias("k"), F.col("other").alias("word"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("no")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("no")))).alias("e")
    near = pairs.select(ends).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(other).alias("best"))
    t = words.join(near, "word", "left")
    common = -F.col("best.k") >= ratio * F.col("n")
    t = stage(t.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.k")).alias("form_n")), "forms")
    # Each step up a chain multiplies n, so chains are short; every round doubles how far each word sees.
    chain = t.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = stage(chain.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if chain.where("moved").isEmpty():
            break
        chain = chain.drop("moved")
    return t.join(chain.select("word", "root"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
