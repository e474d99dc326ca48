"""Near-duplicates by MinHash bands with sequential Bayesian verification.

Texts become sets of five-word shingles. Equal sets collapse to one
representative first, so a group of copies costs one row. Banded MinHash keys
propose candidates: every member of a band bucket is paired with one leader of
that bucket (by one of four random orders), not with all the others. Pairs
are then checked against the signatures batch by batch: given m of n agreeing
hashes and a uniform prior, a pair is dropped as soon as the posterior
probability of reaching the threshold falls under the chosen miss probability.
Survivors are verified exactly, on full shingle sets. In buckets
whose members then still lie in several components, the members of different
components are compared block against block, with their texts at hand, so that
no pair of a bucket stays open unless the signatures rule it out.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, mix64, stage, text_steps, word_hashes, words_of

SHINGLE, BANDS, ROWS = 5, 32, 4
HASHES = BANDS * ROWS
#: Band buckets choose their leaders by this many different orders, in turn.
ORDERS = 4
#: Signature comparisons happen in batches of this many hashes.
BATCH = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(5)
_FACTORS = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1), _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32))
_PLACES = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = np.uint64(0x632BE59BD9B4E019)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and where each text's begin."""
    data = _LOWER[data]
    starts, first = words_of(data, offsets)
    words = word_hashes(data, starts)
    counts = np.diff(first)
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(number)))
    hashes = np.zeros(int(begin[-1]), np.uint64)
    long = np.flatnonzero(counts >= width)
    if len(long):
        sums = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width):
            sums += words[k : len(words) - width + 1 + k] * _PLACES[k]
        source = np.repeat(first[:-1][long] - begin[:-1][long], number[long])
        target = np.concatenate([np.arange(begin[t], begin[t + 1]) for t in long]) if len(long) < 64 else np.flatnonzero(np.repeat(counts >= width, number))
        hashes[target] = mix64(sums[target + source])
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        some = words[first[t] : first[t + 1]]
        hashes[begin[t]] = mix64((some * _PLACES[: len(some)]).sum(keepdims=True) + np.full(1, len(some), np.uint64) * _SHORT)[0]
    cuts = begin.tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[begin[:-1][number > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return hashes[fresh], kept[begin]


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """MinHash values, one row of ``HASHES`` for each non-empty set."""
    full = begin[:-1][begin[:-1] < begin[1:]]
    out = np.empty((len(full), HASHES), np.uint32)
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(low * _FACTORS[0][k] + _FACTORS[1][k], full)
    return out


def _sketch(batches):
    names = ["_id", "n", "size", "fp1", "fp2", "sig", "bands"]
    band_no = np.arange(BANDS, dtype=np.int64) << 32
    for batch in batches:
        for i, j, data, offsets in text_steps(batch.column("_text")):
            hashes, begin = shingle_sets(data, offsets)
            number = np.diff(begin)
            full = np.flatnonzero(number)
            minima = signatures(hashes, begin)
            mixed = mix64(hashes ^ np.uint64(0xD1B54A32D192ED03))
            prints = [np.zeros(len(number), np.uint64), np.zeros(len(number), np.uint64)]
            if len(full):
                prints[0][full] = np.add.reduceat(hashes, begin[full])
                prints[1][full] = np.add.reduceat(mixed, begin[full])
            keys = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                keys = mix64(keys + minima[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
            keys = (keys >> np.uint64(33)).astype(np.int64) + band_no
            sig = mix64(minima.astype(np.uint64)).astype(np.uint8)
            of = np.full(len(number), -1)
            of[full] = np.arange(len(full))
            raw = sig.tobytes()
            sigs = pa.array([None if k < 0 else raw[k * HASHES : (k + 1) * HASHES] for k in of.tolist()], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number > 0))) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(number), pa.array(np.diff(offsets)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), sigs, lists], names)


# --- the Bayesian test ------------------------------------------------------


def posterior(matches: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold) after ``matches`` of ``n`` hashes agreed, from a uniform prior: the upper tail of Beta(matches + 1, n - matches + 1), written as a binomial sum."""
    return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(matches + 1))


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch, the fewest agreeing hashes with which a pair stays in play."""
    return [next(m for m in range(n + 1) if posterior(m, n, threshold) >= miss) for n in range(BATCH, HASHES + 1, BATCH)]


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Compare rows of signatures batch by batch; which survive all, and with how many matches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
        alive = alive[matches[alive] >= m]
        if not len(alive):
            break
    return alive, matches[alive]


def _sig(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def prune_pairs(pairs: DataFrame, reps: DataFrame, threshold: float, miss: float) -> DataFrame:
    """``a, b, est`` of the pairs that the signatures don't rule out."""
    least = least_matches(threshold, miss)

    def run(batches):
        for batch in batches:
            alive, matches = surviving(_sig(batch.column("sig_a")), _sig(batch.column("sig_b")), least)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(alive)) for c in "ab"), pa.array(matches)], ["a", "b", "est"])

    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}, est long")


# --- exact verification -----------------------------------------------------


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


#: Members that one copy of their leader's text is sent for.
PART_MEMBERS = 512


def verify_leaders(found: DataFrame, texts: DataFrame, percent: int, part: int = PART_MEMBERS) -> DataFrame:
    """``a, b``: the pairs of members ``x`` and leaders ``y`` whose full shingle sets meet ``percent``: 100 * intersection >= percent * union.

    A leader's members are dealt into parts of about ``part``. Its text goes to each
    part once and comes first there; its shingles are taken once, and the members
    stream past them.
    """
    kind = found.schema["x"].dataType.simpleString()

    def run(batches):
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            y, part, x = (batch.column(c).to_pylist() for c in ("y", "part", "x"))
            out: list[list] = [[], []]
            for i, j, data, offsets in text_steps(batch.column("text")):
                hashes, begin = shingle_sets(data, offsets)
                for k in range(i, j):
                    mine = hashes[begin[k - i] : begin[k - i + 1]]
                    if x[k] is None:
                        now, own = (y[k], part[k]), mine.copy()
                    elif now == (y[k], part[k]) and min(len(mine), len(own)) * 100 >= percent * max(len(mine), len(own)):
                        same = _overlap(mine, own)
                        if same and 100 * same >= percent * (len(mine) + len(own) - same):
                            out[0].append(min(x[k], y[k]))
                            out[1].append(max(x[k], y[k]))
            yield pa.RecordBatch.from_arrays([pa.array(o, batch.column("y").type) for o in out], ["a", "b"])

    sizes = stage(found.groupBy("y").agg(F.count("*").alias("m")).withColumn("parts", F.ceil(F.col("m") / part)), "led")
    dealt = join_counted(found.select("x", "y"), sizes, "y", "m", found.count()).withColumn("part", F.pmod(F.xxhash64("x"), F.col("parts")))
    members = dealt.join(texts.withColumnRenamed("rep", "x"), "x").select("y", "part", "x", "text")
    copies = sizes.select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("rep", "y"), "y")
    rows = members.unionByName(copies.select("y", "part", F.lit(None).cast(kind).alias("x"), "text"))
    return rows.repartition("y", "part").sortWithinPartitions("y", "part", F.asc_nulls_first("x")).mapInArrow(run, f"a {kind}, b {kind}")


# --- components -------------------------------------------------------------


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, comp``: the smallest node of each node's component, by alternating large and small stars over staged edges."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        ends = 2 * (state[0] if state else edges.count())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = join_counted(both.where("v > u"), least, "u", "d", ends).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = join_counted(large, least, "u", "d", ends).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small, "edges")  # neither star makes more edges than it gets
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))


def _labelled(reps: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links)
    return stage(reps.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("comp", "rep").alias("comp")), "labels")


def _crossing(pairs: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends lie in different components."""
    of = lambda side: labels.select(F.col("rep").alias(side), F.col("comp").alias(f"comp_{side}"))
    return pairs.join(of(a), a).join(of(b), b).where(F.col(f"comp_{a}") != F.col(f"comp_{b}"))


def _complete(members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, least: list[int], percent: int, block: int, block_bytes: int) -> DataFrame:
    """``a, b``: links between different components within buckets of three or more, enough of them to join what belongs together.

    Large buckets go block against block, each block with its members' texts:
    about ``block`` members or ``block_bytes`` of text, whichever is less.
    Pairs that lie in different components, also after the links found so far,
    take the signature tests; survivors are verified exactly, all of a member's
    at once, on shingles numbered within the blocks. Only links leave the task.
    """
    kind = labels.schema["rep"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, side = (table.column(c).to_numpy() for c in ("rep", "side"))
        comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)[1]
        sig = _sig(table.column("sig"))
        parts, sizes = [], []
        for _, _, data, offsets in text_steps(table.column("text").combine_chunks()):
            hashes, begin = shingle_sets(data, offsets)
            parts.append(hashes)
            sizes.append(np.diff(begin))
        size = np.concatenate(sizes)
        begin = np.concatenate(([0], np.cumsum(size)))
        number = np.unique(np.concatenate(parts), return_inverse=True)[1]
        mark = np.zeros(int(number.max(initial=0)) + 1, bool)
        left = np.flatnonzero(side == 0)
        diagonal = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        right = left if diagonal else np.flatnonzero(side == 1)
        found: list[list] = [[], []]
        for x in left:
            other = right[(comp[right] != comp[x]) & ((rep[right] > rep[x]) if diagonal else True)]
            if len(other):
                other = other[surviving(np.broadcast_to(sig[x], (len(other), HASHES)), sig[other], least)[0]]
            if not len(other):
                continue
            n = size[other]
            ends = np.cumsum(n)
            at = np.repeat(begin[other] - (ends - n), n) + np.arange(ends[-1])
            mark[number[begin[x] : begin[x + 1]]] = True
            hits = np.concatenate(([0], np.cumsum(mark[number[at]])))
            mark[number[begin[x] : begin[x + 1]]] = False
            same = hits[ends] - hits[ends - n]
            for y in other[100 * same >= percent * (size[x] + n - same)]:
                if comp[y] != comp[x]:
                    found[0].append(rep[x])
                    found[1].append(rep[y])
                    comp[comp == comp[y]] = comp[x]
        of = table.schema.field("rep").type
        return pa.table({"a": pa.array(found[0], of), "b": pa.array(found[1], of)})

    mixed = members.join(labels, "rep").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.sum("size").alias("size")).where("lo <> hi and m > 2").select("key", "m", F.ceil(F.greatest(F.col("m") / block, F.col("size") / block_bytes)).alias("nb"))
    rows = join_counted(members.drop("size"), stage(mixed, "mixed"), "key", "m", members.count()).join(labels, "rep").join(reps.select("rep", "sig"), "rep").join(texts, "rep").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("side", (F.col("mine") == F.col("j")).cast("int"))
    rows = rows.withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("side"))).select("key", "i", "j", "side", "rep", "comp", "sig", "text")
    return rows.groupBy("key", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, miss: float = 1e-6, block: int = 4096, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: ``<id_col>, n_shingles, component_id, kept``.

    ``n_shingles`` is the size of the row's set of distinct five-word shingles
    (words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of one to
    four words has one shingle). Rows without words have 0 and are linked with
    nothing. Rows are linked when 100 * intersection >= ``percent`` * union;
    ``component_id`` is the smallest id that can be reached. Rows that repeat an
    id count as one document that has all their sets. A null id can't be linked:
    its component is null and it is kept. An empty table gives an empty result.

    Band keys miss a pair of similarity 0.75 with a chance of about 5e-6
    ((1 - 0.75**4)**32), and each of eight signature tests with about ``miss``;
    what is linked is exact.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    marks = stage(docs.mapInArrow(_sketch, f"_id {kind}, n long, size long, fp1 long, fp2 long, sig binary, bands array<long>"), "sketches")
    real = marks.where("n > 0 and _id is not null")
    reps = stage(real.groupBy("n", "fp1", "fp2").agg(F.min("_id").alias("rep"), F.max("size").alias("size"), F.min("sig").alias("sig"), F.min("bands").alias("bands")), "reps")

    members = reps.select(F.explode("bands").alias("key"), "rep", "size")
    order = F.xxhash64("rep", F.shiftright("key", 32) % ORDERS)
    leaders = members.groupBy("key").agg(F.min(F.struct(order.alias("h"), F.col("rep").alias("lead"))).alias("lead"), F.count("*").alias("m")).where("m > 1")
    leaders = stage(leaders.select("key", "lead.lead", "m"), "buckets")
    members = stage(join_counted(members, leaders, "key", "m", BANDS * reps.count()), "members")
    star = members.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    candidates = stage(prune_pairs(star, reps, percent / 100, miss).withColumnsRenamed({"a": "x", "b": "y"}), "candidates")

    near = members.select("rep").distinct()
    texts = docs.join(near, F.col("_id") == F.col("rep"), "left_semi")
    texts = stage(texts.select(F.col("_id").alias("rep"), F.col("_text").alias("text")), "texts")

    # Each document with its most similar leader, then with more of the leaders that still lie apart.
    links, tested = None, None
    for width in (1, BANDS):
        open_ = candidates if tested is None else _crossing(candidates, labels, "x", "y").join(tested, ["x", "y"], "left_anti")
        nth = Window.partitionBy("x").orderBy(F.desc("est"), "y")
        found = stage(open_.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= width).select("x", "y"), "leaders")
        if tested is not None and found.isEmpty():
            break
        new = verify_leaders(found, texts, percent)
        links = stage(new if links is None else links.unionByName(new), "links")
        labels = _labelled(reps, links)
        tested = found if tested is None else stage(tested.unionByName(found), "tested")

    # Then pairs of which neither is a leader.
    more = _complete(members.select("key", "rep", "size"), labels, reps, texts, least_matches(percent / 100, miss), percent, block, block_bytes)
    links = stage(links.unionByName(more), "links")
    # Rows that repeat an id connect their sets.
    same_id = real.groupBy("_id").agg(F.count("*").alias("k")).where("k > 1").select("_id")
    rep_of = real.join(reps.select("n", "fp1", "fp2", "rep"), ["n", "fp1", "fp2"]).select("_id", "rep")
    doubled = rep_of.join(same_id, "_id").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    labels = _labelled(reps.select("rep").unionByName(doubled.select(F.col("a").alias("rep"))), links.unionByName(doubled))

    out = marks.join(reps.select("n", "fp1", "fp2", "rep"), ["n", "fp1", "fp2"], "left").join(labels, "rep", "left")
    comp = F.when(F.col("_id").isNull(), None).when(F.col("n") == 0, F.col("_id")).otherwise(F.col("comp"))
    out = out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
