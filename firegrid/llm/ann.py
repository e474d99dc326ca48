"""Nearest neighbours by score-aware anisotropic quantisation.

Unit vectors are product-quantised, two dimensions and four bits to a subspace.
The codebooks and the codes minimise a loss in which the residual along the
vector itself weighs ``eta`` times the residual across it, because that is the
part which changes large inner products. Queries scan the packed codes through
lookup tables, two four-bit codes a byte; the best by approximate score are then
scored exactly on the original vectors, and after them all whose angle to their
code leaves them a chance to be among the nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

CENTRES = 16


def pairs_of(x: np.ndarray) -> np.ndarray:
    """Rows cut into subspaces of two dimensions, an even number of them, zero-padded."""
    pad = -x.shape[1] % 4
    if pad:
        x = np.pad(x, ((0, 0), (0, pad)))
    return x.reshape(len(x), -1, 2)


def eta_for(threshold: float, dims: int) -> float:
    """Weight of the parallel residual if inner products above ``threshold`` matter."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, books: np.ndarray, eta: float, passes: int = 3) -> np.ndarray:
    """Codes that minimise the anisotropic loss by coordinate descent over the subspaces."""
    n, m, _ = x.shape
    near = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    along = np.einsum("nmd,mkd->nmk", x, books)
    code = near.argmin(2)
    each = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0]
    total = (x**2).sum((1, 2))
    rest = total - each.sum(1)
    for _ in range(passes):
        before = code.copy()
        for k in range(m):
            rest += each[:, k]
            code[:, k] = (near[:, k] + (eta - 1) * (rest[:, None] - along[:, k]) ** 2).argmin(1)
            each[:, k] = along[np.arange(n), k, code[:, k]]
            rest -= each[:, k]
        if (before == code).all():
            break
    return code


def train(x: np.ndarray, eta: float, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Codebooks (subspaces, 16, 2) from rows of unit vectors in subspaces."""
    rng = np.random.default_rng(seed)
    n, m, _ = x.shape
    books = np.stack([x[rng.choice(n, CENTRES, replace=n < CENTRES), k] + rng.normal(0, 1e-4, (CENTRES, 2)) for k in range(m)])
    flat, place = x.reshape(-1, 2), CENTRES * np.arange(m)
    size = (x**2).sum((1, 2))
    for r in range(rounds):
        weight = 1.0 if r < rounds // 2 else eta  # plain k-means first
        code = encode(x, books, weight, passes=0 if weight == 1.0 else 2)
        each = (np.take_along_axis(books[None], code[:, :, None, None], 2)[:, :, 0] * x).sum(2)
        pull = (1 + (weight - 1) * ((size - each.sum(1))[:, None] + each)).ravel()
        # each centre solves its own normal equations: sums over the vectors of that code
        of = (code + place).ravel()
        total = lambda w: np.bincount(of, w, CENTRES * m)  # noqa: E731, B023
        n, xx, xy, yy = np.bincount(of, minlength=CENTRES * m), total(flat[:, 0] ** 2), total(flat[:, 0] * flat[:, 1]), total(flat[:, 1] ** 2)
        left = np.stack([n + (weight - 1) * xx, (weight - 1) * xy, (weight - 1) * xy, n + (weight - 1) * yy], 1).reshape(-1, 2, 2)
        right = np.stack([total(flat[:, 0] * pull), total(flat[:, 1] * pull)], 1)
        used = n > 0
        books.reshape(-1, 2)[used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
    return books


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Per query and byte of code, the inner product that each of 256 byte values adds."""
    one = np.einsum("qmd,mkd->qmk", queries, books).astype(np.float32)
    return (one[:, 0::2, None, :] + one[:, 1::2, :, None]).reshape(len(queries), -1, 256)


def pack_codes(code: np.ndarray) -> np.ndarray:
    return (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)


def scan(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows)."""
    out = np.zeros((len(table), len(packed)), np.float32)
    columns = np.ascontiguousarray(packed.T)
    for q in range(len(table)):
        for b in range(len(columns)):
            out[q] += table[q, b].take(columns[b])
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` best by score, ties to the smaller id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:n]


def decode(books: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, by subspace."""
    return np.take_along_axis(books[None], code[:, :, None, None], 2)[:, :, 0]


def slack(x: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each coded vector, the part along the unit vector that it stands for, and the length of the part across it."""
    along = (coded * x).sum((1, 2))
    return along, np.sqrt(np.maximum((coded**2).sum((1, 2)) - along**2, 0))


def reach(scores: np.ndarray, along: np.ndarray, across: np.ndarray, least: float, margin: float = 1e-4) -> np.ndarray:
    """Whether rows of these approximate scores can have an exact one of ``least``.

    If a unit vector is within the angle a of the query and its code within b of
    it, the code is within a + b of the query. ``margin`` is more than single
    precision loses in a scan and a norm.
    """
    least = min(max(least, -1.0), 1.0)
    return (scores >= least * along - np.sqrt(1 - least**2) * across - margin) | (least * np.hypot(along, across) <= margin - along)


def capped(order: np.ndarray, lead: np.ndarray, single: np.ndarray, k: int) -> np.ndarray:
    """Of places in order, those that are not preceded by ``k`` others of one id alone: no query needs more of them."""
    own = np.where(single[order], lead[order], 0)
    by = np.lexsort((np.arange(len(order)), own, ~single[order]))
    first = np.ones(len(by), bool)
    first[1:] = (own[by][1:] != own[by][:-1]) | (single[order][by][1:] != single[order][by][:-1])
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    keep = np.ones(len(order), bool)
    keep[by] = (nth < k) | ~single[order][by]
    return order[keep]


class Block:
    """Coded vectors of a block: both levels of codes with their slacks, ids and unit vectors."""

    def __init__(self, lead: np.ndarray, single: np.ndarray, x: np.ndarray, codes: list[np.ndarray], slacks: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.lead, self.single, self.x, self.codes, self.slacks = lead, single, x, codes, slacks
        self.exact = 0  # how many vectors have been scored exactly

    def nearest(self, scores: np.ndarray, finer: np.ndarray, query: np.ndarray, k: int, rerank: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the ``2 * k`` vectors nearest to a query, ties to the smaller id, at most ``k`` of one id alone; those below ``least`` may be left out.

        ``scores`` are the first level's, ``finer`` the query's table of the second.
        What the ``rerank`` best reach exactly is the least that others must be able
        to reach: first by their code, then by the finer one.
        """
        some = best_of(scores, self.lead, rerank)
        exact = (self.x[some] * query).sum(1)
        self.exact += len(some)
        if len(scores) > len(some):
            mine = capped(np.lexsort((self.lead[some], -exact)), self.lead[some], self.single[some], k)
            if len(mine) >= 2 * k:
                least = max(least, exact[mine[2 * k - 1]])
            may = np.flatnonzero(reach(scores, *self.slacks[0], least))
            both = scores[may] + scan(finer[None], self.codes[1][may])[0]
            some = may[reach(both, *(v[may] for v in self.slacks[1]), least)]
            exact = (self.x[some] * query).sum(1)
            self.exact += len(some)
        order = np.lexsort((self.lead[some], -exact))
        best = capped(order[exact[order] >= least - 1e-9], self.lead[some], self.single[some], k)[: 2 * k]
        return some[best], exact[best]


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float32 if flat.dtype == np.float32 else np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sound(v: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, rerank: int = 60, train_rows: int = 20_000, threshold: float = 0.2, block: int = 16_384, query_block: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` rows of largest cosine for each row whose id is divisible by ``every``.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do those whose length isn't the most common one, nor rows without
    an id (a cosine needs equal lengths; a table with two has two kinds of vectors).
    Rows that repeat an id and its vector count once. Rows that repeat an
    id with other vectors are candidates each and queries each, but never
    candidates for a query of their own id. Ties go to the smaller id; with fewer
    candidates than ``k`` all are returned; an empty table gives an empty result.

    Equal vectors are indexed once, with the ``k + 1`` smallest of their ids: no
    query can have another among its ``k`` nearest. A query's own id may hold
    several of the nearest vectors alone: of each id ``k`` such vectors are kept at
    most and ``2 * k`` vectors in all, so ``k`` others are always among them.
    Codebooks are fitted on at most ``train_rows`` distinct vectors (those of the
    smallest id hashes); every distinct vector is encoded and scanned by every query, block against block.
    In a block the ``rerank`` best by approximate score are scored exactly, in
    double precision; what they reach is the least that others must be able to
    reach. Whose code allows that is scanned with a second table, of codes for what
    the first level leaves over, and whose two codes still allow it is scored
    exactly, however many they are. So the result is exact, and codes only save work.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & sound(F.col("v")))
    spark = df.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], result)
    rows = rows.where(F.size("v") == common["d"])
    eta = eta_for(threshold, common["d"])

    # A row per distinct vector: a number of its own, the smallest ids that have it, and the first of those.
    by_vector = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("nth", F.dense_rank().over(by_vector)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    members = stage(members.select(F.monotonically_increasing_id().alias("rep"), F.col("ids")[0].alias("lead"), "ids", "v"), "members")
    reps = members.select("rep", "lead", (F.size("ids") == 1).alias("single"), "v")
    queries = stage(rows.where(F.col("id") % every == 0).join(reps.select("rep", "v"), "v").select(F.col("id").alias("query_id"), "rep").distinct(), "queries")
    asked = reps.join(queries.select("rep").distinct(), "rep", "left_semi")

    sample = reps.orderBy(F.xxhash64("lead"), "lead", "v").limit(train_rows).select("v").toArrow()["v"].combine_chunks()
    x = pairs_of(_unit(_rows(sample)))
    books = train(x, eta)
    finer = train(x - decode(books, encode(x, books, eta)), 1.0, rounds=8)  # for what is left over

    def index(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, v = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rep", "lead", "single")]), _rows(table.column("v").combine_chunks())
        packed, slacks = [], []
        for a in range(0, len(v), 2048):
            x = pairs_of(_unit(v[a : a + 2048]))
            code = encode(x, books, eta)
            coded = decode(books, code)
            rest = encode(x - coded, finer, 1.0, passes=0)
            packed.append(np.stack((pack_codes(code), pack_codes(rest))))
            slacks.append(np.stack((*slack(x, coded), *slack(x, coded + decode(finer, rest)))))
        return pa.table({n: pa.array([x.tobytes()], pa.binary()) for n, x in (("ids", ids), ("codes", np.concatenate(packed, 1)), ("slacks", np.concatenate(slacks, 1)), ("rows", v))})

    def together(table: pa.Table) -> pa.Table:
        v = _unit(_rows(table.combine_chunks().column("v").combine_chunks()))
        return pa.table({"asked": pa.array([table.column("rep").to_numpy().astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([v.tobytes()], pa.binary())})

    def blocks(d: DataFrame, size: int, f, ddl: str) -> DataFrame:
        n = max(1, -(-d.count() // size))
        return d.withColumn("b", F.pmod(F.xxhash64("rep"), F.lit(n))).groupBy("b").applyInArrow(f, ddl)

    single_precision = rows.schema["v"].dataType.elementType.typeName() == "float"
    block = min(block, max(1, (8 << 20) // (common["d"] * (4 if single_precision else 8))))  # a block's vectors go with its codes
    coded = stage(blocks(reps, block, index, "ids binary, codes binary, slacks binary, rows binary"), "codes")
    asking = stage(blocks(asked, query_block, together, "asked binary, vectors binary"), "asking")

    def scan_blocks(batches):
        reached = {}  # per block of queries, the best exact scores of this task so far
        for batch in batches:
            for r in range(batch.num_rows):
                ids, codes, slacks, x, asked, vectors = (batch.column(c)[r].as_py() for c in ("ids", "codes", "slacks", "rows", "asked", "vectors"))
                (ids, lead, single), who = np.frombuffer(ids, np.int64).reshape(3, -1), np.frombuffer(asked, np.int64)
                own = Block(
                    lead, single.astype(bool), _unit(np.frombuffer(x, np.float32 if single_precision else np.float64).reshape(len(ids), -1)),
                    list(np.frombuffer(codes, np.uint8).reshape(2, len(ids), -1)), [(p, q) for p, q in np.frombuffer(slacks).reshape(2, 2, -1)],
                )
                vectors = np.frombuffer(vectors).reshape(len(who), -1)
                top = reached.setdefault(asked, np.full(len(who), -2.0))
                for a in range(0, len(who), 32):
                    parts = pairs_of(vectors[a : a + 32])
                    scores, fine = scan(tables(parts, books), own.codes[0]), tables(parts, finer)
                    best = [own.nearest(s, fine[q - a], vectors[q], k, rerank, top[q]) for q, s in enumerate(scores, a)]
                    for q, (_, exact) in enumerate(best, a):
                        if len(exact) == 2 * k:
                            top[q] = max(top[q], exact[-1])
                    at = np.concatenate([b for b, _ in best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(who[a : a + 32], [len(b) for b, _ in best])), pa.array(ids[at]), pa.array(lead[at]), pa.array(single[at] == 1), pa.array(np.concatenate([e for _, e in best]))], ["q", "rep", "lead", "single", "score"])

    scanned = asking.repartition("asked").crossJoin(coded).mapInArrow(scan_blocks, "q long, rep long, lead long, single boolean, score double")
    first = [F.desc("score"), "lead", "rep"]
    alone = F.row_number().over(Window.partitionBy("q", "lead", "single").orderBy(*first))
    kept = scanned.withColumn("alone", alone).where(f"not single or alone <= {k}")
    scored = kept.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(*first))).where(F.col("nth") <= 2 * k).select("q", "rep", "score")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = scored.join(members.select("rep", F.explode("ids").alias("id")), "rep").withColumn("nth", F.row_number().over(ranked))
    lists = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("near"))
    mine = queries.join(lists, queries["rep"] == lists["q"]).select("query_id", F.slice(F.expr("filter(near, x -> x.id <> query_id)"), 1, k).alias("near"))
    return mine.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
