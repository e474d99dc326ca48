"""Language identification by interpolated Kneser-Ney character models.

For each language the counts of four-letter sequences within words give an
interpolated Kneser-Ney model of orders 4 to 1. All models share one sorted
array of hashed sequences per order, with a log probability per language beside
it, so one search scores a position for every language. A text gets the language
of the lowest cross-entropy per event; thresholds for rejection come from
labelled texts that the counts have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stage, text_steps
from .letters import letter_events

ORDER = 4
UNKNOWN = "und"


def fold(id_col: str | Column) -> Column:
    """The fold of an id: crc32 of its text, modulo 3. Fold 1 is held out."""
    return F.crc32(F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")).cast("binary")) % 3


def grams(events: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The event and the three before it, packed into 64 bits; nothing before the word or the text counts (0)."""
    g = events.astype(np.uint64)
    out = g.copy()
    first = begin[:-1][begin[:-1] < begin[1:]]
    open_ = np.ones(len(g), bool)
    for k in range(1, ORDER):
        before = np.zeros(len(g), np.uint64)
        before[k:] = g[:-k] if k < len(g) else 0
        for j in range(k):
            at = first + j
            before[at[at < len(g)]] = 0
        open_ &= before != 0
        out |= np.where(open_, before, np.uint64(0)) << np.uint64(16 * k)
    return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


@dataclass
class CharModel:
    """Sorted hash arrays by order: ``keys[k]`` with ``logp[k]``, and for contexts ``ctx[k]`` with ``back[k]`` (log weights of the lower order)."""

    languages: list[str]
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    ctx: list[np.ndarray]
    back: list[np.ndarray]
    unseen: np.ndarray

    def score(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each packed sequence's last event, a column per language."""
        if order == 0:
            return np.broadcast_to(self.unseen, (len(g), len(self.languages)))
        mask = np.uint64((1 << 16 * order) - 1)
        some = g & mask
        at, hit = _lookup(self.keys[order], mix64(some + np.uint64(order)))
        out = self.logp[order][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self.score(g[miss], order - 1)
            at, hit = _lookup(self.ctx[order], mix64((some[miss] >> np.uint64(16)) + np.uint64(order)))
            out[miss] = lower + np.where(hit[:, None], self.back[order][at], 0)
        return out


def build_model(languages: list[str], which: np.ndarray, g: np.ndarray, count: np.ndarray) -> CharModel:
    """Interpolated Kneser-Ney from counts of packed four-event sequences of each language."""
    n = len(languages)
    mask = lambda k: np.uint64((1 << 16 * k) - 1)
    per: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    for k in range(n):
        some = which == k
        level = {ORDER: (g[some], count[some].astype(np.float64))}
        types = g[some]
        for order in range(ORDER - 1, 0, -1):  # how many different events stand before
            types, level_count = np.unique(types & mask(order), return_counts=True)
            level[order] = (types, level_count.astype(np.float64))
        per.append(level)
    union = {order: np.unique(np.concatenate([p[order][0] for p in per])) for order in range(1, ORDER + 1)}
    keys, logp, ctx, back = [[np.zeros(0)] * (ORDER + 1) for _ in range(4)]
    events = max(2, len(union[1]) + 1)
    unseen, lower = np.zeros(n, np.float32), None
    for order in range(1, ORDER + 1):
        grams_, contexts = union[order], np.unique(union[order] >> np.uint64(16))
        prob, weight = np.zeros((len(grams_), n)), np.ones((len(contexts), n))
        in_ctx = np.searchsorted(contexts, grams_ >> np.uint64(16))
        in_low = np.searchsorted(union[order - 1], grams_ & mask(order - 1)) if order > 1 else None
        for k in range(n):
            own, c = per[k][order]
            if not len(own):
                continue
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            of = np.searchsorted(contexts, own >> np.uint64(16))
            total = np.bincount(of, c, len(contexts))
            kinds = np.bincount(of, minlength=len(contexts))
            seen = total > 0
            weight[seen, k] = discount * kinds[seen] / total[seen]
            at = np.searchsorted(grams_, own)
            prob[at, k] = np.maximum(c - discount, 0) / total[of]
        prob += weight[in_ctx] * (1 / events if order == 1 else lower[in_low])
        if order == 1:
            unseen = np.log(weight[0] / events).astype(np.float32)
            weight = np.ones_like(weight)
        lower = prob
        for arrays, values, names in ((keys, logp, grams_), (ctx, back, contexts)):
            hashed = mix64(names + np.uint64(order))
            by_hash = np.argsort(hashed)
            arrays[order] = hashed[by_hash]
            values[order] = np.log(np.maximum((prob if values is logp else weight)[by_hash], 1e-30)).astype(np.float32)
    return CharModel(languages, keys, logp, ctx, back, unseen)


def _count(batches):
    for batch in batches:
        lang = np.array(batch.column("_lang").to_pylist(), object)
        for i, j, data, offsets in text_steps(batch.column("_text")):
            events, begin = letter_events(data, offsets)
            g, of = grams(events, begin), np.repeat(np.arange(j - i), np.diff(begin))
            for name in set(lang[i:j]):
                some, counts = np.unique(g[(lang[i:j] == name)[of]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "g", "n"])


#: A score weighs a text's entropies as if it had at most so many letters: neighbouring sequences overlap, and all scores of longer texts would be 1. The prediction takes all letters.
MOST_WEIGHED = 40


def score_texts(model: CharModel, column: pa.Array):
    """Yield ``(i, j, events, best, entropy, score)`` for rows ``i:j``; ``best`` is -1 for texts without letters."""
    for i, j, data, offsets in text_steps(column, 1 << 20):
        events, begin = letter_events(data, offsets)
        n = np.diff(begin)
        best, entropy, score = np.full(j - i, -1), np.zeros(j - i), np.zeros(j - i)
        full = np.flatnonzero(n)
        if len(full):
            total = np.add.reduceat(model.score(grams(events, begin)), begin[full], axis=0, dtype=np.float64)
            rate = -total / n[full, None]
            best[full] = rate.argmin(1)
            entropy[full] = rate.min(1)
            odds = np.exp(np.minimum(n[full], MOST_WEIGHED)[:, None] * (entropy[full][:, None] - rate))
            score[full] = 1 / odds.sum(1)
        yield i, j, n, best, entropy, score


def _scored(docs: DataFrame, model: CharModel, kind: str) -> DataFrame:
    """``_id, events, best, entropy, score`` of each row of ``_id, _text``."""

    def run(batches):
        for batch in batches:
            for i, j, n, best, entropy, score in score_texts(model, batch.column("_text")):
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(n), pa.array(best, pa.int64()), pa.array(entropy), pa.array(score)], ["_id", "events", "best", "entropy", "score"])

    return docs.select("_id", "_text").mapInArrow(run, f"_id {kind}, events long, best long, entropy double, score double")


def choose(labelled: DataFrame, train_docs: int) -> DataFrame:
    """The ``train_docs`` rows of each ``_lang`` with the smallest id hashes, numbered ``nth``.

    A threshold on the hash, from the languages' row counts, leaves half as many
    again to be ranked, so that a language with most of the rows does not gather
    in one task. Where ids repeat so that too few stay, all are ranked.
    """
    place = F.shiftrightunsigned(F.xxhash64("_id"), 33)
    sizes = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}  # a row per language, as the models are
    spark = labelled.sparkSession
    small = F.broadcast if len(sizes) <= 10_000 else lambda t: t
    first = Window.partitionBy("_lang").orderBy("_place", "_id", "_text")
    for spare in (1.5, None):
        bounds = spark.createDataFrame([(k, 2**31 if spare is None else int(min(1.0, spare * train_docs / n) * 2**31)) for k, n in sizes.items()], "_of string, _most long")
        near = labelled.withColumn("_place", place).join(small(bounds), F.col("_lang") == F.col("_of")).where(F.col("_place") <= F.col("_most"))
        chosen = stage(near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= train_docs).select("_id", "_lang", "_text", "nth"), "sample")
        got = {r["_lang"]: r["count"] for r in chosen.groupBy("_lang").count().collect()}
        if all(got.get(k, 0) == min(n, train_docs) for k, n in sizes.items()):
            break
    return chosen


@dataclass
class Fitted:
    """A model and, by place of the language, the cross-entropy above which a text is rejected."""

    model: CharModel
    limit: np.ndarray

    def rejects(self, events: np.ndarray, best: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        return (best < 0) | ((events >= LEAST_EVENTS) & (entropy > self.limit[np.maximum(best, 0)]))


#: Shorter texts are never rejected for their cross-entropy.
LEAST_EVENTS = 20


def _columns(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2500, slack: float = 4.0) -> Fitted | None:
    """Learn from text and non-null language of rows outside fold 1; None if there is nothing to learn from. See :func:`identify`."""
    docs = _columns(df, id_col, text_col, lang_col)
    kind = docs.schema["_id"].dataType.simpleString()
    labelled = docs.where(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & (F.length("_text") > 0) & (fold("_id") != 1))
    sample = choose(labelled, train_docs)
    counts = sample.where("nth % 5 <> 0").mapInArrow(_count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    counts = counts.sort_by([("lang", "ascending"), ("g", "ascending")])
    names = counts["lang"].to_numpy(zero_copy_only=False)
    languages = sorted(set(names))
    model = build_model(languages, np.searchsorted(np.array(languages, object), names), counts["g"].to_numpy().view(np.uint64), counts["n"].to_numpy())
    seen = _scored(sample.where("nth % 5 = 0"), model, kind).where(F.col("events") >= LEAST_EVENTS).groupBy("best").agg(F.percentile("entropy", F.lit(0.5)).alias("mid"), F.percentile("entropy", F.lit(0.995)).alias("high")).collect()  # a row per language
    limit = np.full(len(languages), np.inf)
    for r in seen:
        limit[r["best"]] = r["mid"] + max(slack * (r["high"] - r["mid"]), 1.0)
    return Fitted(model, limit)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2500, slack: float = 4.0) -> DataFrame:
    """One row per input row: ``<id_col>, held_out, lang_pred, score, entropy, rejected``.

    Learns from text and non-null language of rows outside fold 1 only, at most
    ``train_docs`` rows of each language (those of the smallest id hashes): counts
    from four in five of them, rejection thresholds from the fifth. A text that is null or
    has no letter gets ``und`` and score 0 and is rejected; so is one of at least
    20 letters whose cross-entropy lies further above its language's median than
    ``slack`` times the distance to the 99.5 % point of the labelled texts, and by more than 1. If
    there is nothing to learn from, every text gets ``und``. ``score`` is the
    language's share of the likelihoods, with entropies per letter weighed by the
    number of letters, ``MOST_WEIGHED`` at most. Equal entropies go to
    the first language by name. Rows that repeat an id are scored each, as are
    rows with a null id, which teach nothing; an empty table gives an empty result.
    """
    docs = _columns(df, id_col, text_col, lang_col)
    fitted = fit(df, id_col, text_col, lang_col, train_docs, slack)
    out = [F.col("_id").alias(id_col), (fold("_id") == 1).alias("held_out")]
    if fitted is None:
        return docs.select(*out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    names, limits = (F.array(*map(F.lit, x)) for x in (fitted.model.languages, map(float, fitted.limit)))
    of = lambda a: F.element_at(a, (F.col("best") + 1).cast("int"))
    none = F.col("best") < 0
    pred = F.when(none, F.lit(UNKNOWN)).otherwise(of(names))
    rejected = F.when(none, True).otherwise((F.col("events") >= LEAST_EVENTS) & (F.col("entropy") > of(limits)))
    scored = _scored(docs, fitted.model, docs.schema["_id"].dataType.simpleString())
    return scored.select(*out, pred.alias("lang_pred"), "score", "entropy", rejected.alias("rejected"))


def known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 2500, slack: float = 4.0) -> DataFrame:
    """The rows that :func:`identify` does not reject, as they are; each row is judged on its own text, so no join is needed.

    Null texts and texts without a letter go. Rows that repeat an id, and rows
    with a null id, are judged each. If there is nothing to learn from (no row
    with a language outside fold 1), no language is known and no row stays; an
    empty table gives an empty one. Columns of any name are carried along.
    """
    fitted = fit(df, id_col, text_col, lang_col, train_docs, slack)
    if fitted is None:
        return df.limit(0)

    def run(batches):
        for batch in batches:
            for i, j, events, best, entropy, _ in score_texts(fitted.model, batch.column(text_col)):
                yield batch.slice(i, j - i).filter(pa.array(~fitted.rejects(events, best, entropy)))

    return df.mapInArrow(run, df.schema)
