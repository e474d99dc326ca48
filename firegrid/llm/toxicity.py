"""Toxic passages as maximum-scoring segments.

Tokens are words and the beginnings of longer words. Their log-odds between
toxic and clean labelled texts, with a Dirichlet prior, make a lexicon of those
that differ significantly from 0, either way. Walking through a text, a lexicon
token adds its log-odds and a token that tells neither way costs a little; a
linear scan finds all maximal segments. Scores of maximal segments follow an
extreme-value law, whose decay and scale are fitted on the segments of clean
labelled texts; it gives a segment's expected number of chance occurrences. A
text's evidence sums over its significant segments and is turned into a
probability on labelled texts. Every labelled text is judged by the lexicon
without it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, stage, text_steps
from .langid import fold
from .letters import letter_events

#: Lengths of the word beginnings that count as tokens beside whole words.
PREFIXES = range(3, 9)


def token_features(events: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (words, 1 + prefixes) of each word and its proper beginnings, 0 where there is none; and each text's first word."""
    n = len(events)
    if not n:
        return np.zeros((0, 1 + len(PREFIXES)), np.uint64), np.zeros(len(begin), np.int64)
    letter = events != 0
    starts_mask = letter.copy()
    starts_mask[1:] &= ~letter[:-1]
    texts = begin[:-1][begin[:-1] < begin[1:]]
    starts_mask[texts] = letter[texts]
    starts = np.flatnonzero(starts_mask)
    stops = letter.copy()
    stops[:-1] &= ~letter[1:] | starts_mask[1:]
    ends = np.flatnonzero(stops) + 1
    place = np.arange(n) - np.maximum.accumulate(np.where(starts_mask, np.arange(n), 0))
    powers = np.cumprod(np.concatenate(([1], np.full(int(place.max()), 0x9E3779B97F4A7C15, np.uint64))).astype(np.uint64), dtype=np.uint64)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(events.astype(np.uint64) + np.uint64(1)) * powers[place] * letter, dtype=np.uint64)))
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = mix64(run[ends] - run[starts])
    length = ends - starts
    for k, size in enumerate(PREFIXES, 1):
        some = length > size
        out[some, k] = mix64((run[starts[some] + size] - run[starts[some]]) ^ np.uint64(size))
    return out, np.searchsorted(starts, begin)


def maximal_segments(positions: np.ndarray, weights: np.ndarray, cost: float, losses: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first token, last token, score)`` in linear time (Ruzzo and Tompa's candidate list).

    Positive ``weights`` stand at ``positions``; what the tokens before each of
    them take off is ``losses``, or ``cost`` for each token.
    """
    if losses is None:
        losses = cost * (np.diff(positions, prepend=-1) - 1)
    parts: list[list] = []  # first, last, total before, total after, index of the nearest earlier one with a smaller total before
    total = 0.0
    for p, w, loss in zip(positions.tolist(), weights.tolist(), losses.tolist(), strict=True):
        total -= loss
        first, left = p, total
        total += w
        right = total
        while True:
            j = len(parts) - 1
            while j >= 0 and parts[j][2] >= left:
                j = parts[j][4]
            if j < 0 or parts[j][3] >= right:
                parts.append([first, p, left, right, j])
                break
            first, left = parts[j][0], parts[j][2]
            del parts[j:]
    return [(a, b, r - x) for a, b, x, r, _ in parts]


@dataclass
class Lexicon:
    """Sorted token hashes with their log-odds, and the cost of any other token."""

    keys: np.ndarray
    weights: np.ndarray
    cost: float

    def of(self, features: np.ndarray) -> np.ndarray:
        """Each word's weight: the largest of its tokens' that are in the lexicon, 0 if none is."""
        out = np.full(len(features), -np.inf)
        if len(self.keys):
            for k in range(features.shape[1]):
                at = np.searchsorted(self.keys, features[:, k])
                at[at == len(self.keys)] = 0
                np.maximum(out, np.where((self.keys[at] == features[:, k]) & (self.weights[at] != 0), self.weights[at], -np.inf), out=out)
        return np.where(np.isfinite(out), out, 0.0)

    def segments(self, weights: np.ndarray) -> list[tuple[int, int, float]]:
        """A text's maximal segments, from its words' weights."""
        at = np.flatnonzero(weights > 0)
        lost = np.cumsum(np.where(weights == 0, self.cost, np.maximum(-weights, 0)))[at]
        return maximal_segments(at, weights[at], self.cost, np.diff(lost, prepend=0.0))


@dataclass
class Law:
    """The number of chance segments of a score of at least s expected in n words: ``scale * n * exp(-decay * s)``."""

    decay: float
    scale: float

    @classmethod
    def fitted(cls, segments: int, total: float, least: float, words: int) -> Law:
        """By maximum likelihood from ``segments`` maximal segments of clean texts of ``words`` words in all, with their summed and least score. Without any, one segment is expected in all these words."""
        if not segments:
            return cls(1.0, 1 / max(words, 1))
        decay = segments / max(total - segments * least, 1e-3 * segments)
        return cls(decay, segments / max(words, 1) * float(np.exp(min(decay * least, 500.0))))

    def least_score(self, words: np.ndarray, most: float) -> np.ndarray:
        """A little less than the score of which ``most`` are expected."""
        return np.log(np.maximum(self.scale * words, 1e-300) / most) / self.decay - 1e-9

    def log_expected(self, words: Column, score: Column) -> Column:
        return F.log(words * F.lit(self.scale)) - F.lit(self.decay) * score


def _feature_counts(batches):
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j, data, offsets in text_steps(batch.column("_text"), 1 << 20):
            features, first = token_features(*letter_events(data, offsets))
            seen = [[], []]
            for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                seen[int(toxic[i + t])].append(np.unique(features[a:b]))  # once a text, so that no repetitive text makes the lexicon
            for t in (0, 1):
                if seen[t]:
                    some, n = np.unique(np.concatenate(seen[t]), return_counts=True)
                    n = n[some != 0]
                    some = some[some != 0]
                    zero = np.zeros(len(some), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n if t else zero, pa.int64()), pa.array(zero if t else n, pa.int64())], ["token", "toxic", "clean"])


def log_odds(toxic, clean, toxic_docs: int, clean_docs: int):
    """z-score and value of the log-odds under a uniform Dirichlet prior of one pseudo-count; columns or arrays."""
    log, sqrt = (F.log, F.sqrt) if isinstance(toxic, Column) else (np.log, np.sqrt)
    odds = log((toxic + 1.0) / (toxic_docs + 2.0)) - log((clean + 1.0) / (clean_docs + 2.0))
    return odds / sqrt(1 / (toxic + 1.0) + 1 / (clean + 1.0)), odds


_SEGMENTS = "array<struct<first:int,last:int,score:double>>"


def _scan(docs: DataFrame, lexicon: Lexicon, kind: str, law: Law | None = None, most: float = 1.0) -> DataFrame:
    """``_id, words, segments`` per row of ``_id, _text``: the number of words and all maximal segments; with a law, those of which fewer than ``most`` are expected by chance."""
    segment = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_steps(batch.column("_text"), 1 << 20):
                features, first = token_features(*letter_events(data, offsets))
                weights = lexicon.of(features)
                hot = np.concatenate(([0], np.cumsum(weights > 0)))
                found = [[] for _ in range(j - i)]
                words = np.diff(first)
                least = law.least_score(words, most) if law else np.full(j - i, -np.inf)
                for t in np.flatnonzero(hot[first[1:]] > hot[first[:-1]]):
                    found[t] = [{"first": a, "last": b, "score": s} for a, b, s in lexicon.segments(weights[first[t] : first[t + 1]]) if s >= least[t]]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(words), pa.array(found, segment)], ["_id", "words", "segments"])

    return docs.mapInArrow(run, f"_id {kind}, words long, segments {_SEGMENTS}")


def _judged(scanned: DataFrame, law: Law, most: float) -> DataFrame:
    """With ``passages``, the segments of which fewer than ``most`` are expected by chance, and ``evidence``, minus the sum of the logs of their expectations."""
    passage = lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["score"].alias("score"), law.log_expected(F.col("words"), s["score"]).alias("log_expected"))
    found = F.filter(F.transform("segments", passage), lambda p: p["log_expected"] <= float(np.log(most)))
    t = scanned.withColumn("passages", found).drop("segments")
    return t.withColumn("evidence", F.aggregate("passages", F.lit(0.0), lambda a, p: a - p["log_expected"]))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps on lightly penalised likelihood."""
    a, b = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * x).sum() - ridge * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 20_000, least_z: tuple[float, ...] = (3.5, 4.25, 5.0), cost: float = 0.1, most: float = 0.05) -> DataFrame:
    """One row per input row: ``<id_col>, held_out, score, passages``.

    Learns from labelled rows outside fold 1, at most ``train_docs`` of them (those
    of the smallest id hashes): the lexicon, the extreme-value law, and the final
    probability from each text's evidence, the last two under the lexicon without
    that text. Lexicon tokens have a log-odds z-score of at least one of ``least_z``
    either way: the more texts are labelled, the more chance tokens pass a low bar
    and add up in long texts, so the bar is the one under which the labelled texts
    are predicted with the least loss. Any other token takes off ``cost``; segments count if fewer than
    ``most`` such are expected by chance. Null and empty texts, and those without
    letters, have no passages and the lowest score. Null labels teach nothing;
    without labels of both kinds the score is the share of label 1 (0 if there
    are no labels). Rows that repeat an id are scored each; an id with several
    labels takes the largest. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema["_id"].dataType.simpleString()
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("toxic")).where("_id is not null and toxic is not null").groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(fold("_id") != 1).orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    sample = stage(docs.join(stage(known, "known"), "_id"), "sample")
    shares = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), F.avg("toxic").alias("p")).first()
    toxic_docs, clean_docs = shares["t"] or 0, shares["n"] - (shares["t"] or 0)
    held = (fold("_id") == 1).alias("held_out")
    if not toxic_docs or not clean_docs:
        empty = F.from_json(F.lit("[]"), "array<struct<first:int,last:int,score:double,log_expected:double>>")
        return docs.select(F.col("_id").alias(id_col), held, F.lit(float(shares["p"] or 0)).alias("score"), empty.alias("passages"))

    counts = sample.mapInArrow(_feature_counts, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    z, _ = log_odds(F.col("toxic"), F.col("clean"), toxic_docs, clean_docs)
    words = counts.where(F.abs(z) >= min(least_z)).select("token", "toxic", "clean").toArrow()  # significant tokens only
    by_key = np.argsort(words["token"].to_numpy().view(np.uint64))
    keys, hits, misses = (words[c].to_numpy()[by_key] for c in ("token", "toxic", "clean"))

    def lexicon(least: float, less_toxic: int, less_clean: int) -> Lexicon:
        """From all labelled texts but one toxic or clean one that holds the token."""
        z, odds = log_odds(np.maximum(hits - less_toxic, 0), np.maximum(misses - less_clean, 0), toxic_docs - less_toxic, clean_docs - less_clean)
        return Lexicon(keys.view(np.uint64), np.where(np.abs(z) >= least, odds, 0.0), cost)

    def fitted(least: float) -> tuple[float, float, Law, float, float]:
        """Mean loss on the labelled texts of lexica of one significance, with the law and the curve. A labelled text's own evidence is taken without its part in the lexicon, else the curve would be too sure."""
        checked = [_scan(sample.where(F.col("toxic") == t), lexicon(least, t, 1 - t), kind).withColumn("toxic", F.lit(t)) for t in (0, 1)]
        checked = stage(checked[0].unionByName(checked[1]), "checked")
        clean = checked.where("toxic = 0")
        seen = clean.select(F.explode("segments.score").alias("s")).agg(F.count("s"), F.sum("s"), F.min("s")).first()
        law = Law.fitted(seen[0], seen[1] or 0.0, seen[2] or 0.0, clean.agg(F.sum("words")).first()[0] or 0)
        curve = _judged(checked, law, most).select("evidence", "toxic").toArrow()  # two numbers for each of at most train_docs rows
        x, y = np.log1p(curve["evidence"].to_numpy()), curve["toxic"].to_numpy().astype(float)
        a, b = platt(x, y)
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (max(a, 0.0) * x + b)).mean()), least, law, max(a, 0.0), b

    _, least, law, a, b = min(map(fitted, least_z), key=lambda f: f[:2])
    score = 1 / (1 + F.exp(-(F.lit(float(a)) * F.log1p("evidence") + F.lit(float(b)))))
    return _judged(_scan(docs, lexicon(least, 0, 0), kind, law, most), law, most).select(F.col("_id").alias(id_col), held, score.alias("score"), "passages")
