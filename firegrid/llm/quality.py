"""Quality by a sparse ensemble of rules.

Statistics of whole texts feed a small forest; every path of its trees, from the
root to any node, is a conjunction of threshold tests, a rule. An L1-penalised
logistic regression over the rules keeps a few of them with weights, and these
are compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_steps, word_hashes, words_of
from .langid import fold

#: Classes of bytes whose share of a text is a statistic.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "mark": b".,;:?'\"()-",
    "bang": b"!",
    "symbol": b"#$%&*@^~=+_<>{}[]/\\`",
    "bar": b"|",
    "line": b"\n",
    "control": bytes([*range(9), *range(14, 32), 127]),
}
STATISTICS = ["bytes", "words", "mean_word", "longest_word", "space", "wide", *CLASSES, "repeated_word", "repeated_line", "mean_line"]


def _shares(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Each statistic of each text; an empty text has zeros."""
    size = np.diff(offsets)
    starts, first = words_of(data, offsets)
    words = np.diff(first)
    out = {"bytes": np.log1p(size), "words": np.log1p(words)}
    wide = np.zeros(256, bool)
    wide[128:] = True
    for name, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[name] = _shares(data, offsets, table)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    out["space"], out["wide"] = _shares(data, offsets, space), _shares(data, offsets, wide)
    out["mean_word"] = size * (1 - out["space"]) / np.maximum(words, 1)
    longest = np.zeros(len(size), np.int64)
    full = np.flatnonzero(words)
    if len(full):
        blank = np.flatnonzero(space[data])
        ends = np.append(blank, len(data))[np.searchsorted(blank, starts)]
        ends = np.minimum(ends, offsets[1:][np.searchsorted(offsets[1:], starts, "right")])
        longest[full] = np.maximum.reduceat(ends - starts, first[full])
    out["longest_word"] = np.log1p(longest)
    hashes = word_hashes(data, starts)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][full]] = False
    out["repeated_word"] = _per_text(again, first) / np.maximum(words, 1)

    texts = np.flatnonzero(size)
    lines = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][texts])
    lines = lines[lines < len(data)]
    of = np.searchsorted(offsets[1:], lines, "right")
    marks = word_hashes(data, lines)
    order = np.lexsort((marks, of))
    repeated = np.zeros(len(lines), bool)
    repeated[1:] = (marks[order][1:] == marks[order][:-1]) & (of[order][1:] == of[order][:-1])
    number = np.bincount(of, minlength=len(size))
    out["repeated_line"] = np.bincount(of[order], repeated, len(size)) / np.maximum(number, 1)
    out["mean_line"] = np.log1p(size / np.maximum(number, 1))
    return out


def text_statistics(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``_id``, the columns ``extra`` and a double column per statistic, from ``_text``."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_steps(batch.column("_text")):
                found = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("_id", *extra)), *(pa.array(found[s].astype(np.float64)) for s in STATISTICS)], ["_id", *extra, *STATISTICS])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("_id", *extra)}
    return docs.select("_id", *extra, "_text").mapInArrow(run, ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{s} double" for s in STATISTICS)]))


Rule = tuple[tuple[int, bool, float], ...]

_NODE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)$")


def tree_rules(described: str) -> list[Rule]:
    """The path to every node of every tree in MLlib's description of a forest, as sorted tests ``(statistic, at most, bound)``."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in described.splitlines():
        node = _NODE.match(line)
        if not node:
            if line.strip().startswith("Tree "):
                path = []
            continue
        depth = len(node[1])
        path = [p for p in path if p[0] < depth] + [(depth, (int(node[3]), node[4] == "<=", float(node[5])))]
        rules[tuple(sorted({test for _, test in path}))] = None
    return list(rules)


def rule_column(rule: Rule) -> Column:
    tests = (F.col(STATISTICS[k]) <= bound if below else F.col(STATISTICS[k]) > bound for k, below, bound in rule)
    return F.when(reduce(and_, tests), 1.0).otherwise(0.0)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 20_000, trees: int = 20, depth: int = 3, penalty: float = 0.001) -> DataFrame:
    """One row per input row: ``<id_col>, held_out, score`` and the text's statistics.

    Learns from labelled rows outside fold 1, at most ``train_docs`` of them (those
    of the smallest id hashes). A null text counts as empty; its statistics are
    zeros, and it is scored like any other. Null labels teach nothing; an id with
    several labels takes the largest; without labels of both kinds the score is
    the share of label 1 (0.5 if there are no labels). Rows that repeat an id
    are scored each; an empty table gives an empty result.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label")).where("_id is not null and label is not null").groupBy("_id").agg(F.max("label").cast("double").alias("label"))
    known = stage(known.where(fold("_id") != 1).orderBy(F.xxhash64("_id"), "_id").limit(train_docs), "known")
    sample = stage(text_statistics(docs.join(known, "_id"), ["label"]), "sample")
    held = (fold("_id") == 1).alias("held_out")
    share = sample.agg(F.avg("label").alias("p"), F.countDistinct("label").alias("k")).first()
    scored = text_statistics(docs, [])
    if share["k"] < 2:
        return scored.select(F.col("_id").alias(id_col), held, F.lit(0.5 if share["p"] is None else float(share["p"])).alias("score"), *STATISTICS)

    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(sample.coalesce(1).sortWithinPartitions("_id")).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=7).fit(vectors)
    rules = tree_rules(forest.toDebugString) or [((0, False, -1.0),)]
    tested = sample.select("label", F.array(*map(rule_column, rules)).alias("r"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False).fit(tested.select("label", array_to_vector("r").alias("features")))
    kept = [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if w]
    total = reduce(add, (F.lit(w) * rule_column(r) for w, r in kept), F.lit(float(lasso.intercept)))
    return scored.select(F.col("_id").alias(id_col), held, (1 / (1 + F.exp(-total))).alias("score"), *STATISTICS)
