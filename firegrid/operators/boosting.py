"""Gradient-boosted trees by histograms.

Trees grow level by level on the residuals of the log-odds: leaves hold mean
residuals, splits are sought at the nine deciles of each feature among a node's
rows. Rows are packed into blocks once, and tasks walk the blocks in NumPy: a
level passes over them twice. The first time, rows, residuals and extremes are
summed up by node, feature and range of values (ranges are fixed once, by
quantiles); the sums say in which range each decile lies. The second time only
rows of these ranges, some ``9 / ranges`` of all, are summed up by value, for the
exact order statistics and the residuals up to them. Tasks add up what they hold
and Spark adds up the tasks. Sums by range and candidate splits are all that the
driver sees: at most ``2**depth`` nodes times features times ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import spread_out, staged
from .scoring import tree_column

DECILES = range(1, 10)
_BLOCK = "y binary, z binary, v array<binary>, c array<binary>"
_KINDS = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]


def _block_batch(y: list, z: list, v: list, c: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((y, z, v, c), _KINDS, strict=True)], ["y", "z", "v", "c"])


def _packed(t: DataFrame, cuts: list[list[float]], start: float) -> tuple[DataFrame, np.dtype]:
    """The rows ``y, v0, v1, ...`` packed, spread over tasks and written: a row for up to a batch of them, with labels ``y`` (NaN: none), features ``v`` and their ranges ``c`` between ``cuts`` as bytes, and log-odds ``z`` (one for all at first). Also the type of ``c``."""
    kind = np.min_scalar_type(max(map(len, cuts)))

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            features = [batch[f"v{k}"] for k in range(len(cuts))]
            xs = [x.to_numpy(zero_copy_only=False) for x in features]
            if any(x.null_count for x in features) or any(np.isnan(x).any() for x in xs):
                raise ValueError("features must not be null or NaN")
            ranges = [np.searchsorted(cut, x, "right").astype(kind).tobytes() for cut, x in zip(cuts, xs, strict=True)]
            yield _block_batch([batch["y"].to_numpy(zero_copy_only=False).tobytes()], [np.float64(start).tobytes()], [[x.tobytes() for x in xs]], [ranges])

    return staged(spread_out(t.mapInArrow(pack, _BLOCK)), "blocks"), kind


def _values(node: dict, xs: list[np.ndarray]) -> np.ndarray | float:
    """What a tree says of rows; one number, where it is a single leaf."""
    if "value" in node:
        return node["value"]
    return np.where(xs[node["feature"]] <= node["threshold"], _values(node["left"], xs), _values(node["right"], xs))


def _nodes(node: dict, xs: list[np.ndarray]) -> np.ndarray | int:
    """The number of the open node that each row lies in; -1 for finished ones."""
    if "feature" not in node:
        return node.get("open", -1)
    return np.where(xs[node["feature"]] <= node["threshold"], _nodes(node["left"], xs), _nodes(node["right"], xs))


def _unpacked(batch: pa.RecordBatch, at: int, trees: list[dict], rate: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Labels, log-odds after ``trees`` and features of a block."""
    y, z, xs = np.frombuffer(batch["y"][at].as_buffer()), np.frombuffer(batch["z"][at].as_buffer()), [np.frombuffer(v.as_buffer()) for v in batch["v"][at]]
    z = np.broadcast_to(z, y.shape)
    for tree in trees:
        z = z + rate * _values(tree, xs)
    return y, z, xs


def _walk(kind: np.dtype, root: dict, trees: list[dict], rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """A reader of a task's blocks: of rows in open nodes of ``root`` the nodes, residuals after ``trees`` (0 without a label), features and ranges."""

    def walk(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                y, z, xs = _unpacked(batch, at, trees, rate)
                node = np.broadcast_to(_nodes(root, xs), y.shape)
                cs = [np.frombuffer(c.as_buffer(), kind) for c in batch["c"][at]]
                with np.errstate(over="ignore"):
                    r = np.nan_to_num(y - 1 / (1 + np.exp(-z)), nan=0.0)
                if (node < 0).any():
                    open_ = np.flatnonzero(node >= 0)
                    node, r, xs, cs = node[open_], r[open_], [x[open_] for x in xs], [c[open_] for c in cs]
                yield node, r, xs, cs

    return walk


def _range_sums(blocks: DataFrame, walk: Callable, n: int, cells: int, width: int) -> list:
    """``cell, n, s, lo, hi``: rows, residuals and extremes by ``cell``: feature times ``cells``, plus node times ``width``, plus range."""

    def add(batches):
        count, s, lo, hi = np.zeros((n, cells), np.int64), np.zeros((n, cells)), np.full((n, cells), np.inf), np.full((n, cells), -np.inf)
        for node, r, xs, cs in walk(batches):
            for k, (x, c) in enumerate(zip(xs, cs, strict=True)):
                at = node * width + c
                count[k] += np.bincount(at, minlength=cells)
                s[k] += np.bincount(at, r, cells)
                np.minimum.at(lo[k], at, x)
                np.maximum.at(hi[k], at, x)
        here = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(here), *(pa.array(a.ravel()[here]) for a in (count, s, lo, hi))], ["cell", "n", "s", "lo", "hi"])

    sums = blocks.mapInArrow(add, "cell long, n long, s double, lo double, hi double")
    return sums.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # bounded: see above


def _value_sums(blocks: DataFrame, walk: Callable, wanted: np.ndarray, width: int, rows: int = 200_000) -> DataFrame:
    """``cell, v, n, s``: rows and residuals by value in the wanted cells of :func:`_range_sums`, added up within about so many rows of a task."""
    cells = wanted.shape[1]

    def summed(kept):
        cell, v, r = (np.concatenate(a) for a in zip(*kept, strict=True))
        order = np.lexsort((v, cell))
        cell, v, r = cell[order], v[order], r[order]
        first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (v[1:] != v[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(a) for a in (cell[first], v[first], np.diff(np.append(first, len(v))), np.add.reduceat(r, first))], ["cell", "v", "n", "s"])

    def add(batches):
        kept, size = [], 0
        for node, r, xs, cs in walk(batches):
            for k, (x, c) in enumerate(zip(xs, cs, strict=True)):
                at = node * width + c
                take = np.flatnonzero(wanted[k, at])
                if len(take):
                    kept.append((at[take] + k * cells, x[take], r[take]))
                    size += len(take)
            if size >= rows:
                yield summed(kept)
                kept, size = [], 0
        if kept:
            yield summed(kept)

    return blocks.mapInArrow(add, "cell long, v double, n long, s double")


def _candidates(blocks: DataFrame, walk: Callable, n: int, nodes: int, width: int) -> tuple[dict, list]:
    """``{node: (rows, residuals)}`` and candidate splits ``(node, feature, decile, threshold, rows, residuals)`` with what is at most the threshold."""
    cells, groups = nodes * width, {}
    for row in sorted(_range_sums(blocks, walk, n, cells, width)):
        groups.setdefault((row["cell"] % cells // width, row["cell"] // cells), []).append(row)
    totals, found, open_, wanted = {}, [], [], np.zeros((n, cells), bool)
    for (node, feature), rows in groups.items():
        size = sum(row["n"] for row in rows)
        if feature == 0:
            totals[node] = (size, math.fsum(row["s"] for row in rows))
        for d in DECILES:
            at, before, s = min(size * d // 10, size - 1), 0, 0.0
            for row in rows:
                if at < before + row["n"]:
                    break
                before, s = before + row["n"], s + row["s"]
            if row["lo"] == row["hi"]:
                found.append((node, feature, d, row["lo"], before + row["n"], s + row["s"]))
            else:
                open_.append((node, feature, row["cell"], d, at, before, s))
                wanted[feature, row["cell"] % cells] = True
    if open_:
        need = F.broadcast(blocks.sparkSession.createDataFrame(open_, "node int, feature int, cell long, decile int, at long, before long, above double"))  # at most nine per node and feature
        values = _value_sums(blocks, walk, wanted, width).repartition("cell").groupBy("cell", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        w = Window.partitionBy("cell").orderBy("v")
        values = values.withColumn("upto", F.sum("n").over(w)).withColumn("s", F.sum("s").over(w)).join(need, "cell")
        place = F.col("at") - F.col("before")
        hit = values.where((place < F.col("upto")) & (place >= F.col("upto") - F.col("n")))
        found += [tuple(row) for row in hit.select("node", "feature", "decile", "v", F.col("before") + F.col("upto"), F.col("above") + F.col("s")).collect()]
    return totals, found


def _grow(blocks: DataFrame, kind: np.dtype, n: int, width: int, depth: int, least: int, trees: list[dict], rate: float) -> dict:
    """One tree on the residuals after ``trees``, over ``n`` features of up to ``width`` ranges."""
    root: dict = {}
    level = [root]
    for step in range(depth + 1):
        for at, node in enumerate(level):
            node["open"] = at
        totals, found = _candidates(blocks, _walk(kind, root, trees, rate), n, len(level), width) if step < depth else (None, [])
        after = []
        for at, node in enumerate(level):
            del node["open"]
            size, s = totals[at] if totals is not None else node.pop("sums")
            node.pop("sums", None)
            best = None
            for _, feature, decile, threshold, below, s_below in sorted(c for c in found if c[0] == at and size >= least):
                if 0 < below < size:
                    # The split with the least squared error has the largest sum of squares of sums over counts.
                    gain = round(s_below**2 / below + (s - s_below) ** 2 / (size - below), 9)
                    if best is None or gain > best[0]:
                        best = (gain, feature, threshold, below, s_below)
            if best is None:
                node["value"] = s / size
                continue
            _, feature, threshold, below, s_below = best
            left, right = {"sums": (below, s_below)}, {"sums": (size - below, s - s_below)}
            node.update(feature=feature, threshold=threshold, left=left, right=right)
            after += [left, right]
        level = after
        if not level:
            break
    return root


def fit_boosted(df: DataFrame, columns: list[str], label: str = "label", rounds: int = 10, depth: int = 3, rate: float = 0.1, least: int = 20, ranges: int = 256, fold: int = 10) -> dict:
    """A model for :func:`.scoring.score_artifact` without a calibrator: ``features, fill, start, rate, trees``.

    A node with fewer than ``least`` rows is a leaf; ties of splits go to the first
    feature, then the lowest decile. Features must not be null or NaN. After every
    ``fold`` trees the rows' log-odds are written down, so a pass goes through no more
    of them. A table without rows raises ValueError.
    """
    n = len(columns)
    t = df.select(F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(columns)))
    points = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    size, positives, *cuts = t.agg(F.count("*"), F.sum("y"), *(F.array_distinct(F.percentile_approx(f"v{k}", points, F.lit(10 * ranges))) for k in range(n))).first()
    if not size:
        raise ValueError("there is nothing to fit on")
    p = min(max(positives / size, 1e-6), 1 - 1e-6)
    start, trees, since = math.log(p / (1 - p)), [], 0
    cuts = [sorted(own or [0.0]) for own in cuts]
    blocks, kind = _packed(t, cuts, start)
    width = max(map(len, cuts)) + 1
    for k in range(rounds):
        if k and k % fold == 0:
            blocks, since = staged(blocks.mapInArrow(_moved(trees[since:], rate), _BLOCK), "boosted"), k
        trees.append(_grow(blocks, kind, n, width, depth, least, trees[since:], rate))
    return {"features": list(columns), "fill": dict.fromkeys(columns, 0.0), "start": start, "rate": rate, "trees": trees}


def _moved(trees: list[dict], rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks with their log-odds after ``trees``."""

    def move(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                z = _unpacked(batch, at, trees, rate)[1]
                yield _block_batch([batch["y"][at].as_py()], [z.tobytes()], [batch["v"][at].as_py()], [batch["c"][at].as_py()])

    return move


def score_boosted(df: DataFrame, model: dict, name: str = "fitted") -> DataFrame:
    """The model's probability for each row."""
    raw = F.lit(float(model["start"]))
    for tree in model["trees"]:
        raw = raw + float(model["rate"]) * tree_column(tree, model["features"])
    return df.withColumn(name, 1 / (1 + F.exp(-raw)))


def split_counts(model: dict) -> dict[str, int]:
    """How many splits each feature has."""
    counts = dict.fromkeys(model["features"], 0)

    def walk(node: dict) -> None:
        if "feature" in node:
            counts[model["features"][node["feature"]]] += 1
            walk(node["left"])
            walk(node["right"])

    for tree in model["trees"]:
        walk(tree)
    return counts
