"""Joins over the grid and over time, and neighbourhood kernels.

Range conditions are turned into equi-joins: cells join on exploded disks or on
blocks of cells and days, so plans shuffle on keys and never compare all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions.dates import latest_noon
from ..functions.grid import LEVEL, ROW, cell_disk, cell_distance, cell_level, cell_q, cell_r
from ..sources.staging import spread_out, staged

EXACT_KM = 1e-9


def top_per(df: DataFrame, keys: list[str], order: list, n: int = 1, name: str = "_n") -> DataFrame:
    """The first ``n`` rows of each key; Spark limits groups before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within ``keys`` by ``order``. Rows are sorted over ranges of both and numbered within ranges, whose offsets are sums of counts, so a key with many rows lies in several tasks, ties or not."""
    ranged = staged(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    t = ranged.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))).join(offsets, [*keys, "_range"])
    return t.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_per(df, keys, order).drop("_n")


def axial_length(dq: Column, dr: Column) -> Column:
    """Distance between two cell centres, in steps of the grid, from the differences of their axial coordinates."""
    return F.sqrt((dq * dq + dq * dr + dr * dr).cast("double"))


#: Point sets up to this size go to every task; larger ones are joined.
MOST_POINTS = 5_000

#: Distances that one NumPy step holds.
STEP = 1 << 20


def _few(points: DataFrame, point_key: str, most: int) -> pa.Table | None:
    """All points in order of their key, or None if there are over ``most``."""
    if points.limit(most + 1).count() > most:
        return None
    return points.orderBy(point_key).toArrow()  # at most `most` rows


def _distances(batch: pa.RecordBatch, points: pa.Table):
    """Yield ``(first, last, distances)`` for stretches of a batch of cells ``q, r`` to all points ``sq, sr``."""
    q, r, sq, sr = (t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for t, c in ((batch, "q"), (batch, "r"), (points, "sq"), (points, "sr")))
    step = max(1, STEP // max(1, len(sq)))
    for a in range(0, len(q), step):
        dq, dr = q[a : a + step, None] - sq, r[a : a + step, None] - sr
        yield a, min(a + step, len(q)), np.sqrt((dq * dq + dq * dr + dr * dr).astype(float))


def _first(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` smallest values, smallest first, ties to the smaller column."""
    k = min(k, d.shape[1])
    row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def nearest(cells: DataFrame, points: DataFrame, k: int, cell_key: str = "cell", point_key: str = "station", most: int = MOST_POINTS) -> DataFrame:
    """Cells ``q, r`` with their ``k`` nearest points ``sq, sr`` and the ``distance``, ties to the smaller point key.

    Points at one place are equally far from every cell, so the first ``k`` of each
    place by their key are enough. Up to ``most`` of those, each cell searches all
    of them where it is; the pairs are neither written down nor shuffled. Beyond,
    :func:`nearest_by_blocks`.
    """
    points = top_per(points, ["sq", "sr"], [point_key], k).drop("_n")
    few = _few(points, point_key, most)
    if few is None:
        return nearest_by_blocks(cells, staged(points, "points"), k, cell_key, point_key)
    names = [*cells.columns, *points.columns, "distance"]

    def search(batches):
        for batch in batches if few.num_rows else ():
            for a, _, d in _distances(batch, few):
                row, of = _first(d, k)
                own = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in cells_names), *(few.column(c).combine_chunks().take(pa.array(of)) for c in points_names), pa.array(d[row, of])], names)

    cells_names, points_names = cells.columns, points.columns
    return spread_out(cells).mapInArrow(search, StructType([*cells.schema, *points.schema, StructField("distance", DoubleType())]))


def nearest_by_blocks(cells: DataFrame, points: DataFrame, k: int, cell_key: str = "cell", point_key: str = "station") -> DataFrame:
    """:func:`nearest` for any number of points, by blocks of axial coordinates.

    A cell meets the points of its block and the eight around it. Whatever lies
    outside is further away than sqrt(3)/2 of a block's width, so cells whose
    ``k``-th point is nearer are done; the others go on with blocks four times as
    wide. The first width holds about ``2 k`` points in a block on average.
    """
    size = points.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{name}") for c in ("sq", "sr") for name, f in (("lo", F.min), ("hi", F.max)))).first()
    reach = cells.agg(*(f(c).alias(f"{c}_{name}") for c in ("q", "r") for name, f in (("lo", F.min), ("hi", F.max)))).first()
    if not size["n"] or reach["q_lo"] is None:
        return cells.crossJoin(points).withColumn("distance", F.lit(0.0)).limit(0)
    span = max(max(size[f"s{c}_hi"], reach[f"{c}_hi"]) - min(size[f"s{c}_lo"], reach[f"{c}_lo"]) for c in "qr") + 1
    area = (size["sq_hi"] - size["sq_lo"] + 1) * (size["sr_hi"] - size["sr_lo"] + 1)
    width, out, left = max(1, round((2 * k * area / size["n"]) ** 0.5)), None, cells
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    while True:
        at = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        p = points.withColumn("_bq", at("sq")).withColumn("_br", at("sr"))
        c = left.withColumn("_o", F.explode(around)).withColumn("_bq", at("q") + F.col("_o.i")).withColumn("_br", at("r") + F.col("_o.j")).drop("_o")
        pairs = c.join(p, ["_bq", "_br"]).drop("_bq", "_br").withColumn("distance", axial_length(F.col("q") - F.col("sq"), F.col("r") - F.col("sr")))
        found = staged(top_per(pairs, [cell_key], ["distance", point_key], k).drop("_n"), "nearest")
        if width >= span:
            return found if out is None else out.unionByName(found)
        done = found.groupBy(cell_key).agg(F.count("*").alias("_k"), F.max("distance").alias("_d")).where((F.col("_k") == k) & (F.col("_d") <= 3**0.5 / 2 * width)).select(cell_key)
        some = found.join(done, cell_key, "left_semi")
        out = some if out is None else out.unionByName(some)
        left = staged(left.join(done, cell_key, "left_anti"), "left")
        if left.isEmpty():
            return out
        width *= 4


def _places(points: DataFrame, variables: list[str]) -> DataFrame:
    """Points added up by place: ``sq, sr``, each variable's sum and count of finite values, and a ``_place`` to tell them by."""
    finite = lambda v: F.when(F.abs(F.col(v).cast("double")) < float("inf"), F.col(v).cast("double"))
    t = points.groupBy("sq", "sr").agg(*(f.alias(f"{kind}_{v}") for v in variables for kind, f in (("sum", F.coalesce(F.sum(finite(v)), F.lit(0.0))), ("n", F.count(finite(v))))))
    return t.withColumn("_place", F.struct("sq", "sr"))


def idw_all(cells: DataFrame, points: DataFrame, variables: list[str], cell_key: str = "cell", point_key: str = "station", power: float = 2.0, most: int = MOST_POINTS) -> DataFrame:
    """Inverse-distance weighted values per cell from all points, by the rules of :func:`idw`.

    Points at one place weigh the same, so a place's sums and counts stand for them.
    Up to ``most`` places each cell sums them up where it is; beyond,
    :func:`idw_by_blocks`.
    """
    places = _places(points, variables)
    few = _few(places, "_place", most)
    if few is None:
        return idw_by_blocks(cells, points, variables, cell_key, point_key, power, most)
    values = {v: [few.column(f"{kind}_{v}").to_numpy().astype(float) for kind in ("sum", "n")] for v in variables}

    def sums(batches):
        for batch in batches:
            for a, b, d in _distances(batch, few):
                exact = d <= EXACT_KM
                with np.errstate(divide="ignore", invalid="ignore"):
                    w = np.where(exact.any(1, keepdims=True), exact.astype(float), d**-power)
                    out = [(w @ x) / (w @ n) for x, n in values.values()]
                yield pa.RecordBatch.from_arrays([batch.column(cell_key).slice(a, b - a), *(pa.array(x, pa.float64(), mask=~np.isfinite(x)) for x in out)], [cell_key, *variables])

    return spread_out(cells).mapInArrow(sums, StructType([cells.schema[cell_key], *(StructField(v, DoubleType()) for v in variables)]))


#: Cells that meet a block of points at a time.
CELLS_PER_PART = 20_000


def idw_by_blocks(cells: DataFrame, points: DataFrame, variables: list[str], cell_key: str = "cell", point_key: str = "station", power: float = 2.0, block: int = MOST_POINTS) -> DataFrame:
    """:func:`idw_all` for any number of points: sums by cell and block of about ``block`` points, added up by cell.

    Parts of cells meet blocks of points, each once, in NumPy; a cell leaves a row
    of sums for each block, never one for each point, and points at one place are
    added up before. Cells are told apart by their key.
    """
    points = staged(_places(points, variables), "places")
    n_blocks, n_parts = -(-points.count() // block), max(1, -(-cells.count() // CELLS_PER_PART))
    c = cells.select(cell_key, "q", "r").withColumn("_p", F.pmod(F.xxhash64(cell_key), F.lit(n_parts))).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    s = points.select(F.pmod(F.xxhash64("sq", "sr"), F.lit(n_blocks)).alias("_b"), "sq", "sr", *(f"{kind}_{v}" for v in variables for kind in ("sum", "n"))).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
    names = [f"{kind}_{v}" for v in variables for kind in ("sum", "weight", "exact", "exacts")]

    def sums(own: pa.Table, of: pa.Table) -> pa.Table:
        own, of = own.combine_chunks(), of.combine_chunks()
        out: list[list] = [[] for _ in names]
        hit = []
        if of.num_rows:
            values = [[of.column(f"{kind}_{v}").to_numpy().astype(float) for kind in ("sum", "n")] for v in variables]
            for batch in own.to_batches():
                for _, _, d in _distances(batch, of):
                    exact = (d <= EXACT_KM).astype(float)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        w = np.where(exact > 0, 0.0, d**-power)
                    hit.append(exact.any(1))
                    for k, (x, there) in enumerate(values):
                        for j, part in enumerate((w @ x, w @ there, exact @ x, exact @ there)):
                            out[4 * k + j].append(part)
        keys = own.column(cell_key) if of.num_rows else own.column(cell_key).slice(0, 0)
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({cell_key: keys, "_hit": cat(hit, pa.bool_()), **{n: cat(o, pa.float64()) for n, o in zip(names, out, strict=True)}})

    shape = StructType([cells.schema[cell_key], StructField("_hit", BooleanType()), *(StructField(n, DoubleType()) for n in names)])
    by_block = c.groupBy("_p", "_b").cogroup(s.groupBy("_p", "_b")).applyInArrow(sums, shape)
    t = by_block.groupBy(cell_key).agg(F.max("_hit").alias("_hit"), *(F.sum(n).alias(n) for n in names))
    return t.select(cell_key, *(F.when(F.col("_hit"), F.try_divide(F.col(f"exact_{v}"), F.col(f"exacts_{v}"))).otherwise(F.try_divide(F.col(f"sum_{v}"), F.col(f"weight_{v}"))).alias(v) for v in variables))


def lattice_pairs(cells: DataFrame, anchors: DataFrame, step: float, reach: int = 2) -> DataFrame:
    """Cells ``lat, lon`` with the anchors of a lattice of ``step`` degrees that lie within ``reach`` steps: an equi-join on lattice indices."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    at = lambda c: F.floor(F.col(c) / step + 0.5)
    a = anchors.withColumn("ilat", at("alat")).withColumn("ilon", at("alon"))
    c = cells.withColumn("_o", F.explode(around)).withColumn("ilat", at("lat") + F.col("_o.i")).withColumn("ilon", at("lon") + F.col("_o.j")).drop("_o")
    return c.join(a, ["ilat", "ilon"]).drop("ilat", "ilon")


def nearest_on_lattice(cells: DataFrame, anchors: DataFrame, step: float, k: int, cell_key: str = "cell", anchor_key: str = "anchor", reach: int = 2, most: int = MOST_POINTS) -> DataFrame:
    """Cells ``lat, lon`` with their ``k`` nearest anchors of a lattice by ``d2``, the squared distance in degrees to nine places, ties to the smaller anchor key.

    Up to ``most`` anchors each cell searches all of them where it is, so cells that
    crowd a few squares of the lattice stay spread over tasks. Beyond, what lies further than ``reach`` steps of the index is further than ``reach``
    steps away, so cells whose ``k``-th anchor is nearer are done; the others look
    twice as far, until that spans all anchors.
    """
    few = _few(anchors, anchor_key, most)
    if few is not None:
        own_names, anchor_names = cells.columns, anchors.columns
        alat, alon = (few.column(c).to_numpy().astype(float) for c in ("alat", "alon"))

        def search(batches):
            for batch in batches if few.num_rows else ():
                lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
                part = max(1, STEP // few.num_rows)
                for a in range(0, len(lat), part):
                    d2 = np.floor(((lat[a : a + part, None] - alat) ** 2 + (lon[a : a + part, None] - alon) ** 2) * 1e9 + 0.5) / 1e9
                    row, of = _first(d2, k)
                    own = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in own_names), *(few.column(c).combine_chunks().take(pa.array(of)) for c in anchor_names), pa.array(d2[row, of])], [*own_names, *anchor_names, "d2"])

        return spread_out(cells).mapInArrow(search, StructType([*cells.schema, *anchors.schema, StructField("d2", DoubleType())]))
    ends = lambda t, lat, lon: t.agg(F.min(lat), F.max(lat), F.min(lon), F.max(lon)).first()
    a, c = ends(anchors, "alat", "alon"), ends(cells, "lat", "lon")
    span = 0.0 if None in (*a, *c) else max(max(a[1], c[1]) - min(a[0], c[0]), max(a[3], c[3]) - min(a[2], c[2]))
    out, left = None, cells
    while True:
        pairs = lattice_pairs(left, anchors, step, reach).withColumn("d2", F.round(F.pow(F.col("lat") - F.col("alat"), 2) + F.pow(F.col("lon") - F.col("alon"), 2), 9))
        found = staged(top_per(pairs, [cell_key], ["d2", anchor_key], k).drop("_n"), "lattice")
        if (reach - 1) * step >= span:
            return found if out is None else out.unionByName(found)
        done = found.groupBy(cell_key).agg(F.count("*").alias("_k"), F.max("d2").alias("_d")).where((F.col("_k") == k) & (F.col("_d") < (reach * step) ** 2)).select(cell_key)
        some = found.join(done, cell_key, "left_semi")
        out = some if out is None else out.unionByName(some)
        left = staged(left.join(done, cell_key, "left_anti"), "left")
        if left.isEmpty():
            return out
        reach *= 2


def idw(pairs: DataFrame, cell_key: str, variables: list[str], power: float = 2.0) -> DataFrame:
    """Inverse-distance weighted values per cell from ``distance`` (km) and the variables; null values take no part, a point at no distance decides alone (null if its value is)."""
    near = F.min("distance").over(Window.partitionBy(cell_key))
    w = F.when(near <= EXACT_KM, F.when(F.col("distance") <= EXACT_KM, 1.0).otherwise(0.0)).otherwise(F.pow("distance", F.lit(-power)))
    weighted = pairs.withColumn("w", w)
    return weighted.groupBy(cell_key).agg(*(F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("w")))).alias(v) for v in variables))


def latest_visible(scores: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Rows of each horizon's latest batch that isn't incomplete."""
    visible = scores.join(incomplete, "computed_at", "left_anti")
    return visible.join(visible.groupBy("horizon").agg(F.max("computed_at").alias("computed_at")), ["horizon", "computed_at"], "left_semi")


def snapshot_intervals(snapshots: DataFrame, by: str | None = None) -> DataFrame:
    """The snapshots' columns with ``_start, _end``: stretches of time, in microseconds and without overlap, in which the row is the newest one available. ``_end`` is null where that never ends.

    A sweep over the edges of a family's snapshots, newest available first; the
    snapshots of one family (not the facts) meet in one task.
    """
    import heapq

    s = snapshots.withColumn("_from", F.unix_micros("available_from")).withColumn("_until", F.unix_micros("available_until")).where("_from is not null")
    rank = F.struct("_from", *(F.col(c) for c in snapshots.columns))
    s = s.withColumn("_row", F.struct(*snapshots.columns)).withColumn("_family", F.col(by) if by else F.lit(0)).select("_family", "_from", "_until", "_row", rank.alias("_rank"))

    def sweep(table: pa.Table) -> pa.Table:
        order = pa.array(sorted(range(table.num_rows), key=lambda k: ranks[k])) if (ranks := [tuple((v is not None, v) for v in r.values()) for r in table["_rank"].to_pylist()]) else pa.array([], pa.int64())
        table = table.take(order)
        start, until = table["_from"].to_pylist(), table["_until"].to_pylist()
        edges = sorted({*start, *(u for u in until if u is not None)})
        held: list[int] = []
        k, out = 0, []
        for n, t in enumerate(edges):
            while k < len(start) and start[k] <= t:
                heapq.heappush(held, -k)  # rows are in order, the newest last
                k += 1
            while held and until[-held[0]] is not None and until[-held[0]] <= t:
                heapq.heappop(held)
            end = edges[n + 1] if n + 1 < len(edges) else None
            if held and out and out[-1][0] == -held[0] and out[-1][2] == t:
                out[-1][2] = end
            elif held:
                out.append([-held[0], t, end])
        rows = table.take(pa.array([r[0] for r in out], pa.int64()))
        return pa.table({"_row": rows["_row"], "_start": pa.array([r[1] for r in out], pa.int64()), "_end": pa.array([r[2] for r in out], pa.int64())})

    shape = StructType([StructField("_row", s.schema["_row"].dataType), StructField("_start", LongType()), StructField("_end", LongType())])
    return s.groupBy("_family").applyInArrow(sweep, shape).select("_row.*", "_start", "_end")


def asof_snapshot(facts: DataFrame, snapshots: DataFrame, at: str, key: str, by: str | None = None) -> DataFrame:
    """Each fact with the snapshot available then (``available_from <= at < available_until``), the most recent one; facts without one stay. Of snapshots available from the same instant the last in order of its columns counts.

    Snapshots become stretches of time with one winner each, stretches and facts
    are dealt into buckets about as long as a stretch, and both meet by equal
    bucket. ``key`` names a fact; it only has to be a column.
    """
    pieces = staged(snapshot_intervals(snapshots, by), "intervals")
    t = facts.withColumn("_at", F.unix_micros(at))
    n, lo, hi = pieces.agg(F.count("*"), F.min("_start"), F.max(F.coalesce("_end", "_start"))).first()
    last = t.agg(F.max("_at")).first()[0]
    if not n or last is None:
        names = [c for c in snapshots.columns if c != by]
        return facts.select("*", *(F.lit(None).cast(snapshots.schema[c].dataType).alias(c) for c in names))
    width = max(1, (max(hi, last) - lo) // n)
    bucket = lambda c: F.floor(c / width)
    # An open stretch goes on to the last fact.
    end = F.coalesce("_end", F.lit(max(hi, last) + 1))
    spread = pieces.withColumn("_end", end).where(F.col("_end") > F.col("_start")).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_start")), bucket(F.col("_end") - 1))))
    if by:
        spread = spread.withColumnRenamed(by, "_by")
    held = (F.col("_b") == F.col("_bucket")) & (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))
    on = held if by is None else held & (F.col(by) == F.col("_by"))
    return t.withColumn("_b", bucket(F.col("_at"))).join(spread, on, "left").drop("_at", "_b", "_bucket", "_start", "_end", "_by")


def asof_noon(valid: DataFrame, daily: DataFrame, valid_at: str = "valid_at") -> DataFrame:
    """Each cell's state of the last noon at or before an instant: an equi-join on that noon."""
    return valid.withColumn("noon", latest_noon(F.col(valid_at))).join(daily, ["cell", "noon"])


def latest_hour(forecast: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """The latest hour not after ``now``."""
    return latest_per(forecast.where(F.col("valid_at") <= now), keys, [F.desc("valid_at")])


#: Rings and days around an event in which no negative may lie, by strategy; N3 goes by the event's geographic quality.
WINDOWS = {"N0": (0, 0), "N1": (1, 1), "N2": (2, 3)}
ADAPTIVE = {"precision_undocumented": (1, 1), "rounded_coordinate_probable": (3, 2), "municipality_centroid_probable": (5, 2)}
ADAPTIVE_DEFAULT = (5, 3)


#: Cells along a block's edge and days in a bucket, as powers of two; no window reaches further than a block.
BLOCK_BITS, DAY_BITS = 4, 3


def _placed(df: DataFrame, cell: str, date: str) -> DataFrame:
    """With level, axial coordinates and day number of a cell and date."""
    return df.withColumns({"_l": cell_level(F.col(cell)), "_q": cell_q(F.col(cell)), "_r": cell_r(F.col(cell)), "_d": F.datediff(date, F.lit("1970-01-01").cast("date"))})


def _reach(strategy: str) -> tuple[Column, Column]:
    """Rings and days around an event."""
    if strategy != "N3":
        return F.lit(WINDOWS[strategy][0]), F.lit(WINDOWS[strategy][1])
    k, days = F.lit(ADAPTIVE_DEFAULT[0]), F.lit(ADAPTIVE_DEFAULT[1])
    for name, (a, b) in ADAPTIVE.items():
        k, days = F.when(F.col("category") == name, a).otherwise(k), F.when(F.col("category") == name, b).otherwise(days)
    return k, days


def event_windows(events: DataFrame, strategy: str, keep: list[str] | None = None) -> DataFrame:
    """The distinct windows of events: ``wcell, wdate``, rings and days around them, and the columns ``keep``."""
    k, days = _reach(strategy)
    return events.select(F.col("cell").alias("wcell"), F.col("date").alias("wdate"), k.alias("rings"), days.alias("days"), *(keep or [])).distinct()


def _within(candidates: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Candidates with their block, windows with each block that they touch, and the condition that joins them: equal block, then distance and day gap."""
    c = _placed(candidates, "cell", "date")
    c = c.withColumns({"_bq": F.shiftright("_q", BLOCK_BITS), "_br": F.shiftright("_r", BLOCK_BITS), "_bd": F.shiftright("_d", DAY_BITS)})
    w = _placed(windows, "wcell", "wdate")
    touched = lambda at, reach, bits: F.explode(F.sequence(F.shiftright(F.col(at) - F.col(reach), bits), F.shiftright(F.col(at) + F.col(reach), bits)))
    w = w.withColumn("_bq", touched("_q", "rings", BLOCK_BITS)).withColumn("_br", touched("_r", "rings", BLOCK_BITS)).withColumn("_bd", touched("_d", "days", DAY_BITS))
    w = w.withColumnsRenamed({n: f"_w{n}" for n in ("_l", "_q", "_r", "_d", "_bq", "_br", "_bd")})
    dq, dr = F.col("_q") - F.col("_w_q"), F.col("_r") - F.col("_w_r")
    on = F.lit(True)
    for n in ("_l", "_bq", "_br", "_bd"):
        on = on & (F.col(n) == F.col(f"_w{n}"))
    return c, w, on & (F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr)) <= F.col("rings")) & (F.abs(F.col("_d") - F.col("_w_d")) <= F.col("days"))


def exclude_near(candidates: DataFrame, events: DataFrame, strategy: str) -> DataFrame:
    """Candidates (``cell, date``) outside every event's window: an anti join by block of cells and bucket of days, so an event stands in a few blocks and not in each cell and day that it rules out."""
    c, w, on = _within(candidates, event_windows(events, strategy))
    return c.join(w, on, "left_anti").select(*candidates.columns)


def near_events(candidates: DataFrame, events: DataFrame, strategy: str, keep: list[str]) -> DataFrame:
    """Candidates inside a window, with the event's columns ``keep``. A window that touches several blocks meets a candidate in one only."""
    c, w, on = _within(candidates, event_windows(events, strategy, keep))
    return c.join(w, on).select(*candidates.columns, *keep)


def near_by_strategy(candidates: DataFrame, events: DataFrame, strategies: list[str], keep: list[str]) -> DataFrame:
    """As :func:`near_events` for several strategies by one join on the widest of an event's windows: a row per candidate and event near it, with a flag per strategy, in lower case."""
    reach = {s: _reach(s) for s in strategies}
    own = [c.alias(f"_{s}{n}") for s, both in reach.items() for n, c in enumerate(both)]
    widest = [F.greatest(*(both[n] for both in reach.values())).alias(name) for n, name in enumerate(("rings", "days"))]
    c, w, on = _within(candidates, events.select(F.col("cell").alias("wcell"), F.col("date").alias("wdate"), *widest, *own, *keep).distinct())
    dq, dr = F.col("_q") - F.col("_w_q"), F.col("_r") - F.col("_w_r")
    rings, days = F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr)), F.abs(F.col("_d") - F.col("_w_d"))
    return c.join(w, on).select(*candidates.columns, *keep, *(((rings <= F.col(f"_{s}0")) & (days <= F.col(f"_{s}1"))).alias(s.lower()) for s in strategies))


def ring_sum(cells: DataFrame, values: DataFrame, name: str, k: int = 1) -> DataFrame:
    """Sum of a value over each cell's ``k`` rings; the values scatter to their neighbours."""
    spread = values.select(F.explode(cell_disk(F.col("cell"), k)).alias("n"), name).groupBy(F.col("n.cell").alias("cell")).agg(F.sum(name).alias(name))
    return cells.select("cell").join(spread, "cell", "left").na.fill(0, [name])


def history_kernel(cells: DataFrame, ignitions: DataFrame) -> DataFrame:
    """Ignitions weighted 1, 1/2 and 1/4 at rings 0, 1 and 2."""
    counted = ignitions.groupBy("cell").agg(F.count("*").alias("n"))
    spread = counted.select(F.explode(cell_disk(F.col("cell"), 2)).alias("d"), "n").groupBy(F.col("d.cell").alias("cell")).agg(F.sum(F.col("n") * F.pow(F.lit(0.5), F.col("d.ring"))).alias("hist"))
    return cells.select("cell").join(spread, "cell", "left").na.fill(0.0, ["hist"])


def max_normalize(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """A column over its largest value within a partition; 0 where that is 0."""
    top = df.groupBy(*by).agg(F.max(name).alias("_top"))
    return df.join(top, by).withColumn(name, F.when(F.col("_top") > 0, F.col(name) / F.col("_top")).otherwise(0.0)).drop("_top")


def wui_cells(buildings: DataFrame, points: DataFrame, flags: DataFrame, metres: float = 50.0) -> DataFrame:
    """Cells of buildings within some metres of a combustible point of the ring around, or whose own cell is combustible.

    Buildings look, in each cell of the ring, into the up to four squares of twice
    ``metres`` around them and stop at the first point; squares of a 1.5th of that width, whose points are all near
    enough, are asked first, so crowded places are settled without distances. A
    cell goes on to the next step only while none of its buildings has a hit.
    """
    square = lambda c, w: F.floor((F.col(c) if isinstance(c, str) else c) / w)
    own = buildings.join(flags.where("combustible").select("cell"), "cell", "left_semi").select("cell").distinct()
    small = metres / 1.5  # its diagonal is shorter than ``metres``
    p = points.select(F.col("cell").alias("pcell"), F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    b = buildings.select("cell", F.col("x").alias("bx"), F.col("y").alias("by")).distinct().join(own, "cell", "left_anti")
    # A square and a cell of the ring that both have points: any pair of them is near.
    crowded = p.select("pcell", square("px", small).alias("_x"), square("py", small).alias("_y")).distinct()
    near = b.withColumn("n", F.explode(cell_disk(F.col("cell"), 1))).select("cell", F.col("n.cell").alias("pcell"), square("bx", small).alias("_x"), square("by", small).alias("_y")).distinct()
    sure = near.join(crowded, ["pcell", "_x", "_y"], "left_semi").select("cell").distinct()
    wide = 2 * metres
    around = lambda c: F.explode(F.sequence(square(c - metres, wide), square(c + metres, wide)))
    left = b.join(sure, "cell", "left_anti").withColumn("_x", around(F.col("bx"))).withColumn("_y", around(F.col("by")))
    left = left.withColumn("n", F.explode(cell_disk(F.col("cell"), 1))).withColumn("_cell", F.col("n.cell")).drop("n")
    bins = p.withColumn("_px", square("px", wide)).withColumn("_py", square("py", wide))
    hit = (F.col("_cell") == F.col("pcell")) & (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")) & (F.pow(F.col("bx") - F.col("px"), 2) + F.pow(F.col("by") - F.col("py"), 2) <= metres * metres)
    close = left.join(bins, hit, "left_semi").select("cell").distinct()
    return own.unionByName(sure).unionByName(close)


def nearest_combustible(events: DataFrame, static: DataFrame, keep: int = 5) -> DataFrame:
    """Each event's combustible cells within two rings: the ``keep`` first by ring and cell, and counts per ring."""
    near = events.select("event", F.explode(cell_disk(F.col("cell"), 2)).alias("n")).select("event", "n.cell", "n.ring").join(static.where("combustible").select("cell"), "cell", "left_semi")
    first = top_per(near, ["event"], ["ring", "cell"], keep).groupBy("event").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "cell"))), lambda s: s["cell"]).alias("nearest"))
    counts = near.groupBy("event").agg(*(F.count_if(F.col("ring") == k).alias(f"ring_{k}") for k in (0, 1, 2)))
    return counts.join(first, "event")


#: Events that one side of a comparison holds at a time.
PART_ROWS = 2_000


def _triangle(events: DataFrame, by: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Two copies of events whose equal ``by, _i, _j`` meet every pair of a group once: large groups are cut into parts, and part meets part."""
    sizes = events.groupBy(*by).agg(F.count("*").alias("_m")).where(F.col("_m") > rows).select(*by, F.ceil(F.col("_m") / rows).alias("_parts"))
    t = events.join(sizes, by, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    left = t.withColumn("_i", F.col("_part")).withColumn("_j", F.explode(F.sequence("_part", F.col("_parts") - 1)))
    right = t.withColumn("_j", F.col("_part")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_part"))))
    return left.drop("_part", "_parts"), right.drop("_part", "_parts")


def duplicate_pairs(events: DataFrame, rows: int = PART_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Candidate duplicates ``left < right`` of one UTC day: cells at most a ring apart, or one municipality within 24 h. Ids are unique.

    Joins on day and neighbour cell, and on day and municipality; no pair of a
    day is compared otherwise. A day of a cell or municipality with over ``rows``
    events is cut into parts, so no task holds its pairs: of a municipality each
    pair of parts meets once, of a cell each part meets all neighbours. The columns
    ``keep`` of both events come along as ``{column}_l`` and ``{column}_r``: only
    events are shuffled, never pairs.
    """
    e = events.select("id", F.to_date("occurred_at").alias("day"), F.col("commune").alias("_c"), F.col("cell").alias("_cell"), cell_level(F.col("cell")).alias("_l"), cell_q(F.col("cell")).alias("_q"), cell_r(F.col("cell")).alias("_r"), F.struct(F.col("id").alias("_id"), *(F.col(c) for c in keep)).alias("_e")).where("day is not null")
    second_of = lambda t: t.select(*(F.col(c).alias(f"{c}2") for c in t.columns))
    sides = lambda one, two: [one["_id"].alias("left"), two["_id"].alias("right"), *(one[c].alias(f"{c}_l") for c in keep), *(two[c].alias(f"{c}_r") for c in keep)]
    first, second = _triangle(e.where("_c is not null"), ["day", "_c"], rows)
    second = second_of(second)
    same = F.lit(True)
    for c in ("day", "_c", "_i", "_j"):
        same = same & (F.col(c) == F.col(f"{c}2"))
    dq, dr = F.col("_q") - F.col("_q2"), F.col("_r") - F.col("_r2")
    apart = F.coalesce((F.col("_l") != F.col("_l2")) | (F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr)) > 1), F.lit(True))  # nearer ones come from the other join
    place = first.join(second, same & apart & ((F.col("_i") < F.col("_j")) | (F.col("id") < F.col("id2"))) & (F.col("id") != F.col("id2")))
    in_order = F.col("id") < F.col("id2")
    by_place = place.select(*sides(F.when(in_order, F.col("_e")).otherwise(F.col("_e2")), F.when(in_order, F.col("_e2")).otherwise(F.col("_e"))))

    r = e.select(F.col("_cell").alias("rcell"), F.col("day").alias("rday"), F.col("id").alias("id2"), F.col("_e").alias("_e2")).where("rcell is not null")
    hot = r.groupBy("rcell", "rday").agg(F.count("*").alias("_m")).where(F.col("_m") > rows).select("rcell", "rday", F.ceil(F.col("_m") / rows).alias("_parts"))
    r = r.join(hot, ["rcell", "rday"], "left").withColumn("_part", F.pmod(F.xxhash64("id2"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    a = e.select("id", "_e", F.col("day").alias("rday"), F.explode(cell_disk(F.col("_cell"), 1)).alias("n")).select("id", "_e", "rday", F.col("n.cell").alias("rcell"))
    a = a.join(hot, ["rcell", "rday"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    by_cell = a.join(r, ["rday", "rcell", "_part"]).where("id < id2").select(*sides(F.col("_e"), F.col("_e2")))
    return by_cell.unionByName(by_place)


def fill_missing(expected: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Every expected key, with whether it was observed."""
    v = values.withColumn("_seen", F.lit(True))
    return expected.join(v, key, "left").withColumn("status", F.when(F.col("_seen"), "observed").otherwise("missing")).drop("_seen")


def cell_at(q: Column, r: Column, level: int = 8) -> Column:
    """Id of axial coordinates (a shorthand of the grid's formula)."""
    return F.lit(level * LEVEL + (1 << 25) * ROW + (1 << 25)) + q.cast("long") * ROW + r.cast("long")


def axial_distance(a: Column, b: Column) -> Column:
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def rolling_precip(df: DataFrame, keys: list[str], time: str, rain: str = "rain", rows: int = 24) -> Column:
    """Sum of the last ``rows`` rows' precipitation, the current one included; missing and negative values count 0."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - rows, 0)
    return F.sum(F.greatest(F.coalesce(F.col(rain), F.lit(0.0)), F.lit(0.0))).over(w)


def station_selection(obs: DataFrame, noon: Column) -> DataFrame:
    """Per station the observation nearest to noon (the earlier on ties) and the latest one's time."""
    w = Window.partitionBy("station")
    gap = F.abs(F.unix_timestamp("observed_at") - F.unix_timestamp(noon))
    t = obs.withColumn("gap", gap).withColumn("latest", F.max("observed_at").over(w))
    return latest_per(t, ["station"], ["gap", "observed_at"])
