"""Quality audit of fire records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import LEVEL, ROW, cell_level, cell_q, cell_r, disk_offsets
from ..sources.staging import staged
from .spatial import PART_ROWS, duplicate_pairs, nearest_combustible


def assess_label(category: Column, subcategory: Column) -> Column:
    """Confidence, eligibility and reasons of a label. An unknown cause is never a negative."""
    accident = subcategory == "accident_unspecified"

    def of(confidence, eligibility: str, sensitivity, reasons) -> Column:
        return F.struct(confidence.alias("confidence"), F.lit(eligibility).alias("eligibility"), sensitivity.alias("sensitivity"), reasons.alias("reasons"))

    no, words = F.lit(False), lambda *r: F.array(*map(F.lit, r))
    human = of(F.when(accident, "medium").otherwise("high"), "eligible_human_positive", F.coalesce(accident, no), F.when(accident, words("known_human_taxonomy", "accidental_category_requires_sensitivity_analysis")).otherwise(words("known_human_taxonomy")))
    return (
        F.when(category == "human_known", human)
        .when(category == "natural_known", of(F.lit("high"), "eligible_natural_cohort", no, words("known_natural_taxonomy_not_absence_of_fire")))
        .when(category == "unknown", of(F.lit("unknown"), "unknown_cause_cohort", no, words("unknown_cause_must_not_be_used_as_negative")))
        .when(category == "indeterminate", of(F.lit("low"), "indeterminate_cause_cohort", no, words("unmapped_non_empty_source_label")))
        .otherwise(of(F.lit("low"), "invalid_or_unusable", no, words("unsupported_cause_category")))
    )


def coordinate_stats(events: DataFrame) -> DataFrame:
    """Events with the number of events, municipalities and years at their exact coordinate."""
    at = events.groupBy("lat", "lon").agg(F.count("*").alias("event_count"), F.countDistinct("commune").alias("municipality_count"), F.countDistinct(F.year("occurred_at")).alias("year_count"))
    return events.join(at, ["lat", "lon"])


def centroid_status(events: Column, municipalities: Column, years: Column, precision: Column) -> Column:
    one = municipalities == 1
    return F.when(one & (events >= 5) & (years >= 2), "probable_centroid").when(one & (events >= 3), "possible_centroid").when((events == 1) & (precision > 3), "not_centroid_like").otherwise("undetermined")


def assess_geography(status: Column, precision: Column, official: Column | None = None) -> Column:
    """Category, confidence and reasons of a location (the names are fixed values)."""
    of = lambda c, v, *r: F.struct(F.lit(c).alias("category"), F.lit(v).alias("confidence"), F.array(*map(F.lit, r)).alias("reasons"))
    known = F.coalesce(official, F.lit(False)) if official is not None else F.lit(False)
    return (
        F.when(known, of("municipality_centroid_confirmed", 1.0, "official_versioned_centroid_match"))
        .when(status == "probable_centroid", of("municipality_centroid_probable", 0.75, "same_coordinate_repeated_within_one_municipality", "multiple_years_without_spatial_variation", "no_official_centroid_reference_available"))
        .when(precision <= 3, of("rounded_coordinate_probable", 0.65, "limited_decimal_precision"))
        .otherwise(of("precision_undocumented", 0.5, "source_precision_metadata_unavailable"))
    )


#: Names of the parts of a duplicate score, in order of name.
PARTS = ["centroid_ambiguity", "same_cause", "same_h3", "same_municipality", "spatial_distance", "surface_similarity", "time_difference"]


def duplicate_contributions(p: dict[str, Column]) -> dict[str, Column]:
    """The seven signed parts of a pair's score."""
    d, m, s = p["distance_m"], p["minutes"], p["surface_difference"]
    return {
        "same_municipality": F.when(p["same_municipality"], 0.15).otherwise(-0.15),
        "same_h3": F.when(p["same_cell"], 0.10).otherwise(-0.10),
        "spatial_distance": F.when(d <= 25, 0.25).when(d <= 150, 0.12).otherwise(-0.15),
        "time_difference": F.when(m <= 30, 0.25).when(m <= 180, 0.12).when(m >= 720, -0.20).otherwise(0.0),
        "same_cause": F.when(p["same_cause"], 0.15).otherwise(-0.08),
        "surface_similarity": F.when(s <= 0.05, 0.10).when(s >= 0.75, -0.10).otherwise(0.0),
        "centroid_ambiguity": F.when(p["ambiguous"], -0.10).otherwise(0.0),
    }


#: What of an event a pair's assessment looks at.
ASSESSED = ("occurred_at", "commune", "cell", "x", "y", "surface_ha", "category", "subcategory", "geography")


def assess_duplicates(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """Score, class and parts of each pair. A full score alone is not certain: all signals must agree.

    ``events``: ``id, occurred_at, commune, cell, x, y, surface_ha, category,
    subcategory, geography`` with plane coordinates in metres. Pairs that have the
    columns ``ASSESSED`` of both sides need no join with them.
    """
    side = lambda n: events.select(*(F.col(c).alias(f"{c}_{n}") for c in ("id", *ASSESSED)))
    held = {f"{c}_{n}" for c in ASSESSED for n in "lr"} <= set(pairs.columns)
    t = pairs if held else pairs.join(side("l"), F.col("left") == F.col("id_l")).join(side("r"), F.col("right") == F.col("id_r"))
    same = lambda c: F.col(f"{c}_l") == F.col(f"{c}_r")
    largest = F.greatest("surface_ha_l", "surface_ha_r")
    t = t.select(
        "left", "right", F.floor(F.abs(F.unix_timestamp("occurred_at_r") - F.unix_timestamp("occurred_at_l")) / 60).alias("minutes"),
        F.sqrt(F.pow(F.col("x_l") - F.col("x_r"), 2) + F.pow(F.col("y_l") - F.col("y_r"), 2)).alias("distance_m"),
        F.when(largest > 0, F.abs(F.col("surface_ha_l") - F.col("surface_ha_r")) / largest).otherwise(0.0).alias("surface_difference"),
        same("commune").alias("same_municipality"), same("cell").alias("same_cell"), (same("category") & same("subcategory")).alias("same_cause"),
        (F.contains("geography_l", F.lit("centroid")) | F.contains("geography_r", F.lit("centroid"))).alias("ambiguous"), (F.to_date("occurred_at_l") == F.to_date("occurred_at_r")).alias("same_day"),
    )
    cols = {c: F.col(c) for c in t.columns}
    parts = duplicate_contributions(cols)
    total = sum((parts[n] for n in PARTS), F.lit(0.20))
    t = t.withColumn("contributions", F.create_map(*(x for n in PARTS for x in (F.lit(n), parts[n])))).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 10))))
    full = ~F.col("ambiguous") & F.col("same_municipality") & F.col("same_cell") & F.col("same_cause") & (F.col("distance_m") <= 25) & (F.col("minutes") <= 30) & (F.col("surface_difference") <= 0.05)
    s = F.col("score")
    kind = F.when((s >= 0.92) & full, "certain_duplicate").when((s >= 0.75) & ~F.col("ambiguous"), "probable_duplicate").when(s >= 0.55, "possible_duplicate").when(F.col("same_cell") & F.col("same_day"), "indeterminate").otherwise("probably_distinct")
    return t.withColumn("classification", kind)


#: Classes of a pair, the surest first; the first three are to be reviewed.
REVIEWED = ["certain_duplicate", "probable_duplicate", "possible_duplicate"]
CLASSES = [*REVIEWED, "indeterminate", "probably_distinct"]

#: Cells along a block's edge, as a power of two, by which neighbours meet; events that a task takes; pairs of a NumPy step.
MEETING_BITS, MEETING_ROWS, PAIR_STEP = 3, 200_000, 1 << 16

_KEYS = ["k", "day", "i", "j"]


def _meetings(events: DataFrame, rows: int) -> DataFrame:
    """A row of an event for each group in which it meets others of its day: its municipality (``k`` below 0), its block of cells, and blocks that a neighbour of its cell lies in (not ``own``). Sorted by group within tasks; a group of over ``rows`` is cut into parts, and part ``i`` meets part ``j``."""
    c = F.col("cell")
    block = lambda dq, dr: F.xxhash64(cell_level(c), F.shiftright(cell_q(c) + dq, MEETING_BITS), F.shiftright(cell_r(c) + dr, MEETING_BITS)).bitwiseAND(F.lit((1 << 63) - 1))
    place = F.when(F.col("commune").isNotNull(), F.array(F.xxhash64("commune").bitwiseOR(F.lit(-(1 << 63)))))
    blocks = F.when(c.isNotNull(), F.array_distinct(F.array(*(block(dq, dr) for dq, dr, _ in disk_offsets(1)))))
    none = F.array().cast("array<long>")
    number = lambda name: F.col(name).cast("double").alias(name)
    e = events.where("occurred_at is not null").select(
        "id", "commune", "cell", F.datediff(F.to_date("occurred_at"), F.lit("1970-01-01").cast("date")).alias("day"), F.unix_timestamp("occurred_at").alias("at"), number("x"), number("y"), number("surface_ha"), "category", "subcategory",
        F.contains("geography", F.lit("centroid")).alias("ambiguous"), F.coalesce(block(0, 0), F.lit(0)).alias("_own"), F.explode(F.concat(F.coalesce(place, none), F.coalesce(blocks, none))).alias("k"),
    )
    e = e.withColumn("own", F.col("k") == F.col("_own")).drop("_own")
    hot = staged(e.groupBy("k", "day").agg(F.count("*").alias("_m")).where(F.col("_m") > rows).select("k", "day", F.ceil(F.col("_m") / rows).alias("_parts")), "hot")
    if hot.isEmpty():
        e = e.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    else:
        e = e.join(hot, ["k", "day"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
        e = e.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        side = F.when(F.col("_part") == F.col("_with"), 0).when(F.col("_part") < F.col("_with"), 1).otherwise(2)
        e = e.withColumns({"i": F.least("_part", "_with").cast("int"), "j": F.greatest("_part", "_with").cast("int"), "side": side}).drop("_part", "_with", "_parts")
    n = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // MEETING_ROWS))
    return e.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS, "side", "id")


def _bounds(t: pa.Table) -> np.ndarray:
    """Where a group begins, and the end."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for name in _KEYS:
        v = t[name].to_numpy()
        new |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, t.num_rows]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups, as many as there are in a batch, with their bounds."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        bounds = _bounds(t)
        if len(bounds) > 2:
            yield t.slice(0, bounds[-2]), bounds[:-1]
        held = t.slice(bounds[-2]) if t.num_rows else None
    if held is not None and held.num_rows:
        yield held, _bounds(held)


def _pairs(t: pa.Table, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``left, right``, score in hundredths and number of the class of all pairs in some groups, by stretches of about ``PAIR_STEP``."""
    code = lambda *names: [pc.dictionary_encode(t[n].combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False) for n in names]
    array = lambda name, null=None: (t[name] if null is None else t[name].fill_null(null)).to_numpy()
    ids, k, at, side, own = (array(n) for n in ("id", "k", "at", "side", "own"))
    x, y, cell = array("x", np.nan), array("y", np.nan), array("cell", -1)
    level, q, r = cell // LEVEL, cell // ROW % ROW, cell % ROW
    surface, no_surface = array("surface_ha", 0.0), t["surface_ha"].is_null().to_numpy()
    unsure = t["ambiguous"].is_null().to_numpy()
    ambiguous = array("ambiguous", False)
    commune, category, subcategory = code("commune", "category", "subcategory")
    size = np.diff(bounds)
    end = np.repeat(bounds[1:], size)
    first = np.repeat(bounds[:-1] + np.add.reduceat((side == 1).astype(np.int64), bounds[:-1]), size)  # of the other part
    first = np.where(side == 0, np.arange(len(ids)) + 1, np.where(side == 1, first, end))
    upto = np.cumsum(end - first)
    a = 0
    while a < len(ids):
        done = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, done + PAIR_STEP, "right")))
        n = (end - first)[a:b]
        one = np.repeat(np.arange(a, b), n)
        two = np.arange(len(one)) + np.repeat(first[a:b] - (upto[a:b] - n - done), n)
        a = b
        swap = ids[one] > ids[two]
        one, two = np.where(swap, two, one), np.where(swap, one, two)
        same = lambda v: v[one] == v[two]  # noqa: B023, E731
        here = same(commune) & (commune[one] >= 0)
        dq, dr = np.abs(q[one] - q[two]), np.abs(r[one] - r[two])
        near = (cell[one] >= 0) & (cell[two] >= 0) & same(level) & (np.maximum(np.maximum(dq, dr), np.abs(q[one] - q[two] + r[one] - r[two])) <= 1)
        ok = np.where(k[one] < 0, here, near & own[one] & ~here) & (ids[one] != ids[two])  # neighbours in the block of the left one
        if not ok.all():
            one, two, here = one[ok], two[ok], here[ok]
        if not len(one):
            continue
        cause = same(category) & same(subcategory) & (category[one] >= 0) & (subcategory[one] >= 0)
        one_cell = same(cell) & (cell[one] >= 0)
        d, s = np.sqrt((x[one] - x[two]) ** 2 + (y[one] - y[two]) ** 2), np.abs(at[one] - at[two])
        close, soon = d <= 25, s < 31 * 60
        u, v, u_no, v_no = surface[one], surface[two], no_surface[one], no_surface[two]
        largest = np.where(u_no, v, np.where(v_no, u, np.maximum(u, v)))
        burnt = ~(u_no & v_no) & ~(largest <= 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.abs(u - v) / largest
        alike, unlike = ~burnt | (~(u_no | v_no) & (gap <= 0.05)), burnt & ~(u_no | v_no) & ~(gap < 0.75)
        doubt = ambiguous[one] | ambiguous[two]
        sure = ~(doubt | unsure[one] | unsure[two])
        h = np.where(here, 35, 5).astype(np.int16) - 10 * doubt.astype(np.int16)
        h += np.where(one_cell, 10, -10).astype(np.int16) + np.where(cause, 15, -8).astype(np.int16)
        h += np.where(close, 25, np.where(d <= 150, 12, -15)).astype(np.int16)
        h += np.where(soon, 25, np.where(s < 181 * 60, 12, np.where(s >= 720 * 60, -20, 0))).astype(np.int16)
        h += 10 * alike.astype(np.int16) - 10 * unlike.astype(np.int16)
        full = sure & here & one_cell & cause & close & soon & alike
        kind = np.where((h >= 92) & full, 0, np.where((h >= 75) & sure, 1, np.where(h >= 55, 2, np.where(one_cell, 3, 4)))).astype(np.int16)
        yield ids[one], ids[two], np.clip(h, 0, 100), kind


def assessed_pairs(events: DataFrame, rows: int = PART_ROWS, review: bool = False) -> DataFrame:
    """``left, right, score, classification`` as of :func:`assess_duplicates` over :func:`~.spatial.duplicate_pairs`; with ``review`` only those of :func:`duplicate_groups`.

    Events (ids and cells are long) are dealt once, to their municipality's day and
    to the day of a block of cells, and a task compares the events of a group in
    NumPy, a stretch of pairs at a time: no pair is shuffled, sorted or held, and all
    parts of a score are whole hundredths.
    """

    def found(batches):
        for t, bounds in _groups(batches):
            for left, right, h, kind in _pairs(t, bounds):
                if review:
                    ok = kind < len(REVIEWED)
                    left, right, h, kind = left[ok], right[ok], h[ok], kind[ok]
                yield pa.record_batch({"left": left, "right": right, "h": h, "kind": kind})

    t = _meetings(events, rows).mapInArrow(found, "left long, right long, h short, kind short")
    return t.select("left", "right", (F.col("h") / F.lit(100.0)).alias("score"), F.element_at(F.array(*map(F.lit, CLASSES)), F.col("kind") + 1).alias("classification"))


def duplicate_classes(events: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """``classification, pairs``: how many of :func:`assessed_pairs` each class has; tasks send counts, never pairs."""

    def counted(batches):
        n = np.zeros(len(CLASSES), np.int64)
        for t, bounds in _groups(batches):
            for *_, kind in _pairs(t, bounds):
                n += np.bincount(kind, minlength=len(CLASSES))
        yield pa.record_batch({"classification": CLASSES, "pairs": n})

    t = _meetings(events, rows).mapInArrow(counted, "classification string, pairs long")
    return t.where("pairs > 0").groupBy("classification").agg(F.sum("pairs").alias("pairs"))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """Two members for each pair to review: the anchor, which is kept, and the candidate; with the pair's class."""
    members = F.array(F.struct(F.col("left").alias("event"), F.lit("anchor").alias("role")), F.struct(F.col("right").alias("event"), F.lit("candidate").alias("role")))
    t = pairs.where(F.col("classification").isin(*REVIEWED)).withColumn("m", F.explode(members))
    decision = F.when(F.col("m.role") == "anchor", "keep").when(F.col("classification") == "certain_duplicate", "exclude").otherwise("review")
    return t.select(F.concat_ws(":", F.col("left").cast("string"), F.col("right").cast("string")).alias("group"), F.col("m.event").alias("event"), F.col("m.role").alias("role"), decision.alias("decision"), "classification")


def assess_combustibility(events: DataFrame, static: DataFrame) -> DataFrame:
    """Whether an event's own cell burns, what burns around it, and flags for review."""
    own = static.select("cell", "combustible")
    near = nearest_combustible(events.select("event", "cell"), static)
    t = events.select("event", "cell").join(own, "cell", "left").join(near, "event", "left").na.fill(0, ["ring_0", "ring_1", "ring_2"])
    flags = F.array_compact(F.array(F.when(F.col("combustible").isNull(), "static_cell_missing"), F.when(F.col("combustible") == F.lit(False), "cell_not_combustible"), F.when((F.col("ring_1") + F.col("ring_2")) == 0, "no_combustible_neighbour")))
    return t.select("event", F.coalesce("combustible", F.lit(False)).alias("combustible"), "ring_0", "ring_1", "ring_2", "nearest", flags.alias("flags"))


def audit_quality(events: DataFrame, static: DataFrame) -> dict[str, DataFrame]:
    """The whole audit: labels, geography, duplicates with their groups and the number of each class, combustibility."""
    labels = events.select("id", assess_label(F.col("category"), F.col("subcategory")).alias("label"))
    pairs = assess_duplicates(duplicate_pairs(events, keep=ASSESSED), events)
    return {"labels": labels, "pairs": pairs, "groups": duplicate_groups(pairs), "classes": duplicate_classes(events), "combustibility": assess_combustibility(events.withColumnRenamed("id", "event"), static)}


def strict_safe(classification: Column) -> Column:
    """Whether a feature's temporal class may be used without leakage."""
    return F.coalesce(classification.isin("static", "calendar_deterministic", "snapshot_available"), F.lit(False))
