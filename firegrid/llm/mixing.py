"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key. Within a source the keys are dealt into
ranges of about equal size, the ranges' word totals are summed up in order, and
each document's place is its range's total before plus the running total within
the range. The source is then cut at its exact budget; whole passes come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """Targets for ``_source, source_size``: a share of all words by weight, none above ``passes`` times its source.

    Capping and resharing until none is above ends where the sources are cut at
    one common level per weight, so the level is read off running sums over the
    sources in order of size per weight. Works on one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    names = every.orderBy(F.col("_source").asc_nulls_last())
    of_rank = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = every.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("rank", F.row_number().over(names)).withColumn("weight", of_rank.cast("long"))
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    t = t.withColumn("capped", F.coalesce(F.sum("source_size").over(level), F.lit(0)) * passes)
    t = t.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0)))
    t = t.withColumn("by_weight", (F.col("total") - F.col("capped")) * F.col("weight") / F.col("open"))
    fits = F.col("by_weight") <= passes * F.col("source_size")
    t = t.withColumn("first", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), "rank", "capped", "open"))).over(every))
    before = F.struct(F.col("source_size") / F.col("weight"), F.col("rank"), F.col("capped"), F.col("open")) < F.col("first")
    level_target = (F.col("total") - F.col("first.capped")) * F.col("weight") / F.col("first.open")
    target = F.when(F.col("first").isNull() | before, (passes * F.col("source_size")).cast("double")).otherwise(F.least(level_target, (passes * F.col("source_size")).cast("double")))
    return t.select("_source", "rank", "source_size", "rows", target.alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 17, rows_per_range: int = 4000) -> DataFrame:
    """``<id_col>, size, source_size, target, taken`` for each input row.

    ``size`` counts words (null or empty text: 0). Sources take ``weights`` in
    code point order, null last; a null source is a source of its own. ``taken``
    is the words the mix takes of the row: whole passes, then the row's part of
    the last, cut pass, so that a source's taken words sum to its target rounded
    to a word. Rows are ordered by the md5 of seed and id, then id and size, so
    reruns agree and rows that repeat an id are cut one after the other. Null
    ids hash like an empty id. An empty table gives an empty result; a source
    without words has target 0 and takes nothing.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"))
    docs = stage(docs, "sizes")
    sizes = docs.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(sizes, weights, share, passes).withColumnRenamed("_source", "_named")
    budget = F.floor(F.col("target") + 0.5)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    keyed = docs.join(targets, F.col("_source").eqNullSafe(F.col("_named"))).drop("_source", "_named").withColumn("key", key)
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("range", F.floor(lead * F.ceil(F.col("rows") / rows_per_range) / F.lit(2**32)))
    totals = keyed.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    prefix = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "range", F.coalesce(F.sum("words").over(prefix), F.lit(0)).alias("range_before"))
    inner = Window.partitionBy("rank", "range").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(totals, ["rank", "range"]).withColumn("before", F.col("range_before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def take_mix(df: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Apply a mix to its documents: the input's columns, each row once per whole pass, and a last row of its text up to the word where the budget ends inside it.

    Rows of which nothing is taken go, so those without words do. Rows that repeat
    an id and size are told apart by their texts' order, and each takes a share of
    its own. A cut text keeps its white space and its ``n_chars``, if there is such
    a column, becomes its length. Further columns of any name are carried along.
    """
    whole = F.struct(*df.columns)  # one column, so that no name can clash
    rows = df.select(whole.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of = ["id", "size"]
    rows = rows.withColumn("size", word_count(F.col("text"))).where("size > 0").withColumn("nth", F.row_number().over(Window.partitionBy(*of).orderBy("text")))
    shares = mix.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), "taken").where("size > 0")
    shares = shares.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_size").orderBy("taken"))).where("taken > 0")
    rows = rows.join(shares, F.col("id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("nth") == F.col("_nth")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))))
    rest = F.col("taken") % F.col("size")
    cut = (F.col("copy") * F.col("size") > F.col("taken")) & (rest > 0)
    # one piece per word, with the white space before it
    pieces = F.slice(F.split("text", "(?<=[^ \\t-\\r])(?=[ \\t-\\r])"), F.lit(1), rest.cast("int"))
    rows = rows.withColumn("text", F.when(cut, F.array_join(pieces, "")).otherwise(F.col("text"))).withColumn("cut", cut)
    new = {text_col: F.col("text")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.when(F.col("cut"), F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in df.columns))
