"""Prefix trie of conversations: ROLLUP over blocks of positional turn-id columns.

Turns become ids, dealt into blocks of a fixed number of columns. One ROLLUP per
block of columns, keyed by the node where the block before ended, aggregates all
prefixes at once; ``grouping_id`` tells a prefix's length. A node's key is folded
from the columns that it groups by, so a later block finds the node that it hangs
from, and a child its parent, by equi-join. Sums over subtrees are a second
ROLLUP: what a node is worth counts for its smallest member, and members add up.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Turn-id columns of a block, and the modulus of borrowed turns.
WIDTH, FAMILY, BORROWED = 8, 5, 9


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 within ``keys`` by ``order``: rows are sorted over ranges of both, then numbered within ranges, whose offsets are sums of counts. A key with many rows lies in several ranges."""
    ranged = stage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_range").orderBy(*order)
    t = ranged.withColumn(name, F.row_number().over(inner)).join(offsets, [*keys, "_range"])
    return t.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return F.crc32(conv.cast("string").cast("binary")) % BORROWED


def turn_ids(df: DataFrame) -> DataFrame:
    """``conv, i, t``: each turn's place in its conversation and its id, the MD5 of role and text with the text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    t = F.struct(digest.alias("id"), F.octet_length(text).cast("long").alias("n"))
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", t.alias("t"))
    return numbered(rows, ["conv"], ["turn", "t"], "i").select("conv", "i", "t")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, p, t``: conversations that begin with their family's first turns, then go on with their own; p = 0 stands for each conversation itself."""
    size = stage(turns.groupBy("conv").agg(F.count("*").alias("n")), "sizes")
    mine = size.select("conv", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), borrowed(F.col("conv")).alias("h"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    mine = mine.join(size.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv", "base", "h", taken.alias("m"))
    first = turns.where(F.col("i") < BORROWED).withColumnRenamed("conv", "base")
    lent = first.join(mine, "base").where(F.col("i") <= F.col("h")).select("conv", F.col("i").alias("p"), "t")
    own = turns.withColumn("h", borrowed(F.col("conv"))).where(F.col("i") > F.col("h")).join(mine.select("conv", "m"), "conv").select("conv", (F.col("i") - F.col("h") + F.col("m")).alias("p"), "t")
    return size.select("conv", F.lit(0).cast("long").alias("p"), F.lit(None).cast(turns.schema["t"].dataType).alias("t")).unionByName(lent).unionByName(own)


def _mark(p: Column, t: Column, which: int) -> Column:
    """What a turn at a place adds to the key of a prefix."""
    return F.xxhash64(F.lit(which), p.cast("long"), t["id"], p.cast("long"))


def blocks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``conv, block, k1, k2, t1 .. t<width>, last``: a row per conversation and block of turns, with the key of the node at which the blocks before end, and the conversation's length."""
    at = F.greatest(F.col("p") - 1, F.lit(0))
    t = rows.select("conv", "p", "t", F.floor(at / width).alias("block"), (at % width + 1).alias("k"))
    marks = [F.bit_xor(F.when(F.col("p") > 0, _mark(F.col("p"), F.col("t"), w))).alias(f"x{w}") for w in (1, 2)]
    wide = t.groupBy("conv", "block").agg(*(F.max(F.when((F.col("k") == k) & (F.col("p") > 0), F.col("t"))).alias(f"t{k}") for k in range(1, width + 1)), F.max("p").alias("last"), *marks)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    keys = [F.coalesce(F.bit_xor(f"x{w}").over(before), F.lit(0)).alias(f"k{w}") for w in (1, 2)]
    return wide.select("conv", "block", *keys, *(f"t{k}" for k in range(1, width + 1)), F.max("last").over(whole).alias("last"))


def rolled(wide: DataFrame, sums: list[tuple[str, str]], width: int = WIDTH) -> DataFrame:
    """``depth, k1, k2, p1, p2, bytes`` and aggregates of each prefix: its own key, its parent's, and the bytes of its last turn.

    GROUP BY block and the node before, ROLLUP over the turn columns. Levels that
    end in a conversation's missing turns, and of later blocks the level of no
    turn, are no prefixes of their own.
    """
    names = [f"t{k}" for k in range(1, width + 1)]
    figures = ", ".join(f"{expr} AS {name}" for expr, name in sums)
    turns = ", ".join(names)
    found = wide.sparkSession.sql(f"SELECT block, k1, k2, {turns}, grouping_id() AS gid, {figures} FROM {{wide}} GROUP BY block, k1, k2, ROLLUP({turns})", wide=wide)
    found = found.withColumn("level", F.lit(width) - F.bit_count("gid"))  # it has a bit for every column that a level leaves out
    last = F.coalesce(*(F.when(F.col("level") == k, F.col(n)) for k, n in enumerate(names, 1)))
    found = found.withColumn("t", last).where(F.col("t").isNotNull() | ((F.col("level") == 0) & (F.col("block") == 0)))
    depth = F.col("block") * width + F.col("level")

    def key(w: int, upto: Column) -> Column:
        k = F.col(f"k{w}")
        for j, n in enumerate(names, 1):
            k = k.bitwiseXOR(F.when(upto >= j, _mark(F.col("block") * width + j, F.col(n), w)).otherwise(F.lit(0)))
        return k

    keys = [key(w, F.col("level")).alias(f"own{w}") for w in (1, 2)] + [key(w, F.col("level") - 1).alias(f"p{w}") for w in (1, 2)]
    t = found.select(depth.alias("depth"), *keys, F.coalesce("t.n", F.lit(0)).alias("bytes"), *(n for _, n in sums))
    return t.withColumnsRenamed({"own1": "k1", "own2": "k2"})


def _end_digests(batches):
    """SHA-256 of the comma-joined ids of each key; rows come sorted by key and id."""
    now, digest, key_names = None, None, ["depth", "k1", "k2"]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        columns = [batch.column(c).to_pylist() for c in (*key_names, "conv")]
        for *key, conv in zip(*columns, strict=True):
            if key != now:
                if now is not None:
                    for column, v in zip(out, (*now, digest.hexdigest()), strict=True):
                        column.append(v)
                now, digest = key, hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], [*key_names, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in now), pa.array([digest.hexdigest()], pa.string())], [*key_names, "ends_sha256"])


def trie(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``df``: ``conv_id, turn, role, text``. Turns are ordered by turn, nulls first,
    then by the turn's digest; null roles and texts are empty ones. Each conversation
    is rebuilt first (:func:`rebuilt`). Rows without a conversation id belong to
    none and are left out; repeated rows are repeated turns. An empty table gives
    an empty result. Ids of turns and keys of nodes have 128 bits.
    """
    rows = stage(rebuilt(stage(turn_ids(df.select("conv_id", "turn", "role", "text")), "turns")), "rebuilt")
    wide = stage(blocks(rows, width), "blocks")
    key = ["depth", "k1", "k2"]
    nodes = stage(rolled(wide, [("min(conv)", "conv_id"), ("count(*)", "n_convs")], width), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, key, "left").na.fill(0, ["n_children"])
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    # A conversation stands for the nodes whose smallest member it is; these form the end of its path.
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("saved_above", F.coalesce(F.sum("saved").over(above), F.lit(0)))
    nodes = stage(nodes, "counted")
    worth = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    paid = wide.join(worth, "conv", "left").na.fill(0, ["saved", "leaf"])
    sums = rolled(paid, [("sum(saved)", "saved_all"), ("sum(leaf)", "n_leaves")], width).select(*key, "saved_all", "n_leaves")
    # Ends: the key of a conversation's last node is its last block's, with that block's turns.
    end = wide.where(F.floor(F.greatest(F.col("last") - 1, F.lit(0)) / width) == F.col("block"))
    fold = []
    for w in (1, 2):
        k = F.col(f"k{w}")
        for j in range(1, width + 1):
            k = k.bitwiseXOR(F.when(F.col(f"t{j}").isNotNull(), _mark(F.col("block") * width + j, F.col(f"t{j}"), w)).otherwise(F.lit(0)))
        fold.append(k.alias(f"k{w}"))
    ends = end.select(F.col("last").alias("depth"), *fold, "conv").repartition(*key).sortWithinPartitions(*key, "conv")
    digests = ends.mapInArrow(_end_digests, "depth long, k1 long, k2 long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    t = nodes.join(sums, key).join(digests, key, "left").join(parents, ["depth", "p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return t.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved_all") - F.col("saved_above")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
