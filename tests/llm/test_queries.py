"""Registered queries against SQL, and the pipeline's stages against their operators' contracts."""

import pytest
from comparing import assert_same
from pyspark.sql import functions as F

from firegrid.llm import mixing, queries
from firegrid.llm.common import stage


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(name, spark, duck, sf_dir):
    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    from test_neardup import brute

    docs = queries.table(spark, sf_dir, "documents")
    extra = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = stage(docs.unionByName(extra).unionByName(docs.limit(2)), "docs")
    kept = [docs]
    for name, step in p.STAGES[:-1]:
        kept.append(stage(step(spark, kept[-1], sf_dir), name))
        assert kept[-1].columns == docs.columns
    _, known, single, apart, mixed = (k.toPandas() for k in kept)
    assert known.text.notna().all() and len(known) >= 0.98 * (docs.count() - 3)
    assert single.text.str.split().str.join(" ").is_unique and single.doc_id.is_unique
    _, comp = brute(list(zip(single.doc_id, single.text, strict=True)))
    assert sorted(apart.doc_id) == sorted({*comp.values()})
    want = mixing.mix_sources(kept[3]).agg(F.sum("taken")).first()[0]
    assert mixed.text.str.findall(r"[^\x20\x09-\x0D]+").str.len().sum() == want
    packed = p.STAGES[-1][1](spark, kept[4], sf_dir).toPandas()
    g = packed.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert set(packed.doc_id) == set(mixed.doc_id) and p.ORACLE_SQL is None


def clashing(spark, rows):
    """Documents with columns of the names that stages use inside."""
    names = ["row", "id", "keep", "own", "sha", "nth", "size", "copy", "cut", "taken", "_size", "_copy", "_kept", "_body", "_id", "_text", "_lang", "rank", "length", "component_id", "kept"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *(f"'{n}' as {n}" for n in names))


def test_stages_carry_clashing_columns_and_take_edge_cases(spark, sf_dir):
    import corpus_pipeline as p

    words = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(k, f"{words} {words} number {k} of many", "en", "ab"[k % 2], 10) for k in range(40)]
    rows += [(1, "a a b c", "en", "a", 7), (2, "a  a b c", "en", "a", 8), (2, "b\nb\tc d e", "en", None, 9), (2, "b b c d e", "en", None, 9), (None, "no id has this text", None, "b", 1), (60, None, "en", "a", 0), (61, "", "en", "a", 0), (62, "123 456 !!", "en", "b", 0)]
    docs = stage(clashing(spark, rows), "clashing")
    now = docs
    for name, step in p.STAGES[:-1]:
        now = stage(step(spark, now, sf_dir), name)
        assert now.columns == docs.columns and all((r["row"], r["kept"], r["_size"]) == ("row", "kept", "_size") for r in now.collect()), name
    assert p.STAGES[-1][1](spark, now, sf_dir).count() >= now.count()
    known = p.keep_known_language(spark, docs, sf_dir).toPandas()
    assert known.text.notna().all() and not set(known.doc_id.dropna()) & {60, 61, 62}
    single = p.drop_exact_copies(spark, docs, sf_dir).toPandas()
    left = single[single.doc_id.isin([1, 2]) & single.text.str.len().lt(20)]
    assert sorted(zip(left.doc_id.astype(int), left.text, strict=True)) == [(1, "a a b c"), (2, "b\nb\tc d e")]
    assert single.doc_id.isna().sum() == 1 and len(single[single.doc_id == 60]) == 1 and len(single[single.doc_id == 61]) == 0
    near = p.drop_near_copies(spark, docs, sf_dir).toPandas()
    assert near.doc_id.isna().sum() == 1 and {60.0, 61.0} <= set(near.doc_id)


def test_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline as p

    docs = queries.table(spark, sf_dir, "documents").limit(0)
    for _, step in p.STAGES:
        assert step(spark, docs, sf_dir).count() == 0
