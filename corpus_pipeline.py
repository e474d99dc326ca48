"""The corpus pipeline: language, exact copies, near copies, source mix, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written and read again as the next one's documents. All but the last return the
columns of ``documents`` and carry further columns of any name along. Every
stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firegrid.llm import exact, langid, mixing, neardup, packing
from firegrid.llm.common import SPACES, stage
from firegrid.llm.queries import tokenizer_path


def _carried(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column ``row``, beside their ``id``: no name of theirs can clash with a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))


def _rows(carried: DataFrame, docs: DataFrame) -> DataFrame:
    return carried.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; those rejected go.

    Each row is judged on its own text, repeated rows and ids alike. Null texts
    and texts without letters have no language and go.
    """
    return langid.known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal up to white space the one of the smallest id.

    A null text counts as empty, and a null id comes after all others. Of rows
    that repeat an id and its text one stays (the first by its text as written);
    rows that repeat an id with another text are documents of their own.
    """
    every = stage(exact.exact_duplicates(docs), "exact")
    found = every.where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("sha"))
    body = F.regexp_replace(F.coalesce(F.col("row.text"), F.lit("")), SPACES, " ")
    rows = _carried(docs).withColumn("own", F.sha2(body, 256))
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("keep")) & (F.col("own") == F.col("sha")), "left_semi")
    if every.groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return _rows(rows, docs)
    one = Window.partitionBy("own").orderBy(F.col("row.text").asc_nulls_last())  # the ids of a text that stay are equal
    return _rows(rows.withColumn("nth", F.row_number().over(one)).where("nth = 1"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Texts without words, null ones among them, are near to nothing and stay, as do
    documents with a null id. Rows that repeat an id are one document and stay or
    go together.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("keep")).distinct()
    return _rows(_carried(docs).join(kept, F.col("id").eqNullSafe(F.col("keep")), "left_semi"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; the one in which a budget ends is cut there.

    A null source is a source. Texts without words, null ones among them, have
    nothing to take and go. Rows that repeat an id are taken each.
    """
    return mixing.take_mix(docs, mixing.mix_sources(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets.

    Every row is a document, repeated ids included; null and empty texts are
    documents of one token.
    """
    return packing.pack(docs, tokenizer_path=tokenizer_path())


STAGES = [
    ("language", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The language models cannot be written in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
