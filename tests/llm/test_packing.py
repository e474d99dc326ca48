import zlib

import numpy as np
import pytest

from firegrid.llm import packing
from firegrid.llm.queries import tokenizer_path

TEXTS = ["Hello, World. It's 12.5!", None, "", "É à la Çédille × ÷ ŉ İstanbul J̌", "a.,b ,. c\x1cd\xa0e f", "word " * 5000, "DON'T <|endoftext|> stop", "naïve Straße, ÜBER.", "a<|endoftext|>b <|EndOfText|> <|startoftext|>"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_tokenizers_ids(tokenizer):
    w = packing.WordIds(tokenizer_path(), limit=10)
    for _ in range(2):
        for text, ids in zip(TEXTS, w.encode([(t or "").encode() for t in TEXTS]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pack(spark, tokenizer):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(60)] + [(None, "null id"), (5, "repeated")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank")
    got = packing.pack(df, tokenizer_path=tokenizer_path(), capacity=64).toPandas()
    want = []
    for k, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-1 if k is None else k, p, p * 64, len(ids[p * 64 : p * 64 + 64]), zlib.crc32(ids[p * 64 : p * 64 + 64].tobytes())) for p in range(-(-len(ids) // 64))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.fillna({"doc_id": -1})[columns].astype(int).values.tolist())) == sorted(want)
    check_gapless(got, 64)


def check_gapless(got, capacity):
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    assert g.groupby("sequence_id").length.sum().max() <= capacity


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path=tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_gapless_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(5.5 + seed / 4, 1, 4000)).astype(int))
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    for groups in (16, 128):
        plan = packing.plan_packing(counts, 2048, groups)
        used, ranks = {}, {}
        for length, rank, n, sequence, offset in plan.runs:
            ranks.setdefault(length, []).extend(range(rank, rank + n))
            for k in range(n):
                used.setdefault(sequence + k, []).append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert plan.sequences <= 1.04 * -(-lengths.sum() // 2048) + 1 or (lengths > 1024).sum() > 0.9 * plan.sequences


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_grouped_plan_is_within_a_hundredth_of_the_bound(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    pieces = packing.token_pieces(docs, "doc_id", "text", tokenizer_path(), 2048)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    bound = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert packing.plan_packing(counts, 2048).sequences <= 1.01 * bound + 1


def test_grouping_carries_the_large_pieces():
    counts = {1000: 50, 1040: 50, 700: 40, 5: 100}
    chosen, used = packing.configurations(np.array([1040, 1000]), np.array([50, 50]), 2048, 2)
    assert used.sum() == pytest.approx(50) and (packing.whole_times(chosen, used, np.array([50, 50])) @ chosen == 50).all()
    plan = packing.plan_packing(counts, 2048)
    assert plan.sequences == 70  # fifty pairs of 1040 and 1000, twenty of 700 twice
