import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from firegrid.llm import exact

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[SPACES.sub(" ", t or "")].append(k)
    return groups


def result(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as keep_id", "1 as kept", "2 as fp1")
    return exact.exact_duplicates(df, **more).toPandas()


def test_edge_cases(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, None), (5, ""), (7, "x"), (7, "x"), (None, "a\nb"), (None, "only"), (9, " a b"), (4, "é" * 200_000), (8, "é" * 200_000)]
    got = result(spark, rows)
    groups = brute(rows)
    assert len(got) == len(rows)
    for _, r in got.iterrows():
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [k for k in groups[text] if k is not None]
        assert r.group_size == len(groups[text])
        assert (r.keep_id == min(ids)) if ids else np.isnan(r.keep_id)
    assert got[got.kept].groupby("text_sha256").size().tolist() == [1] * len(groups)


def test_salts_and_huge_texts_change_nothing(spark):
    rows = [(k, f"text {k % 7} " + "word  " * (50 if k % 7 == 3 else 1)) for k in range(300)]
    a = result(spark, rows).sort_values("doc_id").reset_index(drop=True)
    b = result(spark, rows, rows_per_salt=10).sort_values("doc_id").reset_index(drop=True)
    assert a.equals(b)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = exact.fingerprint_rows(docs, "doc_id", "text", huge_chars=40).toPandas().sort_values("_id").reset_index(drop=True)
    whole = exact.fingerprint_rows(docs, "doc_id", "text").toPandas().sort_values("_id").reset_index(drop=True)
    assert cut.equals(whole)


@given(st.lists(st.sampled_from([b" ", b"\t\n", b"ab", b"\xc3\xa9", b"    "]), max_size=60), st.integers(1, 9), st.integers(1, 9))
def test_streamed_chunks_are_those_of_the_normalised_text(parts, step, chunk):
    data = np.frombuffer(b"".join(parts), np.uint8)
    body = exact.normalise(data, np.array([0, len(data)]))[0].tobytes()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(exact, "STEP_BYTES", step)
        patch.setattr(exact, "CHUNK", chunk)
        *chunks, digest = exact.streamed_chunks(data)
    assert chunks == ([body[k : k + chunk] for k in range(0, len(body), chunk)] or [b""]) and digest == hashlib.sha256(body).hexdigest()


def test_a_huge_text_equals_a_small_one_with_fewer_spaces(spark):
    small, wide = "word " * 30_000, "word" + " " * 90_000 + "word " * 29_999
    rows = [(1, small), (2, wide), (3, wide.replace(" ", "\n")), (4, small + "x"), (5, " " * 200_000), (6, " ")]
    got = result(spark, rows, huge_chars=170_000).sort_values("doc_id")
    assert got.keep_id.tolist() == [1, 1, 1, 4, 5, 5]
    assert got.text_sha256.tolist() == [hashlib.sha256(SPACES.sub(" ", t).encode()).hexdigest() for _, t in rows]


def test_empty_table(spark):
    assert result(spark, []).empty


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_fingerprints_compose(a, b):
    data = lambda x: np.frombuffer(x, np.uint8)
    one = lambda x: [int(v[0]) for v in exact.fingerprints(data(x), np.array([0, len(x)]))]
    for which, whole in enumerate(one(a + b)):
        assert exact.combine(one(a)[which], one(b)[which], len(b), which) == whole


def test_equal_fingerprints_of_different_texts_are_told_apart():
    import pyarrow as pa

    texts = {10: b"abcdef", 11: b"abcxef", 12: b"abcdef", 13: b"abcde!", 14: b"abcxef"}
    rows = sorted((p, k, t[2 * p : 2 * p + 2]) for k, t in texts.items() for p in range(3))
    n = len(rows)
    same = {"fp1": [1] * n, "fp2": [2] * n, "bytes": [6] * n, "part": [0] * n, "_id": [r[1] // 2 for r in rows], "row": [r[1] for r in rows], "place": [r[0] for r in rows], "chunk": [r[2] for r in rows]}
    other = {c: v[:3] for c, v in same.items()} | {"fp1": [5] * 3, "place": [0] * 3, "row": [1, 2, 3], "chunk": [b"a", b"b", b"a"]}
    for cut in (1, 4, n):
        both = pa.concat_tables([pa.table(same), pa.table(other)]).combine_chunks().to_batches(max_chunksize=cut)
        out = pa.Table.from_batches(list(exact.tell_apart(both)))
        assert out["cls"].to_pylist() == [0, 1, 0, 2, 1, 0, 1, 0]
        assert out["sha"].to_pylist()[:5] == [hashlib.sha256(t).hexdigest() for t in texts.values()]
        assert out["lead"].to_pylist() == [True, True, False, True, False, True, True, False]
        assert out["again"].to_pylist()[:5] == [False, False, False, False, False]


def test_huge_texts_and_cut_groups_match_brute_force(spark):
    rows = [(k, ("ab \n" * 30 + "x" * (k % 3)) if k % 2 else f"t {k % 5}") for k in range(200)] + [(7, "t 2"), (7, "t 2"), (None, "t  2"), (None, None), (3, "")]
    want = brute(rows)
    for more in ({"huge_chars": 20}, {"rows_per_salt": 4}, {"huge_chars": 20, "rows_per_salt": 4, "most_hot": 1000}):
        got = result(spark, rows, **more)
        assert len(got) == len(rows)
        for text, ids in want.items():
            mine = got[got.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
            real = [k for k in ids if k is not None]
            assert set(mine.group_size) == {len(ids)} and mine.kept.sum() == 1 and set(mine.keep_id.dropna()) == ({min(real)} if real else set())
