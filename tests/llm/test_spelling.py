"""Spelling variants against brute force, and the k-d tree's pieces."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from firegrid.llm import spelling


def brute(rows, ratio=10):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def texts(seed, n):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcdeé"), rng.integers(7, 12))) for _ in range(40)]
    out = []
    for k in range(n):
        words = []
        for _ in range(30):
            w = str(rng.choice(stems[: 1 + int(rng.integers(len(stems)))]))
            at, kind = int(rng.integers(len(w))), int(rng.integers(12))
            words.append({0: w[:at] + w[at + 1 :], 1: w[:at] + "z" + w[at:], 2: w[:at] + "y" + w[at + 1 :]}.get(kind, w))
        out.append((k, " ".join(words).upper() if k % 3 == 0 else "-".join(words)))
    return out


def found(df, **more):
    return {tuple(r) for r in spelling.variants(df, **more).select("word", "n", "n_near", "form", "form_n", "root").collect()}


def test_equals_brute_force(spark):
    rows = [*texts(1, 150), (None, "Variant variant variant"), (5, None), (6, ""), (7, "abcdefgh " * 50), (8, "x" * 3000 + " " + "x" * 3000), (9, "x" * 2999 + "é " + "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as word", "1 as n", "2 as form", "3 as cell")
    want = brute(rows)
    assert found(df) == want and any(r[3] for r in want)
    # Many cells and small buckets give the same.
    assert found(df, cell=20, bucket=3) == want


def test_chains_end_at_their_root(spark):
    words = ["abcdefg"] * 2 + ["abcdefgh"] * 20 + ["abcdefghi"] * 200 + ["abcdefghij"] * 2000
    rows = [(k, w) for k, w in enumerate(words) if zlib.crc32(f"{k}:{w}".encode()) % 31]
    got = {r[0]: r for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {r[0]: r for r in brute(rows)}
    assert got["abcdefgh"][5] == "abcdefghij"


def test_letters_in_other_orders_go_by_masks(spark):
    rng = np.random.default_rng(3)
    same = {"".join(rng.permutation(list("aabbccdd"))) for _ in range(300)}
    more = {w[:3] + "e" + w[4:] for w in list(same)[:50]} | {w + "f" for w in list(same)[:50]} | {w[1:] for w in list(same)[:50]}
    rows = [(k, w) for k, w in enumerate([*same, *more] * 3)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, most_equal=100) == want == found(df)


def test_empty_tables(spark):
    assert not found(spark.createDataFrame([], "doc_id long, text string"))
    assert not found(spark.createDataFrame([(1, None), (2, ""), (None, "short words only")], "doc_id long, text string"))


WORD = st.text(st.sampled_from("abcdeéÿ"), min_size=9, max_size=9)


@given(st.lists(WORD, min_size=1, max_size=60), st.lists(WORD, min_size=1, max_size=20), st.integers(1, 8))
def test_tree_reaches_every_near_word(points, queries, leaf):
    p, q = (spelling.letter_counts(spelling.letters_of(pa.array(x), 9)) for x in (points, queries))
    tree = spelling.Tree(p, leaf)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(len(points)))
    far = np.abs(p[None].astype(int) - q[:, None]).sum(2)
    bits = np.bitwise_count(spelling.codes_of(q)[:, None] ^ spelling.codes_of(p)[None])
    assert (bits <= far).all()
    for radius in (1, 2):
        met = {(int(i), int(j)) for leaf_, rows in tree.search(q, radius) for i in rows for j in tree.members[leaf_]}
        assert {tuple(map(int, x)) for x in np.argwhere(far <= radius)} <= met
    home = [0] * len(points)
    for leaf_, rows in tree.search(p, 0):
        for i in rows:
            home[i] = leaf_
    assert all(i in tree.members[h].tolist() for i, h in enumerate(home))


@given(st.lists(st.tuples(WORD, WORD), min_size=1, max_size=20))
def test_letter_order(pairs):
    a, b = (spelling.letters_of(pa.array([p[k] for p in pairs]), 9) for k in (0, 1))
    assert spelling.one_replaced(a, b).tolist() == [one_edit(x, y) for x, y in pairs]
    assert spelling.one_inserted(a[:, 1:], b).tolist() == [one_edit(x[1:], y) for x, y in pairs]
