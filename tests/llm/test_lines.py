"""Line dedup: brute force, reversibility, and the cuckoo filter."""

import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from firegrid.llm import lines
from firegrid.llm.common import shared_dir

LONG = "This line is long enough to count"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute(rows, least=3):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 20:
                holders.setdefault(key_of(line), set()).add(doc)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(holders.get(key_of(x), ())) < least or doc == max(holders[key_of(x)], key=lambda d: -1 if d is None else d)]
        out.append((doc, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def cleaned(df, **more):
    return sorted((tuple(r) for r in lines.drop_repeated_lines(df, **more).select("doc_id", "n_lines", "n_dropped", "kept").collect()), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    shared = [f"{LONG}, number {k}" for k in range(12)] + ["short", "", "É" + "é" * 18, "Éé" * 10, " \x0b"]
    rows = [(int(k), "\n".join([*map(str, rng.choice(shared, rng.integers(0, 9))), f"only here {k} and nowhere else"][:: 1 if k % 2 else -1])) for k in range(60)]
    rows += [(1, LONG), (1, LONG), (2, f"\t{LONG.upper()} \r"), (3, f"{LONG} "), (4, LONG.lower() + "\n"), (None, LONG), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, f"{LONG}\n" * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as key", "1 as n", "2 as kept", "3 as shard", "4 as drops")
    want = brute(rows)
    assert sum(r[2] for r in want) > 100
    assert cleaned(df) == want == cleaned(df, batches=5)


def test_a_hot_line_and_repeated_rows(spark, monkeypatch):
    rows = [(k, f"{LONG}\nown text of this document {k}") for k in range(3000)] + [(5, f"{LONG}\nthe same row again and again")] * 500 + [(None, f"{LONG}\nno id")] * 300
    assert cleaned(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty_tables(spark):
    assert cleaned(spark.createDataFrame([], "doc_id long, text string")) == []
    assert cleaned(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [(1, 1, 0, "")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "_id long, _text string")


def contents(index):
    return {tuple(r) for r in index.postings().collect()}, {tuple(r) for r in index.refs().collect()}


def test_insertions_and_deletions_undo_each_other(spark):
    one = [(k, f"{LONG} {k % 7}\n{LONG} own {k}") for k in range(40)]
    two = [(k, f"{LONG} {k % 9}\n{LONG} own {k}") for k in range(100, 140)]
    empty = lines.LineIndex(spark, shared_dir(spark), 3)
    keys = {name: lines.line_keys(docs(spark, rows)) for name, rows in (("one", one), ("two", two))}
    first = empty.insert(keys["one"])
    both = first.insert(keys["two"])
    again = both.insert(keys["one"])  # nothing is counted twice
    assert contents(again) == contents(both)
    assert both.refs().agg({"n": "sum"}).first()[0] == 160
    back = again.delete(docs(spark, two).select("_id"))
    assert contents(back) == contents(first)
    # The filters: nothing held is missed; of what went, next to nothing is left.
    held = back.may_hold(keys["one"]).collect()
    assert all(r["seen"] for r in held) and len(held) == 47
    own = lines.line_keys(docs(spark, [(1, "\n".join(f"{LONG} own {k}" for k in range(100, 140)))]))
    assert sum(r["seen"] for r in back.may_hold(own).collect()) <= 2
    assert all(r["seen"] for r in both.may_hold(own).collect())
    # Cleaning follows the index: with the second batch, its larger ids hold the shared lines.
    of = lambda index, rows: sorted((tuple(r) for r in index.clean(docs(spark, rows)).collect()), key=str)
    assert of(both, one + two) == brute(one + two)
    assert of(back, one) == brute(one)
    gone = back.delete(docs(spark, one).select("_id"))
    assert contents(gone) == (set(), set()) and not any(r["seen"] for r in gone.may_hold(keys["one"]).collect())


def test_a_full_shard_is_built_anew(spark):
    index = lines.LineIndex(spark, shared_dir(spark), 1).insert(lines.line_keys(docs(spark, [(1, f"{LONG} first")])))
    many = lines.line_keys(docs(spark, [(k, "\n".join(f"{LONG} {k} {i}" for i in range(100))) for k in range(30)]))
    index = index.insert(many)
    assert len(lines.Cuckoo.load(index.filters().first()["data"]).slots) > 64
    assert all(r["seen"] for r in index.may_hold(many).collect())
    assert index.refs().count() == 3001


@given(st.integers(0, 10**6), st.integers(0, 3000), st.integers(0, 3000))
def test_cuckoo_filter(seed, n, more):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**63, (n + more, 2), dtype=np.uint64)
    cuckoo = lines.Cuckoo.sized(n + more)
    assert cuckoo.insert(keys[:n]) and cuckoo.contains(keys[:n]).all()
    before = np.sort(cuckoo.slots[cuckoo.slots != 0])
    assert cuckoo.insert(keys[n:]) and lines.Cuckoo.load(cuckoo.dump()).contains(keys).all()
    cuckoo.remove(keys[n:])
    assert cuckoo.contains(keys[:n]).all() and (np.sort(cuckoo.slots[cuckoo.slots != 0]) == before).all()
    if more > 500:
        assert cuckoo.contains(keys[n:]).mean() < 0.02
    cuckoo.remove(keys[:n])
    assert not cuckoo.slots.any()


def test_keys_are_digests_of_the_stripped_lower_cased_line():
    assert lines.line_key(f"  {LONG}\r".encode()) == hashlib.md5(LONG.lower().encode()).digest()
    assert lines.line_key(b"x" * 19) is None and lines.line_key(("é" * 19).encode()) is None and lines.line_key(("é" * 20).encode())
