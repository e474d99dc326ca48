"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from firegrid.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))

    def order(t):
        turn, role, text = t
        digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
        return (turn is not None, turn or 0, digest)

    own = {c: [t[1:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(nodes, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = sum(saved[c] for c in children[node]) + (len(nodes[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        ends = sorted(c for c in nodes[node] if len(convs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' as block", "1 as k1", "2 as depth", "3 as conv", "4 as t")
    return sorted((tuple(r) for r in prefixes.trie(df, **more).select(*COLUMNS).collect()), key=str)


def test_equals_brute_force_in_blocks_of_any_width(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(120):
        for k in range(int(rng.integers(1, 30))):
            rows.append((c * 3, k, "user" if k % 2 == 0 else "assistant", ["hi", "yes", "ok é"][int(rng.integers(3)) if k > 3 else 0]))
    rows += [(-7, 0, "user", "hi"), (-10, 0, "user", "hi"), (10**12, 1, None, None), (10**12, None, "", ""), (5001, 0, "user", ""), (5003, 0, "u", "ser"), (5004, 0, "us", "er")]
    want = brute(rows)
    for width in (8, 3):
        assert found(spark, rows, width=width) == want


def test_null_ties_and_repeated_rows(spark):
    rows = [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, None, "system", None), (50, 2, None, "x"), (50, 2, None, "x"), (None, 1, "user", "no conversation"), (51, 1, "user", "a")] + [(55 + k, 0, "user", "hi") for k in range(10)]
    assert found(spark, rows) == brute(rows)


def test_turnless_conversations_and_empty_table(spark):
    # Conversations whose family's first is absent, with no turns after the borrowed ones.
    alone = [c for c in range(1, 300) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:4]
    rows = [(c, 0, "user", "x") for c in alone]
    assert [r[:6] for r in found(spark, rows)] == [(min(alone), 0, None, 4, 0, 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_a_hot_conversation_and_copies(spark):
    rows = [(5, k, "user", f"t{k % 3}") for k in range(4000)] + [(10 * c, k, "user", "same") for c in range(1, 800) for k in range(3)]
    assert found(spark, rows, width=16) == brute(rows)
    t = spark.createDataFrame(rows, SCHEMA)
    got = prefixes.turn_ids(t).groupBy("conv").agg({"i": "max"}).collect()
    assert {r[0]: r[1] for r in got}[5] == 4000
