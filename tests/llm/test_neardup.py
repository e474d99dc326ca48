import numpy as np
import pytest

from firegrid.llm import neardup


def shingles(text):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) or rows[a][0] == rows[b][0]:
                comp[find(a)] = find(b)
    return sets, {rows[k][0]: min(rows[j][0] for j in range(len(rows)) if find(j) == find(k)) for k in range(len(rows))}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [[f"w{x}" for x in rng.integers(0, 500, n)] for n in (4, 5, 30, 80, 120)]
    rows = []
    for k in range(220):
        words = list(base[k % 5])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 9)}"
        rows.append((k, " ".join(words).title() if k % 3 else "\n".join(words)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "One"), (905, "z " * 60_000)]
    sets, want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as kept", "3 as sig")
    got = neardup.near_duplicates(df, block=16).toPandas()
    assert len(got) == len(rows)
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == {r[0]: len(s) for r, s in zip(rows, sets, strict=True)}
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g"), (2, "q w e r t y"), (2, "completely other words stand here now"), (3, "completely other words stand here now")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == 5 and got[got.doc_id.isna()].kept.all()
    assert got[got.doc_id == 3].component_id.tolist() == [2.0]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bounds():
    least = neardup.least_matches(0.75, 1e-6)
    assert least == sorted(least) and 0.5 * neardup.HASHES < least[-1] < 0.75 * neardup.HASHES
    assert neardup.posterior(neardup.HASHES, neardup.HASHES, 0.75) > 0.99
    assert neardup.posterior(0, 16, 0.75) == pytest.approx(0.25**17)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 130)] + [(1, k) for k in range(2, 20)]
    got = {r["node"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 131)} | {k: 1 for k in range(2, 20)} | {k: v for k, v in got.items() if k in (1, 100)}


def test_members_meet_their_leader_part_by_part(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = {0: base}
    for k in range(1, 300):
        words = list(base)
        for at in rng.choice(400, int(rng.integers(0, 40)), replace=False):
            words[at] = f"x{k}"
        texts[k] = words
    texts |= {1000 + k: [f"y{x}" for x in range(k, k + 60)] for k in range(20)}
    texts = {k: " ".join(v) for k, v in texts.items()}
    found = [(k, 0) for k in range(1, 300)] + [(1000 + k, 1010) for k in range(20) if k != 10] + [(1000, 0)]
    want = set()
    for x, y in found:
        a, b = shingles(texts[x]), shingles(texts[y])
        if 100 * len(a & b) >= 75 * len(a | b):
            want.add((min(x, y), max(x, y)))
    assert 20 < len(want) < 300
    pairs, rows = spark.createDataFrame(found, "x long, y long"), spark.createDataFrame(list(texts.items()), "rep long, text string")
    for part in (512, 16):
        assert {tuple(r) for r in neardup.verify_leaders(pairs, rows, 75, part).collect()} == want
