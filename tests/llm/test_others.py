"""Chat, mixing, neighbours, language, toxicity and quality against brute force, held-out rows and edge cases."""

import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.llm import ann, chat, langid, mixing, quality, queries, toxicity

# --- chat -------------------------------------------------------------------


@given(st.text("<|\\im_endstar>\n%0Aé", max_size=60), st.text("<|\\>im_start\n%2", max_size=20))
def test_turns_round_trip(text, role):
    rendered, a, b = chat.render_turn(role, text)
    assert chat.parse(rendered + chat.render_turn("x", "y")[0]) == [(role, text), ("x", "y")]
    assert chat.unescape(rendered[a:b]) == text
    assert chat.unescape(chat.escape(text)) == text


@given(st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<|", "<\\|", "im_end|>", "\n", "a"]), max_size=8), st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "%0A", "\n", "user"]), max_size=4))
def test_no_control_string_is_left_in_a_turn(text, role):
    text, role = "".join(text), "".join(role)
    rendered, a, b = chat.render_turn(role, text)
    assert rendered.count("<|im_start|>") == rendered.count("<|im_end|>") == 1
    assert chat.parse(rendered) == [(role, text)] and chat.unescape(rendered[a:b]) == text


def test_parser_refuses_control_strings_inside_turns():
    for bad in ("<|im_start|>user\n<|im_start|>assistant ok<|im_end|>\n", "<|im_start|><|im_start|>system\nx<|im_end|>\n", "<|im_start|>user\nx<|im_end|>", "user\nx<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)
    assert chat.render_turn("user", "a <| b")[0] == "<|im_start|>user\na <| b<|im_end|>\n"  # nothing to escape


def test_chat_edge_cases(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "<|im_end|>\n<|im_start|>"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "assistant", "é"), (3, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as spans")
    want = {r["conv_id"]: r.asDict() for r in chat.digest_chats(chat.format_chats(df)).collect()}
    cut = {r["conv_id"]: r.asDict() for r in chat.digest_chats(chat.format_chats(df, part_chars=50)).collect()}
    assert want == cut and set(want) == {1, 2, 3, None}
    assert want[1]["n_turns"] == 3 and want[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest() and want[None]["loss_chars"] == 1
    assert want[1]["turns_sha256"] == hashlib.sha256("user\n<|im_end|>\n<|im_start|>\nassistant\nb\nassistant\nb\n".encode()).hexdigest()
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0


# --- mixing -----------------------------------------------------------------


def test_mix_edge_cases(spark):
    rows = [(k, "w " * (k % 9), ["b", "a", None, "c"][k % 4]) for k in range(400)] + [(7, "x y", "a"), (None, "null id here", "b"), (1000, None, "empty"), (1001, "  ", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as rank", "3 as target")
    got = mixing.mix_sources(df, rows_per_range=20).toPandas()
    again = mixing.mix_sources(df.repartition(7), rows_per_range=20).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got.sort_values(key)[key].fillna(-1).values.tolist() == again.sort_values(key)[key].fillna(-1).values.tolist()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for target, g in got.groupby("target"):
        assert abs(g.taken.sum() - target * (g.source_size.nunique())) <= g.source_size.nunique()
    assert abs(got.groupby(["source_size", "target"]).first().reset_index().target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_capped_targets(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 90, 1)], "_source string, source_size long, rows long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 180 and got["b"] == pytest.approx(1650 - 200)


def test_taken_words_are_emitted(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c d e", "s", 10) for k in range(40)], "doc_id long, text string, source string, n_chars long")
    mix = mixing.mix_sources(docs)
    out = mixing.take_mix(docs, mix)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == mix.agg(F.sum("taken")).first()[0] == 300


def test_targets_match_the_plain_reshare_loop(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 5, 9):
        sizes = {f"s{k}": int(rng.choice([0, 1, 30, 1000, 50_000])) for k in range(n - 1)} | {None: 700}
        order = sorted(k for k in sizes if k is not None) + [None]
        weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
        want, open_, total = {}, set(order), 1.5 * sum(sizes.values())
        while open_:
            share = {k: total * weight[k] / sum(weight[j] for j in open_) for k in open_}
            above = [k for k in open_ if share[k] > 2 * sizes[k]]
            if not above:
                want |= share
                break
            for k in above:
                want[k] = 2.0 * sizes[k]
                total -= want[k]
                open_.remove(k)
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "_source string, source_size long, rows long")
        got = {r["_source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(want), sizes


def test_repeated_ids_take_shares_of_their_own_and_cuts_keep_white_space(spark):
    rows = [(k % 7, f" x{k}\n\ty  z{k} ", "s", 9, "a", "b") for k in range(25)] + [(3, None, "s", 0, "a", "b"), (None, "p\nq\nr", "s", 5, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, _copy string, _size string")
    mix = mixing.mix_sources(docs)
    out = mixing.take_mix(docs, mix)
    assert out.columns == docs.columns
    got = out.toPandas()
    assert got.text.str.findall(r"[^\x20\x09-\x0D]+").str.len().sum() == mix.agg(F.sum("taken")).first()[0] == round(1.5 * 78)
    texts = [r[1] for r in rows if r[1]]
    assert all(any(t.startswith(x) for t in texts) for x in got.text) and (got[~got.text.isin(texts)].text.str.len() == got[~got.text.isin(texts)].n_chars).all()
    assert got.text.isin(texts).sum() >= len(texts) and set(got._copy) == {"a"}
    assert mixing.take_mix(docs.limit(0), mix.limit(0)).count() == 0


# --- neighbours -------------------------------------------------------------


def test_recall_ties_and_unsound_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[500:1500] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] + [1.0] * 23), (5150, [None] + [1.0] * 23), (5200, [1.0] * 5), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as rank")
    got = ann.search(df).toPandas()
    assert set(got.query_id) == set(range(0, 3000, 50)) and (got.groupby("query_id").size() == 5).all()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -s))[:5]
        g = g.sort_values("rank")
        hits += len(set(best) & set(g.vec_id))
        assert np.allclose(g.score, (unit @ unit[q])[g.vec_id], atol=1e-12) and q not in set(g.vec_id)
        if q == 0 or 500 <= q < 1500:
            assert g.vec_id.tolist() == [k for k in [0, *range(500, 507)] if k != q][:5]
    assert hits / (5 * 60) >= 0.9


def test_exact_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[1000:3000] = x[1000] + rng.normal(size=(2000, 16)) * 1e-3  # a third of all rows
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for block in (16_384, 700):
        got = ann.search(df, block=block).toPandas().sort_values(["query_id", "rank"])
        near = {q: g.vec_id.tolist() for q, g in got.groupby("query_id")}
        assert set(near) == set(range(0, 6000, 50))
        for q, found in near.items():
            s = unit @ unit[q]
            s[q] = -9
            assert found == np.argsort(-s)[:5].tolist()


def test_repeated_ids_and_rows(spark):
    rows = [(0, [1.0, 0.0])] * 8 + [(1, [1.0, 0.1]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    # an id with more vectors near the query than neighbours are asked for; it asks with each of them
    many = [(50, [1.0, k / 100]) for k in range(20)] + [(k, [1.0, 0.5 + k / 10]) for k in range(1, 9)] + [(3, [1.0, 0.7])]
    got = ann.search(spark.createDataFrame(many, "vec_id long, embedding array<double>")).toPandas()
    assert len(got) == 20 * 5 and 50 not in set(got.vec_id) and set(got[got["rank"] == 1].vec_id) == {1}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_tables(spark, sf):
    df = queries.table(spark, f"/root/testdata/{sf}", "embeddings")
    got = ann.search(df).toPandas().sort_values(["query_id", "rank"])
    rows = df.select("vec_id", "embedding").toPandas().dropna().sort_values("vec_id")
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    ids = rows.vec_id.to_numpy()
    ok = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
    x, ids = x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True), ids[ok]
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        best = set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]])
        found = got[got.query_id == ids[q]]
        assert len(found) == min(5, len(ids) - 1) and np.allclose(np.sort(s)[::-1][: len(found)], found.score, atol=1e-9)
        hits, total = hits + len(best & set(found.vec_id)), total + len(best)
    assert hits / total >= 0.99


@given(st.integers(0, 10**6), st.floats(-1, 1))
def test_reach_never_drops_what_reaches(seed, least):
    rng = np.random.default_rng(seed)
    x, query = rng.normal(size=(200, 6)), rng.normal(size=6)
    x, query = x / np.linalg.norm(x, axis=1, keepdims=True), query / np.linalg.norm(query)
    books = rng.normal(size=(4, 16, 2)) * 0.4
    pairs = ann.pairs_of(x)
    code = rng.integers(0, 16, (200, 4))
    scores = ann.scan(ann.tables(ann.pairs_of(query[None]), books), ann.pack_codes(code))[0]
    may = ann.reach(scores, *ann.slack(pairs, ann.decode(books, code)), least)
    assert may[x @ query >= least].all()


def test_few_vectors_are_scored_exactly():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs, eta = ann.pairs_of(x), ann.eta_for(0.2, 64)
    books = ann.train(pairs[:4000], eta, rounds=6)
    coded = ann.decode(books, code := ann.encode(pairs, books, eta))
    finer = ann.train(pairs[:4000] - coded[:4000], 1.0, rounds=6)
    rest = ann.encode(pairs - coded, finer, 1.0, passes=0)
    block = ann.Block(np.arange(8000), np.ones(8000, bool), x, [ann.pack_codes(code), ann.pack_codes(rest)], [ann.slack(pairs, coded), ann.slack(pairs, coded + ann.decode(finer, rest))])
    for q in range(0, 8000, 400):
        t = ann.pairs_of(x[q][None])
        at, scores = block.nearest(ann.scan(ann.tables(t, books), block.codes[0])[0], ann.tables(t, finer)[0], x[q], 5, 60, -2.0)
        want = np.argsort(-(x @ x[q]))[:10]
        assert at.tolist() == want.tolist() and np.allclose(scores, (x @ x[q])[want])
    assert block.exact < 0.05 * 20 * 8000


def test_an_id_with_many_vectors_leaves_room_for_others(spark):
    # 400 vectors of id 50 alone lie nearest to its query; the nearest others must still come, ties of one vector included.
    rows = [(50, [1.0, k / 10_000]) for k in range(400)] + [(k, [1.0, 0.2 + k / 100]) for k in range(1, 9)] + [(9, [1.0, 0.0001]), (50, [1.0, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rerank=20).toPandas()
    assert len(got) == 401 * 5
    assert {tuple(g.sort_values("rank").vec_id) for _, g in got.groupby(got.index // 5)} >= {(9, 1, 2, 3, 4)}
    assert 50 not in set(got.vec_id)


@given(st.lists(st.tuples(st.integers(0, 3), st.booleans()), max_size=30), st.integers(1, 3))
def test_capped_keeps_k_of_one_id_alone(rows, k):
    lead, single = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool)
    want, seen = [], {}
    for at, (of, alone) in enumerate(rows):
        seen[of] = seen.get(of, 0) + alone
        if not alone or seen[of] <= k:
            want.append(at)
    assert ann.capped(np.arange(len(rows)), lead, single, k).tolist() == want


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(df).collect()] == [(0, 1, 1, 0.0)]
    assert ann.search(df.limit(0)).count() == 0


def test_anisotropic_codes_keep_parallel_residuals_smaller():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x = ann.pairs_of(x / np.linalg.norm(x, axis=1, keepdims=True))
    along = {}
    for eta in (1.0, 4.0):
        books = ann.train(x, eta)
        code = ann.encode(x, books, eta)
        near = np.take_along_axis(books[None], code[:, :, None, None], 2)[:, :, 0]
        along[eta] = np.abs(((x - near) * x).sum((1, 2))).mean()
    assert along[4.0] < along[1.0]


# --- language, toxicity, quality ---------------------------------------------


def test_language_on_held_out_rows_and_edges(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 !!", None), (-4, "the " * 50_000, "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd).selectExpr("*", "1 as score", "2 as events")
    got = langid.identify(both).toPandas().merge(both.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out & (got.doc_id >= 0)]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert set(got[got.doc_id.isin([-1, -2, -3])].lang_pred) == {"und"} and got[got.doc_id.isin([-1, -2, -3])].rejected.all()
    assert got[got.doc_id >= 0].rejected.mean() < 0.02
    none = langid.identify(both.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert set(none.lang_pred) == {"und"} and langid.identify(both.limit(0)).count() == 0


def test_model_is_a_distribution():
    g = np.array([(0 << 48) | (0 << 32) | (a << 16) | b for a in (0, 97, 98) for b in (97, 98, 99)], np.uint64)
    m = langid.build_model(["x"], np.zeros(len(g), int), g, np.arange(1, len(g) + 1))
    for a in (97, 98):
        after = np.array([(a << 16) | b for b in (97, 98, 99)], np.uint64)
        assert np.exp(m.score(after)).sum() <= 1 + 1e-6


def kneser_ney(counts):
    """The model as written in the papers, from dictionaries: counts of four-letter sequences to a function of context and letter."""
    order = 4
    levels = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        low = {}
        for gram in levels[k + 1]:
            low[gram[1:]] = low.get(gram[1:], 0) + 1
        levels[k] = low

    def prob(gram, k, letters):
        if k == 0:
            return 1 / max(2, letters + 1)
        gram = gram[-k:]
        table = levels[k]
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return prob(gram, k - 1, letters)
        return max(same.get(gram, 0) - discount, 0) / total + discount * len(same) / total * prob(gram, k - 1, letters)

    letters = len(levels[1])
    return lambda gram: prob(gram, order, letters)


def test_model_matches_a_dictionary_one():
    from firegrid.llm.letters import letter_events

    text = "la vie est belle et la mer est bleue. le chat est la. les amis sont la et la lune luit " * 2
    other = "abba laba zzz est la nuit"
    events = lambda t: letter_events(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    g, n = np.unique(langid.grams(*events(text)), return_counts=True)
    model = langid.build_model(["x"], np.zeros(len(g), int), g, n)
    unpack = lambda x: tuple(int(x) >> 16 * k & 0xFFFF for k in (3, 2, 1, 0))
    want = kneser_ney({unpack(x): int(c) for x, c in zip(g, n, strict=True)})
    asked = np.concatenate((langid.grams(*events(text)), langid.grams(*events(other))))
    assert np.allclose(np.exp(model.score(asked)[:, 0]), [want(unpack(x)) for x in asked], rtol=1e-4)


def test_language_ties_repeats_nulls_and_letters_of_all_planes(spark):
    rows = [(k, ("le chat dort sur la table " if k % 2 else "the cat sleeps on the table ") * (1 + k % 3), ["en", "fr"][k % 2]) for k in range(60)]
    rows += [(2, "the cat sleeps", "en")] * 3 + [(None, "le chat", "fr"), (71, "\U00010400\U00010401\U00010402", None), (72, "\U0001d400\U0001d401", None), (73, "\u4f60\u597d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as _lang", "1 as best", "2 as nth")
    got = langid.identify(df, train_docs=10).toPandas()
    assert len(got) == len(rows) and set(got[got.doc_id.isin([71, 72, 73])].lang_pred) <= {"en", "fr"}
    assert got[got.doc_id.isna()].lang_pred.tolist() == ["fr"] and got[got.doc_id == 2].lang_pred.tolist() == ["en"] * 4
    again = langid.identify(df.repartition(5), train_docs=10).toPandas()
    key = ["doc_id", "lang_pred", "score", "entropy"]
    assert got.sort_values(key)[key].round(9).astype(str).values.tolist() == again.sort_values(key)[key].round(9).astype(str).values.tolist()
    kept = langid.known(df, train_docs=10)
    assert kept.columns == df.columns and kept.count() == (~got.rejected).sum()


def test_chosen_rows_are_those_of_the_smallest_hashes(spark):
    rows = [(k % 900, f"t{k}", "ab"[k % 10 > 0]) for k in range(3000)] + [(5, f"same {k}", "c") for k in range(30)]
    df = spark.createDataFrame(rows, "_id long, _text string, _lang string")
    for most in (7, 100, 5000):
        got = langid.choose(df, most).toPandas()
        assert got.groupby("_lang").size().to_dict() == {k: min(most, sum(r[2] == k for r in rows)) for k in "abc"}
        order = df.withColumn("h", F.shiftrightunsigned(F.xxhash64("_id"), 33)).toPandas().sort_values(["_lang", "h", "_id", "_text"])
        want = order.groupby("_lang").head(most)
        assert sorted(got._text) == sorted(want._text)


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best one (leftmost, then shortest), then those left and right of it."""
    out = []

    def go(a, b):
        best, where = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > best + 1e-9:
                    best, where = total, (i, j)
        if where:
            go(a, where[0])
            out.append((*where, best))
            go(where[1] + 1, b)

    go(0, len(scores))
    return out


@given(st.lists(st.integers(-3, 4), max_size=18))
def test_maximal_segments_are_all_of_them(scores):
    scores = [s + 0.001 * k + 0.0003 for k, s in enumerate(scores)]  # without zeros and ties of sums
    at = np.array([k for k, s in enumerate(scores) if s > 0], int)
    lost = np.cumsum([max(-s, 0) for s in scores])[at] if len(at) else np.zeros(0)
    found = toxicity.maximal_segments(at, np.array(scores)[at], 0.0, np.diff(lost, prepend=0.0))
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in found] == pytest.approx([s for *_, s in want])


def test_extreme_value_law_is_recovered_from_its_own_segments():
    rng = np.random.default_rng(7)
    for decay, scale in ((0.7, 0.01), (2.5, 0.2)):
        words, least = 400_000, 1.5
        scores = least + rng.exponential(1 / decay, rng.poisson(scale * words * np.exp(-decay * least)))
        law = toxicity.Law.fitted(len(scores), scores.sum(), scores.min(), words)
        assert law.decay == pytest.approx(decay, rel=0.1) and law.scale == pytest.approx(scale, rel=0.35)
    assert toxicity.Law.fitted(0, 0.0, 0.0, 500) == toxicity.Law(1.0, 1 / 500)


def test_compiled_rules_match_a_row_wise_evaluator(spark):
    described = """Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 6 <= 0.25)
      Predict: 0.0
     Else (feature 6 > 0.25)
      Predict: 1.0
    Else (feature 0 > 2.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 3 <= 1.0E-3)
     Predict: 0.0
    Else (feature 3 > 1.0E-3)
     Predict: 1.0
"""
    rules = quality.tree_rules(described)
    assert set(rules) == {((0, True, 2.5),), ((0, True, 2.5), (6, True, 0.25)), ((0, True, 2.5), (6, False, 0.25)), ((0, False, 2.5),), ((3, True, 1e-3),), ((3, False, 1e-3),)}
    texts = [None, "", "A", "aaa bbb ccc " * 20, "CAPS CAPS", "x" * 500, "one two\none two\n", "é!!", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    stats = quality.text_statistics(docs, [])
    got = stats.select("*", *(quality.rule_column(r).alias(f"r{k}") for k, r in enumerate(rules))).toPandas()
    for _, row in got.iterrows():
        for k, rule in enumerate(rules):
            holds = all((row[quality.STATISTICS[f]] <= bound) == below for f, below, bound in rule)
            assert row[f"r{k}"] == float(holds)


def test_statistics_match_plain_python(spark):
    import math

    texts = ["", "A bb  CCC\n\n1 2!", "aa aa aa bb\naa aa aa bb\nx", "éé | é\t#", " lead", "x" * 300 + "\ny", "a\n\na\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_id long, _text string")
    got = quality.text_statistics(docs, []).toPandas().sort_values("_id").to_dict("records")
    for t, row in zip(texts, got, strict=True):
        raw = t.encode()
        words = raw.split()
        n = len(raw)
        lines = raw[:-1].split(b"\n") if raw.endswith(b"\n") else raw.split(b"\n")
        lines = lines if n else []
        assert row["bytes"] == pytest.approx(math.log1p(n)) and row["words"] == pytest.approx(math.log1p(len(words)))
        assert row["longest_word"] == pytest.approx(math.log1p(max(map(len, words), default=0)))
        assert row["mean_word"] == pytest.approx(sum(map(len, words)) / max(len(words), 1))
        assert row["repeated_word"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1))
        for name, members in quality.CLASSES.items():
            assert row[name] == pytest.approx(sum(b in members for b in raw) / max(n, 1)), name


@given(st.lists(st.tuples(st.integers(1, 6), st.floats(0.5, 5)), max_size=12))
def test_maximal_segments_hold_the_best_one(gaps):
    at = np.cumsum([g for g, _ in gaps]).astype(int) if gaps else np.zeros(0, int)
    w = np.array([x for _, x in gaps])
    scores = np.full((at.max() if len(at) else 0) + 3, -1.0)
    scores[at] = w
    best = max((scores[a:b].sum() for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)
    found = toxicity.maximal_segments(at, w, 1.0)
    assert len(found) == 0 if not len(at) else max(s for *_, s in found) == pytest.approx(best)
    assert all(s == pytest.approx(scores[a : b + 1].sum()) for a, b, s in found)
    assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def made(spark, n=600):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ana", "elo", "iru", "onto")]
    rows, labels = [], []
    for k in range(n):
        t = list(rng.choice(words, 80))
        toxic = k % 6 == 0
        for p in rng.integers(0, 80, 5 if toxic else 0):
            t[p] = ["vileness", "grotesk"][p % 2]
        junk = k % 5 == 0
        rows.append((k, " ".join(w.upper() + "!!" if junk else w for w in t)))
        labels.append((k, int(not junk), int(toxic)))
    rows += [(-1, None), (-2, ""), (-3, "x" * 100_000), (None, "no id")]
    labels += [(-5, 1, 1), (None, 1, 1), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "2 as toxic"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = made(spark)
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == 604 and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id >= 0)]
    assert ((held.score >= 0.7) == (held.doc_id % 6 == 0)).mean() > 0.98
    assert (got[got.doc_id < 0].score < 0.5).all()
    twice = toxicity.toxicity(docs.unionByName(docs.where("doc_id in (0, 1, 6)")), labels).toPandas()
    pairs = twice[twice.doc_id.isin([0, 1, 6])].groupby("doc_id").score.nunique()
    assert len(twice) == 607 and pairs.tolist() == [1, 1, 1]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0


def test_quality(spark):
    docs, labels = made(spark)
    got = quality.quality(docs, labels).toPandas()
    assert len(got) == 604 and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id >= 0)]
    assert ((held.score >= 0.5) == (held.doc_id % 5 != 0)).mean() > 0.98
    many = labels.unionByName(labels.where("doc_id < 50").withColumn("quality", F.lit(0)))  # the largest of an id's labels counts
    again = quality.quality(docs.unionByName(docs.where("doc_id in (0, 1)")), many).toPandas()
    assert len(again) == 606 and again.groupby("doc_id").score.nunique().max() == 1
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5


def test_held_out_scores_on_given_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = queries.table(spark, d, "labels")
    for query, column, least in ((queries.op5_quality, "quality", 0.97), (queries.op10_toxicity, "toxic", 0.95)):
        got = query(spark, d).where("held_out").join(labels, "doc_id").toPandas()
        assert (got.predicted == got[column]).mean() > least, column


def test_the_bar_of_least_loss_is_taken(spark):
    rng = np.random.default_rng(12)
    common = [f"{a}{b}ing" for a in "bcdfghjk" for b in "aeiouy"]
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = list(rng.choice(common, int(rng.integers(5, 60)))) + (["vileword", "hateful"] if bad else [])
        rows.append((k, " ".join(map(str, rng.permutation(words)))))
        marks.append((k, int(bad)))
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    run = lambda *bars: toxicity.toxicity(df, labels, least_z=bars).select("doc_id", "held_out", "score").toPandas().set_index("doc_id").sort_index()
    low, high, both = run(1.5), run(4.0), run(1.5, 4.0)
    truth = np.array([m for _, m in marks])
    right = lambda t: (((t.score >= 0.7) == (truth == 1)) & t.held_out).sum()
    assert both.equals(high) or both.equals(low)
    assert right(both) == max(right(low), right(high)) >= 0.98 * both.held_out.sum(), (right(low), right(high))
