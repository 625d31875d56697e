from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aspectra.functions import stemmer, strings
from aspectra.operators import align, annotate, cvalue, graph, itemsets, joins, propagate, running, text, windows
from aspectra.plans import evaluate, grid


@pytest.fixture
def toks(spark):
    def make(*sents):
        rows = []
        for s, sent in enumerate(sents, 1):
            for i, t in enumerate(sent.split()):
                w, pos, iob = (t.split("/") + ["O"])[:3]
                rows.append(("c", s, s, i, w, w.lower(), pos, iob))
        return spark.createDataFrame(rows, "corpus string, review_id long, sent_id long, idx int, word string, lemma string, pos string, iob string")

    return make


@pytest.mark.parametrize(
    "word, stem",
    [
        ("sky", "sky"), ("skies", "sky"), ("dying", "die"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("agreedly", "agre"), ("hopping", "hop"),
        ("falling", "fall"), ("generic", "generic"), ("communism", "communism"), ("inning", "inning"), ("national", "nation"), ("relational", "relat"),
        ("bell", "bell"), ("rate", "rate"), ("naïve", "naïve"), ("by", "by"), ("happy", "happi"), ("say", "say"), ("hoping", "hope"), ("consistency", "consist"), ("knightly", "knight"), ("y's", "y"),
    ],
)
def test_stemmer(word, stem):
    assert stemmer.stem(word) == stem


def test_stem_columns_agree_with_the_function(spark):
    words = ["caresses", "ties", "cries", "gas", "this", "kiwis", "dog's", "dogs'", "boy"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.s for r in df.select("word", stemmer.step_1a(stemmer.step_0(F.col("word"))).alias("s")).collect()}
    assert got == {"caresses": "caress", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "kiwis": "kiwi", "dog's": "dog", "dogs'": "dog", "boy": "boy"}
    assert {(r.word, r.stem) for r in stemmer.stems(df).collect()} == {(w, stemmer.stem(w)) for w in words}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (x == y)))
        row = new
    return row[-1]


def test_ratio(spark):
    pairs = [("kitten", "sitting"), ("good", "goods"), ("same", "same"), ("abc", "xyz"), ("", ""), ("", "a"), ("héé", "hé")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", strings.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        n = len(r.a) + len(r.b)
        assert r.r == pytest.approx(2 * _lcs(r.a, r.b) / n if n else 1.0)
    assert round(got[0].r, 4) == 0.6154 and round(got[1].r, 4) == 0.8889


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "b binary")
    assert [r[0] for r in df.select(strings.decoded(F.col("b"))).collect()] == ["é", "é"]
    assert spark.createDataFrame([("a/é",)], "t string").select(strings.ascii_only(strings.escape_slash(F.col("t")))).first()[0] == "a&slash;?"


def test_chunk_ids(toks):
    t = toks("a/X/B-NP b/X/I-NP c/X/B-VP d/X/B-NP e/X/O f/X/O g/X/I-NP")
    assert [r.chunk_id for r in text.chunked(t).orderBy("idx").collect()] == [1, 1, 2, 3, 4, 4, 5]


def test_phrase_search(toks):
    t = toks("a/X b/X a/X b/X c/X")
    find = lambda w: [(r.start, r.stop) for r in text.phrase_spans(t, w).collect()]
    assert find(["a", "b", "c"]) == [(2, 5)] and find(["a", None, "c"]) == [(2, 5)] and find(["b"]) == [(1, 1)] and find(["x"]) == [] and find(["b", None, None, None, None]) == []


def test_slice_modes(toks):
    t = toks("a/X/B-NP b/X/I-NP c/X/B-VP d/X/I-VP")
    got = lambda mode: [r.iob for r in text.piece(t, None, 0, 4, mode)[0].orderBy("idx").collect()]
    assert got("reference") == ["B-NP", "I-NP", "O", "O"] and got("intended") == ["B-NP", "I-NP", "B-VP", "I-VP"]


def test_neighbours_miss_the_first_token_in_reference_mode(toks):
    t = toks("a/NN b/X c/NN d/X")
    got = lambda mode: [(r.next_idx, r.prev_idx) for r in windows.neighbours(t, "NN", mode).orderBy("idx").collect()]
    assert got("reference") == [(2, None), (2, None), (None, None), (None, 2)]
    assert got("intended") == [(2, None), (2, 0), (None, 0), (None, 2)]


def test_clean_terms_as_the_list_shrinks(spark):
    t = spark.createDataFrame([("k", i, s) for i, s in enumerate([0, 0, 0, 5, 0])], "kind string, ord int, support int")
    assert sorted(r.ord for r in text.clean_terms(t, 0, "reference").collect()) == [1, 3]
    assert [r.ord for r in text.clean_terms(t, 0).collect()] == [3]


def test_noun_runs_and_lost_tail(toks):
    t = toks("the/DT/B-NP red/JJ/I-NP dog/NN/I-NP house/NN/I-NP is/VB/B-VP big/NN/B-NP dogs/NN/B-NP")
    assert [r.word for r in windows.noun_runs(t).orderBy("place").collect()] == ["the", "red", "dog house", "is"]
    assert [r.word for r in windows.noun_runs(t, "intended").orderBy("place").collect()] == ["the", "red", "dog house", "is", "big dogs"]


def test_regroup_loses_the_next_token_in_reference_mode(spark, toks):
    t = toks("zoom/NN in/IN on/IN the/DT optical/JJ zoom/NN lens/NN now/RB", "plain/JJ")
    spans = spark.createDataFrame([(1, 4, 6), (1, 4, 7)], "sent_id long, start int, stop int")
    words = lambda mode: [r.word for r in windows.regroup(t, spans, mode).where("sent_id = 1").orderBy("place").collect()]
    assert words("intended") == ["zoom", "in", "on", "the", "optical zoom lens", "now"]
    assert words("reference") == ["zoom", "in", "on", "the", "optical zoom", "now"]
    assert windows.regroup(t, spans).where("sent_id = 2").count() == 1


def test_negation_windows(toks):
    t = toks("not/X a/X b/X c/X d/X e/X not/X")
    near = lambda m: [r.negations for r in windows.negations_near(t, ["not"], 3, m).orderBy("idx").collect()]
    assert near("reference") == [1, 1, 1, 1, 1, 1, 1] and near("intended") == [1, 1, 1, 2, 1, 1, 1]


def test_spans_and_third_condition(toks):
    t = toks("a/DT b/JJ c/NN d/VBZ e/NN f/NNS g/NNPS")
    assert sorted((r.start, r.stop) for r in cvalue.spans(t, 2).collect()) == [(1, 3), (4, 7)]
    assert cvalue.spans(t, 3).count() == 2


def test_cvalue_by_hand(spark):
    g = spark.createDataFrame([("optical zoom", 2, 5), ("optical zooms", 2, 2), ("big optical zoom", 3, 1)], "string string, t int, freq long")
    ref = {r.string: r.cvalue for r in cvalue.cvalue(g).collect()}
    assert ref["optical zoom"] == pytest.approx(math.log(2) * 5 * (2 + 3) / 2) and ref["optical zooms"] == pytest.approx(math.log(2) * 2)
    assert {r.string: r.cvalue for r in cvalue.cvalue(g, "intended").collect()}["optical zoom"] == pytest.approx(math.log(2) * (5 - 1.5))


def test_nested_groups_brute_force(spark):
    import itertools

    words = ["a", "ab", "ba", "b"]
    strings_ = [" ".join(p) for n in (2, 3) for p in itertools.product(words, repeat=n)]
    g = spark.createDataFrame([(s, len(s.split()), 1) for s in strings_], "string string, t int, freq long")
    got = {(r.string, r.other) for r in cvalue.nested(g).collect()}
    assert got == {(a, b) for a in strings_ for b in strings_ if a != b and a in b}


def test_pure_support_and_pruning(spark):
    sets = spark.createDataFrame([("a", ["a"], 3), ("a+b", ["a", "b"], 1), ("b", ["b"], 2)], "set_id string, items array<string>, support long")
    occ = spark.createDataFrame([("a", s, ["a"]) for s in (1, 2, 3)] + [("b", s, ["b"]) for s in (1, 4)] + [("a+b", 1, ["a", "b"])], "set_id string, sent_id long, items array<string>")
    assert {(r.set_id, r.psupport) for r in itemsets.pure_support(sets, occ).collect()} == {("a", 2), ("b", 1), ("a+b", 1)}
    kept = lambda n, m: sorted(r.set_id for r in itemsets.redundancy_pruning(sets, occ, n, m).collect())
    assert kept(1, "reference") == ["a", "a+b"] and kept(1, "intended") == ["a", "a+b", "b"] and kept(2, "intended") == ["a", "a+b"]


def test_pop_while_reading_keeps_the_middle_one(spark):
    sets = spark.createDataFrame([(s, [s], 1) for s in "abc"], "set_id string, items array<string>, support long")
    bad = sets.select("set_id")
    assert [r.set_id for r in itemsets._drop(sets, bad, "reference").collect()] == ["b"]
    assert itemsets._drop(sets, bad, "intended").isEmpty()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcde"), max_size=4), min_size=1, max_size=12), st.integers(1, 3))
def test_frequent_itemsets_brute_force(spark, baskets, least):
    import itertools

    rows = [(i, x) for i, b in enumerate(baskets) for x in b] or [(0, "z")]
    got = {(r.set_id, r.support) for r in itemsets.frequent(spark.createDataFrame(rows, "sent_id long, item string"), len(baskets), -least, 3).collect()}
    items = sorted({x for _, x in rows})
    baskets = [{x for j, x in rows if j == i} for i in range(len(baskets))]
    want = {("+".join(c), n) for k in (1, 2, 3) for c in itertools.combinations(items, k) if (n := sum(set(c) <= b for b in baskets)) >= least}
    assert got == want


def test_compact_positions(spark, toks):
    t = toks("a/NN x/X b/NN x/X x/X x/X a/NN")
    occ = spark.createDataFrame([("a+b", 1, ["a", "b"]), ("a", 1, ["a"])], "set_id string, sent_id long, items array<string>")
    got = {(r.set_id, tuple(r.idxs)) for r in windows.compact_positions(occ, t, 3).collect()}
    assert got == {("a+b", (0, 2)), ("a", (0,)), ("a", (6,))}


def test_clusters(spark):
    w = spark.createDataFrame([(x,) for x in ("color", "colour", "zoom", "colours")], "word string")
    assert all(r.word == r.cluster for r in itemsets.clusters(w, 90).collect())
    assert {(r.word, r.cluster) for r in itemsets.clusters(w, 80, "intended").collect()} == {("color", "color"), ("colour", "color"), ("colours", "color"), ("zoom", "zoom")}


def _edges(spark, rows):
    return spark.createDataFrame([(1, i + 1, h, l, d) for i, (h, l, d) in enumerate(rows)], "sent_id long, rel_id int, head_idx int, label string, dep_idx int")


def _rule(spark, toks, name, known, sent, rows):
    t = toks(sent)
    e = propagate.labelled(t, _edges(spark, rows))
    k = spark.createDataFrame([(known,)], "term string")
    return sorted(r.term for r in propagate.apply_rule(name, e, propagate.sibling_edges(e), k).collect())


def test_rules(spark, toks):
    run = lambda *a: _rule(spark, toks, *a)
    assert run("1_1", "good", "good/JJ phone/NN", [(1, "amod", 0)]) == ["phone"]
    assert run("1_1", "phone", "good/JJ phone/NN", [(1, "amod", 0)]) == []
    assert run("1_2", "best", "phone/NN is/VB best/JJ", [(1, "nsubj", 0), (1, "dobj", 2)]) == ["phone"]
    assert run("2_1", "phone", "good/JJ phone/NN", [(1, "amod", 0)]) == ["good"]
    assert run("2_2", "phone", "phone/NN is/VB best/JJ", [(1, "nsubj", 0), (1, "dobj", 2)]) == ["best"]
    assert run("3_1", "screen", "screen/NN and/CC sound/NN", [(0, "conj_and", 2)]) == ["sound"]
    assert run("3_1", "sound", "screen/NN and/CC sound/NN", [(0, "conj_and", 2)]) == []
    assert run("3_2", "lens", "player/NN has/VB lens/NN", [(1, "obj", 0), (1, "nsubj", 2)]) == ["player"]
    assert run("4_1", "big", "big/JJ and/CC honest/JJ", [(0, "conj_and", 2)]) == ["honest"]
    assert run("4_2", "big", "big/JJ x/X honest/JJ", [(1, "amod", 0), (1, "prep_of", 2)]) == ["honest"]
    assert run("4_2", "big", "big/JJ honest/JJ", [(-1, "root", 0), (-1, "root", 1)]) == ["honest"]  # the root is a head, too


def test_fixpoint_ignores_conjuncts_of_second_phase(spark, toks):
    # good -> phone (1_1, phase 1), phone -> case (3_1, phase 2); case -> cover needs case in phase 1, which never happens
    t = toks("good/JJ phone/NN", "phone/NN and/CC case/NN", "case/NN and/CC cover/NN")
    rels = spark.createDataFrame([(1, 1, 1, "amod", 0), (2, 1, 0, "conj_and", 2), (3, 1, 0, "conj_and", 2)], "sent_id long, rel_id int, head_idx int, label string, dep_idx int")
    terms, history = propagate.propagate(t, rels, spark.createDataFrame([("good",), ("absent",)], "term string"))
    assert {(r.kind, r.term) for r in terms.collect()} == {("opinion", "good"), ("aspect", "phone"), ("aspect", "case")}
    got = {(r.kind, r.term): r.orientation for r in propagate.orientations(history, spark.createDataFrame([("good", 1.0)], "term string, orientation double"), t).collect()}
    assert got[("aspect", "phone")] == 1.0 and got[("aspect", "case")] == 1.0
    gone = spark.createDataFrame([("aspect", "phone")], "kind string, term string")
    left = propagate.cascade(terms.select("kind", "term"), history, gone, terms.where("round = 0"))
    assert {r.term for r in left.collect()} == {"good"}


def test_phrase_pruning(spark, toks):
    t = toks("better/JJR than/IN x/X rival/NN", "buy/VB from/IN y/X", "shop/NN buy/VB from/IN y/X")
    occ = spark.createDataFrame([("rival", 1, 3), ("shop", 3, 0)], "term string, sent_id long, idx int")
    assert propagate.phrase_pruning(occ, t).count() == 2 and propagate.phrase_pruning(occ, t, "intended").count() == 0


def test_alignment_by_hand(spark, toks):
    t = toks("good/JJ phone/NN", "good/JJ case/NN")
    pair = align.pairs(t)
    words = {(r.e, r.f): r.c for r in align.step(pair, align.initial(pair)).collect()}
    # totals before: '' has 3 words, good has {good, phone, case}, phone {good, phone}, case {good, case}
    p = (1 / 3) / (1 / 3 + 1 / 3)
    assert words["phone", "good"] == pytest.approx(1 + p) and words["phone", ""] == pytest.approx(1 + p)
    q = (1 / 2) / (1 / 2 + 1 / 3)
    assert words["good", "phone"] == pytest.approx(1 + q) and words["good", ""] == pytest.approx(1 + 2 * (1 - q))
    assert words["good", "good"] == 1.0
    for r in align.posteriors(pair, align.initial(pair)).groupBy("sent_id", "j").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1)
    best = {(r.sent_id, r.e): r.f for r in align.best(align.posteriors(pair, align.model1(pair, 2))).collect()}
    assert best[(1, "good")] == "phone"


def test_sequential_alignment_differs_only_by_order(toks):
    one = align.sequential([[("good", "JJ"), ("phone", "NN")]], 1)
    assert one["good", "phone"] == pytest.approx(1.5) and set(one) == {(e, f) for e in ("good", "phone") for f in ("", "good", "phone")}


def test_model2_posteriors(toks):
    pair = align.pairs(toks("good/JJ phone/NN bad/JJ case/NN", "good/JJ case/NN"), "monolingual")
    words, places = align.model2(pair, align.model1(pair, 1), 2)
    for r in align.posteriors(pair, words, places, False).groupBy("sent_id", "j").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1)


def test_walk_equals_matrix_powers(spark):
    m = np.array([[0.5, 0.2, 0.0], [0.1, 0.4, 0.3], [0.0, 0.2, 0.6]])
    rows = [(f"n{i}", f"j{j}", float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]]
    assoc = spark.createDataFrame(rows, "nn string, jj string, association double")
    s = np.array([1.0, 2.0, 3.0])
    score = spark.createDataFrame([(f"n{i}", float(s[i])) for i in range(3)], "term string, importance double")
    got = {r.term: r.confidence for r in graph.confidence(assoc, score, terms=6).collect()}
    b = 0.7 * m @ m.T
    want = 0.3 * sum(s @ np.linalg.matrix_power(b, i) for i in range(7))
    assert [got[f"n{i}"] for i in range(3)] == pytest.approx(list(want))


def test_walk_overflow_is_said(spark):
    assoc = spark.createDataFrame([("n", "j", 1e100)], "nn string, jj string, association double")
    score = spark.createDataFrame([("n", 1.0)], "term string, importance double")
    assert graph.confidence(assoc, score, terms=2).first().overflow
    assert not graph.confidence(assoc, score, terms=3, mode="intended").first().overflow


def test_scores(spark):
    g = lambda *x: spark.createDataFrame([("c", i) for i in x], "corpus string, term string")
    r = evaluate.scores(g(*"abc"), g(*"bcd")).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.precision == r.recall == pytest.approx(2 / 3) and r.f == pytest.approx(2 / 3)
    none = evaluate.scores(g(*"abc"), g()).first()
    assert (none.precision, none.recall, none.f, none.accuracy) == (0, 0, 0, 0)


def test_scores_at(spark):
    ranked = spark.createDataFrame([(f"t{i:02d}", i) for i in range(1, 26)], "term string, rank int")
    gold = spark.createDataFrame([(f"t{i:02d}",) for i in (1, 5, 15, 25)], "term string")
    got = [(r.n, r.tp) for r in evaluate.scores_at(gold, ranked).orderBy("n").collect()]
    assert got == [(10, 2), (20, 3)]


def test_grid(tmp_path):
    g = grid.Grid({"y": ["a", "b", "c"], "x": [1, 2]})
    assert len(g) == 6 and list(g)[4] == g[4] == {"x": 2, "y": "b"}
    two = grid.Grid([{"x": [1]}, {"x": [2, 3]}])
    assert len(two) == 3 and two[2] == {"x": 3}
    with pytest.raises(IndexError):
        two[3]


def test_runner_keeps_errors(spark, tmp_path):
    def model(params, corpus):
        if params["x"] == 2:
            raise ValueError("no")
        return spark.createDataFrame([(0.5,)], "f double")

    out = grid.run(grid.Grid({"x": [1, 2]}), ["c"], model, str(tmp_path / "r.json"), every=1)
    assert out[0]["f"] == 0.5 and out[1]["error"] == "no"
    import json

    saved = json.loads((tmp_path / "r.json").read_text())
    assert saved["names"] == ["corpus", "error", "f", "x"] and len(saved["data"]) == 2


def test_models_run_on_a_grid(spark, toks, tmp_path):
    from aspectra.plans import experiments

    t = toks("good/JJ phone/NN", "good/JJ phone/NN", "bad/JJ case/NN", "great/JJ case/NN").withColumn("review_id", F.col("sent_id")).withColumn("corpus", F.lit("c"))
    rels = _edges(spark, [(1, "amod", 0)])
    gold = spark.createDataFrame([("phone",), ("case",)], "term string")
    seeds = spark.createDataFrame([("good", 1.0)], "term string, orientation double")
    idf = spark.createDataFrame([("phone", 1.0), ("case", 1.0)], "term string, idf double")
    c = experiments.Corpus(t, rels, gold, spark.createDataFrame([("the",)], "word string"), seeds, idf)
    for model, params in (("frequent", {"support": [50.0], "compact": [0, 1]}), ("propagation", {"percent": [50.0]}), ("graph", {"terms": [2]})):
        sink = f"file://{tmp_path}/{model}.json"
        out = grid.run(grid.Grid(params), ["c"], experiments.runner(model, {"c": c}), sink)
        assert not any("error" in r for r in out), out
        import json

        assert (tmp_path / f"{model}.json").exists() and json.loads((tmp_path / f"{model}.json").read_text())["data"] == [[r[n] for n in sorted(r)] for r in out]
        if model == "propagation":
            assert out[0]["precision"] > 0


def test_orientations_have_signs_alone(spark, toks):
    # two adjectives of opposite signs about phone, three about case
    t = toks("good/JJ phone/NN", "bad/JJ phone/NN", "good/JJ case/NN", "good/JJ case/NN", "bad/JJ case/NN").withColumn("review_id", F.lit(7))
    rels = spark.createDataFrame([(i, 1, 1, "amod", 0) for i in range(1, 6)], "sent_id long, rel_id int, head_idx int, label string, dep_idx int")
    seeds = spark.createDataFrame([("good", 1.0), ("bad", -1.0)], "term string, orientation double")
    _, history = propagate.propagate(t, rels, seeds)
    for mode, want in (("reference", {"phone": -1.0, "case": -1.0}), ("intended", {"phone": -1.0, "case": 1.0})):
        known = propagate.orientations(history, seeds, t, mode=mode)
        assert {r.term: r.orientation for r in known.where("kind = 'aspect'").collect()} == want
        in_review = propagate.aspect_orientations(history, known, t, mode=mode)
        assert {(r.review_id, r.term): r.orientation for r in in_review.collect()} == {(7, "phone"): -1.0, (7, "case"): 1.0}


def test_nearest_by_brute_force(spark, toks):
    import random

    from aspectra.operators import text, windows

    rnd = random.Random(3)
    sents = [[(f"w{i}", rnd.choice(["NN", "NNS", "JJ", "VB", "DT"])) for i in range(rnd.randint(1, 14))] for _ in range(30)]
    t = toks(*(" ".join(f"{w}/{p}" for w, p in s) for s in sents))
    got = {(r.sent_id, r.idx): r.noun_idx for r in joins.nearest_noun(t).collect()}
    assert got == {(n, i): min((j for j, (_, q) in enumerate(s) if q.startswith("NN")), key=lambda j: (abs(i - j), j)) for n, s in enumerate(sents, 1) for i, (_, p) in enumerate(s) if p == "JJ" and any(q.startswith("NN") for _, q in s)}
    spans = spark.createDataFrame([(n, a, a + 2) for n, s in enumerate(sents, 1) for a in range(0, len(s), 3)], "sent_id long, start int, stop int")
    for mode, shift in (("reference", 1), ("intended", 0)):
        after = {(r.sent_id, r.start): r.noun_idx for r in joins.noun_after(t, spans, mode).collect()}
        assert after == {(n, a): k[0] for n, s in enumerate(sents, 1) for a in range(0, len(s), 3) if (k := [j for j, (_, q) in enumerate(s) if q.startswith("NN") and j >= a + 2 + shift])}
    before = {(r.sent_id, r.start): r.noun_idx for r in joins.noun_before(t, spans).collect()}
    assert before == {(n, a): k[-1] for n, s in enumerate(sents, 1) for a in range(0, len(s), 3) if (k := [j for j, (_, q) in enumerate(s) if q.startswith("NN") and j < a])}
    points = spans.select("sent_id", F.col("start").alias("pos"))
    for side in ("next", "previous"):
        near = {(r.sent_id, r.pos, r["rank"]): r.idx for r in windows.nearest_k(t, points, 2, side).collect()}
        want = {}
        for n, s in enumerate(sents, 1):
            for a in range(0, len(s), 3):
                k = [j for j, (_, q) in enumerate(s) if q.startswith("NN") and (j > a if side == "next" else j < a)]
                want |= {(n, a, r): j for r, j in enumerate(sorted(k, key=lambda j: abs(j - a))[:2], 1)}
        assert near == want


def test_running_total_across_stretches(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(5, 8)], "g string, o long")
    got = {(r.g, r.o): r.n for r in running.running_total(df, "g", "o", F.lit(1), "n", stretch=3).collect()}
    assert got == {("a", i): i + 1 for i in range(10)} | {("b", i): i - 4 for i in range(5, 8)}


def test_merge_tags_needs_equal_sizes(spark, toks):
    t = toks("a/NN b/NN", "c/NN d/NN").withColumn("pos", F.when(F.col("idx") == 0, F.col("pos")))
    given_ = spark.createDataFrame([(1, 0, "X"), (1, 1, "Y"), (2, 1, "Z")], "sent_id long, idx int, pos string")
    got = {(r.sent_id, r.idx): r.pos for r in annotate.merge_tags(t, given_, "pos").collect()}
    assert got == {(1, 0): "NN", (1, 1): "Y", (2, 0): "NN", (2, 1): None}


def test_fuzzy_terms(spark):
    w = spark.createDataFrame([("goods",), ("xyz",)], "word string")
    terms = spark.createDataFrame([("good", 1), ("gods", 2), ("food", 3)], "term string, ord int")
    got = {(r.word, r.term) for r in joins.fuzzy_terms(w, terms, 0.8).collect()}
    assert got == {("goods", "good")}


def test_fuzzy_joins_by_brute_force(spark):
    import random

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(max(old[j] + 1 if x == y else 0, old[j + 1], row[j]))
        return 2 * row[-1] / (len(a) + len(b))

    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abeéQ1") for _ in range(rnd.randint(1, 8))) for _ in range(80)})
    w = spark.createDataFrame([(x,) for x in words], "word string")
    for least in (0.5, 0.8, 1.0):
        want = {(a, b) for a in words for b in words if a < b and ratio(a, b) >= least}
        assert {(r.a, r.b) for r in joins.fuzzy_pairs(w, least).collect()} == want


def test_similar_words_count_as_known(spark, toks):
    t = toks("great/JJ phone/NN", "greatt/JJ case/NN")
    rels = spark.createDataFrame([(i, 1, 1, "amod", 0) for i in (1, 2)], "sent_id long, rel_id int, head_idx int, label string, dep_idx int")
    seeds = spark.createDataFrame([("great",)], "term string")
    found = lambda match: {r.term for r in propagate.propagate(t, rels, seeds, match=match)[0].where("kind = 'aspect'").collect()}
    assert found(1.0) == {"phone"} and found(0.9) == {"phone", "case"}


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_contained_sets_meet_at_their_rarest_item(spark):
    """A common item joined all its sets with all its sentences."""
    import random

    rng = random.Random(5)
    baskets = [{"common", *rng.sample("abcdefghij", rng.randint(0, 4))} for _ in range(60)] + [set("abcdefghijklmnop")]
    sets = {"+".join(sorted(x)): x for x in [{"common"}, {"a"}, {"z"}, {"a", "z"}, {"common", "z"}, *({"common", *rng.sample("abcdefghij", k)} for k in (1, 1, 2, 3, 3)), {"a", "b"}]}
    pairs = lambda d: [(k, i) for k, v in d.items() for i in v]
    df = spark.createDataFrame(pairs(sets), "set_id string, item string")
    tx = spark.createDataFrame(pairs(dict(enumerate(baskets))), "sent_id int, item string")
    got = [tuple(r) for r in joins.contained_sets(df, tx).select("set_id", "sent_id").collect()]
    assert sorted(got) == sorted((k, n) for k, v in sets.items() for n, b in enumerate(baskets) if v <= b)
    over = lambda strict: sorted((r.set_id, r.other) for r in joins.supersets(df, strict).collect())
    assert over(True) == over(False) == sorted((a, b) for a, x in sets.items() for b, y in sets.items() if x < y)
    each = spark.range(30000).select(F.col("id").cast("string").alias("set_id"))
    many = each.select("set_id", F.explode(F.array(F.lit("common"), F.concat(F.lit("own"), "set_id"))).alias("item"))  # 900 million pairs share the common item
    assert joins.supersets(many, strict=False).count() == 0


def _dealt(spark, run):
    """What run() returns, and how many rows its stages wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    out = run()
    sc.listenerBus().waitUntilEmpty()
    n = 0
    for i in range(first, sc.dagScheduler().nextStageId()):
        try:
            n += sc.statusStore().lastStageAttempt(i).shuffleWriteRecords()
        except Exception:  # a stage that was skipped has no attempt
            continue
    return out, n


@pytest.fixture
def many(spark, tmp_path):
    """36,000 tokens of 2,000 sentences, 35,000 of them of 100 words that are in fewer than 500 sentences; phone and screen are in 500, a good beside each phone."""
    rare = "transform(sequence(1, if(id % 4 = 0, 16, 18)), k -> named_struct('word', concat('rare', (id * 7 + k * 13) % 100), 'pos', 'NN'))"
    own = "if(id % 4 = 0, array(named_struct('word', 'good', 'pos', 'JJ'), named_struct('word', 'phone', 'pos', 'NN'), named_struct('word', 'screen', 'pos', 'NN')), array())"
    df = spark.range(2000).selectExpr("id as sent_id", f"posexplode(concat({own}, {rare})) as (idx, z)").selectExpr("sent_id", "idx", "z.word", "z.word as lemma", "z.pos", "'B-NP' as iob")
    df.write.parquet(str(tmp_path / "toks"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "15000")  # below the tokens, above lists of a few words
    yield spark.read.parquet(str(tmp_path / "toks"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_frequent_terms_deal_words_of_frequent_sets_alone(spark, many, tmp_path):
    """All tokens were dealt, three times, before Spark found out that the lists they meet are small."""
    spark.createDataFrame([("the",)], "word string").write.parquet(str(tmp_path / "stop"))
    stop = spark.read.parquet(str(tmp_path / "stop"))
    got, n = _dealt(spark, lambda: {(r.set_id, r.term) for r in itemsets.extract(many, stop, -500.0, psupport=1).collect()})
    kept = {x for s in got for x in s}
    assert {"phone", "screen", "phone+screen", "phone screen"} & kept and not any("rare" in x for x in kept)
    assert n < many.count()


def test_items_too_rare_are_left_out_before_they_are_dealt(toks):
    t = toks("phone/NN phone/NN case/NN", "phone/NN cable/NN", "case/NN x/NN")
    items = lambda least: {(r.sent_id, r.item) for r in itemsets.transactions(t, None, least).collect()}
    assert items(2) == {x for x in items(1) if x[1] in ("phone", "case")} and items(3) == {x for x in items(1) if x[1] == "phone"}


def test_near_adjectives_deal_adjectives_and_ranges_alone(spark, many):
    """All tokens were dealt to say the lemmas of the adjectives found."""
    occ = many.where("lemma = 'phone'").selectExpr("lemma as set_id", "sent_id", "array(lemma) as items")
    places = many.where("lemma = 'phone'").selectExpr("lemma as set_id", "sent_id", "array(idx) as idxs")
    got, n = _dealt(spark, lambda: [r.word for r in itemsets.near_adjectives(occ, places, many, 5, "intended").collect()])
    assert got == ["good"] and n < many.count() / 4


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.text("an", min_size=1, max_size=14), st.lists(st.tuples(st.integers(0, 13), st.integers(0, 13)), max_size=3)), min_size=1, max_size=5), st.integers(0, 3))
def test_adjectives_near_against_brute_force(spark, sents, window):
    words = [(k, i, f"{c}{i}", "JJ" if c == "a" else "NN") for k, (s, _) in enumerate(sents) for i, c in enumerate(s)]
    spans = {(k, min(a, b), max(a, b)) for k, (s, pairs) in enumerate(sents) for a, b in pairs if max(a, b) < len(s)}
    t = spark.createDataFrame(words, "sent_id long, idx int, lemma string, pos string")
    df = spark.createDataFrame(sorted(spans), "sent_id long, first int, last int")
    for mode in ("intended", "reference"):
        want = set()
        for k, a, z in spans:
            n = len(sents[k][0])
            lo, hi = a if a - window < 0 else 0, z if z + window > n else n
            for s, i, lemma, pos in words:
                hit = a - window <= i <= z + window if mode == "intended" else lo <= i <= z or z <= i < hi
                if s == k and pos == "JJ" and hit:
                    want.add((s, i, lemma))
        got = [tuple(r) for r in windows.adjectives_near(t, df, window, mode).collect()]
        assert sorted(got) == sorted(want)


def test_infrequent_nouns_against_brute_force(spark, toks):
    t = toks("good/JJ phone/NN bad/JJ case/NN", "case/NN good/NN x/XX good/JJ", "a/XX good/JJ b/XX phone/NN", "bad/JJ", "phone/NN good/JJ case/NN")
    occ = spark.createDataFrame([("none", 99)], "set_id string, sent_id long")
    adj, stop = spark.createDataFrame([("good",)], "word string"), spark.createDataFrame([], "word string")
    rows = {}
    for r in t.collect():
        rows.setdefault(r.sent_id, []).append(r)
    want = set()
    for found in rows.values():
        near = [(abs(n.idx - a.idx), a.idx, n.idx, n.lemma) for a in found if a.lemma == "good" for n in found if n.pos.startswith("NN")]
        want |= {min(near)[3].lower()} if near else set()
    assert {r.set_id for r in itemsets.infrequent(t, occ, adj, stop, "intended").collect()} == want


def test_allowed_pairs_are_those_of_all_pairs(toks):
    t = toks("good/JJ phone/NN bad/JJ phone/NN", "good/JJ case/NN", "good/JJ case/NN").select("sent_id", "idx", "word", "pos")
    pair, words = align.allowed_pairs(t)
    every = align.pairs(t)
    cols = ["sent_id", "j", "e", "i", "f", "l", "m", "k"]
    assert sorted(map(tuple, pair.select(cols).collect())) == sorted(map(tuple, every.where("k > 0").select(cols).collect()))
    assert sorted(map(tuple, words.select("e", "f", "c").collect())) == sorted(map(tuple, align.initial(every).select("e", "f", "c").collect()))


def test_ngrams_do_not_carry_their_sentence(toks):
    t = toks("The/DT dog/NN of/IN the/DT house/NN", "one/XX", " ".join(["a/DT"] * 30000))
    got = cvalue.ngrams(t, 2, 3)
    assert sorted((r.start, r.surface) for r in got.where("sent_id = 1").collect()) == sorted((i, "The dog of the house".split()[i : i + n]) for n in (2, 3) for i in range(6 - n))
    assert got.where("sent_id = 2").count() == 0 and got.where("sent_id = 3").count() == 59997


def test_spans_of_a_long_sentence(toks):
    """Each span met all tokens of its sentence: 10,000 spans and 30,000 tokens."""
    t = toks(" ".join(["Big/JJ house/NN x/XX"] * 10000), "a/NN b/NNPS c/NNP")
    got = cvalue.spans(t, 2)
    assert got.where("sent_id = 1").count() == 10000
    assert [(r.start, r.stop, r.key, r.surface) for r in got.where("sent_id = 1 and start = 3").collect()] == [(3, 5, ["big", "house"], ["Big", "house"])]
    assert [(r.start, r.stop, r.surface) for r in got.where("sent_id = 2").collect()] == [(0, 2, ["a", "b"])]


def test_candidates_find_what_each_rule_finds(spark, toks):
    import random

    from aspectra.operators.text import RULE_JJ, RULE_NN

    r = random.Random(7)
    pos, words = {}, [(s, i, r.choice("abcdef"), r.choice([*RULE_NN, *RULE_JJ, "VB"])) for s in range(12) for i in range(7)]
    for s, i, w, p in words:
        pos[s, i] = (w, p)
    rows = [(s, n, r.choice([-1, *range(7)]), r.choice(["amod", "nsubj", "dobj", "conj_and", "root", "prep_of", "xsubj"]), r.randrange(7)) for s in range(12) for n in range(9)]
    t = spark.createDataFrame(words, "sent_id long, idx int, lemma string, pos string")
    rels = spark.createDataFrame(rows, "sent_id long, rel_id int, head_idx int, label string, dep_idx int")
    with_words = spark.createDataFrame([(*x, *pos.get((x[0], x[2]), (None, None)), *pos[x[0], x[4]]) for x in rows], rels._jdf.schema().toDDL() + ", h_term string, h_pos string, d_term string, d_pos string")
    edges = propagate.labelled(t, rels).localCheckpoint()
    sib, known = propagate.sibling_edges(edges), spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    own = propagate.labelled(t, with_words)
    assert "Join" not in own._jdf.queryExecution().toString()
    for e in (edges, own):
        found = propagate.candidates(e).where("origin in ('a', 'b', 'c')").select("kind", "rule", "sent_id", "term", "idx", "origin", "origin_idx").localCheckpoint()
        assert found.select("rule").distinct().count() == 8
        for rule in propagate.ORDER:
            want = sorted(map(tuple, propagate.apply_rule(rule, edges, sib, known).collect()))
            assert sorted(map(tuple, found.where(F.col("rule") == rule).collect())) == want


def test_edges_come_with_their_words(spark):
    from aspectra.sources import bridge

    docs = spark.createDataFrame([(0, "s", "The visible nations considered trees and useless houses walked"), (1, "s", "usable and capable tables of walking cats"), (2, "s", "a b"), (3, "s", None)], "doc_id long, source string, text string")
    sents = bridge.sentences(docs)
    toks = bridge.tokens(sents)
    cols = ["sent_id", "h", "l", "d", "rel_id", "h_term", "h_pos", "d_term", "d_pos"]
    got = propagate.labelled(toks, bridge.edges(sents)).select(cols).collect()
    assert len(got) > 5 and sorted(map(str, got)) == sorted(map(str, propagate.labelled(toks, bridge.rels(toks)).select(cols).collect()))


def test_history_has_each_finding_once(spark, toks):
    t = toks("good/JJ phone/NN", "fine/JJ phone/NN", "fine/JJ case/NN", "good/JJ phone/NN")
    rels = spark.createDataFrame([(s, 1, 1, "amod", 0) for s in (1, 2, 3, 4)], "sent_id long, rel_id int, head_idx int, label string, dep_idx int")
    seeds = spark.createDataFrame([("good",)], "term string")
    terms, history = propagate.propagate(t, rels, seeds)
    rows = history.select("rule", "sent_id", "idx", "origin", "round").collect()
    assert len(rows) == len({x[:4] for x in rows}) and {(x[1], x[4]) for x in rows if x[0] == "1_1"} == {(1, 1), (4, 1), (2, 2), (3, 2)}
    words, sources = propagate.spread(t, rels, seeds)
    assert sorted(words.collect()) == sorted(terms.collect())
    assert sorted(sources.collect()) == sorted(history.select(sources.columns).distinct().collect())


def test_orientations_run_over_pairs_of_words(spark, toks, monkeypatch):
    from aspectra.functions.lineage import saved

    t = toks(*["good/JJ phone/NN not/RB fine/JJ case/NN", "not/RB good/JJ case/NN", "a/X b/X c/X d/X e/X f/X not/RB good/JJ phone/NN"] * 7)
    rels = spark.createDataFrame([(s, i, i + 1, "amod", i) for s in range(1, 22) for i in ((0, 3), (1,), (7,))[(s - 1) % 3]], "sent_id long, rel_id int, head_idx int, label string, dep_idx int")
    seeds = spark.createDataFrame([("good", 1.0)], "term string, orientation double")
    _, history = propagate.propagate(t, rels, seeds.select("term"))
    rows = {}

    def counted(df, name):
        out = saved(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(propagate, "saved", counted)
    for mode, want in (("reference", {"good": 1.0, "phone": -1.0, "case": -1.0, "fine": -1.0}), ("intended", {"good": 1.0, "phone": -1.0, "case": -1.0, "fine": 1.0})):
        got = {r.term: r.orientation for r in propagate.orientations(history, seeds, t, mode=mode).collect()}
        assert rows["turned"] <= 6 and "first" not in rows
        assert {k: v for k, v in got.items() if k != "fine"} == {k: v for k, v in want.items() if k != "fine"}


def test_phrase_pruning_deals_words_once(spark):
    import random

    r = random.Random(3)
    some = ["compare", "to", "with", "better", "worse", "than", "shop", "buy", "from", "x"]
    sents = [[(r.choice(some), r.choice(["NN", "NNS", "XX"])) for _ in range(r.randint(1, 14))] for _ in range(80)]
    t = spark.createDataFrame([(s, i, w, p) for s, x in enumerate(sents) for i, (w, p) in enumerate(x)], "sent_id long, idx int, lemma string, pos string")
    gone = set()
    for s, x in enumerate(sents):
        nouns = [i for i, (_, p) in enumerate(x) if p.startswith("NN")]
        for phrases, after in ((propagate.PRODUCT_PHRASES, True), (propagate.DEALER_PHRASES, False)):
            for p in phrases:
                at = next((i for i in range(len(x) - len(p) + 1) if all(w is None or x[i + k][0] == w for k, w in enumerate(p))), None)
                near = [] if at is None else [i for i in nouns if i >= at + len(p)][:1] if after else [i for i in nouns if i < at][-1:]
                gone |= {(s, i) for i in near}
    occ = t.where("pos like 'NN%'").select(F.col("lemma").alias("term"), "sent_id", "idx")
    left = propagate.phrase_pruning(occ, t, "intended")
    assert {(x.sent_id, x.idx) for x in left.collect()} == {(s, i) for s, x in enumerate(sents) for i, (_, p) in enumerate(x) if p.startswith("NN")} - gone
    assert len(gone) > 20 and left._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 6


@pytest.mark.parametrize("mode", ["reference", "intended"])
def test_regroup_by_brute_force(spark, mode):
    import random

    r = random.Random(5)
    size = {s: r.randint(1, 9) for s in range(60)}
    words = {(s, i): r.choice(["a", "b", "c"]) for s in size for i in range(size[s])}
    spans = {(s, a, a + r.randint(0, 4)) for s in size for a in (r.randrange(10) for _ in range(r.randrange(4)))}
    want = []
    for s, n in size.items():
        mine = [x[1:] for x in spans if x[0] == s]
        inside = (lambda x, y: y[0] >= x[0] and y[1] <= x[1]) if mode == "reference" else (lambda x, y: y[0] <= x[0] and y[1] >= x[1])
        kept = [x for x in mine if x[1] > x[0] and not any(x != y and inside(x, y) for y in mine)]
        over = {i for a, b in kept for i in range(a, b + (mode == "reference"))}
        rows = [(i, words[s, i], "X") for i in range(n) if i not in over] + [(a, " ".join(words[s, i] for i in range(a, min(b, n))), "NN") for a, b in kept if a < n]
        want += [(s, k, w, p) for k, (_, w, p) in enumerate(sorted(rows))]
    t = spark.createDataFrame([(s, i, w, "X") for (s, i), w in words.items()], "sent_id long, idx int, word string, pos string")
    got = windows.regroup(t, spark.createDataFrame(sorted(spans), "sent_id long, start int, stop int"), mode)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_nearest_nouns_need_no_join(spark, toks):
    from types import SimpleNamespace

    from aspectra.plans.q_aggregates import _pairs

    t = toks("Good/JJ phone/NN x/X bad/JJ", "x/X Good/JJ phone/NN", "bad/JJ x/X")
    got = _pairs(SimpleNamespace(toks=t))
    assert sorted(map(tuple, got.collect())) == [("phone", "bad", 1), ("phone", "good", 2)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
