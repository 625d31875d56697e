"""Decontamination, line dedup, encoding, language and quality against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aspectra.llm import bpe, decontaminate, langid, linededup, quality, queries
from aspectra.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_scan(text, items, size=10):
    w = words_of(text)
    hit, found = set(), set()
    for item, t in items:
        v = words_of(t)
        for i in range(max(1, len(v) - size + 1)) if v else []:
            win = v[i : i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(item)
    return len(w), hit, found


@settings(max_examples=200, deadline=None)
@given(st.text("ab é.", max_size=60), st.lists(st.text("ab é.", max_size=30), max_size=4), st.integers(1, 3))
def test_scan_equals_brute_force(text, items, size):
    items = [(str(i), t) for i, t in enumerate(items)]
    a = decontaminate.automaton([(i, t.encode()) for i, t in items], size)
    n, runs, found = decontaminate.scan(text.encode(), a)
    want = brute_scan(text, items, size)
    assert (n, {k for s, e in runs for k in range(s, e)}, found) == want
    spans = decontaminate.spans(text.encode(), runs)
    assert [words_of(text[s:e]) for s, e in spans] == [words_of(text)[s:e] for s, e in runs]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, "Alpha beta. Gamma"), (2, "one two three four five six seven eight nine ten eleven"), (2, "zeta"), (3, None), (None, "lost"), (4, "...")], "item_id long, text string")


DOCS = [
    (1, "x ALPHA, beta--gamma y", "a"), (2, None, "b"), (3, "", None), (None, "zeta zeta", "c"), (5, "0 one two three four five six seven eight nine ten 1", "d"),
    (5, "0 one two three four five six seven eight nine ten 1", "d"), (6, "two three four five six seven eight nine ten eleven", "e"), (7, "lost", "f"),
]


@pytest.mark.parametrize("part", [1 << 20, 12])
def test_decontaminate_in_one_or_many_parts(spark, bench, part):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, n_words string").withColumnRenamed("n_words", "items").withColumn("extra col", __import__("pyspark").sql.functions.lit(1))
    got = decontaminate.decontaminate(docs, bench, part_bytes=part)
    assert got.columns == ["doc_id", "text", "extra col", "n_words", "n_hit", "items", "hit_spans"]
    rows = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple((s.start, s.end) for s in r.hit_spans)) for r in got.collect()}
    assert got.count() == len(DOCS)
    assert rows == {
        (1, 5, 3, ("1",), ((2, 20),)), (2, 0, 0, (), ()), (3, 0, 0, (), ()), (None, 2, 2, ("2",), ((0, 9),)), (5, 12, 10, ("2",), ((2, 50),)),
        (6, 10, 10, ("2",), ((0, 51),)), (7, 1, 0, (), ()),
    }


def test_decontaminate_empty_tables(spark, bench):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.decontaminate(one, bench.limit(0)).first().n_hit == 0


def test_decontaminate_very_long_text(spark, bench):
    text = "é word " * 100_000 + "Alpha, beta; GAMMA " + "x " * 100_000
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = decontaminate.decontaminate(one, bench).first()
    assert (r.n_words, r.n_hit, list(r["items"])) == (300_003, 3, ["1"]) and text[r.hit_spans[0].start : r.hit_spans[0].end] == "Alpha, beta; GAMMA"


# line dedup


LINE = "This page is licensed under the terms of use"


def test_lines_of_recurring_templates_go_but_for_the_first(spark):
    docs = [
        (3, f"own words in the third one\n{LINE}\nEs."), (1, f"{LINE}\nunique words of document one here"), (2, f"Posted on 2024-01-05 by the editor\nmore own words for two\n{LINE}"),
        (4, "Posted on 1999-12-31 by the editor\nyet other words stand in four"), (5, None), (6, ""), (None, f"null id goes first\n{LINE}"), (7, "Es."),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_lines int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_lines(df).collect()}
    assert got[1] == ("unique words of document one here", 2, 1) and got[3] == ("own words in the third one\nEs.", 3, 1)
    assert got[2] == ("Posted on 2024-01-05 by the editor\nmore own words for two", 3, 1)
    assert got[4] == ("yet other words stand in four", 2, 1)
    assert got[5] == (None, 0, 0) and got[6] == ("", 1, 0) and got[7] == ("Es.", 1, 0)
    assert got[None] == (f"null id goes first\n{LINE}", 2, 0)


def test_rows_of_figures_are_no_template(spark):
    df = spark.createDataFrame([(i, f"{i} {i + 1} {i + 2} {i + 3}\n7 7 7 7\n7 7 7 7") for i in range(3)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in linededup.drop_lines(df).collect()) == [(0, 0), (1, 2), (2, 2)]


def test_variable_words_make_a_template(spark):
    names = ["anna", "bert", "carl", "dora", "emil"]
    docs = [(i, f"The user {n} has joined our big forum today and says hello to all\nown line number of document {n} {'abcdefgh'[i]} with its words") for i, n in enumerate(names)]
    docs += [(9, "The user manual says nothing of this but has as many words as it")]
    got = {r.doc_id: r.n_dropped for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == 0 and got[9] == 0 and all(got[i] >= 1 for i in range(1, 5))


def test_lines_that_recur_as_they_are_share_a_template_with_others(spark):
    names = ["anna", "bert", "carl", "dora"]
    # each name in two documents; then one line in many documents and variants of it in one each
    docs = [(10 * j + i, f"This long post was written by user {n} for the forum") for j in (0, 1) for i, n in enumerate(names)]
    docs += [(100 + i, "it was a fine day and everybody went to see the sea") for i in range(6)]
    docs += [(50, "it was a fine day and nobody went to see the sea"), (200, "it was a fine day and everybody went to see the moon")]
    got = {r.doc_id: r.n_dropped for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i, n in sorted(got.items()) if n == 0] == [0, 50]


def test_tokens_with_digits_leave_the_constant_share_alone(spark):
    names = ["anna", "bert", "carl", "dora"]
    docs = [(i, f"2024-05-0{i + 1} 10:32:0{i} user {n} logged in from host 10.0.0.{i} port {440 + i}") for i, n in enumerate(names)]
    docs += [(10 + i, f"total {i} {i + 1} {i + 2} {i + 3} {i + 4} {i + 5} {i + 6} {i + 7}") for i in range(4)]
    got = {r.doc_id: r.n_dropped for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i, n in sorted(got.items()) if n == 0] == [0, 10, 11, 12, 13]


def test_short_lines_recur_as_they_are(spark, tmp_path):
    import corpus_pipeline as p

    texts = ["Read more\nwords that only one of them has\nPage 1", "read  more\nother words stand in this one\nPage 2\n\nEnd", "Read more\n\nPage 1", "words that only one of them has\nRead more\nPage 1"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: texts[0], 1: "other words stand in this one\nPage 2\n\nEnd", 2: "", 3: ""}
    got = {r.doc_id: (r.text, r.n_dropped) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (t, n) for (i, t), n in zip(want.items(), (0, 1, 2, 3), strict=True)}
    assert {r.doc_id: r.text for r in p.lines(spark, df, DATA).collect()} == {0: want[0], 1: want[1]}


def test_equal_ids_are_one_document(spark):
    df = spark.createDataFrame([(1, LINE), (1, LINE), (2, "other words stand here alone")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in linededup.drop_lines(df).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert linededup.drop_lines(df.limit(0)).count() == 0


def test_each_text_of_a_repeated_id_loses_its_own_lines(spark):
    a, b = f"unique words of row a here\n{LINE}\nand more of row a here", "first line of row b here\nIMPORTANT unique content of row b here\nlast of it all here"
    df = spark.createDataFrame([(1, LINE), (2, a), (2, b), (2, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in linededup.drop_lines(df).collect())
    cut = "unique words of row a here\nand more of row a here"
    assert got == [(1, LINE, 0), (2, b, 0), (2, cut, 1), (2, cut, 1)]


def test_very_many_lines(spark):
    long = "\n".join(f"{LINE} number {i} and word x{'abcdefghij'[i % 10]}" for i in range(30_000)) + "\nthe end of this one is its own"
    df = spark.createDataFrame([(1, long), (2, long + "\nmore words stand in the copy")], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.drop_lines(df).collect()}
    assert got[1].n_dropped == 0 and got[2].text == "more words stand in the copy" and got[2].n_dropped == 30_001


def brute_lines(rows):
    """The texts that drop_lines leaves, by definition; rows: (doc_id, text) with distinct ids."""

    def tokens(line):
        low = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        return [None if re.search("[0-9]", w) else w for w in low], low

    docs_of, at = {}, {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            masked, low = tokens(line)
            if masked:
                key = tuple(masked) if len(masked) >= 4 and 2 * masked.count(None) <= len(masked) else ("own", *low)
                docs_of.setdefault(key, set()).add(i)
                at[i, k] = (key, masked)
    first = {key: min(d) for key, d in docs_of.items() if len(d) > 1}
    leaves = {}
    for key, masked in set((key, tuple(m)) for key, m in at.values()):
        if len(masked) >= 4:
            leaves.setdefault((len(masked), masked[:3]), set()).add((key, masked))
    for lines in leaves.values():
        count = {}
        plain = [(key, m) for key, m in lines if 2 * sum(x is not None for x in m) >= len(m)]
        for _, m in plain:
            for p, x in enumerate(m):
                count[p, x] = count.get((p, x), 0) + 1
        shared = {}
        for key, m in plain:
            constant = tuple((p, x) for p, x in enumerate(m) if x is not None and count[p, x] >= 3)
            if len(constant) >= 0.8 * sum(x is not None for x in m):
                shared.setdefault(constant, []).append(key)
        for constant, keys in shared.items():
            seen = set().union(*(docs_of[k] for k in keys))
            if constant and len(keys) >= 3 and len(seen) > 1:
                for k in keys:
                    first[k] = min(first.get(k, min(seen)), min(seen))
    return {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in at or first.get(at[i, k][0], i) == i) for i, t in rows}


def test_line_query_brute_force(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert {r.doc_id: r.text for r in queries.op2_line_dedup(spark, DATA).collect()} == brute_lines(rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["the", "cat", "dog", "sat", "on", "a", "mat", "7", "x1"]), min_size=1, max_size=6).map(" ".join), min_size=1, max_size=40))
def test_generalised_templates_property(spark, found):
    rows = [(i % 7, "\n".join(found[i::7])) for i in range(min(7, len(found)))]
    got = {r.doc_id: r.text for r in linededup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    assert got == brute_lines(rows)


def test_exact_templates_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.text for r in linededup.drop_lines(docs).collect()}
    seen: dict[tuple, int] = {}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())

    def key(line):
        low = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
        masked = ["#" if re.search("[0-9]", w) else w for w in low]
        return tuple(masked if 2 * masked.count("#") <= len(masked) else low)

    for i, t in rows:
        for line in t.split("\n"):
            seen.setdefault(key(line), i)
    for i, t in rows:
        want = [line for line in t.split("\n") if len(key(line)) < 4 or seen[key(line)] == i]
        # generalised templates may take more, never less
        assert set(got[i].split("\n")) <= {*want, ""} and len(want) - len(got[i].split("\n")) <= 1


# quality


def test_dictionaries_learn_from_the_whole_of_long_texts():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(40_000)) + " late words that only the end has" * 2_000 for _ in range(20)]
    assert b"late words that only the end has" in quality.dictionary([t.encode() for t in texts])
    few = quality.chunks([t.encode() for t in texts], 100)
    assert len(few) == 100 and any(b"late words" in c for c in few) and len(quality.chunks([b"x" * 1025])) == 3 and quality.chunks([b""]) == []


def test_labels_far_behind_in_long_texts_are_learned(spark):
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    words = {1: "calm orderly sentences stand behind the noise here ", 0: "%%% buy !! cheap ## pills $$ now && click "}
    rows = [(i, noise(40_000) + words[i % 2] * 400) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    model = quality.train(docs.where("doc_id < 30"), spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int"))
    assert all(r.predicted == r.doc_id % 2 for r in quality.score(docs, model, threshold=0.5).collect())


def brute_difference(text, model):
    import zstandard

    sizes = []
    for d in (model.good, model.bad):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text[i : i + quality.CHUNK])) for i in range(0, len(text), quality.CHUNK)))
    return (sizes[1] - sizes[0]) / max(sizes) if text else 0.0


def test_quality_query_brute_force(spark):
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    model = quality.train(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"))
    for r in queries.op9_quality(spark, DATA).collect():
        want = 1 / (1 + math.exp(-(model.slope * brute_difference(texts[r.doc_id], model) + model.bias)))
        assert r.held_out == held[r.doc_id] and r.score == pytest.approx(want) and r.predicted == int(want >= 0.3)


# encoding


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    path, pattern = vocabulary()
    ranks = bpe.load_ranks(path)
    return bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab \n\t'sé中0", max_size=200), st.text("ab", min_size=30, max_size=400), st.text("-=_ ", max_size=300)))
def test_encoding_equals_the_library(coders, text):
    own, library = coders
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n\t'slve中，0.-•", max_size=120)), st.integers(1, 9))
def test_trees_of_small_leaves_equal_the_library(coders, text, leaf):
    own, library = coders
    text = text.encode("utf-8", "ignore").decode()
    small = bpe.Encoder(bpe.load_ranks(vocabulary()[0]), vocabulary()[1], leaf) if leaf not in _SMALL else _SMALL[leaf]
    _SMALL[leaf] = small
    assert small.encode(text) == library.encode_ordinary(text)


_SMALL: dict[int, bpe.Encoder] = {}


@pytest.mark.parametrize("window", [64, 1 << 16])
@pytest.mark.parametrize("letters", ["abcde", "a", " ", "\n", "中", "^", "a. "])
def test_long_texts_without_seams(coders, monkeypatch, window, letters):
    monkeypatch.setattr(bpe, "WINDOW", window)
    own, library = coders
    rnd = random.Random(3)
    text = "".join(rnd.choice(letters) for _ in range(20_000))
    assert own.encode(text) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_encoding_query_equals_the_library_on_the_whole_table(spark, coders):
    _, library = coders
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op4_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_encode_and_decode_frames(spark):
    path, pattern = vocabulary()
    df = spark.createDataFrame([(1, "Hello  world\n", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, ids int")
    e = bpe.encode(df, path, pattern)
    assert e.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(e, path, pattern).collect()} == {1: b"Hello  world\n", 2: b"", 3: b""}
    assert bpe.digests(df.limit(0), path, pattern).count() == bpe.encode(df.limit(0), path, pattern).count() == 0
    d = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.digests(df, path, pattern).collect()}
    assert d[1] == (4, hashlib.sha256(b"Hello  world\n").hexdigest()) and d[2] == d[3] == (0, hashlib.sha256(b"").hexdigest())


# language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    held = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    model = langid.train(docs.where(~docs.doc_id.isin(held)))
    got = {r.doc_id: r for r in langid.predict(docs.drop("lang"), model).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in rows if r.doc_id in held]
    assert sum(right) / len(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", None), (None, "the dog", "en"), (6, "", "de")], "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = sorted(((r.doc_id or 0), r.lang_pred, r.score) for r in langid.predict(docs.withColumnRenamed("lang", "score"), model).collect())
    assert [(i, p) for i, p, _ in got if i in (3, 4, 6)] == [(3, "und"), (4, "und"), (6, "und")] and got[1][1] == "en"
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_many_languages_are_learned(spark):
    names = [f"l{i:03d}" for i in range(250)]
    rows = [(1000 * i + k, f"{chr(0x4E00 + i) * 3} {chr(0x4E00 + i) * 5} ab", n) for i, n in enumerate(names) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs.where("doc_id % 1000 = 0"), langid.train(docs)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 245 and len({r.lang_pred for r in got}) >= 245


def test_language_query_brute_force(spark):
    """Features, weights and temperature by plain loops over dictionaries, from the same sample (all rows: none is left out)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = langid.train(docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2"))

    def brute(text):
        import numpy as np

        low = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "").lower())
        low = re.sub(" +", " ", " ".join(["", low, ""]))[1:]
        g = langid.grams([text]).bucket
        n = {k: [low[i : i + k] for i in range(len(low) - k + 1)] for k in (1, 2, 3)}
        assert abs(len(g) - sum(len([x for x in v if k > 1 or x != " "]) for k, v in n.items())) <= 3
        z = np.zeros(len(model.languages))
        for b in g:
            z += model.weights[b] / len(g)
        p = np.exp((z - z.max()) / model.temperature)
        return model.languages[int(p.argmax())], float(p.max() / p.sum())

    for r in queries.op7_language(spark, DATA).collect():
        assert r.held_out == held[r.doc_id]
        if not re.search(r"[^\W\d_]", texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            lang, score = brute(texts[r.doc_id])
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)


def test_language_repeated_ids_ties_and_long_texts(spark):
    rows = [(1, "aaa bbb", "x"), (1, "ccc ddd", "y"), (1, "ccc ddd", "y"), (2, "aaa", "y"), (2, "aaa", "x"), (3, "aaa bbb " * 100_000, "x"), (4, "ccc ddd " * 100_000, "y")]
    docs = spark.createDataFrame([(*r, "l", 0, 0) for r in rows], "doc_id long, text string, lang string, lang_pred string, h int, n int")
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got if r.doc_id != 2)
    same = [(i, "zzz", lang) for i in range(40) for lang in ("p", "q")]
    tied = langid.predict(docs, langid.train(spark.createDataFrame(same, "doc_id long, text string, lang string"))).select("lang_pred", "score").distinct().collect()
    assert all(r.score <= 1 for r in tied)
    even = langid.Model(["p", "q"], __import__("numpy").zeros((langid.BUCKETS, 2), "float32"), __import__("numpy").zeros(2), 1.0)
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, even).collect()} == {("p", 0.5)}


def test_grams_do_not_cross_texts():
    a, b = langid.grams(["ab", "cd"]), [langid.grams([t]) for t in ("ab", "cd")]
    for i in (0, 1):
        assert sorted(a.bucket[a.doc == i]) == sorted(b[i].bucket)


# quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0"))
    held = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    right = [got[i].predicted == q for i, q in held.items()]
    assert sum(right) / len(right) > 0.85 and all(0 <= r.score <= 1 for r in got.values())


def test_quality_repeated_ids_and_long_texts(spark):
    rows = [(i, ("good calm words " if i % 2 else "%% buy now ## ") * (1 + i)) for i in range(40)] + [(1, "good calm words again"), (1, "good calm words again"), (99, "good calm words " * 100_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, h double")
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    got = quality.score(docs, model, threshold=0.5).collect()
    assert len(got) == len(rows) and next(r for r in got if r.doc_id == 99).predicted == 1


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words in a row"), (2, None), (3, ""), (None, "x"), (4, "bad %% $$ ##"), (4, "bad %% $$ ##")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs.withColumnRenamed("doc_id", "predicted"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5} and quality.score(docs.limit(0), none).count() == 0
