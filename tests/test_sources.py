from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aspectra.sources import lexicons, readers, reviews, trees

LINES = [
    "* a comment", "[t]the first review", "battery[+2][u], screen[-1]##It lasts long, but the screen is dim.", "##Nothing to say.", "",
    "[t]another one", "price[+1]##Cheap.", "a[+1],b[+2]##Two tags without a blank.", "zoom##No brackets.", "no separator here",
]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("c", i, x) for i, x in enumerate(LINES)], "corpus string, line_no long, line string")


def test_scan_counts_reviews_and_sentences(lines):
    rows = sorted((r.review_id, r.sent_id, r.text) for r in reviews.scan(lines).collect())
    assert rows[:3] == [(1, 1, "It lasts long, but the screen is dim."), (1, 2, "Nothing to say."), (2, 3, "Cheap.")]
    assert len(rows) == 6


def test_gold_fields(lines):
    rows = {(r.term, r.orientation, r.type) for r in reviews.gold(reviews.scan(lines)).collect()}
    assert {("battery", 1, "u"), ("screen", -1, "n"), ("price", 1, "n")} <= rows
    assert ("a", 1, "n") in rows and ("b", 1, "n") not in rows  # a comma without a blank doesn't part tags here


def test_strict_reader_names_bad_lines(lines):
    assert {(r.line_no, r.problem) for r in reviews.problems(lines).collect()} == {(8, "no term"), (9, "no separator")}
    with pytest.raises(Exception, match="no "):
        reviews.checked(lines).collect()
    assert reviews.checked(lines.where("line_no < 8")).count() == 8


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LINES))
    assert [r.line for r in reviews.read_lines(spark, {"a": str(tmp_path / "a.txt")}).orderBy("line_no").collect()] == LINES


def test_lexicon_negative_overrides(spark):
    w = lambda *x: spark.createDataFrame([(i,) for i in x], "word string")
    got = {(r.word, r.orientation) for r in lexicons.merge_lexicon(w("good", "odd"), w("bad", "odd")).collect()}
    assert got == {("good", 1.0), ("bad", -1.0), ("odd", -1.0)}


def test_idf_table_keeps_the_last_line_and_appends_new_terms(spark, tmp_path):
    (tmp_path / "idf.tsv").write_text("a\t1.5\nb\t2\na\t3\n")
    got = lexicons.read_idf(spark, str(tmp_path / "idf.tsv"))
    assert {(r.term, r.idf) for r in got.collect()} == {("a", 3.0), ("b", 2.0)}
    new = spark.createDataFrame([("b", 9.0), ("c", 1.0)], "term string, idf double")
    assert [r.term for r in lexicons.append_idf(got, new).collect()] == ["c"]


def test_freeze_and_unfreeze(spark, tmp_path):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 3)], "corpus string, pipeline string, v int")
    lexicons.freeze(df, str(tmp_path / "f"))
    assert lexicons.frozen_pipelines(spark, str(tmp_path / "f")).count() == 3
    assert [r.v for r in lexicons.unfreeze(spark, str(tmp_path / "f"), "x", "q").collect()] == [2]


def test_dependency_lines(spark):
    df = spark.createDataFrame([(1, "nsubj(runs-2, dog-1)"), (1, "root(ROOT-0, runs-2)"), (1, "junk"), (1, "dep(a-b-3, c(d)-4)")], "sent_id long, line string")
    got = {tuple(r)[1:] for r in readers.dependency_lines(df).collect()}
    assert got == {("nsubj", "runs", 1, "dog", 0), ("root", "ROOT", -1, "runs", 1), ("dep", "a-b", 2, "c(d)", 3)}


def test_shell_text(spark):
    reply = (
        "Sentence #1 (2 tokens):\nDogs run\n[Text=Dogs CharacterOffsetBegin=0 CharacterOffsetEnd=4 PartOfSpeech=NNS Lemma=dog] [Text=run CharacterOffsetBegin=5 CharacterOffsetEnd=8 PartOfSpeech=VBP Lemma=run]\n"
        "(ROOT\n  (S (NP (NNS Dogs)) (VP (VBP run))))\n\nnsubj(run-2, Dogs-1)\nroot(ROOT-0, run-2)\n"
    )
    got = readers.shell_text(spark.createDataFrame([(7, reply)], "reply_id long, reply string")).collect()
    assert [r.fields for r in got if r.part == "token"][1] == ["run", "5", "8", "VBP", "run"]
    assert len([r for r in got if r.part == "dependency"]) == 2
    assert [r.fields for r in got if r.part == "tree"] == [["(ROOT (S (NP (NNS Dogs)) (VP (VBP run))))"]]


def test_parser_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<root><document><sentences><sentence id="1"><tokens><token id="1"><word>Dogs</word><lemma>dog</lemma><CharacterOffsetBegin>0</CharacterOffsetBegin><CharacterOffsetEnd>4</CharacterOffsetEnd><POS>NNS</POS></token>'
        '<token id="2"><word>run</word><lemma>run</lemma><CharacterOffsetBegin>5</CharacterOffsetBegin><CharacterOffsetEnd>8</CharacterOffsetEnd><POS>VBP</POS></token></tokens><parse>(ROOT)</parse>'
        '<dependencies type="basic"><dep type="nsubj"><governor idx="2">run</governor><dependent idx="1">Dogs</dependent></dep></dependencies></sentence></sentences></document></root>'
    )
    xml = (tmp_path / "a.xml").read_text().replace(' id="', ' _id="').replace("_id", "id")
    (tmp_path / "a.xml").write_text(xml)
    tokens, deps = readers.parser_xml(spark, str(tmp_path / "a.xml"))
    assert [(r.idx, r.word, r.lemma, r.pos) for r in tokens.orderBy("idx").collect()] == [(0, "Dogs", "dog", "NNS"), (1, "run", "run", "VBP")]
    assert [(r.head_idx, r.label, r.dep_idx) for r in deps.collect()] == [(1, "nsubj", 0)]


TREE = "(S (NP (DT the) (NN dog)) (VP (V chased) (NP (DT the) (NN cat))))"


def test_tree_functions(spark):
    node = trees.nodes(spark.createDataFrame([(1, TREE)], "sent_id long, tree string")).cache()
    assert [(r.word, r.pos) for r in trees.leaves(node).orderBy("idx").collect()] == [("the", "DT"), ("dog", "NN"), ("chased", "V"), ("the", "DT"), ("cat", "NN")]
    assert trees.heights(node).first().height == 5
    assert [r.path for r in trees.positions(node, "leaves").orderBy("n").collect()] == [[0, 0, 0], [0, 1, 0], [1, 0, 0], [1, 1, 0, 0], [1, 1, 1, 0]]
    assert [r.path for r in trees.positions(node, "pre").orderBy("n").collect()][:4] == [[], [0], [0, 0], [0, 0, 0]]
    assert [r.path for r in trees.positions(node, "post").orderBy("n").collect()][:3] == [[0, 0, 0], [0, 0], [0, 1, 0]]
    both = [r.path for r in trees.positions(node, "both").orderBy("n").collect()]
    assert both[:6] == [[], [0], [0, 0], [0, 0, 0], [0, 0], [0, 1]] and both[-1] == [] and len(both) == 14 + 9
    assert trees.subtrees(node, "NP").count() == 2
    span = spark.createDataFrame([(1, 3, 5), (1, 1, 4), (1, 0, 1)], "sent_id long, start int, stop int")
    assert {(r.start, tuple(r.path)) for r in trees.spanning(node, span).collect()} == {(3, (1, 1)), (1, ()), (0, (0, 0, 0))}
    assert trees.flat(node).first().tree == "(S the dog chased the cat)"
    assert trees.at_path(node, [1, 1]).first().label == "NP"


@pytest.mark.parametrize("text, place", [("(S (NP a)", 9), ("a", 0), ("(S a) b", 6), (") (S a)", 0)])
def test_tree_errors_say_where(text, place):
    with pytest.raises(trees.TreeError, match=f"at {place}:"):
        trees.parse(text)


def test_several_trees_of_a_sentence_are_put_together(spark):
    given = spark.createDataFrame([(1, 0, "(ROOT (S (NP (NN dogs)) (VP (VBP run))))"), (1, 1, "(ROOT (S (NP (NN cats)) (VP (VBP sit)))"), (2, 0, "(S (NP (NN one)))"), (3, 0, "(S) x")], "sent_id long, place int, tree string")
    toks = spark.createDataFrame([(1, i, w, "X") for i, w in enumerate(["Dogs", "run", "Cats", "sit"])] + [(2, 0, "One", "Y")], "sent_id long, idx int, word string, pos string")
    got = trees.attached(given, toks).collect()
    assert [(r.idx, r.word, r.label) for r in sorted(got, key=lambda r: r.node_id or 0) if r.sent_id == 1 and r.idx is not None] == [(0, "Dogs", "NN"), (1, "run", "VBP"), (2, "Cats", "NN"), (3, "sit", "VBP")]
    assert [r.label for r in sorted(got, key=lambda r: r.node_id or 0) if r.sent_id == 1 and r.depth < 3] == ["S", "S", "S", "S"]
    assert not any(r.is_leaf for r in got if r.sent_id != 3) and [r.error for r in got if r.sent_id == 3] == ["at 4: the tree has ended, but more follows"]


def test_iob_chains(spark):
    node = trees.nodes(spark.createDataFrame([(1, TREE)], "sent_id long, tree string"))
    got = {r.idx: r.chain for r in trees.iob_chains(node).collect()}
    assert got == {0: "B-S/B-NP", 1: "I-S/E-NP", 2: "I-S/B-VP", 3: "I-S/I-VP/B-NP", 4: "E-S/E-VP/E-NP"}


def test_repair():
    assert trees.repair("(S (NP a)") == "(S (NP a))" and trees.repair("(S a))") == "((S a))"


def test_clauses(spark):
    t = "(ROOT (S (NP (PRP I)) (VP (VBP think) (SBAR (IN that) (S (NP (PRP it)) (VP (VBZ works)))))))"
    got = trees.clauses(trees.nodes(spark.createDataFrame([(1, t)], "sent_id long, tree string"))).collect()
    assert [(r.start, r.stop, r.text) for r in got] == [(3, 5, "it works")]


def test_chunks():
    got = trees.chunk_tags(trees.parse("(S (NP (NP (NNP Kim) (POS 's)) (NN dog)) (VP (MD will) (VP (ADVP (RB soon)) (VB chase) (NP (DT the) (QP (CD two) (CD hundred)) (NNS cats)) (PP (IN in) (NP (NN town))))))"))
    assert [x[2] for x in got] == ["B-NP", "B-NP", "I-NP", "B-VP", "I-VP", "I-VP", "B-NP", "I-NP", "I-NP", "I-NP", "B-PP", "B-NP"]


def test_chunks_of_coordination_and_schemes():
    t = trees.parse("(S (NP (NP (NN salt)) (CC and) (NP (NN pepper))) (VP (VBZ helps)))")
    assert [x[2] for x in trees.chunk_tags(t)] == ["B-NP", "O", "B-NP", "B-VP"]
    assert [x[2] for x in trees.chunk_tags(t, "BeginEndCombined")] == ["C-NP", "O", "C-NP", "C-VP"]


def test_semantic_roles(spark):
    rows = [(1, "eat", 0, "Dogs", "S-A0"), (1, "eat", 1, "eat", "S-V"), (1, "eat", 2, "raw", "B-A1"), (1, "eat", 3, "meat", "E-A1"), (1, "eat", 4, "now", "O")]
    got = trees.semantic_roles(spark.createDataFrame(rows, "sent_id long, verb string, idx int, word string, tag string")).first()
    assert got.roles == {"A0": "Dogs", "V": "eat", "A1": "raw meat"}


def test_node_tables_of_a_batch_are_those_of_each_tree():
    import random

    import pyarrow as pa

    rng = random.Random(3)

    def some(depth):
        inside = [some(depth - 1) if depth and rng.random() < 0.6 else rng.choice(["dog", "a", "zz9"]) for _ in range(rng.randint(0, 3))]
        return f"({rng.choice(['NP', 'S', 'VP-X'])}{rng.choice([' ', chr(10)])}{'  '.join(inside)})"

    texts = [some(rng.randint(0, 5)) for _ in range(500)] + ["", "x", "(a", "a)", ")(", "(a) b", "(a)(b)", "(S \u00e9)", " (S a) ", "()", "(())", "( (a b))", "(S " * 3000 + "a" + ")" * 3000]
    names, read = [*trees._FIELDS, "idx"], lambda t: trees.parse(trees.repair(t))
    got: dict = {}
    for b in trees._read(pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(texts), names, read):
        for i, r in zip(b.column(0).to_pylist(), b.select(names).to_pylist(), strict=True):
            got.setdefault(i, []).append(r)
    for i, t in enumerate(texts[:-1]):
        try:
            want = trees._one(read(t), names)
        except trees.TreeError as e:
            want = [dict.fromkeys(names) | {"error": str(e)}]
        assert got[i] == want, t
    assert len(got[len(texts) - 1]) == 3001 and got[len(texts) - 1][0]["height"] == 3001  # deeper than Python's stack, which failed


def test_trees_are_read_and_used_without_joins(spark):
    """Node tables have no size that Spark knows: it took them for small and sent them to the driver."""
    node = trees.nodes(spark.createDataFrame([(1, TREE)], "sent_id long, tree string"))
    span = spark.createDataFrame([(1, 3, 5)], "sent_id long, start int, stop int")
    for df in (trees.leaves(node), trees.iob_chains(node), trees.spanning(node, span), trees.attached(node.limit(0).select("sent_id", F.lit(0).alias("place"), F.lit("").alias("tree")), node.select("sent_id", "node_id", F.lit("").alias("word"), F.lit("").alias("pos")).withColumnRenamed("node_id", "idx"))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    words = trees.nodes(spark.createDataFrame([(1, "(S word (NN dog))")], "sent_id long, tree string"))
    assert {r.idx: r.chain for r in trees.iob_chains(words).collect()} == {1: "E-S"}  # a word right below the root has no phrase above a part of speech


def test_tree_text_of_chunks(spark):
    rows = [("DT", "the", "B-NP"), ("NN", "dog", "I-NP"), ("VB", "bit", "I-VP"), ("CC", "and", "O"), ("XX", "so", "O"), ("NN", "cat", "I-NP"), ("NN", "mat", "B-NP")]
    toks = spark.createDataFrame([(1, k, w, p, i) for k, (p, w, i) in enumerate(rows)], "sent_id long, idx int, word string, pos string, iob string")
    assert trees.tree_text(toks).first().tree == "(S (NP (DT the) (NN dog)) (VP (VB bit)) (CC and) (XX so) (NP (NN cat)) (NP (NN mat)))"
