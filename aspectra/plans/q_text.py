"""Queries over projections, filters and annotation steps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aspectra.functions import stemmer
from aspectra.operators import annotate, text
from aspectra.plans.registry import Tables, query

CHUNKED = """
kinded AS (SELECT *, CASE WHEN iob <> 'O' THEN string_split(iob, '-')[2] END AS type FROM toks),
begun AS (SELECT *, iob LIKE 'B-%' OR idx = 0 OR coalesce(type, '') <> coalesce(lag(type) OVER (PARTITION BY sent_id ORDER BY idx), '') AS fresh FROM kinded),
chunked AS (SELECT *, (sum(fresh::INT) OVER (PARTITION BY sent_id ORDER BY idx))::INT AS chunk_id FROM begun),
chunks AS (SELECT sent_id, chunk_id, type, min(idx) AS start, max(idx) + 1 AS stop, string_agg(word, ' ' ORDER BY idx) AS string FROM chunked GROUP BY ALL)"""


@query("prj1_tags", "SELECT sent_id, string_agg(lemma, ' ' ORDER BY idx) AS lemmata, string_agg(pos, ' ' ORDER BY idx) AS pos_tags, string_agg(word || '/' || pos, ' ' ORDER BY idx) AS tagged FROM toks GROUP BY sent_id")
def prj1(t: Tables):
    return text.tags(t.toks).select("sent_id", *(F.array_join(c, " ").alias(c) for c in ("lemmata", "pos_tags", "tagged")))


@query("prj2_keys", "SELECT lower(word) AS lower_key, coalesce(nullif(CASE WHEN pos = 'XX' THEN '' ELSE lemma END, ''), lower(word)) AS stem_key, count(*) AS n FROM toks GROUP BY ALL")
def prj2(t: Tables):
    stem = F.when(F.col("pos") == "XX", "").otherwise(F.col("lemma"))
    return t.toks.select(text.lower_key(F.col("word")).alias("lower_key"), text.stem_key(stem, F.col("word")).alias("stem_key")).groupBy("lower_key", "stem_key").agg(F.count("*").alias("n"))


PRJ3 = """WITH {CHUNKED}, sized AS (SELECT c.*, k.start, k.stop FROM chunked c JOIN chunks k USING (sent_id, chunk_id))
SELECT sent_id, idx - 1 AS idx, word, CASE WHEN start >= 1 AND stop {op} 5 THEN iob ELSE 'O' END AS iob FROM sized WHERE idx >= 1 AND idx < 5"""


@query("prj3_slice", PRJ3.format(CHUNKED=CHUNKED, op="<"))
def prj3(t: Tables):
    return text.piece(t.toks, None, 1, 5)[0]


@query("prj3_slice__intended", PRJ3.format(CHUNKED=CHUNKED, op="<="))
def prj3_intended(t: Tables):
    return text.piece(t.toks, None, 1, 5, "intended")[0]


@query("prj3_slice_edges", "SELECT sent_id, head_idx - 1 AS head_idx, label, dep_idx - 1 AS dep_idx FROM rels WHERE head_idx BETWEEN 1 AND 4 AND dep_idx BETWEEN 1 AND 4")
def prj3_edges(t: Tables):
    return text.piece(t.toks, t.rels, 1, 5)[1]


@query("prj4_chunk_spans", f"WITH {CHUNKED} SELECT sent_id, chunk_id, type, start, stop, string FROM chunks")
def prj4(t: Tables):
    return text.chunks(t.toks)


@query("flt1_word_classes", "SELECT sent_id, count(*) FILTER (pos LIKE 'NN%') AS nouns, count(*) FILTER (pos LIKE 'VB%') AS verbs, count(*) FILTER (pos LIKE 'JJ%') AS adjectives FROM toks GROUP BY sent_id")
def flt1(t: Tables):
    n = lambda f: F.count_if(f(F.col("pos")))
    return t.toks.groupBy("sent_id").agg(n(text.is_noun).alias("nouns"), n(text.is_verb).alias("verbs"), n(text.is_adjective).alias("adjectives"))


@query("flt2_noun_phrases", f"WITH {CHUNKED} SELECT sent_id, chunk_id, string FROM chunks WHERE type = 'NP'")
def flt2(t: Tables):
    return text.chunks(t.toks).where("type = 'NP'").select("sent_id", "chunk_id", "string")


@query("flt3_final_word", "SELECT sent_id, arg_max(word, idx) = 'the' AS ends_with_the FROM toks GROUP BY sent_id")
def flt3(t: Tables):
    return text.last_word(t.toks).select("sent_id", (F.col("last") == "the").alias("ends_with_the"))


@query("flt4_completeness", "SELECT sent_id, true AS is_tokenized, bool_and(lemma <> '') AS is_lemmatized, bool_and(pos <> '') AS is_tagged, bool_and(iob <> '') AS is_chunked, sent_id IN (SELECT sent_id FROM rels) AS is_dep_parsed FROM toks GROUP BY sent_id")
def flt4(t: Tables):
    return text.completeness(t.toks, t.rels)


@query("flt5_phrase_search", """WITH n AS (SELECT sent_id, idx, lower(word) AS a, lead(lower(word), 1) OVER w AS b, lead(lower(word), 2) OVER w AS c FROM toks WINDOW w AS (PARTITION BY sent_id ORDER BY idx))
SELECT 'of the' AS phrase, sent_id, min(idx) AS start, min(idx) + 2 AS stop FROM n WHERE a = 'of' AND b = 'the' GROUP BY sent_id
UNION ALL SELECT 'the * and', sent_id, min(idx), min(idx) + 3 FROM n WHERE a = 'the' AND c = 'and' GROUP BY sent_id
UNION ALL SELECT 'from', sent_id, min(idx), min(idx) FROM n WHERE a = 'from' GROUP BY sent_id""")
def flt5(t: Tables):
    one = lambda name, words: text.phrase_spans(t.toks, words).select(F.lit(name).alias("phrase"), "sent_id", "start", "stop")
    return one("of the", ["of", "the"]).unionByName(one("the * and", ["the", None, "and"])).unionByName(one("from", ["from"]))


LABELS = "short AS (SELECT *, CASE WHEN label = 'amod' THEN 'mod' WHEN contains(label, 'prep') THEN 'pnmod' WHEN contains(label, 'nsubj') OR contains(label, 'csubj') THEN 'subj' WHEN label = 'xsubj' THEN 'obj' WHEN label = 'dobj' THEN 'obj2' WHEN label = 'iobj' THEN 'desc' WHEN contains(label, 'conj') THEN 'conj' ELSE label END AS l FROM {0})"


@query("flt6_label_sets", f"WITH {LABELS.format('rels')} SELECT l AS label, l IN ('mod', 'pnmod') AS mods, l IN ('subj', 's', 'obj') AS objs, l IN ('obj2', 'desc', 'mod', 'pnmod', 'subj', 's', 'obj') AS mr, l = 'conj' AS conj, count(*) AS n FROM short GROUP BY ALL")
def flt6(t: Tables):
    label = F.col("label")
    df = t.rels.select(text.short_label(label).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return df.select("label", *(label.isin(v).alias(n) for n, v in (("mods", text.MODS), ("objs", text.OBJS), ("mr", text.MR), ("conj", text.CONJ))), "n")


ALL_LABELS = "('amod'), ('prep_of'), ('nsubj'), ('nsubjpass'), ('csubj'), ('xsubj'), ('dobj'), ('iobj'), ('conj_and'), ('root'), ('det'), ('pnmod'), ('s'), ('obj'), ('subj'), ('mod'), ('desc'), ('obj2')"


def _labels(t: Tables):
    return t.spark.createDataFrame([(x.strip(" ()'"),) for x in ALL_LABELS.split(",")], "label string")


@query("flt7_short_labels", f"WITH labels AS (SELECT * FROM (VALUES {ALL_LABELS}) v(label)), {LABELS.format('labels')} SELECT label, l AS short FROM short")
def flt7(t: Tables):
    return _labels(t).select("label", text.short_label(F.col("label")).alias("short"))


@query("flt8_same_label", f"""WITH labels AS (SELECT * FROM (VALUES {ALL_LABELS}) v(label)), same AS (SELECT * FROM (VALUES ('mod', 'pnmod'), ('pnmod', 'mod'), ('s', 'subj'), ('subj', 's'), ('subj', 'obj'), ('obj', 'subj')) v(a, b))
SELECT x.label AS a, y.label AS b FROM labels x, labels y WHERE x.label = y.label OR (x.label, y.label) IN (SELECT (a, b) FROM same)""")
def flt8(t: Tables):
    df = _labels(t).toDF("a").crossJoin(F.broadcast(_labels(t).toDF("b")))  # a fixed list of 18 labels
    return df.where(text.same_label(F.col("a"), F.col("b")))


@query("flt9_without_stopwords", "SELECT lower(word) AS word, count(*) AS n FROM toks WHERE length(word) > 1 AND lower(word) NOT IN (SELECT lower(word) FROM toks WHERE pos IN ('DT', 'IN')) GROUP BY 1")
def flt9(t: Tables):
    stop = t.toks.where(F.col("pos").isin("DT", "IN")).select("word").distinct()
    return text.without_stopwords(t.toks, stop).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


@query("flt10_clean_bigrams", "WITH p AS (SELECT lower(word) AS a, lead(lower(word)) OVER (PARTITION BY sent_id ORDER BY idx) AS b FROM toks), s AS (SELECT DISTINCT lower(word) AS w FROM toks WHERE pos IN ('DT', 'IN', 'CC')) SELECT a || ' ' || b AS bigram, count(*) AS n FROM p WHERE b IS NOT NULL AND a NOT IN (SELECT w FROM s) AND b NOT IN (SELECT w FROM s) GROUP BY 1")
def flt10(t: Tables):
    from aspectra.operators import cvalue

    stop = t.toks.where(F.col("pos").isin("DT", "IN", "CC")).select(F.lower("word").alias("word")).distinct()
    grams = cvalue.ngrams(t.toks, 2, 2)
    return cvalue.without_stopwords(grams, stop).groupBy(F.array_join("key", " ").alias("bigram")).agg(F.count("*").alias("n"))


@query("flt11_conjunction_in_segment", "SELECT sent_id, idx // 8 AS segment, bool_or(lower(word) IN ('and', 'or')) AS has_conjunction FROM toks GROUP BY ALL")
def flt11(t: Tables):
    return t.toks.groupBy("sent_id", F.floor(F.col("idx") / 8).cast("int").alias("segment")).agg(F.bool_or(F.lower("word").isin("and", "or")).alias("has_conjunction"))


@query("flt12_supported_terms", "SELECT lemma AS term, count(DISTINCT sent_id) AS support FROM toks WHERE pos LIKE 'NN%' GROUP BY 1 HAVING count(DISTINCT sent_id) > 3")
def flt12(t: Tables):
    df = t.toks.where(text.is_noun(F.col("pos"))).groupBy(F.col("lemma").alias("term")).agg(F.count_distinct("sent_id").alias("support"))
    return text.clean_terms(df, 3)


def _lexicon(t: Tables):
    from aspectra.sources import lexicons

    w = t.toks.where("pos = 'JJ'").select(F.col("lemma").alias("word")).distinct()
    return lexicons.merge_lexicon(w.where("word like '%ble'"), w.where("word like '%less'"))


@query("flt13_polarity__intended", "SELECT DISTINCT lemma AS word, -1 AS sign FROM toks WHERE pos = 'JJ' AND lemma LIKE '%less' UNION ALL SELECT DISTINCT lemma, 1 FROM toks WHERE pos = 'JJ' AND lemma LIKE '%ble'")
def flt13_intended(t: Tables):
    one = lambda s: text.polarity(_lexicon(t), s, "intended").select("word", F.lit(s).alias("sign"))
    return one(1).unionByName(one(-1))


@query("flt13_polarity", "SELECT lemma AS word FROM toks WHERE false")
def flt13(t: Tables):
    return text.polarity(_lexicon(t), 1).select("word")


@query("flt14_relation_membership", "SELECT label, count(*) FILTER (head_idx = 2) AS head_is_2, count(*) FILTER (head_idx = 2 OR dep_idx = 2) AS holds_2 FROM rels GROUP BY label")
def flt14(t: Tables):
    head, dep = F.col("head_idx") == 2, F.col("dep_idx") == 2
    return t.rels.groupBy("label").agg(F.count_if(head).alias("head_is_2"), F.count_if(head | dep).alias("holds_2"))


@query("ann4_zero_based", "SELECT sent_id, head_idx + 1 AS head, dep_idx + 1 AS dep, head_idx, dep_idx FROM rels WHERE label = 'amod'")
def ann4(t: Tables):
    ones = t.rels.where("label = 'amod'").select("sent_id", (F.col("head_idx") + 1).alias("head"), (F.col("dep_idx") + 1).alias("dep"))
    return annotate.zero_based(ones)


@query("ann8c_stem_marks", """WITH w AS (SELECT DISTINCT lower(word) AS word FROM toks), a AS (SELECT word, regexp_replace(word, '^y', 'Y') AS y FROM w)
SELECT word, regexp_replace(y, '([aeiouy])y', '\\1Y', 'g') AS marked FROM a""")
def ann8c(t: Tables):
    return t.toks.select(F.lower("word").alias("word")).distinct().select("word", stemmer.mark_consonant_y(F.col("word")).alias("marked"))


@query("ann8d_first_steps", """WITH w AS (SELECT DISTINCT lower(word) AS word FROM toks)
SELECT word, CASE WHEN word LIKE '%sses' THEN left(word, -2) WHEN word LIKE '%ied' OR word LIKE '%ies' THEN left(word, -3) || CASE WHEN length(word) > 4 THEN 'i' ELSE 'ie' END
  WHEN word LIKE '%us' OR word LIKE '%ss' THEN word WHEN word LIKE '%s' AND regexp_matches(left(word, -1), '[aeiouy].') THEN left(word, -1) ELSE word END AS stem FROM w""")
def ann8d(t: Tables):
    return t.toks.select(F.lower("word").alias("word")).distinct().select("word", stemmer.step_1a(stemmer.step_0(F.col("word"))).alias("stem"))


@query("ann8_stems")
def ann8(t: Tables):
    return stemmer.stems(t.toks.select(F.lower("word").alias("word")))


@query("ann8g_fill_stems", "SELECT pos, coalesce(CASE WHEN pos IN ('NN', 'NNS') THEN lemma END, lower(word)) AS lemma, count(*) AS n FROM toks GROUP BY ALL")
def ann8g(t: Tables):
    some = t.toks.withColumn("lemma", F.when(F.col("pos").isin("NN", "NNS"), F.col("lemma")))
    return annotate.fill_lemmas(some, F.lower("word")).groupBy("pos", "lemma").agg(F.count("*").alias("n"))


@query("ann10_merge_tags", """WITH have AS (SELECT sent_id, idx, word, CASE WHEN idx % 2 = 0 THEN pos END AS pos FROM toks), given AS (SELECT sent_id, idx, 'N:' || pos AS pos FROM toks WHERE NOT (sent_id % 3 = 0 AND idx = 0)),
n AS (SELECT sent_id, count(*) AS n FROM have GROUP BY 1), m AS (SELECT sent_id, count(*) AS m FROM given GROUP BY 1)
SELECT h.sent_id, h.idx, coalesce(h.pos, CASE WHEN n = m THEN g.pos END) AS pos FROM have h JOIN n USING (sent_id) LEFT JOIN m USING (sent_id) LEFT JOIN given g ON g.sent_id = h.sent_id AND g.idx = h.idx""")
def ann10(t: Tables):
    have = t.toks.select("sent_id", "idx", "word", F.when(F.col("idx") % 2 == 0, F.col("pos")).alias("pos"))
    given = t.toks.where(~((F.col("sent_id") % 3 == 0) & (F.col("idx") == 0))).select("sent_id", "idx", F.concat(F.lit("N:"), "pos").alias("pos"))
    return annotate.merge_tags(have, given, "pos").select("sent_id", "idx", "pos")


@query("ann11_chunk_assembly", f"WITH {CHUNKED} SELECT type, stop - start AS size, count(*) AS n FROM chunks GROUP BY ALL")
def ann11(t: Tables):
    return text.chunks(t.toks).groupBy("type", (F.col("stop") - F.col("start")).alias("size")).agg(F.count("*").alias("n"))


@query("ann12_attach_edges", "SELECT r.sent_id, r.rel_id, coalesce(h.word, 'ROOT') AS head, r.label, d.word AS dep FROM rels r LEFT JOIN toks h ON h.sent_id = r.sent_id AND h.idx = r.head_idx JOIN toks d ON d.sent_id = r.sent_id AND d.idx = r.dep_idx")
def ann12(t: Tables):
    return annotate.attach_edges(t.toks, t.rels)


@query("ann17_append_tokens", "SELECT review_id, count(*) AS n, max(k) AS last FROM (SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY sent_id, idx) - 1 AS k FROM toks) GROUP BY 1")
def ann17(t: Tables):
    df = t.toks.withColumn("k", F.row_number().over(Window.partitionBy("review_id").orderBy("sent_id", "idx")) - 1)
    return df.groupBy("review_id").agg(F.count("*").alias("n"), F.max("k").cast("long").alias("last"))
