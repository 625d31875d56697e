"""Queries over joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.functions import strings
from aspectra.functions.lineage import saved
from aspectra.operators import cvalue, joins, text
from aspectra.plans.q_text import CHUNKED
from aspectra.plans.registry import Tables, query


@query("jn1_heads", "WITH f AS (SELECT sent_id, dep_idx, arg_min(head_idx, rel_id) AS head_idx, arg_min(label, rel_id) AS label FROM rels GROUP BY ALL) SELECT t.sent_id, t.idx, head_idx, label FROM toks t LEFT JOIN f ON f.sent_id = t.sent_id AND f.dep_idx = t.idx")
def jn1(t: Tables):
    return joins.heads(t.toks, t.rels)


@query("jn2_dependents", "SELECT sent_id, head_idx AS idx, count(*) AS n, min(dep_idx) AS first FROM rels GROUP BY ALL")
def jn2(t: Tables):
    return joins.dependents(t.rels).groupBy("sent_id", "idx").agg(F.count("*").alias("n"), F.min("dep_idx").alias("first"))


@query("jn3_siblings", "SELECT x.sent_id, x.head_idx, x.dep_idx AS a, x.label AS a_label, y.dep_idx AS b, y.label AS b_label FROM rels x JOIN rels y ON x.sent_id = y.sent_id AND x.head_idx = y.head_idx AND x.dep_idx <> y.dep_idx")
def jn3(t: Tables):
    return joins.siblings(t.rels)


@query("jn4_exact_terms", "SELECT lemma, count(*) AS n FROM toks WHERE lemma IN (SELECT DISTINCT lemma FROM toks WHERE pos = 'JJ') GROUP BY 1")
def jn4(t: Tables):
    terms = t.toks.where("pos = 'JJ'").select(F.col("lemma").alias("term"))
    return joins.exact_terms(t.toks, terms).groupBy("lemma").agg(F.count("*").alias("n"))


#: LCS of all pairs of words a, b, by the usual table, in SQL.
LCS = """pairs AS ({pairs}),
dp AS (SELECT a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM pairs
  UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, greatest(acc[len(acc)], r[j[1] + 1], r[j[1]] + CASE WHEN substr(a, i + 1, 1) = substr(b, j[1], 1) THEN 1 ELSE 0 END)), [0]) FROM dp WHERE i < length(a)),
ratios AS (SELECT a, b, 2.0::DOUBLE * r[len(r)] / (length(a) + length(b)) AS ratio FROM dp WHERE i = length(a))"""
PART_WORDS = "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part"


def _part_words(t: Tables):
    return t.read("part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("fn1_similarity", f"WITH RECURSIVE words AS ({PART_WORDS}), {LCS.format(pairs='SELECT x.w AS a, y.w AS b FROM words x, words y WHERE x.w < y.w')} SELECT a, b, round(ratio, 6) AS ratio FROM ratios")
def fn1(t: Tables):
    w = _part_words(t)
    pairs = w.toDF("a").join(w.toDF("b"), F.col("a") < F.col("b"))  # the words of a fixed list of part names
    return pairs.select("a", "b", F.round(strings.ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("jn5_fuzzy_terms", f"""WITH RECURSIVE words AS ({PART_WORDS}), terms AS (SELECT upper(w) AS x, lower(w) || 'y' AS term, row_number() OVER (ORDER BY w) AS ord FROM words),
{LCS.format(pairs='SELECT w AS a, term AS b FROM words, terms')}, best AS (SELECT a, b, ratio, row_number() OVER (PARTITION BY a ORDER BY ratio DESC, ord) AS n FROM ratios JOIN terms ON term = b WHERE ratio >= 0.5)
SELECT a AS word, b AS term, round(ratio, 6) AS ratio FROM best WHERE n = 1""")
def jn5(t: Tables):
    from pyspark.sql.window import Window

    w = _part_words(t)
    terms = w.select(F.concat(F.lower("word"), F.lit("y")).alias("term"), F.row_number().over(Window.orderBy("word")).alias("ord"))
    return joins.fuzzy_terms(w, terms, 0.5).select("word", "term", F.round("ratio", 6).alias("ratio"))


ITEMS = "items AS (SELECT DISTINCT sent_id, lemma AS item FROM toks WHERE pos LIKE 'NN%' AND length(word) > 1)"


def _items(t: Tables):
    return t.toks.where(text.is_noun(F.col("pos")) & (F.length("word") > 1)).select("sent_id", F.col("lemma").alias("item")).distinct()


#: Itemsets for containment: the two alphabetically first nouns of each sentence, and the first one alone.
SETS = ITEMS + """, firsts AS (SELECT sent_id, min(item) AS a, min_by(item, item) FILTER (item > m) AS b FROM (SELECT *, min(item) OVER (PARTITION BY sent_id) AS m FROM items) GROUP BY sent_id),
names AS (SELECT DISTINCT a AS set_id, a AS item FROM firsts UNION SELECT DISTINCT a || '+' || b, unnest([a, b]) FROM firsts WHERE b IS NOT NULL)"""


def _sets(items):
    from pyspark.sql.window import Window

    items = items.withColumn("m", F.min("item").over(Window.partitionBy("sent_id")))
    firsts = items.groupBy("sent_id").agg(F.min("item").alias("a"), F.min(F.when(F.col("item") > F.col("m"), F.col("item"))).alias("b"))
    two = firsts.where("b is not null").select(F.concat("a", F.lit("+"), "b").alias("set_id"), F.explode(F.array("a", "b")).alias("item"))
    return firsts.select(F.col("a").alias("set_id"), F.col("a").alias("item")).unionByName(two).distinct()


@query("jn6_contained_sets", f"WITH {SETS}, size AS (SELECT set_id, count(*) AS size FROM names GROUP BY 1), hit AS (SELECT set_id, sent_id, count(*) AS k FROM names JOIN items USING (item) GROUP BY ALL) SELECT set_id, count(*) AS n FROM hit JOIN size USING (set_id) WHERE k = size GROUP BY 1")
def jn6(t: Tables):
    items = saved(_items(t), "items")
    return joins.contained_sets(saved(_sets(items), "sets"), items).groupBy("set_id").agg(F.count("*").alias("n"))


@query("jn7_supersets", f"WITH {SETS} SELECT x.set_id, count(*) AS n FROM names x JOIN names y ON x.item = y.item AND x.set_id <> y.set_id WHERE NOT contains(x.set_id, '+') AND contains(y.set_id, '+') GROUP BY 1")
def jn7(t: Tables):
    return joins.supersets(saved(_sets(_items(t)), "sets")).groupBy("set_id").agg(F.count("*").alias("n"))


PART_GROUPS = """groups AS (SELECT lower(p_name) AS string, count(*) AS freq, len(string_split(p_name, ' ')) AS t FROM part GROUP BY ALL
  UNION ALL SELECT lower(p_name) || ' ' || lower(p_type), count(*), 1 + len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) - 1 FROM part GROUP BY ALL)"""


def _part_groups(t: Tables):
    part = t.read("part")
    name, kind = F.lower("p_name"), F.lower("p_type")
    one = part.groupBy(name.alias("string")).agg(F.count("*").alias("freq"))
    two = part.groupBy(F.concat(name, F.lit(" "), kind).alias("string")).agg(F.count("*").alias("freq"))
    return one.unionByName(two).select("string", "freq", F.size(F.split("string", " ")).alias("t"))


@query("jn8_nested_groups", f"WITH {PART_GROUPS} SELECT x.string, y.string AS other FROM groups x JOIN groups y ON contains(y.string, x.string) AND x.string <> y.string")
def jn8(t: Tables):
    return cvalue.nested(_part_groups(t))


@query("agg7_cvalue", f"""WITH {PART_GROUPS}, around AS (SELECT x.string, sum(y.t) / count(*) AS mean FROM groups x JOIN groups y ON contains(y.string, x.string) AND x.string <> y.string GROUP BY 1)
SELECT string, t, freq, round(ln(t) * freq * coalesce(mean, 1), 6) AS cvalue FROM groups LEFT JOIN around USING (string)""")
def agg7(t: Tables):
    return cvalue.cvalue(_part_groups(t)).select("string", "t", "freq", F.round("cvalue", 6).alias("cvalue"))


@query("agg7_cvalue__intended", f"""WITH {PART_GROUPS}, around AS (SELECT x.string, sum(y.freq) / count(*) AS mean FROM groups x JOIN groups y ON contains(y.string, x.string) AND x.string <> y.string GROUP BY 1)
SELECT string, t, freq, round(ln(t) * (freq - coalesce(mean, 0)), 6) AS cvalue FROM groups LEFT JOIN around USING (string)""")
def agg7_intended(t: Tables):
    return cvalue.cvalue(_part_groups(t), "intended").select("string", "t", "freq", F.round("cvalue", 6).alias("cvalue"))


@query("top1_best_groups", f"""WITH {PART_GROUPS}, around AS (SELECT x.string, sum(y.t) / count(*) AS mean FROM groups x JOIN groups y ON contains(y.string, x.string) AND x.string <> y.string GROUP BY 1)
SELECT string, round(ln(t) * freq * coalesce(mean, 1), 6) AS cvalue FROM groups LEFT JOIN around USING (string) ORDER BY ln(t) * freq * coalesce(mean, 1) DESC, string LIMIT 20""")
def top1(t: Tables):
    return cvalue.top_groups(cvalue.cvalue(_part_groups(t)), 20).select("string", F.round("cvalue", 6).alias("cvalue"))


@query("jn9_terms_in_sentences", """WITH n AS (SELECT sent_id, idx, lower(word) || ' ' || lead(lower(word)) OVER (PARTITION BY sent_id ORDER BY idx) AS g FROM toks), g AS (SELECT g, count(*) AS c FROM n WHERE g IS NOT NULL GROUP BY 1),
terms AS (SELECT g FROM g WHERE c > 1) SELECT sent_id, g AS term, min(idx) AS start FROM n WHERE g IN (SELECT g FROM terms) GROUP BY ALL""")
def jn9(t: Tables):
    grams = cvalue.ngrams(t.toks, 2, 2).select("sent_id", "start", F.array_join("key", " ").alias("term"))
    terms = grams.groupBy("term").agg(F.count("*").alias("c")).where("c > 1").select("term")
    return grams.join(terms, "term", "left_semi").groupBy("sent_id", "term").agg(F.min("start").alias("start"))


@query("jn10_word_pairs", """WITH w AS (SELECT sent_id, idx, lower(word) AS w FROM toks WHERE pos IN ('NN', 'NNS', 'JJ')), p AS (SELECT x.w AS e, y.w AS f FROM w x JOIN w y ON x.sent_id = y.sent_id AND x.idx <> y.idx WHERE 'JJ' = 'JJ' UNION ALL SELECT w, '' FROM w)
SELECT e, f, count(*) AS n FROM p WHERE f = '' OR f LIKE '%ble' GROUP BY ALL""")
def jn10(t: Tables):
    df = joins.word_pairs(t.toks.where(F.col("pos").isin("NN", "NNS", "JJ")))
    return df.where("f = '' or f like '%ble'").groupBy("e", "f").agg(F.count("*").alias("n"))


FREQUENT = "frequent AS (SELECT lemma FROM toks WHERE pos LIKE 'NN%' GROUP BY 1 HAVING count(DISTINCT sent_id) >= 20)"


@query("jn11_uncovered_sentences", f"WITH {FREQUENT} SELECT DISTINCT sent_id FROM toks WHERE sent_id NOT IN (SELECT sent_id FROM toks WHERE pos LIKE 'NN%' AND lemma IN (SELECT lemma FROM frequent))")
def jn11(t: Tables):
    noun = t.toks.where(text.is_noun(F.col("pos")))
    often = noun.groupBy("lemma").agg(F.count_distinct("sent_id").alias("n")).where("n >= 20").select("lemma")
    return t.sents.select("sent_id").join(noun.join(often, "lemma", "left_semi").select("sent_id").distinct(), "sent_id", "left_anti")


@query("jn12_nearest_noun", """WITH p AS (SELECT a.sent_id, a.idx, n.idx AS noun_idx, n.lemma AS noun, row_number() OVER (PARTITION BY a.sent_id, a.idx ORDER BY abs(a.idx - n.idx), n.idx) AS k FROM toks a JOIN toks n ON a.sent_id = n.sent_id WHERE a.pos = 'JJ' AND n.pos LIKE 'NN%') SELECT sent_id, idx, noun_idx, noun FROM p WHERE k = 1""")
def jn12(t: Tables):
    return joins.nearest_noun(t.toks)


@query("jn12_nearest_phrase", f"""WITH {CHUNKED}, p AS (SELECT a.sent_id, a.idx, string, row_number() OVER (PARTITION BY a.sent_id, a.idx ORDER BY least(abs(start - a.idx), abs(stop - a.idx)), start) AS k FROM toks a JOIN chunks c ON a.sent_id = c.sent_id WHERE a.pos = 'JJ' AND type = 'NP') SELECT sent_id, idx, string FROM p WHERE k = 1""")
def jn12_phrase(t: Tables):
    return joins.nearest_phrase(t.toks)


SPANS = "n AS (SELECT sent_id, idx, lower(word) AS a, lead(lower(word)) OVER (PARTITION BY sent_id ORDER BY idx) AS b FROM toks), spans AS (SELECT sent_id, min(idx) AS start, min(idx) + 2 AS stop FROM n WHERE a = 'of' AND b = 'the' GROUP BY 1)"


@query("jn13_noun_after", f"WITH {SPANS} SELECT s.sent_id, start, min(t.idx) AS noun_idx FROM spans s JOIN toks t ON s.sent_id = t.sent_id AND t.idx > stop AND pos LIKE 'NN%' GROUP BY ALL")
def jn13(t: Tables):
    return joins.noun_after(t.toks, text.phrase_spans(t.toks, ["of", "the"]))


@query("jn13_noun_after__intended", f"WITH {SPANS} SELECT s.sent_id, start, min(t.idx) AS noun_idx FROM spans s JOIN toks t ON s.sent_id = t.sent_id AND t.idx >= stop AND pos LIKE 'NN%' GROUP BY ALL")
def jn13_intended(t: Tables):
    return joins.noun_after(t.toks, text.phrase_spans(t.toks, ["of", "the"]), "intended")


@query("jn13_noun_before", f"WITH {SPANS} SELECT s.sent_id, start, max(t.idx) AS noun_idx FROM spans s JOIN toks t ON s.sent_id = t.sent_id AND t.idx < start AND pos LIKE 'NN%' GROUP BY ALL")
def jn13_before(t: Tables):
    return joins.noun_before(t.toks, text.phrase_spans(t.toks, ["of", "the"]))


@query("jn14_points_in_segments", f"WITH {CHUNKED} SELECT a.sent_id, a.idx AS pos, c.start, c.stop FROM toks a JOIN chunks c ON a.sent_id = c.sent_id AND a.idx >= c.start AND a.idx < c.stop WHERE a.pos = 'JJ'")
def jn14(t: Tables):
    points = t.toks.where("pos = 'JJ'").select("sent_id", F.col("idx").alias("pos"))
    return joins.in_segment(points, text.chunks(t.toks).select("sent_id", "start", "stop"))


@query("jn17_zip", "SELECT pos, iob, count(*) AS n FROM toks GROUP BY ALL")
def jn17(t: Tables):
    return joins.zipped(t.toks.select("sent_id", "idx", "pos"), t.toks.select("sent_id", "idx", "iob")).groupBy("pos", "iob").agg(F.count("*").alias("n"))


GOLD_MODEL = """gold AS (SELECT DISTINCT source AS corpus, lang AS term FROM documents), model AS (SELECT DISTINCT source AS corpus, CASE WHEN text LIKE '%http%' THEN lang ELSE 'of ' || source END AS term FROM documents)"""


def _gold_model(t: Tables):
    gold = t.docs.select(F.col("source").alias("corpus"), F.col("lang").alias("term")).distinct()
    said = F.when(F.col("text").contains("http"), F.col("lang")).otherwise(F.concat(F.lit("of "), "source"))
    return gold, t.docs.select(F.col("source").alias("corpus"), said.alias("term")).distinct()


@query("jn16_model_and_gold", f"WITH {GOLD_MODEL} SELECT corpus, term, 'both' AS side FROM model SEMI JOIN gold USING (corpus, term) UNION ALL SELECT corpus, term, 'model' FROM model ANTI JOIN gold USING (corpus, term)")
def jn16(t: Tables):
    gold, model = _gold_model(t)
    on = ["corpus", "term"]
    return model.join(gold, on, "left_semi").withColumn("side", F.lit("both")).unionByName(model.join(gold, on, "left_anti").withColumn("side", F.lit("model")))


@query("set1_confusion_sets", f"WITH {GOLD_MODEL} SELECT 'tp' AS kind, * FROM (SELECT * FROM gold INTERSECT SELECT * FROM model) UNION ALL SELECT 'fp', * FROM (SELECT * FROM model EXCEPT SELECT * FROM gold) UNION ALL SELECT 'fn', * FROM (SELECT * FROM gold EXCEPT SELECT * FROM model)")
def set1(t: Tables):
    from aspectra.plans import evaluate

    return evaluate.confusion_sets(*_gold_model(t))


@query("set2_transaction_words", "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part")
def set2(t: Tables):
    return t.read("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


@query("set3_other_ids", "SELECT DISTINCT doc_id FROM documents EXCEPT SELECT DISTINCT doc_id FROM labels")
def set3(t: Tables):
    return t.docs.select("doc_id").subtract(t.read("labels").select("doc_id"))


@query("set4_all_strings", "SELECT lower(p_name) AS string FROM part UNION SELECT lower(p_type) FROM part")
def set4(t: Tables):
    p = t.read("part")
    return p.select(F.lower("p_name").alias("string")).union(p.select(F.lower("p_type"))).distinct()


@query("set5_itself_not_superset", "SELECT review_id FROM toks WHERE lemma = 'there' EXCEPT SELECT review_id FROM toks WHERE lemma = 'there' AND idx > 3")
def set5(t: Tables):
    w = t.toks.where("lemma = 'there'")
    return w.select("review_id").exceptAll(w.select("review_id")).union(w.select("review_id").distinct()).subtract(w.where("idx > 3").select("review_id"))


@query("set6_bag_union", "SELECT p_brand AS term, count(*) AS n FROM (SELECT p_brand FROM part UNION ALL SELECT p_brand FROM part WHERE p_size > 25) GROUP BY 1")
def set6(t: Tables):
    p = t.read("part")
    return p.select(F.col("p_brand").alias("term")).unionByName(p.where("p_size > 25").select(F.col("p_brand").alias("term"))).groupBy("term").agg(F.count("*").alias("n"))


@query("fn2_strings", "SELECT doc_id, lower(source) || '|' || upper(lang) AS k, trim(replace(text, 'e', 'E')) AS r, strpos(text, 'th') - 1 AS at, array_to_string(string_split(source, 'r'), '-') AS j FROM documents")
def fn2(t: Tables):
    return t.docs.select("doc_id", F.concat_ws("|", F.lower("source"), F.upper("lang")).alias("k"), F.trim(F.replace("text", F.lit("e"), F.lit("E"))).alias("r"), (F.instr("text", "th") - 1).alias("at"), F.array_join(F.split("source", "r"), "-").alias("j"))


@query("fn3_patterns", "SELECT doc_id, regexp_matches(text, '[0-9]{4}') AS has, len(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS names, len(string_split_regex(text, '[,;]\\s*')) AS parts FROM documents")
def fn3(t: Tables):
    return t.docs.select("doc_id", F.col("text").rlike("[0-9]{4}").alias("has"), F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("names"), F.size(F.split("text", r"[,;]\s*", -1)).alias("parts"))


@query("fn4_ascii", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM documents")
def fn4(t: Tables):
    return t.docs.select("doc_id", strings.ascii_only(F.col("text")).alias("text"))


@query("fn5_slash", "SELECT page_id, replace(url, '/', '&slash;') AS url, replace(replace(url, '/', '&slash;'), '&slash;', '/') = url AS back FROM pages")
def fn5(t: Tables):
    coded = strings.escape_slash(F.col("url"))
    return t.read("pages").select("page_id", coded.alias("url"), (strings.unescape_slash(coded) == F.col("url")).alias("back"))


@query("fn6_distance", "SELECT sent_id, dep_idx, abs(head_idx - dep_idx) AS distance FROM rels WHERE head_idx >= 0")
def fn6(t: Tables):
    return t.rels.where("head_idx >= 0").select("sent_id", "dep_idx", F.abs(F.col("head_idx") - F.col("dep_idx")).alias("distance"))


@query("fn7_logarithm", "SELECT doc_id, round(ln(n_chars + 1), 9) AS l FROM documents")
def fn7(t: Tables):
    return t.docs.select("doc_id", F.round(F.log(F.col("n_chars") + 1), 9).alias("l"))


@query("fn8_idf", "WITH df AS (SELECT lemma AS term, count(DISTINCT review_id) AS df FROM toks GROUP BY 1) SELECT term, round(ln((SELECT count(*) FROM documents) / greatest(df, 1)), 9) AS idf FROM df")
def fn8(t: Tables):
    df = t.toks.groupBy(F.col("lemma").alias("term")).agg(F.count_distinct("review_id").alias("df"))
    total = t.docs.agg(F.count("*").alias("total"))
    return df.crossJoin(F.broadcast(total)).select("term", F.round(strings.idf(F.col("total"), F.col("df")), 9).alias("idf"))  # one row


@query("fn9_flip", "SELECT sent_id, CASE WHEN count(*) FILTER (lemma = 'but') % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM toks GROUP BY 1")
def fn9(t: Tables):
    return t.toks.groupBy("sent_id").agg(F.pow(F.lit(-1.0), F.count_if(F.col("lemma") == "but")).alias("sign"))


@query("fn10_share", "SELECT source, count(*) // 10 AS tenth, round(count(*) / 7, 2) AS r FROM documents GROUP BY 1")
def fn10(t: Tables):
    n = F.count("*")
    return t.docs.groupBy("source").agg(F.floor(n / 10).alias("tenth"), F.round(n / 7, 2).alias("r"))


@query("fn11_arrays", "WITH w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS a, string_split(lower(p_name), ' ') AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS words, array_to_string(a[1:2], ' ') AS two, a[1] || b[1] AS zipped FROM w")
def fn11(t: Tables):
    a, b = F.split(F.lower("p_type"), " "), F.split(F.lower("p_name"), " ")
    zipped = F.array_join(F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, 1), lambda z: F.concat(z.a, z.b)), "")
    return t.read("part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.concat(a, b))), " ").alias("words"), F.array_join(F.slice(a, 1, 2), " ").alias("two"), zipped.alias("zipped"))


@query("fn12_inverted_map", "SELECT lang, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1")
def fn12(t: Tables):
    return t.docs.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
