"""Queries over aggregates, windows, rankings and the frequent-itemset model."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aspectra.functions.lineage import saved
from aspectra.operators import cvalue, itemsets, joins, running, text, windows
from aspectra.plans import evaluate, grid
from aspectra.plans.q_sources import GOLD
from aspectra.plans.q_text import CHUNKED
from aspectra.plans.registry import Tables, query
from aspectra.sources import reviews

STOP = "stop AS (SELECT DISTINCT lower(word) AS w FROM toks WHERE pos IN ('DT', 'IN', 'CC'))"
X = STOP + f""", {CHUNKED},
x AS (SELECT DISTINCT sent_id, lemma AS item FROM chunked WHERE (pos LIKE 'NN%' OR type = 'NP') AND length(word) > 1 AND lower(word) NOT IN (SELECT w FROM stop))"""
#: Itemsets of up to two items that at least 0.2 % of all sentences have.
SETS = X + """,
least AS (SELECT ceil(0.2 / 100 * count(*) - 1e-9) AS k FROM sents),
one AS (SELECT item, count(*) AS c FROM x GROUP BY 1 HAVING count(*) >= (SELECT k FROM least)),
cut AS (SELECT * FROM x WHERE item IN (SELECT item FROM one)),
two AS (SELECT a.item AS i1, b.item AS i2, count(*) AS c FROM cut a JOIN cut b ON a.sent_id = b.sent_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= (SELECT k FROM least)),
sets AS (SELECT item AS set_id, [item] AS items, c AS support FROM one UNION ALL SELECT i1 || '+' || i2, [i1, i2], c FROM two)"""
OCC = SETS + """,
lem AS (SELECT DISTINCT sent_id, lemma FROM toks),
occ AS (SELECT set_id, items, l.sent_id FROM sets JOIN lem l ON l.lemma = items[1] LEFT JOIN lem m ON m.sent_id = l.sent_id AND m.lemma = items[2] WHERE len(items) = 1 OR m.lemma IS NOT NULL)"""
PLACES = OCC + """,
places AS (SELECT set_id, o.sent_id, [a.idx] AS idxs FROM occ o JOIN toks a ON a.sent_id = o.sent_id AND a.lemma = items[1] WHERE len(items) = 1
  UNION SELECT set_id, o.sent_id, list_sort([a.idx, b.idx]) FROM occ o JOIN toks a ON a.sent_id = o.sent_id AND a.lemma = items[1] JOIN toks b ON b.sent_id = o.sent_id AND b.lemma = items[2] WHERE len(items) = 2 AND abs(a.idx - b.idx) <= 3)"""
PURE = OCC + """,
taken AS (SELECT DISTINCT s.set_id, o.sent_id FROM sets s JOIN occ o ON len(s.items) = 1 AND len(o.items) = 2 AND list_contains(o.items, s.items[1])),
pure AS (SELECT s.set_id, count(o.sent_id) FILTER (t.sent_id IS NULL) AS psupport FROM sets s LEFT JOIN occ o USING (set_id) LEFT JOIN taken t ON t.set_id = o.set_id AND t.sent_id = o.sent_id GROUP BY ALL)"""


def _stop(t: Tables):
    # written, so that Spark knows its size: it deals all tokens by their word to meet a list of unknown size
    return saved(t.toks.where(F.col("pos").isin("DT", "IN", "CC")).select(F.lower("word").alias("word")).distinct(), "stop")


def _sets(t: Tables):
    n = t.sents.count()
    items = saved(itemsets.transactions(t.toks, _stop(t), itemsets.least_count(n, 0.2)), "transactions")
    return itemsets.frequent(items, n, 0.2, 2)


def _occ(t: Tables):
    sets = saved(_sets(t), "itemsets")
    return sets, saved(itemsets.occurrences(sets, t.toks), "occurrences")


def _places(t: Tables):
    sets, occ = _occ(t)
    return sets, occ, saved(windows.compact_positions(occ, t.toks, 3), "places")


@query("agg1_transactions", f"WITH {X} SELECT sent_id, string_agg(item, ' ' ORDER BY item) AS items FROM x GROUP BY 1")
def agg1(t: Tables):
    t = t.kept()
    return itemsets.transactions(t.toks, _stop(t)).groupBy("sent_id").agg(F.array_join(F.array_sort(F.collect_list("item")), " ").alias("items"))


@query("agg2_frequent_itemsets", f"WITH {SETS} SELECT set_id, support FROM sets")
def agg2(t: Tables):
    t = t.kept()
    return _sets(t).select("set_id", "support")


@query("agg3_support", "SELECT lemma AS term, count(DISTINCT sent_id) AS sentences, count(DISTINCT review_id) AS reviews FROM toks WHERE pos LIKE 'NN%' GROUP BY 1")
def agg3(t: Tables):
    return t.toks.where(text.is_noun(F.col("pos"))).groupBy(F.col("lemma").alias("term")).agg(F.count_distinct("sent_id").alias("sentences"), F.count_distinct("review_id").alias("reviews"))


@query("agg4_pure_support", f"WITH {PURE} SELECT set_id, psupport FROM pure")
def agg4(t: Tables):
    t = t.kept()
    return itemsets.pure_support(*_occ(t))


COMPACT = PLACES + ", compact AS (SELECT o.set_id, count(*) FILTER (len(o.items) = 1 OR p.sent_id IS NOT NULL) AS compact FROM occ o LEFT JOIN (SELECT DISTINCT set_id, sent_id FROM places) p ON p.set_id = o.set_id AND p.sent_id = o.sent_id GROUP BY ALL)"


@query("agg5_compact_sentences", f"WITH {COMPACT} SELECT set_id, compact FROM compact WHERE compact >= 2")
def agg5(t: Tables):
    t = t.kept()
    _, occ, places = _places(t)
    return itemsets.compact_counts(occ, places).where("compact >= 2")


@query("flt15_aspect_flags", f"WITH {COMPACT} SELECT s.set_id, len(items) > 1 AS is_compound, false AS is_fuzzy, coalesce(compact, 0) > 0 AS is_compact FROM sets s LEFT JOIN compact USING (set_id)")
def flt15(t: Tables):
    t = t.kept()
    return itemsets.flags(*_places(t))


@query("agg6_ngram_groups", """WITH n AS (SELECT lower(word) AS a, word AS w, lead(lower(word)) OVER s AS b, lead(word) OVER s AS v FROM toks WINDOW s AS (PARTITION BY sent_id ORDER BY idx))
SELECT a || ' ' || b AS string, count(*) AS freq, count(DISTINCT w || ' ' || v) AS surfaces FROM n WHERE b IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def agg6(t: Tables):
    return cvalue.groups(cvalue.ngrams(t.toks, 2, 2)).where("freq > 1").select("string", "freq", F.size("original").cast("long").alias("surfaces"))


@query("agg8_stop_list", "WITH n AS (SELECT lower(word) AS word, count(*) AS n FROM toks GROUP BY 1) SELECT word FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS k FROM n) WHERE k <= (SELECT count(*) // 10 FROM n)")
def agg8(t: Tables):
    return cvalue.stop_list(t.toks, 10).select("word")


PAIRS = """near AS (SELECT a.sent_id, a.lemma AS jj, n.lemma AS nn, row_number() OVER (PARTITION BY a.sent_id, a.idx ORDER BY abs(a.idx - n.idx), n.idx) AS k FROM toks a JOIN toks n ON a.sent_id = n.sent_id WHERE a.pos = 'JJ' AND n.pos LIKE 'NN%'),
pairs AS (SELECT nn, jj, count(*) AS c FROM near WHERE k = 1 GROUP BY ALL)"""


def _pairs(t: Tables):
    return joins.nearest_noun(t.toks, own=True).groupBy(F.col("noun").alias("nn"), F.col("lemma").alias("jj")).agg(F.count("*").alias("c"))


@query("agg9_pair_counts", f"WITH {PAIRS} SELECT nn, jj, c FROM pairs")
def agg9(t: Tables):
    return _pairs(t)


@query("agg10_marginals", f"WITH {PAIRS} SELECT nn, jj, c, sum(c) OVER (PARTITION BY nn)::BIGINT AS nn_total, sum(c) OVER (PARTITION BY jj)::BIGINT AS jj_total FROM pairs")
def agg10(t: Tables):
    from aspectra.operators import graph

    return graph.marginals(_pairs(t))


@query("agg11_association", f"WITH {PAIRS}, m AS (SELECT *, sum(c) OVER (PARTITION BY nn) AS a, sum(c) OVER (PARTITION BY jj) AS b FROM pairs) SELECT nn, jj, round(1 / (0.5 / (c / a) + 0.5 / (c / b)), 9) AS association FROM m")
def agg11(t: Tables):
    from aspectra.operators import graph

    return graph.association(_pairs(t)).select("nn", "jj", F.round("association", 9).alias("association"))


@query("agg12_document_frequency", "SELECT lower(word) AS term, count(DISTINCT sent_id) AS df FROM toks GROUP BY 1")
def agg12(t: Tables):
    return t.toks.groupBy(F.lower("word").alias("term")).agg(F.count_distinct("sent_id").alias("df"))


NEGATIONS = ["not", "n't", "'t", "however", "but", "despite", "though", "except", "although", "oddly", "aside"]


@query("agg14_negations_between__intended", "SELECT r.sent_id, head_idx AS a, dep_idx AS b, count(t.idx) AS negations FROM (SELECT DISTINCT sent_id, head_idx, dep_idx FROM rels WHERE head_idx >= 0) r LEFT JOIN toks t ON t.sent_id = r.sent_id AND lower(t.word) IN ('but', 'and', 'not') AND t.idx >= least(head_idx, dep_idx) AND t.idx < greatest(head_idx, dep_idx) GROUP BY ALL")
def agg14(t: Tables):
    pairs = t.rels.where("head_idx >= 0").select("sent_id", F.col("head_idx").alias("a"), F.col("dep_idx").alias("b")).distinct()
    return windows.negations_between(t.toks, pairs, ["but", "and", "not"], "intended")


@query("agg14_negations_between", "SELECT DISTINCT sent_id, head_idx AS a, dep_idx AS b, 0::BIGINT AS negations FROM rels WHERE head_idx >= 0")
def agg14_reference(t: Tables):
    pairs = t.rels.where("head_idx >= 0").select("sent_id", F.col("head_idx").alias("a"), F.col("dep_idx").alias("b")).distinct()
    return windows.negations_between(t.toks, pairs, ["but"])


COUNTS = """gold AS (SELECT DISTINCT source AS corpus, lang AS term FROM documents), model AS (SELECT DISTINCT source AS corpus, CASE WHEN text LIKE '%http%' THEN lang ELSE 'of ' || source END AS term FROM documents),
j AS (SELECT coalesce(g.corpus, m.corpus) AS corpus, g.term AS g, m.term AS m FROM gold g FULL JOIN model m ON g.corpus = m.corpus AND g.term = m.term),
c AS (SELECT corpus, count(*) FILTER (g IS NOT NULL AND m IS NOT NULL) AS tp, count(*) FILTER (g IS NULL) AS fp, count(*) FILTER (m IS NULL) AS fn FROM j GROUP BY 1),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM c)"""


@query("agg18_scores", f"WITH {COUNTS} SELECT corpus, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + fp + fn) END, 9) AS accuracy FROM pr")
def agg18(t: Tables):
    from aspectra.plans.q_joins import _gold_model

    df = evaluate.scores(*_gold_model(t))
    return df.select("corpus", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f", "accuracy")))


RANKED = "ranked AS (SELECT word AS term, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT lower(word) AS word, count(*) AS n FROM toks WHERE pos LIKE 'NN%' GROUP BY 1)), gold AS (SELECT DISTINCT lower(word) AS term FROM toks WHERE pos LIKE 'NN%' AND lower(word) LIKE '%tion')"


@query("agg19_scores_at", f"""WITH {RANKED}, ns AS (SELECT unnest(range(10, (SELECT count(*) FROM ranked), 10)) AS n), c AS (SELECT n, count(*) FILTER (rank <= n AND term IN (SELECT term FROM gold)) AS tp FROM ns, ranked WHERE rank <= n GROUP BY n)
SELECT n, tp, round(tp / n, 9) AS precision, round(tp / (SELECT count(*) FROM gold), 9) AS recall FROM c""")
def agg19(t: Tables):
    noun = t.toks.where(text.is_noun(F.col("pos"))).groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n"))
    ranked = running.numbered(noun, [F.desc("n"), F.col("term")])
    df = evaluate.scores_at(noun.where("term like '%tion'"), ranked)
    return df.select("n", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query("agg20_aspect_types", f"WITH {GOLD} SELECT corpus, term, CASE WHEN bool_or(type = 'n') THEN 'n' ELSE 'u' END AS type FROM gold GROUP BY ALL")
def agg20(t: Tables):
    g = reviews.gold(reviews.scan(t.lines))
    return g.groupBy("corpus", "term").agg(F.when(F.bool_or(F.col("type") == "n"), "n").otherwise("u").alias("type"))


@query("agg21_rollup", f"WITH {GOLD} SELECT term, review_id, count(DISTINCT sent_id) AS sentences, coalesce(sum(orientation), 0)::BIGINT AS orientation FROM gold GROUP BY ROLLUP (term, review_id)")
def agg21(t: Tables):
    g = reviews.gold(reviews.scan(t.lines))
    return g.rollup("term", "review_id").agg(F.count_distinct("sent_id").alias("sentences"), F.coalesce(F.sum("orientation"), F.lit(0)).alias("orientation"))


@query("agg22_grid_size", "SELECT 6 * 3 * 3 * 3 * 3 * 2 * 4 * 3 AS frequent, 3 * 2 * 2 AS graph")
def agg22(t: Tables):
    size = lambda *n: F.aggregate(F.array(*(F.lit(x) for x in n)), F.lit(1), lambda a, x: a * x)
    return t.spark.range(1).select(size(6, 3, 3, 3, 3, 2, 4, 3).alias("frequent"), size(3, 2, 2).alias("graph"))


WIN1 = "SELECT sent_id, idx, (SELECT 1) AS one, min(CASE WHEN pos = 'NN' THEN idx END) OVER (PARTITION BY sent_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_idx, max(CASE WHEN pos = 'NN' {0} THEN idx END) OVER (PARTITION BY sent_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_idx FROM toks"


@query("win1_next_previous", f"SELECT sent_id, idx, next_idx, prev_idx FROM ({WIN1.format('AND idx > 0')})")
def win1(t: Tables):
    return windows.neighbours(t.toks, "NN").select("sent_id", "idx", "next_idx", "prev_idx")


@query("win1_next_previous__intended", f"SELECT sent_id, idx, next_idx, prev_idx FROM ({WIN1.format('')})")
def win1_intended(t: Tables):
    return windows.neighbours(t.toks, "NN", "intended").select("sent_id", "idx", "next_idx", "prev_idx")


@query("win2_nearest_chunk", f"""WITH {CHUNKED}, near AS (SELECT a.sent_id, a.chunk_id, b.chunk_id AS nearest_id, row_number() OVER (PARTITION BY a.sent_id, a.chunk_id ORDER BY abs(a.chunk_id - b.chunk_id), b.chunk_id) AS k FROM chunks a JOIN chunks b ON a.sent_id = b.sent_id AND a.chunk_id <> b.chunk_id AND b.type = 'NP' AND NOT (b.chunk_id = 1 AND b.chunk_id < a.chunk_id))
SELECT sent_id, chunk_id, nearest_id FROM near WHERE k = 1""")
def win2(t: Tables):
    return windows.chunk_neighbours(text.chunks(t.toks), "NP").where("nearest_id is not null").select("sent_id", "chunk_id", "nearest_id")


@query("win3_ngrams", """WITH n AS (SELECT lower(word) AS a, lead(lower(word), 1) OVER s AS b, lead(lower(word), 2) OVER s AS c FROM toks WINDOW s AS (PARTITION BY sent_id ORDER BY idx)), g AS (SELECT a || ' ' || b AS g FROM n WHERE b IS NOT NULL UNION ALL SELECT a || ' ' || b || ' ' || c FROM n WHERE c IS NOT NULL)
SELECT g AS ngram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 2""")
def win3(t: Tables):
    return cvalue.ngrams(t.toks, 2, 3).groupBy(F.array_join("key", " ").alias("ngram")).agg(F.count("*").alias("n")).where("n > 2")


#: Fixed patterns over `idx-POS` strings. The third means the second, as its other alternative can't match.
CONDITIONS = {
    1: r"(\d*-NN\D?\s)+(\d*-NN\D?\s?)",
    2: r"(\d*-JJ\D?\s|\d*-NN\D?\s)+(\d*-NN\D?\s?)",
    3: r"(\d*-JJ\D?\s|\d*-NN\D?\s)+(\d*-NN\D?\s?)",
}
SPANS = r"""tagged_sents AS (SELECT sent_id, string_agg(idx || '-' || pos, ' ' ORDER BY idx) AS tags FROM toks GROUP BY 1),
ms AS (SELECT sent_id, trim(unnest(regexp_extract_all(tags, '{0}', 0))) AS m FROM tagged_sents),
spans AS (SELECT sent_id, string_split(string_split(m, ' ')[1], '-')[1]::INT AS start, string_split(string_split(m, ' ')[-1], '-')[1]::INT + 1 AS stop FROM ms)"""


@query("win4_spans_nouns", f"WITH {SPANS.format(CONDITIONS[1])} SELECT sent_id, start, stop FROM spans")
def win4_nouns(t: Tables):
    return cvalue.spans(t.toks, 1).select("sent_id", "start", "stop")


@query("win4_spans", f"WITH {SPANS.format(CONDITIONS[2])} SELECT sent_id, start, stop FROM spans")
def win4(t: Tables):
    return cvalue.spans(t.toks, 2).select("sent_id", "start", "stop")


@query("win4_spans_third", f"WITH {SPANS.format(CONDITIONS[2])} SELECT count(*) AS n, sum(stop - start)::BIGINT AS words FROM spans")
def win4_third(t: Tables):
    return cvalue.spans(t.toks, 3).agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("words"))


@query("win5_nearest_nouns", "WITH p AS (SELECT a.sent_id, a.idx AS pos, n.idx, row_number() OVER (PARTITION BY a.sent_id, a.idx ORDER BY n.idx) AS rank FROM toks a JOIN toks n ON a.sent_id = n.sent_id AND n.idx > a.idx WHERE a.pos = 'JJ' AND n.pos LIKE 'NN%') SELECT sent_id, pos, idx, rank::INT AS rank FROM p WHERE rank <= 2")
def win5(t: Tables):
    return windows.nearest_k(t.toks, t.toks.where("pos = 'JJ'").select("sent_id", F.col("idx").alias("pos")), 2, "next")


WIN6 = "SELECT sent_id, idx, count(*) FILTER (lower(word) IN ('not', 'n''t', '''t', 'however', 'but', 'despite', 'though', 'except', 'although', 'oddly', 'aside')) OVER (PARTITION BY sent_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND {0} FOLLOWING) AS negations FROM toks"


@query("win6_near_negation", f"SELECT sent_id, sum(negations)::BIGINT AS n FROM ({WIN6.format(4)}) GROUP BY 1")
def win6(t: Tables):
    return windows.negations_near(t.toks, NEGATIONS, 5).groupBy("sent_id").agg(F.sum("negations").alias("n"))


@query("win6_near_negation__intended", f"SELECT sent_id, sum(negations)::BIGINT AS n FROM ({WIN6.format(5)}) GROUP BY 1")
def win6_intended(t: Tables):
    return windows.negations_near(t.toks, NEGATIONS, 5, "intended").groupBy("sent_id").agg(F.sum("negations").alias("n"))


@query("win7_compact_positions", f"WITH {PLACES} SELECT set_id, sent_id, array_to_string(idxs, ' ') AS idxs FROM places WHERE len(idxs) = 2")
def win7(t: Tables):
    t = t.kept()
    return _places(t)[2].where(F.size("idxs") == 2).select("set_id", "sent_id", F.array_join("idxs", " ").alias("idxs"))


NEAR = PLACES + """, spans AS (SELECT DISTINCT sent_id, list_min(idxs) AS first, list_max(idxs) AS last FROM places), sizes AS (SELECT sent_id, count(*) AS n FROM toks GROUP BY 1),
near AS (SELECT DISTINCT s.sent_id, t.idx, t.lemma FROM spans s JOIN sizes USING (sent_id) JOIN toks t ON t.sent_id = s.sent_id AND t.pos = 'JJ' WHERE {0})"""
NEAR_REFERENCE = NEAR.format("(t.idx >= CASE WHEN first - 5 < 0 THEN first ELSE 0 END AND t.idx <= last) OR (t.idx >= last AND t.idx < CASE WHEN last + 5 > n THEN last ELSE n END)")
NEAR_INTENDED = NEAR.format("t.idx BETWEEN first - 5 AND last + 5")


@query("win8_adjective_window", f"WITH {NEAR_REFERENCE} SELECT sent_id, idx FROM near")
def win8(t: Tables):
    t = t.kept()
    places = _places(t)[2]
    spans = places.select("sent_id", F.array_min("idxs").alias("first"), F.array_max("idxs").alias("last"))
    return windows.adjectives_near(t.toks, spans, 5).select("sent_id", "idx")


@query("win8_adjective_window__intended", f"WITH {NEAR_INTENDED} SELECT sent_id, idx FROM near")
def win8_intended(t: Tables):
    t = t.kept()
    places = _places(t)[2]
    spans = places.select("sent_id", F.array_min("idxs").alias("first"), F.array_max("idxs").alias("last"))
    return windows.adjectives_near(t.toks, spans, 5, "intended").select("sent_id", "idx")


RUNS = CHUNKED + """, marked AS (SELECT *, (pos LIKE 'NN%' AND coalesce(type, '') = 'NP') AS r, max(idx) OVER (PARTITION BY sent_id) AS z FROM chunked),
numbered AS (SELECT *, idx - row_number() OVER (PARTITION BY sent_id, r ORDER BY idx) AS island FROM marked),
runs AS (SELECT sent_id, min(idx) AS begins, string_agg(word, ' ' ORDER BY idx) AS word, 'NN' AS pos, max(idx) AS e, max(z) AS z FROM numbered WHERE r GROUP BY sent_id, island UNION ALL SELECT sent_id, idx, word, pos, -1, z FROM numbered WHERE NOT r)"""


@query("win9_noun_runs", f"WITH {RUNS} SELECT sent_id, (row_number() OVER (PARTITION BY sent_id ORDER BY begins) - 1)::INT AS place, word, pos FROM runs WHERE e < z")
def win9(t: Tables):
    return windows.noun_runs(t.toks)


@query("win9_noun_runs__intended", f"WITH {RUNS} SELECT sent_id, (row_number() OVER (PARTITION BY sent_id ORDER BY begins) - 1)::INT AS place, word, pos FROM runs")
def win9_intended(t: Tables):
    return windows.noun_runs(t.toks, "intended")


REGROUP = """g AS (SELECT sent_id, idx, lower(word) || ' ' || lead(lower(word)) OVER (PARTITION BY sent_id ORDER BY idx) AS g FROM toks), spans AS (SELECT DISTINCT sent_id, idx AS start, idx + 2 AS stop FROM g WHERE g = 'of the'),
kept AS (SELECT t.* FROM toks t WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.sent_id = t.sent_id AND t.idx >= s.start AND t.idx < s.stop + {0})),
groups AS (SELECT s.sent_id, s.start, string_agg(word, ' ' ORDER BY idx) AS word FROM spans s JOIN toks t ON t.sent_id = s.sent_id AND t.idx >= s.start AND t.idx < s.stop GROUP BY ALL),
regrouped AS (SELECT sent_id, start, word, 'NN' AS pos FROM groups UNION ALL SELECT sent_id, idx, word, pos FROM kept)
SELECT sent_id, (row_number() OVER (PARTITION BY sent_id ORDER BY start) - 1)::INT AS place, word, pos FROM regrouped"""


def _of_the(t: Tables):
    return text.word_pair(t.toks, "of", "the")


@query("win10_regroup", f"WITH {REGROUP.format(1)}")
def win10(t: Tables):
    return windows.regroup(t.toks, _of_the(t))


@query("win10_regroup__intended", f"WITH {REGROUP.format(0)}")
def win10_intended(t: Tables):
    return windows.regroup(t.toks, _of_the(t), "intended")


@query("win11_iob_schemes", f"""WITH {CHUNKED}, e AS (SELECT *, idx = min(idx) OVER w AS f, idx = max(idx) OVER w AS l, lag(type) OVER (PARTITION BY sent_id ORDER BY idx) AS pt FROM chunked WINDOW w AS (PARTITION BY sent_id, chunk_id)),
s AS (SELECT 'End' AS scheme, CASE WHEN type IS NULL THEN 'O' WHEN l THEN 'E-' || type ELSE 'I-' || type END AS tag FROM e
UNION ALL SELECT 'BeginEndCombined', CASE WHEN type IS NULL THEN 'O' WHEN f AND l THEN 'C-' || type WHEN f THEN 'B-' || type WHEN l THEN 'E-' || type ELSE 'I-' || type END FROM e
UNION ALL SELECT 'Between', CASE WHEN type IS NULL THEN 'O' WHEN f AND pt = type THEN 'B-' || type ELSE 'I-' || type END FROM e)
SELECT scheme, tag, count(*) AS n FROM s GROUP BY ALL""")
def win11(t: Tables):
    out = None
    for s in ("End", "BeginEndCombined", "Between"):
        df = windows.iob_scheme(t.toks, s).groupBy("tag").agg(F.count("*").alias("n")).select(F.lit(s).alias("scheme"), "tag", "n")
        out = df if out is None else out.unionByName(df)
    return out


@query("top2_ranked_targets", f"WITH {PAIRS}, m AS (SELECT nn, sum(c)::BIGINT AS c FROM pairs GROUP BY 1) SELECT nn, c, row_number() OVER (ORDER BY c DESC, nn) AS rank FROM m")
def top2(t: Tables):
    return running.numbered(_pairs(t).groupBy("nn").agg(F.sum("c").alias("c")), [F.desc("c"), F.col("nn")])


@query("top3_best_of_sentence", f"WITH {OCC} SELECT sent_id, arg_max(set_id, (support, -ord)) AS set_id FROM (SELECT o.sent_id, o.set_id, s.support, row_number() OVER (PARTITION BY o.sent_id ORDER BY o.set_id) AS ord FROM occ o JOIN sets s USING (set_id)) GROUP BY 1")
def top3(t: Tables):
    sets, occ = _occ(t)
    df = occ.select("sent_id", "set_id").join(sets.select("set_id", "support"), "set_id")
    w = Window.partitionBy("sent_id").orderBy(F.desc("support"), "set_id")
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").select("sent_id", "set_id")


@query("top4_best_partner", f"WITH {PAIRS} SELECT jj, nn FROM (SELECT *, row_number() OVER (PARTITION BY jj ORDER BY c DESC, nn) AS k FROM pairs) WHERE k = 1")
def top4(t: Tables):
    return _pairs(t).groupBy("jj").agg(F.min_by("nn", F.struct(-F.col("c"), "nn")).alias("nn"))


@query("top5_nearest_adjective", "WITH p AS (SELECT a.sent_id, a.idx AS pos, n.idx, row_number() OVER (PARTITION BY a.sent_id, a.idx ORDER BY n.idx DESC) AS rank FROM toks a JOIN toks n ON a.sent_id = n.sent_id AND n.idx < a.idx WHERE a.pos = 'NNS' AND n.pos = 'JJ') SELECT sent_id, pos, idx FROM p WHERE rank = 1")
def top5(t: Tables):
    return windows.nearest_k(t.toks, t.toks.where("pos = 'NNS'").select("sent_id", F.col("idx").alias("pos")), 1, "previous", "adjective").select("sent_id", "pos", "idx")


@query("top6_first_ranked", f"WITH {RANKED} SELECT term, rank FROM ranked WHERE rank <= 100")
def top6(t: Tables):
    noun = t.toks.where(text.is_noun(F.col("pos"))).groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("n"))
    df = noun.orderBy(F.desc("n"), "term").limit(100)
    return df.select("term", F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("rank"))


@query("mod1b_occurrences", f"WITH {OCC} SELECT set_id, count(*) AS sentences FROM occ GROUP BY 1")
def mod1b(t: Tables):
    t = t.kept()
    return _occ(t)[1].groupBy("set_id").agg(F.count("*").alias("sentences"))


KEPT_C = COMPACT + ", bad AS (SELECT s.set_id FROM sets s LEFT JOIN compact c USING (set_id) WHERE coalesce(compact, 0) < 40)"


@query("mod1c_compactness__intended", f"WITH {KEPT_C} SELECT set_id FROM sets WHERE set_id NOT IN (SELECT set_id FROM bad)")
def mod1c(t: Tables):
    t = t.kept()
    return itemsets.compactness_pruning(*_places(t), 40, "intended").select("set_id")


POPPED = ", flags AS (SELECT set_id, (set_id IN (SELECT set_id FROM bad))::INT AS f FROM sets), isles AS (SELECT *, sum(1 - f) OVER (ORDER BY set_id) AS g FROM flags), places_in AS (SELECT *, row_number() OVER (PARTITION BY g, f ORDER BY set_id) AS k FROM isles) SELECT set_id FROM places_in WHERE f = 0 OR k % 2 = 0"


@query("mod1c_compactness", f"WITH {KEPT_C} {POPPED}")
def mod1c_reference(t: Tables):
    t = t.kept()
    return itemsets.compactness_pruning(*_places(t), 40).select("set_id")


REDUNDANT = PURE + ", above AS (SELECT DISTINCT x.set_id FROM sets x JOIN sets y ON len(x.items) = 1 AND len(y.items) = 2 AND list_contains(y.items, x.items[1])), bad AS (SELECT set_id FROM pure JOIN above USING (set_id) WHERE psupport {0} 60)"


@query("mod1d_redundancy__intended", f"WITH {REDUNDANT.format('<')} SELECT set_id FROM sets WHERE set_id NOT IN (SELECT set_id FROM bad)")
def mod1d(t: Tables):
    t = t.kept()
    return itemsets.redundancy_pruning(*_occ(t), 60, "intended").select("set_id")


@query("mod1d_redundancy", f"WITH {REDUNDANT.format('<=')} {POPPED}")
def mod1d_reference(t: Tables):
    t = t.kept()
    return itemsets.redundancy_pruning(*_occ(t), 60).select("set_id")


@query("mod1e_near_adjectives__intended", f"WITH {NEAR_INTENDED} SELECT DISTINCT lemma AS word FROM near")
def mod1e(t: Tables):
    t = t.kept()
    _, occ, places = _places(t)
    return itemsets.near_adjectives(occ, places, t.toks, 5, "intended")


@query("mod1f_infrequent__intended", f"""WITH {OCC}, known AS (SELECT DISTINCT lemma FROM toks WHERE pos = 'JJ'), left_over AS (SELECT * FROM toks WHERE sent_id NOT IN (SELECT sent_id FROM occ)),
p AS (SELECT a.sent_id, n.lemma, n.word, row_number() OVER (PARTITION BY a.sent_id ORDER BY abs(n.idx - a.idx), a.idx, n.idx) AS k FROM left_over a JOIN left_over n ON a.sent_id = n.sent_id WHERE a.lemma IN (SELECT lemma FROM known) AND n.pos LIKE 'NN%')
SELECT DISTINCT lower(lemma) AS set_id FROM p WHERE k = 1 AND lower(word) NOT IN (SELECT w FROM stop) AND lower(lemma) NOT IN (SELECT set_id FROM occ)""")
def mod1f(t: Tables):
    t = t.kept()
    adj = t.toks.where("pos = 'JJ'").select(F.col("lemma").alias("word")).distinct()
    return itemsets.infrequent(t.toks, _occ(t)[1], adj, _stop(t), "intended")


@query("mod1f_infrequent", f"WITH {SETS} SELECT set_id FROM sets WHERE false")
def mod1f_reference(t: Tables):
    t = t.kept()
    adj = t.toks.where("pos = 'JJ'").select(F.col("lemma").alias("word")).distinct()
    return itemsets.infrequent(t.toks, _occ(t)[1], adj, _stop(t))


@query("mod1h_surfaces", f"WITH {PLACES}, w AS (SELECT DISTINCT set_id, sent_id, idxs FROM places) SELECT DISTINCT w.set_id, a.word || coalesce(' ' || b.word, '') AS term FROM w JOIN toks a ON a.sent_id = w.sent_id AND a.idx = idxs[1] LEFT JOIN toks b ON b.sent_id = w.sent_id AND b.idx = idxs[2]")
def mod1h(t: Tables):
    t = t.kept()
    _, occ, places = _places(t)
    return itemsets.surfaces(occ, places, t.toks)


@query("mod1a_clusters", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word, word AS cluster FROM part")
def mod1a(t: Tables):
    return itemsets.clusters(t.read("part").select(F.explode(F.split("p_name", " ")).alias("word")), 80)


@query("mod1a_clusters__intended")
def mod1a_intended(t: Tables):
    return itemsets.clusters(t.read("part").select(F.explode(F.split("p_name", " ")).alias("word")), 80, "intended")


@query("mod1_frequent_terms")
def mod1(t: Tables):
    t = t.kept()
    return itemsets.extract(t.toks, _stop(t), 0.2)


@query("mod4a_grid", "SELECT x, y, (x - 1) * 3 + CASE y WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END AS config_id FROM (VALUES (1), (2)) a(x), (VALUES ('a'), ('b'), ('c')) b(y)")
def mod4a(t: Tables):
    g = grid.Grid({"x": [1, 2], "y": ["a", "b", "c"]})
    return t.spark.createDataFrame([(g[i]["x"], g[i]["y"], i) for i in range(len(g))], "x int, y string, config_id int")


@query("mod4c_chunks", "SELECT doc_id // 64 AS chunk, count(*) AS n FROM documents GROUP BY 1")
def mod4c(t: Tables):
    return grid.chunks(t.docs, "doc_id", 64).groupBy("chunk").agg(F.count("*").alias("n"))


@query("mod4d_seed_chunks", "WITH s AS (SELECT DISTINCT lemma AS word FROM toks WHERE pos = 'JJ'), n AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS k FROM s) SELECT k // (SELECT greatest(count(*) // 9, 1) FROM s) AS chunk, min(word) AS first, count(*) AS n FROM n GROUP BY 1")
def mod4d(t: Tables):
    s = t.toks.where("pos = 'JJ'").select(F.col("lemma").alias("word")).distinct()
    size = max(s.count() // 9, 1)
    df = running.numbered(s, [F.col("word")], "k").withColumn("k", F.col("k") - 1)
    return grid.chunks(df, "k", size).groupBy("chunk").agg(F.min("word").alias("first"), F.count("*").alias("n"))


@query("jn15_tasks", "SELECT config, corpus FROM (VALUES (0), (1), (2)) a(config), (SELECT DISTINCT source AS corpus FROM documents)")
def jn15(t: Tables):
    params = t.spark.createDataFrame([(i,) for i in range(3)], "config int")
    return grid.tasks(t.docs.select(F.col("source").alias("corpus")).distinct(), params).select("config", "corpus")


@query("sents_terms_scores")
def flagship(t: Tables):
    """Precision, recall and F of the model's terms against the nouns of benchmark items, by corpus."""
    from aspectra.sources import bridge
    t = t.kept()

    sets = _sets(t).where(F.size("items") == 1).select(F.col("set_id").alias("term"))
    by = t.toks.select("corpus", F.col("lemma").alias("term")).distinct().join(sets, "term", "left_semi")
    items = t.read("benchmark").select(F.lit("b").alias("source"), F.col("item_id").alias("doc_id"), "text")
    nouns = bridge.tokens(bridge.sentences(items)).where(text.is_noun(F.col("pos"))).select(F.col("lemma").alias("term")).distinct()
    gold = t.toks.select("corpus", F.col("lemma").alias("term")).distinct().join(nouns, "term", "left_semi")
    return evaluate.scores(gold, by)
