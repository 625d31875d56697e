"""Queries over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from aspectra.operators import running
from aspectra.plans.registry import Tables, query
from aspectra.sources import lexicons, readers, reviews, trees

SCANNED = """
kinds AS (SELECT *, CASE WHEN line = '' OR line LIKE '*%' THEN 'comment' WHEN contains(line, '[t]') THEN 'title' ELSE 'sentence' END AS kind FROM lines),
counted AS (SELECT *, count(*) FILTER (kind = 'title') OVER w AS review_id, count(*) FILTER (kind = 'sentence') OVER w AS sent_id FROM kinds WINDOW w AS (PARTITION BY corpus ORDER BY line_no)),
scanned AS (SELECT corpus, review_id, sent_id, string_split(line, '##')[1] AS tags, trim(coalesce(string_split(line, '##')[2], '')) AS text FROM counted WHERE kind = 'sentence')"""
GOLD = SCANNED + """,
tags AS (SELECT corpus, review_id, sent_id, unnest(string_split(trim(tags), ', ')) AS tag, unnest(range(0, len(string_split(trim(tags), ', ')))) AS place FROM scanned WHERE tags <> ''),
gold AS (SELECT corpus, review_id, sent_id, place, CASE WHEN contains(tag, '[') THEN trim(string_split(tag, '[')[1]) ELSE '' END AS term,
  CASE WHEN contains(tag, '+') THEN 1 WHEN contains(tag, '-') THEN -1 END AS orientation, CASE WHEN contains(tag, '[u]') THEN 'u' WHEN contains(tag, '[p]') THEN 'p' ELSE 'n' END AS type FROM tags)"""


@query("src1_review_scan", f"WITH {SCANNED} SELECT corpus, review_id, sent_id, text FROM scanned")
def src1(t: Tables):
    return reviews.scan(t.lines).select("corpus", "review_id", "sent_id", "text")


@query("src2_parse_tags", f"WITH {GOLD} SELECT corpus, sent_id, place, term FROM gold")
def src2(t: Tables):
    return reviews.gold(reviews.scan(t.lines)).select("corpus", "sent_id", "place", "term")


@query("src3_line_kinds", "SELECT corpus, line_no, line = '' OR starts_with(line, '*') AS is_comment, line LIKE '%[t]%' AS is_title FROM lines")
def src3(t: Tables):
    line = F.col("line")
    return t.lines.select("corpus", "line_no", reviews.is_comment(line).alias("is_comment"), reviews.is_title(line).alias("is_title"))


@query("src4_tag_fields", f"WITH {GOLD} SELECT term, orientation, type, count(*) AS n FROM gold GROUP BY ALL")
def src4(t: Tables):
    return reviews.gold(reviews.scan(t.lines)).groupBy("term", "orientation", "type").agg(F.count("*").alias("n"))


@query("src5_bad_lines", f"""WITH {SCANNED}, parted AS (SELECT corpus, line_no, string_split(line, '##') AS p FROM kinds WHERE kind = 'sentence'),
judged AS (SELECT corpus, line_no, CASE WHEN len(p) < 2 THEN 'no separator' WHEN trim(p[2]) = '' THEN 'no text'
  WHEN p[1] <> '' AND len(list_filter(string_split(trim(p[1]), ','), lambda x: strpos(x, '[') = 0 OR trim(left(x, strpos(x, '[') - 1)) = '')) > 0 THEN 'no term'
  WHEN p[1] <> '' AND len(list_filter(string_split(trim(p[1]), ','), lambda x: NOT contains(x, '+') AND NOT contains(x, '-'))) > 0 THEN 'no orientation' END AS problem FROM parted)
SELECT corpus, line_no, problem FROM judged WHERE problem IS NOT NULL""")
def src5(t: Tables):
    return reviews.problems(t.lines)


@query("src7_opinion_lexicon", """WITH w AS (SELECT DISTINCT lemma FROM toks), pos AS (SELECT lemma FROM w WHERE lemma LIKE '%ble' OR lemma LIKE '%ing'), neg AS (SELECT lemma FROM w WHERE lemma LIKE '%less' OR lemma LIKE 'un%')
SELECT 'opinion' AS name, lemma AS word, CASE WHEN lemma IN (SELECT lemma FROM neg) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS orientation FROM (SELECT * FROM pos UNION SELECT * FROM neg)""")
def src7(t: Tables):
    w = t.toks.select(F.col("lemma").alias("word")).distinct()
    return lexicons.merge_lexicon(w.where("word like '%ble' or word like '%ing'"), w.where("word like '%less' or word like 'un%'"))


@query("src8_manual_lexicon", "SELECT 'seeds' AS name, word, orientation::DOUBLE AS orientation FROM (VALUES ('good', 1.0), ('bad', -1.0)) AS v(word, orientation)")
def src8(t: Tables):
    return lexicons.manual_lexicon(t.spark, {"good": 1.0, "bad": -1.0}, "seeds")


@query("src9_stop_list", "SELECT DISTINCT lower(word) AS word FROM toks WHERE pos IN ('CC', 'DT', 'IN')")
def src9(t: Tables):
    return t.toks.where(F.col("pos").isin("CC", "DT", "IN")).select(F.lower("word").alias("word")).distinct()


@query("src11_stored_pipelines", "SELECT DISTINCT source AS corpus, CASE WHEN lang = 'en' THEN 'rules' ELSE 'rules-other' END AS pipeline FROM documents")
def src11(t: Tables):
    return t.docs.select(F.col("source").alias("corpus"), F.when(F.col("lang") == "en", "rules").otherwise("rules-other").alias("pipeline")).distinct()


@query("src14_idf_cache", """WITH r AS (SELECT lemma AS term, ln(1.0 + idx) AS idf, sent_id * 1000 + idx AS ord FROM toks) SELECT term, round(arg_max(idf, ord), 9) AS idf FROM r GROUP BY term""")
def src14(t: Tables):
    rows = t.toks.select(F.col("lemma").alias("term"), F.log(1.0 + F.col("idx")).alias("idf"), (F.col("sent_id") * 1000 + F.col("idx")).alias("ord"))
    return lexicons.latest_idf(rows).select("term", F.round("idf", 9).alias("idf"))


@query("src20_dependency_text", """WITH words AS (SELECT sent_id, idx, word FROM toks),
text AS (SELECT r.sent_id, r.label || '(' || coalesce(h.word, 'ROOT') || '-' || (head_idx + 1) || ', ' || d.word || '-' || (dep_idx + 1) || ')' AS line FROM rels r LEFT JOIN words h ON h.sent_id = r.sent_id AND h.idx = head_idx JOIN words d ON d.sent_id = r.sent_id AND d.idx = dep_idx)
SELECT sent_id, string_split(line, '(')[1] AS label, regexp_extract(line, '\\((.*)-[0-9]+, ', 1) AS head, regexp_extract(line, '-([0-9]+), ', 1)::INT - 1 AS head_idx,
  regexp_extract(line, ', (.*)-[0-9]+\\)$', 1) AS dep, regexp_extract(line, '-([0-9]+)\\)$', 1)::INT - 1 AS dep_idx FROM text""")
def src20(t: Tables):
    w = t.toks.select("sent_id", "idx", "word")
    h, d = w.toDF("sent_id", "head_idx", "h"), w.toDF("sent_id", "dep_idx", "d")
    df = t.rels.join(h, ["sent_id", "head_idx"], "left").join(d, ["sent_id", "dep_idx"])
    line = F.format_string("%s(%s-%d, %s-%d)", "label", F.coalesce("h", F.lit("ROOT")), F.col("head_idx") + 1, "d", F.col("dep_idx") + 1)
    return readers.dependency_lines(df.select("sent_id", line.alias("line")))


@query("src21_tagger_columns", """WITH grid AS (SELECT sent_id, string_agg(word || chr(9) || pos || chr(9) || iob, chr(10) ORDER BY idx) AS body FROM toks GROUP BY sent_id),
split AS (SELECT sent_id, unnest(string_split(body, chr(10))) AS row, unnest(range(0, len(string_split(body, chr(10))))) AS idx FROM grid)
SELECT sent_id, idx::INT AS idx, string_split(row, chr(9))[1] AS word, string_split(row, chr(9))[2] AS pos, string_split(row, chr(9))[3] AS chk FROM split""")
def src21(t: Tables):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word", "pos", "iob"))), lambda x: F.concat_ws("\t", x.word, x.pos, x.iob))
    return readers.tagger_columns(t.toks.groupBy("sent_id").agg(F.array_join(rows, "\n").alias("body")), ["word", "pos", "chk"])


@query("src19_shell_text", "SELECT sent_id AS reply_id, idx, word, pos, lemma FROM toks")
def src19(t: Tables):
    one = F.format_string("[Text=%s CharacterOffsetBegin=%d CharacterOffsetEnd=%d PartOfSpeech=%s Lemma=%s]", "word", "idx", F.col("idx") + 1, "pos", "lemma")
    said = F.transform(F.array_sort(F.collect_list(F.struct("idx", one.alias("x")))), lambda v: v.x)
    reply = F.concat(F.format_string("Sentence #1 (%d tokens):\ntext\n", F.count("*")), F.array_join(said, " "), F.lit("\n(S (X x))\n\nroot(ROOT-0, x-1)\n"))
    found = readers.shell_text(t.toks.groupBy(F.col("sent_id").alias("reply_id")).agg(reply.alias("reply"))).where("part = 'token'")
    return found.select("reply_id", "idx", F.get("fields", F.lit(0)).alias("word"), F.get("fields", F.lit(3)).alias("pos"), F.get("fields", F.lit(4)).alias("lemma"))


@query("src22_semantic_roles", """WITH v AS (SELECT sent_id, min(idx) AS v, arg_min(lemma, idx) AS verb FROM toks WHERE pos = 'VB' GROUP BY 1)
SELECT sent_id, verb, CASE WHEN idx < v THEN 'A0' ELSE 'A1' END AS role, string_agg(word, ' ' ORDER BY idx) AS words FROM toks JOIN v USING (sent_id) WHERE idx <> v GROUP BY ALL""")
def src22(t: Tables):
    t = t.kept()
    first = t.toks.where("pos = 'VB'").groupBy("sent_id").agg(F.min("idx").alias("v"), F.min_by("lemma", "idx").alias("verb"))
    df = t.toks.join(first, "sent_id").join(t.toks.groupBy("sent_id").agg(F.max("idx").alias("z")), "sent_id")
    begin, end = F.when(F.col("idx") < F.col("v"), 0).otherwise(F.col("v") + 1), F.when(F.col("idx") < F.col("v"), F.col("v") - 1).otherwise(F.col("z"))
    mark = F.when(begin == end, "S").when(F.col("idx") == begin, "B").when(F.col("idx") == end, "E").otherwise("I")
    tag = F.when(F.col("idx") == F.col("v"), "O").otherwise(F.concat_ws("-", mark, F.when(F.col("idx") < F.col("v"), "A0").otherwise("A1")))
    roles = trees.semantic_roles(df.select("sent_id", "verb", "idx", "word", tag.alias("tag")))
    return roles.select("sent_id", "verb", F.explode("roles").alias("role", "words"))


@query("src24_tree_repair", """WITH b AS (SELECT doc_id, '(S ' || text || repeat(')', (doc_id % 4)::INT) AS tree FROM documents), c AS (SELECT *, length(tree) - length(replace(tree, '(', '')) AS l, length(tree) - length(replace(tree, ')', '')) AS r FROM b)
SELECT doc_id, CASE WHEN l > r THEN tree || repeat(')', l - r) WHEN r > l THEN repeat('(', r - l) || tree ELSE tree END AS tree FROM c""")
def src24(t: Tables):
    df = t.docs.select("doc_id", F.concat(F.lit("(S "), F.col("text"), F.expr("repeat(')', int(doc_id % 4))")).alias("tree"))
    return df.select("doc_id", readers.repaired(F.col("tree")).alias("tree"))


@query("src25_chunker_output", """WITH rows AS (SELECT sent_id, idx, CASE WHEN idx % 5 = 4 THEN '# ' || word ELSE '  0  ' || idx || '   ' || pos || ' ' || iob || '  ' || word END AS line FROM toks)
SELECT sent_id, idx, regexp_split_to_array(trim(line), '\\s+')[4] AS iob FROM rows WHERE line NOT LIKE '#%'""")
def src25(t: Tables):
    line = F.when(F.col("idx") % 5 == 4, F.concat(F.lit("# "), "word")).otherwise(F.format_string("  0  %d   %s %s  %s", "idx", "pos", "iob", "word"))
    return readers.chunker_lines(t.toks.select("sent_id", "idx", line.alias("line")))


@query("running_sentences", "SELECT source, doc_id, count(*) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents")
def running_sentences(t: Tables):
    return running.running_total(t.docs.select("source", "doc_id"), "source", "doc_id", F.lit(1), "n")
