"""The registry of queries: a Spark function for each operator, and SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from aspectra.functions.lineage import saved
from aspectra.sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table of fewer partitions than there are cores, as one small file gives, is dealt anew; any larger one is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


class Tables:
    """The tables of a data folder and what the bridge makes of them; each is made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def kept(self) -> Tables:
        """The same with tokens written: for plans that read them many times, which would split and tag all texts anew for each."""
        self.toks = saved(self.toks, "toks")
        return self

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.read("documents"))

    @cached_property
    def sents(self) -> DataFrame:
        return bridge.sentences(self.docs)

    @cached_property
    def toks(self) -> DataFrame:
        return bridge.tokens(self.sents)

    @cached_property
    def rels(self) -> DataFrame:
        return bridge.rels(self.toks)

    @cached_property
    def edges(self) -> DataFrame:
        """rels with the words at both ends."""
        return bridge.edges(self.sents)

    @cached_property
    def lines(self) -> DataFrame:
        return bridge.review_lines(self.docs)


def query(name: str, sql: str | None = None):
    """Registers a function of Tables under a name, with the SQL of the same result."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_bridge(sql)
        return fn

    return add


#: The bridge's tables in SQL, each with what it needs.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "sents": ((), """
split_docs AS (SELECT source AS corpus, doc_id AS review_id, string_split_regex(text, '[.!?\\n]+') AS a FROM documents),
sents AS (SELECT corpus, review_id, review_id * 16777216 + n AS sent_id, trim(t) AS text
  FROM (SELECT corpus, review_id, unnest(a) AS t, unnest(range(0, len(a))) AS n FROM split_docs) WHERE regexp_matches(t, '[A-Za-z]'))"""),
    "toks": (("sents",), """
found AS (SELECT corpus, review_id, sent_id, regexp_extract_all(text, '[A-Za-z]+') AS ws FROM sents),
tagged AS (SELECT corpus, review_id, sent_id, idx, word, lower(word) AS low FROM (SELECT corpus, review_id, sent_id, unnest(ws) AS word, unnest(range(0, len(ws)))::INT AS idx FROM found)),
posed AS (SELECT *, CASE WHEN low IN ('and', 'or', 'but') THEN 'CC' WHEN low IN ('the', 'a', 'an', 'this', 'that') THEN 'DT'
   WHEN low IN ('of', 'in', 'to', 'for', 'on', 'with', 'at', 'by', 'from') THEN 'IN' WHEN low IN ('is', 'was', 'are', 'be', 'had') THEN 'VBZ'
   WHEN low LIKE '%ly' THEN 'RB' WHEN low LIKE '%ble' OR low LIKE '%less' OR low LIKE '%al' THEN 'JJ' WHEN low LIKE '%ing' OR low LIKE '%ed' THEN 'VB'
   WHEN length(low) >= 5 AND low LIKE '%s' THEN 'NNS' WHEN length(low) >= 5 THEN 'NN' ELSE 'XX' END AS pos FROM tagged),
typed AS (SELECT *, CASE WHEN pos IN ('DT', 'JJ', 'NN', 'NNS') THEN 'NP' WHEN pos LIKE 'VB%' THEN 'VP' END AS type FROM posed),
toks AS (SELECT corpus, review_id, sent_id, idx, word, CASE WHEN length(low) > 3 AND low LIKE '%s' AND low NOT LIKE '%ss' THEN left(low, -1) ELSE low END AS lemma, pos,
   CASE WHEN type IS NULL THEN 'O' WHEN lag(type) OVER (PARTITION BY sent_id ORDER BY idx) = type THEN 'I-' || type ELSE 'B-' || type END AS iob FROM typed)"""),
    "rels": (("toks",), """
ahead AS (SELECT sent_id, idx, pos, lead(pos, 1) OVER s AS p1, lead(pos, 2) OVER s AS p2, count(*) FILTER (pos LIKE 'VB%') OVER (s ROWS UNBOUNDED PRECEDING) AS verbs FROM toks WINDOW s AS (PARTITION BY sent_id ORDER BY idx)),
edges AS (SELECT sent_id, idx + 1 AS head_idx, 'amod' AS label, idx AS dep_idx FROM ahead WHERE pos = 'JJ' AND p1 LIKE 'NN%'
  UNION ALL SELECT sent_id, idx, 'conj_and', idx + 2 FROM ahead WHERE p1 = 'CC' AND ((pos LIKE 'NN%' AND p2 LIKE 'NN%') OR (pos = 'JJ' AND p2 = 'JJ'))
  UNION ALL SELECT sent_id, idx + 1, 'nsubj', idx FROM ahead WHERE pos LIKE 'NN%' AND p1 LIKE 'VB%'
  UNION ALL SELECT sent_id, idx, 'dobj', idx + 1 FROM ahead WHERE pos LIKE 'VB%' AND p1 LIKE 'NN%'
  UNION ALL SELECT sent_id, idx, 'dobj', idx + 2 FROM ahead WHERE pos LIKE 'VB%' AND p1 = 'DT' AND p2 LIKE 'NN%'
  UNION ALL SELECT sent_id, -1, 'root', idx FROM ahead WHERE pos LIKE 'VB%' AND verbs = 1),
rels AS (SELECT sent_id, head_idx, label, dep_idx, row_number() OVER (PARTITION BY sent_id ORDER BY dep_idx, head_idx, label) AS rel_id FROM edges)"""),
    "lines": ((), """
bodies AS (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents),
body AS (SELECT doc_id, source, unnest(a) AS t, unnest(range(0, len(a))) AS n FROM bodies),
worded AS (SELECT *, regexp_extract(t, '[A-Za-z]{5,}', 0) AS w FROM body),
lines AS (SELECT source AS corpus, doc_id * 16777216 AS line_no, '[t]review ' || doc_id AS line FROM documents
  UNION ALL SELECT source, doc_id * 16777216 + 1 + n, CASE WHEN n % 7 = 6 THEN '*' || t WHEN trim(t) = '' THEN '' WHEN w = '' THEN '##' || t
    WHEN n % 3 = 0 THEN lower(w) || '[+2]##' || t WHEN n % 3 = 1 THEN lower(w) || '[-1][p], ' || lower(left(w, 4)) || '[+1][u]##' || t ELSE lower(w) || '[u]##' || t END FROM worded)"""),
}


def with_bridge(sql: str) -> str:
    """The SQL after definitions of those bridge tables that it names."""
    import re

    need: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        if name not in need:
            need.append(name)

    for name in PARTS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    parts = [PARTS[n][1] for n in need]
    sql = sql.strip()
    own = re.match(r"WITH( RECURSIVE)?\s+(.*)", sql, re.S)
    if own and (parts or own[1]):
        return f"WITH{own[1] or ''} " + ",".join([*parts, "\n" + own[2]])
    return f"WITH {','.join(parts)}\n{sql}" if parts else sql
