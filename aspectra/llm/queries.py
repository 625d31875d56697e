"""The registered queries of this subpackage: each applies an operator to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, langid, linededup, neardup, quality, secrets, urlfilter
from .common import crc_part, shared_dir, table

URL_RULES = [
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
]


def vocabulary() -> tuple[str, str]:
    """(file of ranks, pattern) of the production tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in 10-word windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, len(w) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, least(n, 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM di, sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as it is read back from the tokens of the emitted prefix tree."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    df = chat.read_back(chat.format_tree(own.unionByName(more), vocabulary()))
    loss = F.array_join("loss", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    path, pattern = vocabulary()
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url, by rule or by trees that learn from the urls that rules decide."""
    df = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return df.select("page_id", "host", "path", "rule", "verdict")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every 50th vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build(v), v.where(F.col("vec_id") % 50 == 0), 5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_part(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held))
    df = langid.predict(docs.select("doc_id", "text").withColumn("held_out", held), model)
    return df.select("doc_id", "held_out", "lang_pred", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every text, scanned into a new ledger."""
    import uuid

    rules = secrets.BASE + secrets.MORE
    ledger = secrets.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    kept = ledger.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)
    df = ledger.findings(kept, rules).withColumn("findings", F.coalesce("findings", F.array().cast(secrets.FINDING)))
    base = [r.kind for r in secrets.BASE]

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")

    count = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in base]
    return df.select("doc_id", *counts, F.sha2(joined(F.filter("findings", lambda f: f.kind.isin(base))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = F.coalesce(crc_part(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.train(docs, labels.where(~held))
    df = quality.score(docs.withColumn("held_out", held), model, keep_text=False)
    return df.select("doc_id", "held_out", "score", "predicted")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, link.b FROM reach r JOIN link ON link.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_chat_format, op4_bpe, op5_url_filter, op6_nearest, op7_language, op8_secrets, op9_quality, op10_near_dup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op10_near_dup": OP10_SQL}
