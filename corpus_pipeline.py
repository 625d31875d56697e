"""A corpus pipeline of five stages: language, lines, near-duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from aspectra.llm import bpe, decontaminate, langid, linededup, neardup
from aspectra.llm.common import crc_part, dropped, saved, table
from aspectra.llm.queries import vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts whose language is less certain than this are rejected, as are those without any letter.
LEAST_CERTAINTY = 0.3
REST = "__aspectra_rest"
#: (words of a shingle, similarity in percent): a pair that reaches one of them is a near copy.
NEAR = [neardup.Measure(5, 80), neardup.Measure(3, 85)]


def _sealed(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that a stage uses, and the others in one, so that none clashes with what the stage adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*others) if others else F.lit(None)).alias(REST))


def _opened(df: DataFrame, docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """The columns of docs again, in their order."""
    return df.select(*(F.col(c) if c in used else F.col(f"{REST}.`{c}`").alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told."""
    used = ("doc_id", "text", "lang")
    model = langid.train(docs.select(*used).where(F.coalesce(crc_part(F.col("doc_id"), 4) != 2, F.lit(False))))
    found = langid.predict(_sealed(docs, *used), model)
    return _opened(found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_CERTAINTY)), docs, used)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of texts; drops documents of which nothing is left."""
    used = ("doc_id", "text", "n_chars")
    found = linededup.drop_lines(_sealed(docs, *used), short=True)
    kept = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return _opened(kept, docs, used)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that with the smallest doc_id. Rows without doc_id stay.

    Documents are linked if they are near by either measure of NEAR: an added passage may reach only the lower bound of the longer
    shingles, words changed here and there only that of the shorter ones.
    """
    found = neardup.classes_by_any(docs.select("doc_id", "text"), NEAR).where("not kept and doc_id is not null")
    # rows of one doc_id may be in several classes: it goes as a whole, as one document
    gone = saved(found.select("doc_id").distinct(), "near")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontaminate.decontaminate(_sealed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return _opened(found.where("n_hit = 0"), docs, ("text",))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, and decodes the ids again."""
    path, pattern = vocabulary()
    return bpe.digests(docs, path, pattern)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", tokens),
]

#: Language ID, templates and tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
        dropped(before)
        before = docs
    return docs
