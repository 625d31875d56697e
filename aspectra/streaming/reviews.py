"""The bridge over streams: documents as they come become tokens; counts of terms go by windows of arrival time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.sources import bridge

SCHEMA = "doc_id long, text string, source string, ts timestamp"


def documents(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files of documents that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)


def tokens(docs: DataFrame) -> DataFrame:
    """The tokens of a stream of documents: rows depend on their document alone, so no state is kept."""
    return bridge.tokens(bridge.sentences(docs))


def noun_counts(docs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, lemma, n) of nouns by window of ts; state goes once the watermark has passed it."""
    words = F.explode(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.struct(bridge.lemma(w).alias("lemma"), bridge.pos_tag(w).alias("pos"))))
    nouns = docs.withWatermark("ts", late).select("ts", words.alias("w")).where(F.col("w.pos").startswith("NN"))
    return nouns.groupBy(F.window("ts", window).alias("window"), F.col("w.lemma").alias("lemma")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "lemma", "n")
