"""Opinion lexicons, stop lists, term tables and the store of annotated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_lexicon(positive: DataFrame, negative: DataFrame, name: str = "opinion") -> DataFrame:
    """(name, word, orientation): +1 and -1; a word in both lists is negative, as the later list overrides."""
    both = positive.select("word", F.lit(1.0).alias("orientation")).unionByName(negative.select("word", F.lit(-1.0).alias("orientation")))
    return both.groupBy("word").agg(F.min("orientation").alias("orientation")).select(F.lit(name).alias("name"), "word", "orientation")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, trimmed; blank lines and repeated words go."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def manual_lexicon(spark: SparkSession, words: dict[str, float], name: str = "manual") -> DataFrame:
    return spark.createDataFrame([(name, w, float(v)) for w, v in words.items()], "name string, word string, orientation double")


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    """(term, idf) of lines `term, tab, value`."""
    return latest_idf(spark.read.option("sep", "\t").schema("term string, idf double").csv(path).withColumn("ord", F.monotonically_increasing_id()))


def latest_idf(rows: DataFrame) -> DataFrame:
    """(term, idf): of repeated terms the row with the highest `ord` counts, as a later line overrides."""
    return rows.groupBy("term").agg(F.max_by("idf", "ord").alias("idf"))


def append_idf(known: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose term is not known yet: what an append must write."""
    return new.join(known, "term", "left_anti")


def freeze(df: DataFrame, path: str) -> None:
    """Stores an annotated table by corpus and pipeline."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus", "pipeline").parquet(path)


def frozen_pipelines(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, pipeline) in store, from the names of the partitions."""
    return spark.read.parquet(path).select("corpus", "pipeline").distinct()


def unfreeze(spark: SparkSession, path: str, corpus: str, pipeline: str) -> DataFrame:
    """One stored table; other partitions are not read."""
    return spark.read.parquet(path).where((F.col("corpus") == corpus) & (F.col("pipeline") == pipeline))
