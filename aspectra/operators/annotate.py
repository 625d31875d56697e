"""Steps that put annotations onto tokens, and the protocol of annotators."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Annotator(Protocol):
    """Anything that turns a table of sentences or tokens into one with more columns; native, or a mapInPandas around an external tool."""

    name: str

    def transform(self, df: DataFrame) -> DataFrame: ...


def annotate(df: DataFrame, steps: list[Annotator]) -> DataFrame:
    """The steps one after the other; `pipeline` holds their names."""
    for s in steps:
        df = s.transform(df)
    return df.withColumn("pipeline", F.lit("-".join(s.name for s in steps)))


def zero_based(edges: DataFrame) -> DataFrame:
    """Edges counted from 1 (the root is 0), with indexes from 0 (the root is -1)."""
    return edges.withColumn("head_idx", F.col("head") - 1).withColumn("dep_idx", F.col("dep") - 1)


def fill_lemmas(toks: DataFrame, stem: Column) -> DataFrame:
    """Lemmas that are there stay; others become the stem."""
    return toks.withColumn("lemma", F.coalesce("lemma", stem))


def merge_tags(toks: DataFrame, given: DataFrame, column: str) -> DataFrame:
    """toks with the given (sent_id, idx, column) where they have none, in sentences for which as many tags are given as there are tokens."""
    sizes = toks.groupBy("sent_id").agg(F.count("*").alias("_n"))
    whole = given.groupBy("sent_id").agg(F.count("*").alias("_m")).join(sizes, "sent_id").where("_n = _m").select("sent_id")
    new = given.join(whole, "sent_id").select("sent_id", "idx", F.col(column).alias("_new"))
    return toks.join(new, ["sent_id", "idx"], "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def attach_edges(toks: DataFrame, rels: DataFrame) -> DataFrame:
    """(sent_id, rel_id, head, label, dep): edges with their words; the head of the root's edge is ROOT."""
    w = toks.select("sent_id", "idx", "word")
    df = rels.join(w.toDF("sent_id", "head_idx", "head"), ["sent_id", "head_idx"], "left").join(w.toDF("sent_id", "dep_idx", "dep"), ["sent_id", "dep_idx"])
    return df.select("sent_id", "rel_id", F.coalesce("head", F.lit("ROOT")).alias("head"), "label", "dep")
