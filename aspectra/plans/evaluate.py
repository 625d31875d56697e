"""Scores of extracted terms against gold terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion_sets(gold: DataFrame, model: DataFrame) -> DataFrame:
    """(kind, corpus, term): tp, fp and fn of two sets of (corpus, term)."""
    g, m = gold.select("corpus", "term").distinct(), model.select("corpus", "term").distinct()
    on = ["corpus", "term"]
    tag = lambda df, k: df.select(F.lit(k).alias("kind"), "corpus", "term")
    return tag(g.join(m, on, "left_semi"), "tp").unionByName(tag(m.join(g, on, "left_anti"), "fp")).unionByName(tag(g.join(m, on, "left_anti"), "fn"))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def measures(counts: DataFrame) -> DataFrame:
    """counts (tp, fp, fn and perhaps tn) with precision, recall, f and accuracy; 0 where a divisor is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    tn = F.col("tn") if "tn" in counts.columns else F.lit(0)
    df = counts.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    df = df.withColumn("f", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return df.withColumn("accuracy", share(tp + tn, tp + fp + fn + tn))


def scores(gold: DataFrame, model: DataFrame) -> DataFrame:
    """(corpus, tp, fp, fn, precision, recall, f, accuracy)."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return measures(confusion_sets(gold, model).groupBy("corpus").agg(n("tp"), n("fp"), n("fn")))


def scores_at(gold: DataFrame, ranked: DataFrame, step: int = 10) -> DataFrame:
    """(n, tp, fp, fn, precision, recall, f, accuracy) of the first n ranked (term, rank), for n = step, 2 step, ... below their number.

    Hits are counted once for each stretch of ranks and then summed up, so that no prefix is expanded.
    """
    g = gold.select("term").distinct()
    hit = ranked.join(g.withColumn("_h", F.lit(1)), "term", "left").withColumn("n", (F.ceil(F.col("rank") / step) * step).cast("long"))
    part = hit.groupBy("n").agg(F.coalesce(F.sum("_h"), F.lit(0)).alias("h"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one row for each stretch
    total = ranked.agg(F.count("*").alias("_all")).crossJoin(g.agg(F.count("*").alias("_gold")))
    df = part.withColumn("tp", F.sum("h").over(w)).crossJoin(F.broadcast(total)).where("n < _all")  # one row
    return measures(df.select("n", "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("_gold") - F.col("tp")).alias("fn")))
