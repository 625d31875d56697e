"""The three models on a corpus, with their scores against gold terms: what the grid runner calls."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.operators import graph, itemsets, propagate
from aspectra.plans import evaluate


class Corpus:
    """What the models read of one corpus: tokens, edges, gold terms (term) and, where a model needs them, stop words (word), seeds (term, orientation), idf (term, idf) and clauses."""

    def __init__(self, toks: DataFrame, rels: DataFrame, gold: DataFrame, stopwords: DataFrame | None = None, seeds: DataFrame | None = None, idf: DataFrame | None = None, segments: DataFrame | None = None) -> None:
        self.toks, self.rels, self.gold = toks, rels, gold
        self.stopwords, self.seeds, self.idf, self.segments = stopwords, seeds, idf, segments


def frequent(c: Corpus, params: dict[str, Any]) -> DataFrame:
    """(precision, recall, f) of the frequent-itemset model's surface forms."""
    return _scored(c, itemsets.extract(c.toks, c.stopwords, **params).select(F.lower("term").alias("term")))


def propagation(c: Corpus, params: dict[str, Any]) -> DataFrame:
    """(precision, recall, f) of the propagation model's aspects."""
    return _scored(c, propagate.extract(c.toks, c.rels, c.seeds, c.segments, **params)[0].select(F.col("aspect").alias("term")))


def targets(c: Corpus, params: dict[str, Any]) -> DataFrame:
    """(n, precision, recall, f) of the graph model's first n targets, for n = 10, 20, ..."""
    found = graph.extract(c.toks, c.idf, **params)
    return evaluate.scores_at(c.gold.select("term"), found.select("term", "rank")).select("n", "precision", "recall", "f")


def _scored(c: Corpus, terms: DataFrame) -> DataFrame:
    one = lambda df: df.select(F.lit("").alias("corpus"), "term").distinct()
    return evaluate.scores(one(c.gold), one(terms)).select("precision", "recall", "f")


MODELS: dict[str, Callable[[Corpus, dict[str, Any]], DataFrame]] = {"frequent": frequent, "propagation": propagation, "graph": targets}


def runner(model: str, corpora: dict[str, Corpus]) -> Callable[[dict[str, Any], str], DataFrame]:
    """What grid.run takes as its model: parameters and the name of a corpus give rows of scores."""
    return lambda params, name: MODELS[model](corpora[name], params)
