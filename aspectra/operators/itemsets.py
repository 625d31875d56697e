"""The frequent-itemset model: transactions, itemsets, support, pruning, infrequent terms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aspectra.functions import strings
from aspectra.functions.components import components
from aspectra.functions.lineage import saved
from aspectra.functions.workers import ship_package
from aspectra.operators import joins, windows
from aspectra.operators.text import is_noun, without_stopwords


def transactions(toks: DataFrame, stopwords: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(sent_id, item): the different lemmas of nouns and of words in noun phrases, without stop words and single letters.

    least: lemmas with fewer such words than that, which can't be in as many sentences, are left out; none of their words is dealt.
    """
    df = toks.where(is_noun(F.col("pos")) | ((F.col("iob") != "O") & (F.substring_index("iob", "-", -1) == "NP")))
    df = without_stopwords(df, stopwords) if stopwords is not None else df.where(F.length("word") > 1)
    df = df.select("sent_id", F.col("lemma").alias("item"))
    if least > 1:
        df = joins.cut_to(df, df.groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") >= least))
    # dealt by sentences, so that neither this nor what gathers sentences deals them again
    return df.select("sent_id", "item").repartition("sent_id").distinct()


def least_count(n: int, support: float) -> int:
    """Support as a number of transactions: a percentage of n, or, below 0, the number itself."""
    import math

    return int(-support) if support < 0 else max(1, math.ceil(support / 100 * n - 1e-9))


def frequent(items: DataFrame, n: int, support: float, most: int = 2) -> DataFrame:
    """(set_id, items, support): itemsets of up to `most` items, level by level.

    Transactions are cut down to frequent items first and put together by sentences, which are dealt once for that; each level adds one later item of the
    same transaction to the frequent sets of the last, so that no transaction is expanded into all its subsets.
    """
    least = least_count(n, support)
    often = saved(items.where("item is not null").groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= least), "often")
    held = items.join(often.select("item"), "item", "left_semi").groupBy("sent_id").agg(F.array_sort(F.collect_list("item")).alias("held"))
    out = often.select(F.array("item").alias("items"), "support")
    if most > 1:
        held = saved(held, "held")
        base = held.select("sent_id", F.explode(F.transform("held", lambda x: F.array(x))).alias("items"), "held")
    for k in range(2, most + 1):
        later = F.filter("held", lambda x: x > F.element_at("items", -1))
        level = base.select("sent_id", "items", F.explode(later).alias("item")).select("sent_id", F.concat("items", F.array("item")).alias("items"))
        found = saved(level.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= least), "level")
        out = out.unionByName(found)
        if k < most:
            base = level.join(found.select("items"), "items", "left_semi").join(held, "sent_id")
    return out.select(F.array_join("items", "+").alias("set_id"), "items", "support")


def occurrences(sets: DataFrame, toks: DataFrame) -> DataFrame:
    """(set_id, sent_id, items): the sentences whose lemmas hold all items of a set."""
    part = sets.select("set_id", F.explode("items").alias("item"))
    lemmas = joins.cut_to(toks.select("sent_id", F.col("lemma").alias("item")), part).repartition("sent_id").distinct()
    hit = joins.contained_sets(part, lemmas)
    return hit.join(sets.select("set_id", "items"), "set_id")


def pure_support(sets: DataFrame, occ: DataFrame) -> DataFrame:
    """(set_id, psupport): sentences of a set without those of its strict supersets."""
    above = joins.supersets(sets.select("set_id", F.explode("items").alias("item")))
    taken = above.join(occ.select(F.col("set_id").alias("other"), "sent_id"), "other").select("set_id", "sent_id").distinct()
    own = occ.select("set_id", "sent_id").join(taken, ["set_id", "sent_id"], "left_anti").groupBy("set_id").agg(F.count("*").alias("psupport"))
    return sets.select("set_id").join(own, "set_id", "left").select("set_id", F.coalesce("psupport", F.lit(0).cast("long")).alias("psupport"))


def compact_counts(occ: DataFrame, places: DataFrame) -> DataFrame:
    """(set_id, compact): in how many sentences a set is compact; sets of one item always are."""
    flag = occ.join(places.select("set_id", "sent_id").distinct().withColumn("_c", F.lit(1)), ["set_id", "sent_id"], "left")
    return flag.groupBy("set_id").agg(F.count_if((F.size("items") == 1) | F.col("_c").isNotNull()).alias("compact"))


def flags(sets: DataFrame, occ: DataFrame, places: DataFrame) -> DataFrame:
    """(set_id, is_compound, is_fuzzy, is_compact): several items; several spellings (`variants`, if sets have that column); compact in some sentence."""
    fuzzy = F.size("variants") > 1 if "variants" in sets.columns else F.lit(False)
    df = sets.join(compact_counts(occ, places), "set_id", "left")
    return df.select("set_id", (F.size("items") > 1).alias("is_compound"), fuzzy.alias("is_fuzzy"), (F.coalesce("compact", F.lit(0)) > 0).alias("is_compact"))


def _drop(sets: DataFrame, bad: DataFrame, mode: str) -> DataFrame:
    """sets without the bad ones. In reference mode, of bad sets in a row (by set_id) every second one stays, as the list shrinks under its reader."""
    if mode == "intended":
        return sets.join(bad, "set_id", "left_anti")
    df = sets.join(bad.select("set_id", F.lit(1).alias("_f")), "set_id", "left").withColumn("_f", F.coalesce("_f", F.lit(0)))
    g = F.sum(1 - F.col("_f")).over(Window.orderBy("set_id"))  # the model's few sets, in one order
    df = df.withColumn("_g", g).withColumn("_n", F.row_number().over(Window.partitionBy("_g", "_f").orderBy("set_id")))
    return df.where("_f = 0 or _n % 2 = 0").drop("_f", "_g", "_n")


def compactness_pruning(sets: DataFrame, occ: DataFrame, places: DataFrame, least: int, mode: str = "reference") -> DataFrame:
    bad = compact_counts(occ, places).where(F.col("compact") < least).select("set_id")
    missing = sets.join(occ.select("set_id").distinct(), "set_id", "left_anti").select("set_id") if least > 0 else sets.limit(0).select("set_id")
    return _drop(sets, bad.unionByName(missing), mode)


def redundancy_pruning(sets: DataFrame, occ: DataFrame, least: int, mode: str = "reference") -> DataFrame:
    """Drops sets with a superset whose pure support is least or lower (reference), or lower than least (intended)."""
    above = joins.supersets(sets.select("set_id", F.explode("items").alias("item"))).select("set_id").distinct()
    low = pure_support(sets, occ).where(F.col("psupport") <= least if mode == "reference" else F.col("psupport") < least)
    return _drop(sets, low.join(above, "set_id", "left_semi").select("set_id"), mode)


def near_adjectives(occ: DataFrame, places: DataFrame, toks: DataFrame, window: int, mode: str = "reference") -> DataFrame:
    """(word): the lemmas of adjectives near compact places."""
    spans = places.join(occ.select("set_id", "sent_id"), ["set_id", "sent_id"]).select("sent_id", F.array_min("idxs").alias("first"), F.array_max("idxs").alias("last"))
    return windows.adjectives_near(toks, spans, window, mode).select(F.col("lemma").alias("word")).distinct()


def infrequent(toks: DataFrame, occ: DataFrame, adjectives: DataFrame, stopwords: DataFrame, mode: str = "reference") -> DataFrame:
    """(set_id): nouns nearest to a known adjective, in sentences without any frequent set; words match exactly. Reference mode never finds any."""
    if mode == "reference":
        return occ.select("set_id").limit(0)
    known = saved(adjectives.select(F.col("word").alias("lemma"), F.lit(True).alias("_known")).distinct(), "adjectives")
    rows = toks.select("sent_id", "idx", "lemma", "word", is_noun(F.col("pos")).alias("_noun")).join(known, "lemma", "left").where("_noun or _known")
    left = rows.join(occ.select("sent_id").distinct(), "sent_id", "left_anti")
    # of each known word the last noun up to it and the first one from it on
    noun = F.when(F.col("_noun"), F.struct("idx", "lemma", "word"))
    near = joins.last_and_next(left, noun).where("_known").select("sent_id", F.col("idx").alias("pos"), F.explode(F.array_compact(F.array("_last", "_next"))).alias("c"))
    best = near.groupBy("sent_id").agg(F.min_by(F.struct("c.lemma", "c.word"), F.struct(F.abs(F.col("c.idx") - F.col("pos")), "pos", "c.idx")).alias("b"))
    df = best.select(F.lower("b.word").alias("_w"), F.lower("b.lemma").alias("set_id"))
    df = df.join(stopwords.select(F.lower("word").alias("_w")).distinct(), "_w", "left_anti").select("set_id").distinct()
    return df.join(occ.select("set_id").distinct(), "set_id", "left_anti")


def surfaces(occ: DataFrame, places: DataFrame, toks: DataFrame) -> DataFrame:
    """(set_id, term): the different surface forms of sets at their compact places, where the sets' items are; no other word is dealt."""
    at = places.join(occ.select("set_id", "sent_id"), ["set_id", "sent_id"])
    said = joins.cut_to(toks.select("sent_id", "idx", "word", F.col("lemma").alias("item")), occ.select(F.explode("items").alias("item")))
    words = at.select("set_id", "sent_id", "idxs", F.explode("idxs").alias("idx")).join(said.select("sent_id", "idx", "word"), ["sent_id", "idx"])
    joined = words.groupBy("set_id", "sent_id", "idxs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x.word), " ").alias("term"))
    return joined.select("set_id", "term").distinct()


def _linked(words: list[str], near: dict[tuple[str, str], float], least: float) -> list[list[str]]:
    """Complete linkage of words: the two groups whose least similar pair is most similar are put together, as long as that pair reaches `least`."""
    groups = [[w] for w in sorted(words)]
    while True:
        best = None
        for i, x in enumerate(groups):
            for j in range(i + 1, len(groups)):
                worst = min(near.get((min(a, b), max(a, b)), 0.0) for a in x for b in groups[j])
                if worst >= least and (best is None or worst > best[0]):
                    best = (worst, i, j)
        if best is None:
            return groups
        groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))


def clusters(words: DataFrame, match: float, mode: str = "reference") -> DataFrame:
    """(word, cluster): words that are similar under complete linkage.

    reference: every word for itself, as distances are taken on another scale than the cut. intended: clusters
    of words whose pairs are all at a ratio of match / 100 or more; the first word names its cluster. Words of different connected
    components of the similar pairs never share a cluster, so each component is clustered by itself, on an executor.
    """
    if mode == "reference":
        return words.select("word", F.col("word").alias("cluster")).distinct()
    ship_package(words.sparkSession)
    w, least = words.select("word").distinct(), match / 100
    pairs = saved(joins.fuzzy_pairs(w, least), "similar")
    part = saved(components(pairs.select("a", "b")), "components")
    alone = w.join(part, F.col("word") == F.col("id"), "left_anti").select("word", F.col("word").alias("cluster"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near = {(a, b): r for a, b, r in zip(rows["a"], rows["b"], rows["ratio"], strict=True)}
        found = _linked(sorted({*rows["a"], *rows["b"]}), near, least)
        return pd.DataFrame([(x, g[0]) for g in found for x in g], columns=["word", "cluster"])

    return alone.unionByName(pairs.join(part, pairs["a"] == part["id"]).groupBy("component").applyInPandas(run, "word string, cluster string"))


def extract(toks: DataFrame, stopwords: DataFrame, support: float = 1.0, most: int = 2, psupport: int = 3, compact: int = 2, distance: int = 3, window: int = 5, mode: str = "reference") -> DataFrame:
    """(set_id, term): the model's terms with their surface forms, from transactions to pruning and infrequent terms."""
    n = toks.select("sent_id").distinct().count()
    items = saved(transactions(toks, stopwords, least_count(n, support)), "transactions")
    sets = saved(frequent(items, n, support, most), "itemsets")
    occ = saved(occurrences(sets, toks), "occurrences")
    places = saved(windows.compact_positions(occ, toks, distance), "places")
    sets = saved(compactness_pruning(sets, occ, places, compact, mode), "compact")
    occ = occ.join(sets.select("set_id"), "set_id", "left_semi").join(places.select("set_id", "sent_id").distinct(), ["set_id", "sent_id"], "left_semi")
    sets = redundancy_pruning(sets, occ, psupport, mode)
    occ = saved(occ.join(sets.select("set_id"), "set_id", "left_semi"), "kept")
    found = surfaces(occ, places, toks)
    more = infrequent(toks, occ, near_adjectives(occ, places, toks, window, mode), stopwords, mode)
    return found.unionByName(more.select("set_id", F.col("set_id").alias("term")))
