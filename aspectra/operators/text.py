"""Projections, filters and predicates over annotated sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def sentence_order() -> WindowSpec:
    """The tokens of a sentence in their order."""
    return Window.partitionBy("sent_id").orderBy("idx")


#: Label sets, and the tags that count as noun and adjective in rules.
MODS = ["mod", "pnmod"]
OBJS = ["subj", "s", "obj"]
MR = ["obj2", "desc", "mod", "pnmod", "subj", "s", "obj"]
CONJ = ["conj"]
RULE_JJ = ["JJ", "JJR", "JJS"]
RULE_NN = ["NN", "NNS"]


def lower_key(word: Column) -> Column:
    return F.lower(word)


def stem_key(lemma: Column, word: Column) -> Column:
    """The stem, or the lower-cased word where there is none."""
    return F.coalesce(F.nullif(lemma, F.lit("")), F.lower(word))


def is_noun(pos: Column) -> Column:
    return pos.startswith("NN")


def is_verb(pos: Column) -> Column:
    return pos.startswith("VB")


def is_adjective(pos: Column) -> Column:
    return pos.startswith("JJ")


def ordered(value: Column, idx: str = "idx") -> Column:
    """An aggregate: the values of a group in the order of idx."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), value.alias("v")))), lambda x: x.v)


def tags(toks: DataFrame) -> DataFrame:
    """(sent_id, lemmata, pos_tags, tagged): what a sentence's tokens say, in order."""
    return toks.groupBy("sent_id").agg(ordered(F.col("lemma")).alias("lemmata"), ordered(F.col("pos")).alias("pos_tags"), ordered(F.concat_ws("/", "word", "pos")).alias("tagged"))


def chunked(toks: DataFrame) -> DataFrame:
    """toks with chunk_id (from 1) and type: a chunk begins with a B tag or where the type changes; outside tokens make chunks without type."""
    kind = F.when(F.col("iob") != "O", F.substring_index("iob", "-", -1))
    df = toks.withColumn("type", kind).withColumn("_b", F.lag(F.coalesce("type", F.lit(""))).over(sentence_order()))
    fresh = F.col("iob").startswith("B-") | F.col("_b").isNull() | (F.col("_b") != F.coalesce("type", F.lit("")))
    return df.withColumn("chunk_id", F.sum(fresh.cast("int")).over(sentence_order()).cast("int")).drop("_b")


def chunks(toks: DataFrame) -> DataFrame:
    """(sent_id, chunk_id, type, start, stop, string): stop is exclusive."""
    return chunked(toks).groupBy("sent_id", "chunk_id", "type").agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("stop"), F.array_join(ordered(F.col("word")), " ").alias("string"))


def piece(toks: DataFrame, rels: DataFrame | None, start: int, stop: int, mode: str = "reference") -> tuple[DataFrame, DataFrame | None]:
    """The tokens start to stop of each sentence, counted anew from 0, with the edges inside.

    A chunk tag stays if its chunk lies inside; in reference mode a chunk that ends with the piece does not.
    """
    size = chunked(toks).withColumn("_a", F.min("idx").over(Window.partitionBy("sent_id", "chunk_id"))).withColumn("_z", F.max("idx").over(Window.partitionBy("sent_id", "chunk_id")) + 1)
    inside = (F.col("_a") >= start) & ((F.col("_z") < stop) if mode == "reference" else (F.col("_z") <= stop))
    out = size.where((F.col("idx") >= start) & (F.col("idx") < stop)).select("sent_id", (F.col("idx") - start).alias("idx"), "word", F.when(inside, F.col("iob")).otherwise("O").alias("iob"))
    if rels is None:
        return out, None
    both = (F.col("head_idx") >= start) & (F.col("head_idx") < stop) & (F.col("dep_idx") >= start) & (F.col("dep_idx") < stop)
    return out, rels.where(both).select("sent_id", (F.col("head_idx") - start).alias("head_idx"), "label", (F.col("dep_idx") - start).alias("dep_idx"))


def last_word(toks: DataFrame) -> DataFrame:
    return toks.groupBy("sent_id").agg(F.max_by("word", "idx").alias("last"))


def completeness(toks: DataFrame, rels: DataFrame) -> DataFrame:
    """(sent_id, is_tokenized, is_lemmatized, is_tagged, is_chunked, is_dep_parsed)."""
    parsed = rels.groupBy("sent_id").agg(F.lit(True).alias("is_dep_parsed"))
    has = lambda c: F.every(F.col(c).isNotNull() & (F.col(c) != ""))
    df = toks.groupBy("sent_id").agg((F.count("*") > 0).alias("is_tokenized"), has("lemma").alias("is_lemmatized"), has("pos").alias("is_tagged"), has("iob").alias("is_chunked"))
    return df.join(parsed, "sent_id", "left").withColumn("is_dep_parsed", F.coalesce("is_dep_parsed", F.lit(False)))


def phrase_spans(toks: DataFrame, words: list[str | None], key: Column | None = None) -> DataFrame:
    """(sent_id, start, stop) of the first place of a phrase in each sentence that has it; None fits any word.

    stop is exclusive, but equals start for a phrase of one word.
    """
    key = F.lower("word") if key is None else key
    df = toks.withColumn("_k", key)
    hit = F.lit(True)
    for k, w in enumerate(words):
        ahead = F.lead("_k", k).over(sentence_order())
        hit = hit & (ahead.isNotNull() if w is None else F.coalesce(ahead == w, F.lit(False)))
    length = len(words) if len(words) > 1 else 0
    return df.withColumn("_hit", hit).where("_hit").groupBy("sent_id").agg(F.min("idx").alias("start")).select("sent_id", "start", (F.col("start") + length).alias("stop"))


def word_pair(toks: DataFrame, first: str, second: str) -> DataFrame:
    """(sent_id, start, stop) of each place of two lower-cased words in a row; only tokens that are one of them are dealt."""
    some = toks.select("sent_id", "idx", F.lower("word").alias("_w")).where(F.col("_w").isin(first, second))
    df = some.withColumn("_n", F.lead(F.struct("idx", "_w")).over(sentence_order()))
    return df.where((F.col("_w") == first) & (F.col("_n._w") == second) & (F.col("_n.idx") == F.col("idx") + 1)).select("sent_id", F.col("idx").alias("start"), (F.col("idx") + 2).alias("stop"))


def short_label(label: Column) -> Column:
    """A dependency label in the coarser scheme of the rules; the first that fits counts."""
    return (
        F.when(label == "amod", "mod").when(label.contains("prep"), "pnmod").when(label.contains("nsubj") | label.contains("csubj"), "subj")
        .when(label == "xsubj", "obj").when(label == "dobj", "obj2").when(label == "iobj", "desc").when(label.contains("conj"), "conj").otherwise(label)
    )


def same_label(a: Column, b: Column) -> Column:
    """Whether two coarse labels count as one: mod is pnmod, s is subj, and subj is obj; s is not obj."""
    pair = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (a == b) | pair("mod", "pnmod") | pair("s", "subj") | pair("subj", "obj")


def without_stopwords(toks: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Words of two letters or more that are no stop words; the list is joined, and broadcast only if Spark finds it small."""
    return toks.where(F.length("word") > 1).join(stopwords.select(F.lower("word").alias("_w")).distinct(), F.lower("word") == F.col("_w"), "left_anti")


def polarity(lexicon: DataFrame, sign: int, mode: str = "reference") -> DataFrame:
    """The words of one orientation. In reference mode values are compared as objects with numbers: no word."""
    return lexicon.where(F.lit(False)) if mode == "reference" else lexicon.where(F.col("orientation") == sign)


def clean_terms(terms: DataFrame, least: int, mode: str = "intended") -> DataFrame:
    """Terms with a support over least. In reference mode, of terms in a row (by `ord`) that fail, every second one stays, as the list shrinks under its reader."""
    if mode == "intended":
        return terms.where(F.col("support") > least)
    fails = (F.col("support") <= least).cast("int")
    df = terms.withColumn("_f", fails)
    w = Window.partitionBy("kind").orderBy("ord")
    island = F.sum(1 - F.col("_f")).over(w)
    df = df.withColumn("_g", island)
    place = F.row_number().over(Window.partitionBy("kind", "_g", "_f").orderBy("ord"))
    return df.withColumn("_n", place).where("_f = 0 or _n % 2 = 0").drop("_f", "_g", "_n")
