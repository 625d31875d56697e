"""Joins of tokens, edges, terms and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aspectra.functions import strings
from aspectra.functions.lineage import saved
from aspectra.operators.text import RULE_JJ, chunks, is_noun


def heads(toks: DataFrame, rels: DataFrame) -> DataFrame:
    """(sent_id, idx, head_idx, label): the first edge that leads to each token; nulls without one."""
    first = rels.groupBy("sent_id", F.col("dep_idx").alias("idx")).agg(F.min_by(F.struct("head_idx", "label"), "rel_id").alias("e"))
    return toks.select("sent_id", "idx").join(first, ["sent_id", "idx"], "left").select("sent_id", "idx", "e.head_idx", "e.label")


def dependents(rels: DataFrame) -> DataFrame:
    """(sent_id, idx, dep_idx, label): the tokens below each token."""
    return rels.select("sent_id", F.col("head_idx").alias("idx"), "dep_idx", "label")


def siblings(rels: DataFrame) -> DataFrame:
    """(sent_id, head_idx, a, a_label, b, b_label): pairs of tokens below one head; the root counts as a head."""
    x = rels.select("sent_id", "head_idx", F.col("dep_idx").alias("a"), F.col("label").alias("a_label"))
    y = rels.select("sent_id", "head_idx", F.col("dep_idx").alias("b"), F.col("label").alias("b_label"))
    return x.join(y, ["sent_id", "head_idx"]).where("a <> b")


def exact_terms(toks: DataFrame, terms: DataFrame) -> DataFrame:
    """Tokens whose lemma is a term."""
    return toks.join(terms.select(F.col("term").alias("lemma")).distinct(), "lemma", "left_semi")


#: Letters from rare to common; others come before them.
_RARITY = "qxzjkvbpygfwmucldrhsnioate"


def _prefix(word: Column, least: float) -> Column:
    """The rarest of a word's letters, counted (the second e is another one), of which any word at a ratio of `least` or more has one, too.

    Such a word has at least k = length * least / (2 - least) of them in common with this one, in whatever order: one of the first length - k + 1 of
    either word, in one order for all, is among them.
    """
    letters = F.split(word, "")
    counted = F.transform(letters, lambda c, i: F.struct(F.instr(F.lit(_RARITY), c).alias("r"), F.concat(c, F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).cast("string")).alias("x")))
    size = F.length(word) - F.ceil(F.length(word) * least / (2 - least) - 1e-9) + 1
    return F.transform(F.slice(F.array_sort(counted), 1, F.greatest(size, F.lit(1)).cast("int")), lambda v: v.x)


def _alike(words: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio) of words (a) and others (b, with any more columns) at a ratio of `least` or more: they meet at a length that can reach it and a rare letter."""
    low, high = F.ceil(F.length("a") * least / (2 - least) - 1e-9), F.floor(F.length("a") * (2 - least) / least + 1e-9)
    x = words.select("a").distinct().where(F.length("a") > 0).select("a", F.explode(_prefix(F.col("a"), least)).alias("x"))
    x = x.withColumn("n", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    y = others.select("b").distinct().where(F.length("b") > 0).select("b", F.length("b").cast("long").alias("n"), F.explode(_prefix(F.col("b"), least)).alias("x"))
    return x.join(y, ["n", "x"]).select("a", "b").distinct().withColumn("ratio", strings.ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)


def fuzzy_terms(words: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """(word, term, ratio): for each word the most similar of terms (term, ord) at a ratio of `least` or more; the first of equals."""
    scored = _alike(words.select(F.col("word").alias("a")), terms.select(F.col("term").alias("b")), least).join(terms.select(F.col("term").alias("b"), "ord"), "b")
    return scored.groupBy(F.col("a").alias("word")).agg(F.max_by(F.struct(F.col("b").alias("term"), "ratio"), F.struct("ratio", -F.col("ord"))).alias("t")).select("word", "t.term", "t.ratio")


def cut_to(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (item, ...) whose item is in a list (item). The list is written first: of a list of unknown size Spark finds out that it is small when all rows have been dealt already."""
    return rows.join(saved(lists.select("item").distinct(), "items"), "item", "left_semi")


def contained_sets(sets: DataFrame, transactions: DataFrame) -> DataFrame:
    """(set_id, sent_id): sentences that hold all items of a set. sets: (set_id, item); transactions: (sent_id, item), both without repeats.

    A set is looked for where its rarest item is, not wherever any of its items is. From a place of an item, either the sets of which it is the rarest look for
    their second item in the sentence, or the sentence's other items look for such sets, whichever are fewer: a common item costs neither all its sets
    in all its sentences nor the square of a long sentence.
    """
    known = transactions.join(sets.select("item").distinct(), "item", "left_semi").select("sent_id", "item")
    known = saved(known.withColumn("k", F.count("*").over(Window.partitionBy("sent_id"))), "known")
    often = known.groupBy("item").agg(F.count("*").alias("c"))
    rare = sets.join(often, "item", "left").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0).cast("long")).alias("c"), "item"))).alias("a"))
    rare = saved(rare.select("set_id", F.col("a.item").alias("items"), F.get("a.item", F.lit(0)).alias("item"), F.get("a.item", F.lit(1)).alias("second"), F.size("a").alias("size")), "rare")
    most = rare.agg(F.coalesce(F.max("size"), F.lit(0)).alias("m")).first()["m"]
    out = rare.where("size = 1").join(known, "item").select("set_id", "sent_id")
    if most > 1:
        several = rare.where("size > 1")
        place = known.join(several.groupBy("item").agg(F.count("*").alias("m")), "item")
        partner = known.select("sent_id", F.col("item").alias("second"))
        by_sets = place.where("m <= k").select("sent_id", "item").join(several, "item").join(partner, ["sent_id", "second"])
        by_words = place.where("m > k").select("sent_id", "item").join(partner, "sent_id").join(several, ["item", "second"])
        hit = by_sets.select("set_id", "sent_id", "items").unionByName(by_words.select("set_id", "sent_id", "items"))
        for k in range(2, most + 1):
            out = out.unionByName(hit.where(F.size("items") == k).select("set_id", "sent_id"))
            if k < most:
                hit = saved(hit.where(F.size("items") > k).withColumn("second", F.get("items", F.lit(k))).join(partner, ["sent_id", "second"]).drop("second"), "hit")
    return out


def supersets(sets: DataFrame, strict: bool = True) -> DataFrame:
    """(set_id, other): sets of which each is contained in another one."""
    size = sets.groupBy("set_id").agg(F.count("*").alias("size"))
    both = contained_sets(sets, sets.select(F.col("set_id").alias("sent_id"), "item")).withColumnRenamed("sent_id", "other").where("set_id <> other")
    if not strict:
        return both
    return both.join(size, "set_id").join(size.toDF("other", "other_size"), "other").where("other_size > size").select("set_id", "other")


def last_and_next(rows: DataFrame, value: Column, at: str = "idx") -> DataFrame:
    """rows with _last and _next: of the rows of a sentence that have a value, the last one up to each row and the first one after it.

    Both windows run forward over one order or its reverse, so that a sentence costs what it has rows, not their square.
    """
    order = lambda c: Window.partitionBy("sent_id").orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("_v", value)
    return df.withColumn("_last", F.last("_v", ignorenulls=True).over(order(F.col(at)))).withColumn("_next", F.last("_v", ignorenulls=True).over(order(F.desc(at)))).drop("_v")


def nearest_noun(toks: DataFrame, own: bool = False) -> DataFrame:
    """(sent_id, idx, noun_idx, noun): for each adjective the nearest noun of its sentence; the earlier one of equals. own: with the adjective's lemma, too. Nouns and adjectives alone are dealt."""
    toks = toks.where(is_noun(F.col("pos")) | F.col("pos").isin(RULE_JJ))
    noun = F.when(is_noun(F.col("pos")), F.struct(F.col("idx").alias("noun_idx"), F.col("lemma").alias("noun")))
    df = last_and_next(toks.select("sent_id", "idx", "lemma", "pos"), noun).where(F.col("pos").isin(RULE_JJ) & (F.col("_last").isNotNull() | F.col("_next").isNotNull()))
    later = F.col("_last").isNull() | (F.col("_next.noun_idx") - F.col("idx") < F.col("idx") - F.col("_last.noun_idx"))
    return df.withColumn("b", F.when(later, F.col("_next")).otherwise(F.col("_last"))).select("sent_id", "idx", "b.noun_idx", "b.noun", *(["lemma"] if own else []))


def nearest_phrase(toks: DataFrame) -> DataFrame:
    """(sent_id, idx, string): for each adjective the nearest noun phrase, by the smaller distance to its start or its exclusive stop.

    Only three can be nearest: the last phrase that begins up to the adjective, the one before that, and the next one.
    """
    one = F.struct("start", "stop", "string")
    np = chunks(toks).where("type = 'NP'").withColumn("np", one).withColumn("before", F.lag("np").over(Window.partitionBy("sent_id").orderBy("start")))
    np = np.select("sent_id", F.col("start").alias("idx"), F.lit(0).alias("kind"), F.struct("np", "before").alias("p"))
    adj = toks.where(F.col("pos").isin(RULE_JJ)).select("sent_id", "idx", F.lit(1).alias("kind"), F.lit(None).alias("p"))
    rows = np.unionByName(adj).withColumn("place", F.struct("idx", "kind"))
    near = last_and_next(rows, F.col("p"), "place").where("kind = 1").select("sent_id", "idx", F.explode(F.array_compact(F.array("_last.np", "_last.before", "_next.np"))).alias("c"))
    d = F.least(F.abs(F.col("c.start") - F.col("idx")), F.abs(F.col("c.stop") - F.col("idx")))
    return near.groupBy("sent_id", "idx").agg(F.min_by("c.string", F.struct(d, "c.start")).alias("string"))


def _span_ends(toks: DataFrame, spans: DataFrame, place: Column, side: str) -> DataFrame:
    """(sent_id, start, noun_idx): for each span the last noun up to a place, or the first one from there on."""
    noun = toks.where(is_noun(F.col("pos"))).select("sent_id", F.col("idx").alias("at"), F.lit(0 if side == "_last" else 2).alias("kind"), F.lit(None).cast("int").alias("start"), F.col("idx").alias("v"))
    point = spans.select("sent_id", place.alias("at"), F.lit(1).alias("kind"), F.col("start").cast("int").alias("start"), F.lit(None).cast("int").alias("v"))
    rows = noun.unionByName(point).withColumn("place", F.struct("at", "kind", "start"))
    return last_and_next(rows, F.col("v"), "place").where(F.col("kind") == 1).where(F.col(side).isNotNull()).groupBy("sent_id", "start").agg((F.max if side == "_last" else F.min)(side).alias("noun_idx"))


def noun_after(toks: DataFrame, spans: DataFrame, mode: str = "reference") -> DataFrame:
    """(sent_id, start, noun_idx): the first noun after a span. In reference mode the token right at the exclusive stop is passed over."""
    return _span_ends(toks, spans, F.col("stop") + (1 if mode == "reference" else 0), "_next")


def noun_before(toks: DataFrame, spans: DataFrame) -> DataFrame:
    """(sent_id, start, noun_idx): the last noun before a span."""
    return _span_ends(toks, spans, F.col("start") - 1, "_last")


def in_segment(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points (sent_id, pos) with the segment [start, stop) of their sentence that they lie in."""
    return points.join(segments, "sent_id").where("pos >= start and pos < stop")


def word_pairs(toks: DataFrame) -> DataFrame:
    """(sent_id, i, e, j, f): each word with each other word of its sentence and with the empty word (i is null, f is empty)."""
    e = toks.select("sent_id", F.col("idx").alias("j"), F.lower("word").alias("e"))
    f = toks.select("sent_id", F.col("idx").alias("i"), F.lower("word").alias("f"))
    none = e.select("sent_id", F.lit(None).cast("int").alias("i"), F.lit("").alias("f"), "j", "e")
    return e.join(f, "sent_id").where("i <> j").select("sent_id", "i", "f", "j", "e").unionByName(none)


def zipped(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables that have the same place in their sentence."""
    return a.join(b, ["sent_id", "idx"])


def fuzzy_pairs(words: DataFrame, least: float) -> DataFrame:
    """(a, b, ratio): pairs a < b of different words at a ratio of `least` or more."""
    return _alike(words.select(F.col("word").alias("a")), words.select(F.col("word").alias("b")), least).where("a < b")
