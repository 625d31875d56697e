"""Readers of what annotators print: dependency lines, tagger and chunker columns, parser XML and shell text, bracketed trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPENDENCY = r"^(.+?)\((.*)-(\d+), (.*)-(\d+)\)$"


def dependency_lines(lines: DataFrame) -> DataFrame:
    """(sent_id, label, head, head_idx, dep, dep_idx) of lines `label(head-i, dep-j)`; indexes from 0, the root is -1."""
    part = lambda k: F.regexp_extract("line", DEPENDENCY, k)
    return lines.where(F.col("line").rlike(DEPENDENCY)).select(
        "sent_id", part(1).alias("label"), part(2).alias("head"), (part(3).cast("int") - 1).alias("head_idx"), part(4).alias("dep"), (part(5).cast("int") - 1).alias("dep_idx")
    )


def tagger_columns(blocks: DataFrame, names: list[str]) -> DataFrame:
    """(sent_id, idx, *names) of blocks of tab-separated rows; which columns there are depends on the tagger's flags."""
    df = blocks.select("sent_id", F.posexplode(F.split("body", "\n", -1)).alias("idx", "row"))
    cell = F.split("row", "\t", -1)
    return df.select("sent_id", "idx", *(F.get(cell, F.lit(k)).alias(n) for k, n in enumerate(names)))


def chunker_lines(lines: DataFrame) -> DataFrame:
    """(sent_id, idx, iob): the fourth column of rows that are no comments."""
    return lines.where(~F.col("line").startswith("#")).select("sent_id", "idx", F.get(F.split(F.trim("line"), r"\s+", -1), F.lit(3)).alias("iob"))


def repaired(tree: Column) -> Column:
    """A bracketed tree with as many closing as opening brackets: closing ones are put at the end, or opening ones at the start."""
    n = lambda c: F.length(tree) - F.length(F.replace(tree, F.lit(c), F.lit("")))
    more = n("(") - n(")")
    return F.when(more > 0, F.concat(tree, F.repeat(F.lit(")"), more))).when(more < 0, F.concat(F.repeat(F.lit("("), -more), tree)).otherwise(tree)


XML_TOKEN = "sentence struct<_id:int, parse:string, tokens:struct<token:array<struct<_id:int, word:string, lemma:string, POS:string, CharacterOffsetBegin:int, CharacterOffsetEnd:int>>>, dependencies:array<struct<_type:string, dep:array<struct<_type:string, governor:struct<_VALUE:string,_idx:int>, dependent:struct<_VALUE:string,_idx:int>>>>>>"


def parser_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, rels) of a parser's XML files, by Spark's XML reader; indexes from 0, the root is -1."""
    inner = XML_TOKEN.removeprefix("sentence struct<").removesuffix(">").replace("_id:int, parse", "_id int, parse", 1).replace("parse:", "parse ", 1).replace("tokens:struct", "tokens struct", 1).replace("dependencies:array", "dependencies array", 1)
    df = spark.read.option("rowTag", "sentence").schema(inner).xml(path).withColumn("file", F.input_file_name())
    tokens = df.select("file", F.col("_id").alias("sentence"), F.explode("tokens.token").alias("t")).select("file", "sentence", (F.col("t._id") - 1).alias("idx"), "t.word", "t.lemma", F.col("t.POS").alias("pos"), F.col("t.CharacterOffsetBegin").alias("start"), F.col("t.CharacterOffsetEnd").alias("end"))
    deps = df.select("file", F.col("_id").alias("sentence"), F.explode("dependencies").alias("d")).select("file", "sentence", F.col("d._type").alias("kind"), F.explode("d.dep").alias("e"))
    return tokens, deps.select("file", "sentence", "kind", (F.col("e.governor._idx") - 1).alias("head_idx"), F.col("e._type").alias("label"), (F.col("e.dependent._idx") - 1).alias("dep_idx"))


SHELL_TOKEN = r"\[Text=(\S+) CharacterOffsetBegin=(\d+) CharacterOffsetEnd=(\d+) PartOfSpeech=([^\s\]]+)(?: Lemma=([^\s\]]+))?[^\]]*\]"


def shell_text(replies: DataFrame) -> DataFrame:
    """(reply_id, sentence, part, idx, fields) of a parser's interactive replies.

    A reply holds, for each sentence, a title line, the text, the bracketed tokens, a tree, a blank line and dependency lines;
    sentences part at the title lines, and their parts are told by their form.
    """
    sents = replies.select("reply_id", F.posexplode(F.filter(F.split("reply", r"Sentence #\d+[^\n]*\n", -1), lambda s: F.trim(s) != "")).alias("sentence", "body"))
    words = F.regexp_extract_all("body", F.lit(SHELL_TOKEN), F.lit(0))
    tokens = sents.select("reply_id", "sentence", F.lit("token").alias("part"), F.posexplode(words).alias("idx", "x"))
    tokens = tokens.select("reply_id", "sentence", "part", "idx", F.array(*(F.regexp_extract("x", SHELL_TOKEN, k) for k in range(1, 6))).alias("fields"))
    deps = sents.select("reply_id", "sentence", F.lit("dependency").alias("part"), F.posexplode(F.filter(F.split("body", "\n", -1), lambda s: s.rlike(DEPENDENCY))).alias("idx", "x"))
    deps = deps.select("reply_id", "sentence", "part", "idx", F.array(*(F.regexp_extract("x", DEPENDENCY, k) for k in range(1, 6))).alias("fields"))
    tree = sents.select("reply_id", "sentence", F.lit("tree").alias("part"), F.lit(0).alias("idx"), F.array(F.regexp_replace(F.regexp_extract("body", r"(?s)(\((?:ROOT|S)\b.*?\))\s*\n\s*\n", 1), r"\s+", " ")).alias("fields"))
    return tokens.unionByName(deps).unionByName(tree)
