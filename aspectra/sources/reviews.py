"""Annotated review files: `[t]` lines begin a review, `*` and blank lines are comments, `tags##text` are sentences.

Everywhere `lines` is (corpus, line_no, line), in the order of line_no within a corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.operators.running import running_total


def read_lines(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The lines of review files by corpus name; each file is one record, so that its lines keep their order."""
    out = None
    for corpus, path in files.items():
        df = spark.read.option("wholetext", True).text(path).select(F.lit(corpus).alias("corpus"), F.posexplode(F.split("value", "\n", -1)).alias("line_no", "line"))
        df = df.select("corpus", F.col("line_no").cast("long").alias("line_no"), "line")
        out = df if out is None else out.unionByName(df)
    return out


def is_comment(line: Column) -> Column:
    """A blank line, or one that begins with a star."""
    return (F.regexp_replace(line, "[\r\n]", "") == "") | line.startswith("*")


def is_title(line: Column) -> Column:
    return line.contains("[t]")


def kinds(lines: DataFrame) -> DataFrame:
    """lines with `kind`: comment, title or sentence."""
    line = F.col("line")
    return lines.withColumn("kind", F.when(is_comment(line), "comment").when(is_title(line), "title").otherwise("sentence"))


def scan(lines: DataFrame) -> DataFrame:
    """(corpus, review_id, sent_id, tags, text): titles counted so far, and sentences counted from 1, per corpus."""
    df = kinds(lines)
    df = running_total(df, "corpus", "line_no", (F.col("kind") == "title").cast("long"), "review_id")
    df = running_total(df, "corpus", "line_no", (F.col("kind") == "sentence").cast("long"), "sent_id")
    parts = F.split("line", "##", -1)
    return df.where("kind = 'sentence'").select("corpus", "review_id", "sent_id", F.get(parts, F.lit(0)).alias("tags"), F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "[\r\n]", "")).alias("text"))


def term(tag: Column) -> Column:
    """What stands before the bracket; empty without one."""
    return F.when(tag.contains("["), F.trim(F.substring_index(tag, "[", 1))).otherwise("")


def orientation(tag: Column) -> Column:
    """1 with a plus anywhere, else -1 with a minus anywhere, else null."""
    return F.when(tag.contains("+"), 1).when(tag.contains("-"), -1)


def aspect_type(tag: Column) -> Column:
    """u: not in the sentence, p: by a pronoun, n: named."""
    return F.when(tag.contains("[u]"), "u").when(tag.contains("[p]"), "p").otherwise("n")


def gold(sents: DataFrame, separator: str = ", ") -> DataFrame:
    """(corpus, review_id, sent_id, place, term, orientation, type) of every tag of scan()'s sentences."""
    tags = sents.where("tags <> ''").select("corpus", "review_id", "sent_id", F.posexplode(F.split(F.trim("tags"), separator, -1)).alias("place", "tag"))
    tag = F.col("tag")
    return tags.select("corpus", "review_id", "sent_id", "place", term(tag).alias("term"), orientation(tag).cast("int").alias("orientation"), aspect_type(tag).alias("type"))


def problems(lines: DataFrame) -> DataFrame:
    """(corpus, line_no, problem) of lines that a strict reader refuses; tags part at commas here."""
    df = kinds(lines).where("kind = 'sentence'")
    parts = F.split("line", "##", -1)
    text = F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "[\r\n]", ""))
    tags = F.split(F.trim(F.get(parts, F.lit(0))), ",", -1)
    tagged = F.get(parts, F.lit(0)) != ""
    problem = (
        F.when(F.size(parts) < 2, "no separator").when(text == "", "no text")
        .when(tagged & F.exists(tags, lambda t: term(t) == ""), "no term").when(tagged & F.exists(tags, lambda t: orientation(t).isNull()), "no orientation")
    )
    return df.withColumn("problem", problem).where("problem is not null").select("corpus", "line_no", "problem")


def checked(lines: DataFrame) -> DataFrame:
    """lines, or an error that names the first line a task finds that a strict reader refuses."""
    bad = problems(lines).withColumnRenamed("problem", "_p")
    df = lines.join(bad, ["corpus", "line_no"], "left")
    return df.where(F.when(F.col("_p").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", "corpus", "line_no", "_p")).cast("boolean"))).drop("_p")
