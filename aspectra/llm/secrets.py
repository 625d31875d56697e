"""Secret scans by an incremental blob ledger.

Every version of every path is addressed by its content (SHA-256). The ledger holds the pairs of blob and rule
version that have been scanned, with their findings; only unseen pairs are scanned, each blob once however many paths have
it, and findings are joined back to all paths. All of it is DataFrame functions.

Whether any rule matches is tested where texts are read; only texts of which that is true move, one for each blob. On an empty ledger
every row is tested, copies within the same scan included.

Matches of a rule are leftmost and do not overlap; those that are too short are dropped after matching.
Offsets are code points, end exclusive: the lengths of what lies between matches and of the matches, summed up
by a window over the matches of one rule in one text.

Defined results: null texts count as empty; rows stay, repeated ones too; a null path is a path. Columns of the
input other than the path, version and text are not used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str  # no match may be empty
    group: int  # whose length counts
    least: int


BASE = [
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # a run of at least 24 is a maximal run, as with + and a check of its length
]
MORE = [
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
]
FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"


def matches(texts: DataFrame, rules: list[Rule], wanted: Callable[[Rule], Column] | None = None) -> DataFrame:
    """(blob, findings) of the texts (blob, text) that have any, in order of start and rank; wanted: whether a rule is asked of a row."""
    text, parts = F.col("text"), []
    for rank, r in enumerate(rules):
        hits = F.transform(F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), lambda h: F.struct(F.length(h).alias("n"), (F.length(F.regexp_extract(h, r.pattern, r.group)) >= r.least).alias("ok")))  # noqa: B023
        pairs = F.arrays_zip(F.transform(F.split(text, r.pattern, -1), F.length).alias("gap"), hits.alias("hit"))
        ask = text.rlike(r.pattern) if wanted is None else wanted(r) & text.rlike(r.pattern)
        parts.append(F.when(ask, F.struct(F.lit(rank).alias("rank"), F.lit(r.kind).alias("kind"), pairs.alias("pairs"))))
    one = texts.select("blob", F.explode(F.array(*parts)).alias("f")).where("f is not null")
    one = one.select("blob", "f.rank", "f.kind", F.posexplode("f.pairs").alias("at", "x")).select("blob", "rank", "kind", "at", "x.gap", "x.hit.n", "x.hit.ok")
    # what lies behind the last match comes last, without a match
    end = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(Window.partitionBy("blob", "rank").orderBy("at")).cast("int")
    found = one.withColumn("end", end).where("ok").select("blob", F.struct((F.col("end") - F.col("n")).alias("start"), "rank", "kind", "end").alias("finding"))
    return found.groupBy("blob").agg(F.array_sort(F.collect_list("finding")).cast(FINDING).alias("findings"))


def suspicious(text: Column, rules: list[Rule]) -> Column:
    """Whether any rule matches."""
    return reduce(Column.__or__, [text.rlike(r.pattern) for r in rules])


def _pair(r: Rule) -> Column:
    return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))


class Ledger:
    """Scanned pairs of blob and rule version, as Parquet files in a folder that all executors share."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        """(blob, rule, version, findings), or None before the first scan."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.schema(f"blob binary, kinds array<struct<kind:string,version:int>>, findings {FINDING}").parquet(self.path)

    def scan(self, versions: DataFrame, rules: list[Rule], path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(path_col, blob) of each row of versions, after scanning what the ledger has not seen."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = versions.select(path_col, F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
        wanted = F.array(*(_pair(r) for r in rules))
        seen = self.rows()
        if seen is None:
            rows = saved(rows.withColumn("text", F.when(suspicious(F.col("text"), rules), F.col("text"))), "paths")
            kept = rows.select(path_col, "blob")
            unseen = kept.select("blob").distinct().withColumn("todo", wanted)
            source = rows.withColumn("todo", wanted)
        else:
            kept = saved(rows.select(path_col, "blob"), "paths")
            done = seen.select("blob", F.explode("kinds").alias("k")).groupBy("blob").agg(F.collect_set("k").alias("done"))
            unseen = kept.select("blob").distinct().join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<kind:string,version:int>>")))).drop("done").where(F.size("todo") > 0)
            unseen = saved(unseen, "unseen")
            source = rows.join(unseen, "blob").where(suspicious(F.col("text"), rules))
        texts = source.where("text is not null").select("blob", "text", "todo").dropDuplicates(["blob"])
        found = matches(texts, rules, lambda r: F.array_contains("todo", _pair(r)))
        rows = unseen.join(found, "blob", "left").select("blob", F.col("todo").alias("kinds"), F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))
        rows.write.mode("append").parquet(self.path)
        return kept

    def findings(self, kept: DataFrame, rules: list[Rule]) -> DataFrame:
        """kept with the findings of these rules' versions in its blob (null: none)."""
        wanted = F.array(*(_pair(r) for r in rules))
        kinds = F.transform(F.array_intersect("kinds", wanted), lambda k: k.kind)
        one = self.rows().where(F.size("findings") > 0).withColumn("findings", F.filter("findings", lambda f: F.array_contains(kinds, f.kind))).where(F.size("findings") > 0)
        # a blob is scanned anew for each new rule version: its findings are put together, repeated rows of one path once
        one = one.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("findings")))).alias("findings"))
        return kept.join(one, "blob", "left")
