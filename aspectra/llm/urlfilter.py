"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Everything runs in DataFrame functions and the DataFrame API of Spark ML; trees are applied as
CASE expressions. The labelled URLs are those that rules decide, or any table of (url, label). Statistics of
host suffixes are computed over all labelled URLs, in SUFFIX_BUCKETS hashed buckets (a bound for
what is broadcast); for the rows that the trees are fitted on they leave out the row's own fold. The trees are fitted on at most
LEARN_ROWS distinct labelled URLs, chosen by a hash of the url.

Defined results: a null url, or one without `://`, has an empty host and path, and fits no rule; the trees judge it
like any other (a null url as the empty one). Of rules that fit, the longest host and path win, then block, then alphabetical order. If
labels have one value alone, or none, all else gets that value, or allow. Rows, repeated ones too, and other columns stay;
columns host, path, rule, verdict and score of the input are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved

LEARN_ROWS = 20_000
FOLDS = 5
SUFFIX_BUCKETS = 1024
TREES, DEPTH = 8, 3
FEATURES = ["f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_parameters", "f_hyphens", "f_labels", "f_suffix"]


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def fits(rule: Rule, host_col: Column, path_col: Column) -> Column:
    return ((host_col == rule.host) | host_col.endswith(f".{rule.host}")) & path_col.startswith(rule.path)


def first_rule(rules: list[Rule], host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """(text, verdict) of the rule that wins, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text), reverse=True):
        hit = fits(r, host_col, path_col)
        text, verdict = F.when(hit, r.text).otherwise(text), F.when(hit, r.verdict).otherwise(verdict)
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits a character; 0 for the empty text."""
    chars = F.split(text, "")
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return F.when(n > 0, bits).otherwise(0.0)


def suffix_bucket(host_col: Column) -> Column:
    """The bucket of a host's last two labels."""
    return F.pmod(F.xxhash64(F.substring_index(host_col, ".", -2)), F.lit(SUFFIX_BUCKETS)).cast("int")


def lexical(df: DataFrame, url_col: str) -> DataFrame:
    """df, which has host and path, with the lexical features (all but f_suffix) and `bucket`."""
    url, h = F.coalesce(F.col(url_col), F.lit("")), F.col("host")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    return df.select(
        "*",
        F.length(url).cast("double").alias("f_length"),
        F.length(h).cast("double").alias("f_host_length"),
        count(F.col("path"), "/").cast("double").alias("f_depth"),
        (count(url, "0123456789") / F.greatest(F.length(url), F.lit(1))).alias("f_digits"),
        entropy(h).alias("f_entropy"),
        count(F.regexp_extract(url, r"\?([^#]*)", 1), "=").cast("double").alias("f_parameters"),
        count(h, "-").cast("double").alias("f_hyphens"),
        (count(h, ".") + 1).cast("double").alias("f_labels"),
        suffix_bucket(h).alias("bucket"),
    )


class Model(NamedTuple):
    suffixes: DataFrame | None  # (bucket, f_suffix), SUFFIX_BUCKETS rows at most
    score: Column | None  # from the features; over 0: block
    constant: str
    prior: float


def _tree(node, weight: float) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(weight * node.prediction())
    split = node.split()
    return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), _tree(node.leftChild(), weight)).otherwise(_tree(node.rightChild(), weight))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", learn_rows: int = LEARN_ROWS) -> Model:
    """Fits the trees to labelled URLs (label 1: block, 0: allow)."""
    df = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))
    df = df.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    df = df.withColumn("bucket", suffix_bucket(F.col("host"))).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(1)), F.lit(FOLDS)).cast("int"))
    folds = saved(df.groupBy("bucket", "fold").agg(F.sum("label").alias("s"), F.count("*").alias("n")), "suffixes")
    total, n = folds.agg(F.sum("s"), F.sum("n")).first()
    if not n or total in (0, n):
        return Model(None, None, "block" if n and total else "allow", 0.0)
    prior = total / n
    smoothed = lambda s, n: (s + 10 * prior) / (n + 10)
    every = folds.groupBy("bucket").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    suffixes = every.select("bucket", smoothed(F.col("all_s"), F.col("all_n")).alias("f_suffix"))
    # a row to fit on must not see its own label, nor those of equal urls: its statistics leave its fold out
    others = every.join(folds, "bucket").select("bucket", "fold", smoothed(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("f_suffix"))
    # only those with a hash below the share of what is wanted (twice it) come to the sort
    hashed = df.select("url", "label", "host", "path", "fold").withColumn("h", F.xxhash64("url")).where(F.col("h") <= min(1.0, 2.0 * learn_rows / n) * 2.0**64 - 2.0**63).distinct()
    sample = saved(hashed.orderBy("h", "url", "label").limit(learn_rows), "url-sample")
    rows = lexical(sample, "url").join(F.broadcast(others), ["bucket", "fold"], "left").fillna({"f_suffix": prior})  # FOLDS * SUFFIX_BUCKETS rows at most
    rows = saved(rows.select("label", *FEATURES), "url-features")
    if rows.select("label").distinct().count() < 2:
        return Model(None, None, "block" if prior > 0.5 else "allow", prior)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, checkpointInterval=-1).fit(vectors)
    score = F.lit(0.0)
    for tree, weight in zip(fitted.trees, fitted.treeWeights, strict=True):
        score = score + _tree(tree._java_obj.rootNode(), weight)
    return Model(suffixes, score, "allow", prior)


def judge(pages: DataFrame, rules: list[Rule], model: Model | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score (the trees' margin; null where they are not asked).

    Without a model, the trees are trained on the URLs of pages that rules decide.
    """
    df = pages.drop("host", "path", "rule", "verdict", "score")
    own = df.columns
    df = df.withColumn("host", F.coalesce(host(F.col(url_col)), F.lit(""))).withColumn("path", F.coalesce(path(F.col(url_col)), F.lit("")))
    rule, verdict = first_rule(rules, F.col("host"), F.col("path"))
    df = df.withColumn("rule", rule).withColumn("__aspectra_ruled", verdict)
    if model is None:
        model = train(df.where("rule is not null").select(F.col(url_col).alias("url"), (F.col("__aspectra_ruled") == "block").cast("int").alias("label")))
    if model.score is None:
        return df.withColumn("verdict", F.coalesce("__aspectra_ruled", F.lit(model.constant))).withColumn("score", F.lit(None).cast("double")).drop("__aspectra_ruled")
    names = {c: f"_own_{i}" for i, c in enumerate(own)}  # so that no column of the input clashes with a feature
    df = df.select(*(F.col(f"`{c}`").alias(names[c]) for c in own), "host", "path", "rule", "__aspectra_ruled")
    df = lexical(df, names[url_col]).join(F.broadcast(model.suffixes), "bucket", "left").fillna({"f_suffix": model.prior})
    score = F.when(F.col("__aspectra_ruled").isNull(), model.score)
    df = df.withColumn("_score", score)
    trees = F.when(F.col("_score") > 0, "block").otherwise("allow")
    return df.select(*(F.col(n).alias(c) for c, n in names.items()), "host", "path", "rule", F.coalesce("__aspectra_ruled", trees).alias("verdict"), F.col("_score").alias("score"))
