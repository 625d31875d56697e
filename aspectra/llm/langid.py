"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; ASCII characters other than letters become blanks, runs of them one. The 1- to 3-grams of
characters are hashed to BUCKETS features. A feature's value is its share of the text's n-grams times its
inverse document frequency, which is computed over all documents that may be learned from. The weights
are trained with follow-the-regularised-leader (FTRL-proximal, elastic-net penalties) on at most
LEARN_ROWS documents of each language, a temperature is fitted on rows held out of that sample, and
texts are scored whole, in one pass, on the executors. Every language that has a label is learned; what is broadcast has
128 KB for each of them.

Rows without doc_id are not learned from, and equal rows count once. Defined results: null texts and texts without any letter get `und` with score 0; so do all texts if there
is nothing to learn from. Ties between languages go to the first in alphabetical order. Rows, repeated
ones too, and other columns stay; columns lang_pred and score of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learning_rows, map_arrow, release, saved, with_fields

BUCKETS = 1 << 15
#: Documents of each language that the weights are learned from, at most.
LEARN_ROWS = 500
SLICE_CHARS = 1 << 17
UNDETERMINED = "und"
_BLANK = 32
_ASCII = np.array([c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else _BLANK for c in range(128)], np.uint32)


class Grams(NamedTuple):
    doc: np.ndarray  # index of the text, ascending
    bucket: np.ndarray


def grams(texts: list[str | None]) -> Grams:
    """The hashed 1- to 3-grams of the texts, in order."""
    low = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    raw = " ".join([*low, ""]).encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, np.uint32)
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != _BLANK) | (c[:-1] != _BLANK)
    c, doc = c[keep].astype(np.uint64), doc[keep]
    docs, out, x = [], [], np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        m = len(c) - n + 1
        if m <= 0:
            break
        x = (x[:m] * np.uint64(0x9E3779B97F4A7C15)) + c[n - 1 :] + np.uint64(1)
        h = (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)
        same = (doc[:m] == doc[n - 1 :]) & ((c[:m] != _BLANK) if n == 1 else True)
        docs.append(doc[:m][same])
        out.append(h[same].astype(np.int32))
    if not docs:
        return Grams(np.zeros(0, np.int32), np.zeros(0, np.int32))
    return Grams(np.concatenate(docs), np.concatenate(out))


def parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about SLICE_CHARS."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > SLICE_CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, texts[at:]


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """(documents that have each feature, documents) over all rows; BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for _, texts in parts(batch.column(0).to_pylist()):
                g = grams(texts)
                pairs = np.zeros((len(texts), BUCKETS), bool) if len(texts) * BUCKETS <= 1 << 21 else None
                if pairs is not None:
                    pairs[g.doc, g.bucket] = True
                    df[:-1] += pairs.sum(0)
                else:
                    key = np.unique(g.doc.astype(np.int64) * BUCKETS + g.bucket)
                    df[:-1] += np.bincount(key % BUCKETS, minlength=BUCKETS)
                n += len(texts)
        df[-1] = n
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(df[has], pa.int64())], names=["bucket", "n"])

    rows = map_arrow(docs.select(text_col), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, with the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, features: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, epochs: int = 4, seed: int = 7) -> np.ndarray:
    """FTRL-proximal for the multinomial logistic loss; rows are (class, feature numbers, values); returns sparse weights."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(i: np.ndarray) -> np.ndarray:
        zi, ni = z[i], n[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, i, x = rows[k]
            w = weights(i)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(features))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(u: float) -> float:
        p = _softmax(logits / np.exp(u))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    a, b, r = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn_rows: int = LEARN_ROWS) -> Model | None:
    """Learns from all rows of docs with a language; the caller leaves out what must not be learned from.

    Document frequencies cover all these rows; the weights are fitted on a bounded sample of them.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select("doc_id", F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not languages:
        return None
    df, n = document_frequency(labelled, "text")
    idf = np.log((1 + n) / (1 + df)) + 1.0
    keys = ["doc_id", "h", "lang"]
    ids = saved(learning_rows(labelled.where("doc_id is not null").select(*keys).distinct(), "lang", learn_rows), "langid-sample")
    sample = labelled.join(ids, keys, "left_semi").dropDuplicates(keys).select(F.xxhash64("doc_id", "h").alias("h"), "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                i, k = np.unique(grams([text]).bucket, return_counts=True)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([lang], pa.string()), pa.array([i.tolist()], pa.list_(pa.int32())), pa.array([k.tolist()], pa.list_(pa.int32()))], names=["h", "lang", "i", "k"])

    rows = sorted(map_arrow(sample, run, "h long, lang string, i array<int>, k array<int>").collect(), key=lambda r: (r.h, r.lang, len(r.i)))
    held, used = [], []
    for r in rows:
        i, k = np.array(r.i), np.array(r.k, float)
        (held if r.h % 5 == 0 else used).append((languages.index(r.lang), i, k / k.sum() * idf[i]))
    if not used:
        return None
    w = ftrl(used, len(languages), BUCKETS)
    calibrate = held or used
    t = temperature(np.array([x @ w[i] for _, i, x in calibrate]), np.array([y for y, _, _ in calibrate]))
    del rows, held, used, calibrate
    release()
    return Model(languages, (w * idf[:, None]).astype(np.float32), np.zeros(len(languages)), t)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the calibrated probability of that language."""
    df = docs.drop("lang_pred", "score")
    if model is None:
        return df.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    # size: BUCKETS floats for each language
    held = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    df = df.withColumn("__aspectra_letters", letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        weights = [np.ascontiguousarray(m.weights[:, k]) for k in range(len(m.languages))]
        for batch in batches:
            z = np.zeros((batch.num_rows, len(weights)))
            for at, texts in parts(batch.column(text_col).to_pylist()):
                g = grams(texts)
                many = np.maximum(np.bincount(g.doc, minlength=len(texts)), 1)
                for k, w in enumerate(weights):
                    z[at : at + len(texts), k] = np.bincount(g.doc, weights=w[g.bucket], minlength=len(texts)) / many
            p = _softmax(z / m.temperature)
            best = p.argmax(1)
            ok = batch.column("__aspectra_letters").to_numpy(zero_copy_only=False)
            lang = [m.languages[b] if o else UNDETERMINED for b, o in zip(best, ok, strict=True)]
            score = np.where(ok, p[np.arange(len(p)), best], 0.0)
            names = [n for n in batch.schema.names if n != "__aspectra_letters"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return map_arrow(df, run, with_fields(df, "lang_pred string, score double", ("__aspectra_letters",)))
