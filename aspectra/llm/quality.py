"""Quality classifier by compression: two zstandard dictionaries, from good and from bad labelled text.

A text is cut into chunks of CHUNK bytes, and each is compressed with either dictionary. The difference of
the summed sizes, divided by the larger sum, is the one feature; logistic calibration, fitted on labelled
rows that the dictionaries have not seen, turns it into a score. Every text is read whole.

Dictionaries and calibration are fitted on at most LEARN_ROWS distinct rows of each label, chosen by a hash of doc_id and text. A
dictionary is built from chunks of their whole texts: of all of them, or of LEARN_CHUNKS chosen by a hash.

Defined results: null counts as the empty text, which gets the score of a difference of 0; without rows
of both labels every score is the share of label 1 among the labelled rows (0.5 without any). A document
with several labels counts with the lowest. Rows, repeated ones too, and other columns stay; columns
score and predicted of the input are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learning_rows, map_arrow, saved, sliced, with_fields

LEARN_ROWS = 1500
#: Chunks that a dictionary is built from, at most (8 MB).
LEARN_CHUNKS = 1 << 14
DICTIONARY_BYTES = 112 << 10
CHUNK = 512
LEVEL = 3
THRESHOLD = 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    bias: float


class Scorer:
    """Compresses chunks with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.compress = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False, write_dict_id=False).compress for d in (good, bad)]

    def difference(self, text: bytes) -> float:
        """From -1 to 1; positive if the dictionary of good text serves better."""
        if not text:
            return 0.0
        good = bad = 0
        c, d = self.compress
        for i in range(0, len(text), CHUNK):
            x = text[i : i + CHUNK]
            good += len(c(x))
            bad += len(d(x))
        return (bad - good) / max(good, bad)


def chunks(texts: list[bytes], most: int = LEARN_CHUNKS) -> list[bytes]:
    """The chunks of whole texts, or those `most` of them that have the smallest hashes, in order."""
    out = [(zlib.crc32(t[i : i + CHUNK], i), t[i : i + CHUNK]) for t in texts for i in range(0, len(t), CHUNK)]
    if len(out) > most:
        least = sorted(h for h, _ in out)[most - 1]
        out = [x for x in out if x[0] <= least][:most]
    return [c for _, c in out]


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of chunks; too few chunks for training are taken as they are."""
    found = chunks(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-DICTIONARY_BYTES:] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, bias) of least penalised log loss, by Newton's method."""
    a = np.stack([x, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", learn_rows: int = LEARN_ROWS) -> Model:
    """Learns from labels (doc_id, label 0 or 1) and the texts of docs; the caller leaves out what must not be learned from."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).alias("_label"))
    texts = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    keys = ["doc_id", "h"]
    ids = saved(learning_rows(texts.select(*keys).join(one, "doc_id").distinct(), "_label", learn_rows), "quality-sample")
    rows = texts.join(ids, keys).dropDuplicates(keys).select(F.xxhash64("doc_id", "h").alias("h"), "_label", "t").collect()
    rows = sorted(rows, key=lambda r: (r.h, bytes(r.t)))
    texts = {y: [bytes(r.t) for r in rows if r["_label"] == y and r.h % 3] for y in (0, 1)}
    held = [(bytes(r.t), r["_label"]) for r in rows if r.h % 3 == 0]
    if not texts[0] or not texts[1]:
        share = (sum(r["_label"] for r in rows) + 1) / (len(rows) + 2)
        return Model(b" " * 8, b" " * 8, 0.0, math.log(share / (1 - share)))
    good, bad = dictionary(texts[1]), dictionary(texts[0])
    s = Scorer(good, bad)
    held = held or [(t, y) for y in (0, 1) for t in texts[y]]
    slope, bias = logistic(np.array([s.difference(t) for t, _ in held]), np.array([y for _, y in held], float))
    return Model(good, bad, slope, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""
    df = docs.drop("score", "predicted")
    # size: two dictionaries of DICTIONARY_BYTES
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        s = Scorer(m.good, m.bad)
        for batch in batches:
            for part, texts in sliced(batch, text_col):
                x = np.array([s.difference(t) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30)))
                names = [n for n in part.schema.names if keep_text or n != text_col]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return map_arrow(df, run, with_fields(df, "score double, predicted int", () if keep_text else (text_col,)))
