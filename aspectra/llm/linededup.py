"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: by its number of tokens, then by its LEADING first tokens, to a
leaf; tokens with a digit count as variable from the start. Within a leaf, two kinds of templates recur:

* lines that are equal but for tokens with digits, in at least two documents; where more than half of the tokens have
  digits, and in lines of less than MIN_TOKENS tokens, lines that are equal altogether;
* lines that are equal but for other variable fields: a token at a place is constant if at least GENERAL_LINES different
  lines of the leaf have it there; a template whose constant share of the tokens without digits is at least CONSTANT and that
  as many different lines share, not all of one document, recurs. (So a line needs five such tokens to vary in one.) Lines that
  recur as they are count once among these.

Lines of recurring templates are dropped, but for those of the first document (smallest doc_id) that has the
template. What the variable fields of a dropped line hold need not be said anywhere else: that is what generalising
means; `variable=False` drops lines of the first kind alone. Lines under MIN_TOKENS tokens are dropped only if drop_lines is
asked for short lines.

Leaves are never gathered: counts and minima are aggregated before shuffles, and lines meet them in joins. Templates are told apart by
128 bits, tokens of a leaf by 32 (and the leaf and their place).

Defined results: null texts stay null, with no lines; empty texts have one empty line. Rows with the
same doc_id count as one document, which loses lines from each of its texts by what that text says; rows without doc_id are one
document that comes first. Rows and other columns stay; columns n_lines and n_dropped of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_arrow, saved, sliced, swept, with_fields
from .textkernel import BLANK, mix, slices, words

MIN_TOKENS, LEADING = 4, 3
GENERAL_LINES, CONSTANT = 3, 0.8
_KEY = ["template", "second"]
_WILD = np.uint64(0x57494C44)
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)], np.int64)
_NEWLINE = np.array([b == 10 for b in range(256)], np.int64)


def parsed(texts: pa.Array, leading: int = LEADING, least: int = MIN_TOKENS) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts, of each line of at least `least` tokens: (text, line number, tokens, leaf, template's two halves, token codes' bounds, token codes)."""
    for at, data, offsets in slices(texts):
        w = words(data, offsets, BLANK)
        if not len(w.doc):
            continue
        line = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
        number = line[w.start] - line[offsets[w.doc]]
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        h = np.where(digits[w.end] > digits[w.start], _WILD, w.hash)
        first = np.flatnonzero(np.concatenate([[True], (w.doc[1:] != w.doc[:-1]) | (number[1:] != number[:-1])]))
        n = np.diff(np.append(first, len(h)))
        place = np.arange(len(h)) - np.repeat(first, n)
        seat = place.astype(np.uint64) * _ODD
        own = (n < MIN_TOKENS) | (2 * np.add.reduceat((h == _WILD).astype(np.int64), first) > n)
        said = np.where(np.repeat(own, n), w.hash, h)
        template, second = (mix(np.add.reduceat(mix(said * salt + seat), first) + 2 * n.astype(np.uint64) + own) for salt in (np.uint64(1), _BASE))
        leaf = mix(n.astype(np.uint64))
        for i in range(leading):
            leaf = np.where(n > i, mix(leaf + h[np.minimum(first + i, len(h) - 1)] * _ODD), leaf)
        keep = n >= least
        code = np.maximum(h >> np.uint64(32), np.uint64(1)).astype(np.uint32)
        code[h == _WILD] = 0
        yield at + w.doc[first[keep]], number[first[keep]], n[keep], *(x[keep].view(np.int64) for x in (leaf, template, second)), first[keep], code


_FIRST = -(1 << 63)  # stands for a missing doc_id


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("__aspectra_doc"), F.xxhash64(text_col).alias("__aspectra_text"))


def _lines(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """(doc, text, line, n, leaf, template, second, codes): text is a hash of it; codes are four bytes a token, for lines that can be generalised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("__aspectra_doc"), batch.column("__aspectra_text")
            for doc, number, n, leaf, template, second, first, code in parsed(batch.column(text_col), least=least):
                raw = code.tobytes()
                # a document needs the codes of a template once, however often it repeats it
                once = np.zeros(len(n), bool)
                once[np.unique(mix(template.view(np.uint64) + doc.astype(np.uint64) * _ODD), return_index=True)[1]] = True
                codes = [raw[4 * s : 4 * (s + k)] if o and k >= MIN_TOKENS else None for s, k, o in zip(first.tolist(), n.tolist(), once.tolist(), strict=True)]
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([ids.take(at), texts.take(at), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(leaf), pa.array(template), pa.array(second), pa.array(codes, pa.binary())], names=["doc", "text", "line", "n", "leaf", "template", "second", "codes"])

    narrow = _keyed(docs, text_col).where(F.col(text_col).isNotNull()).select("__aspectra_doc", "__aspectra_text", text_col)
    return map_arrow(narrow, run, "doc long, text long, line int, n int, leaf long, template long, second long, codes binary")


def _generalised(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """(template, second, first): templates that are equal but for variable fields, with the first document of the template they share."""
    # leaves with several templates
    many = stats.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= GENERAL_LINES).select("leaf")
    some = stats.join(many, "leaf").select(*_KEY, F.col("first").alias("doc"), "last")
    held = saved(lines.where("codes is not null").select("doc", *_KEY, "leaf", "n", "codes").join(some, ["doc", *_KEY]).dropDuplicates(["doc", *_KEY]), "leaves")
    names = ["leaf", *_KEY, "doc", "last"]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32).astype(np.int64)
            n = batch.column("n").to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
            plain = np.bincount(row[code != 0], minlength=len(n))
            # a line that is variable for the most part is only equal to itself
            some = np.flatnonzero((code != 0) & (2 * plain >= n)[row])
            at = pa.array(row[some])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in names] + [pa.array(plain[row[some]].astype(np.int32)), pa.array(place[some].astype(np.int32)), pa.array(code[some])], names=[*names, "plain", "place", "code"])

    t = map_arrow(held, tokens, "leaf long, template long, second long, doc long, last long, plain int, place int, code long")
    constant = t.groupBy("leaf", "place", "code").agg(F.count("*").alias("c")).where(F.col("c") >= GENERAL_LINES).select("leaf", "place", "code")
    masked = t.join(constant, ["leaf", "place", "code"]).groupBy(*names, "plain").agg(F.count("*").alias("k"), *(F.sum(F.xxhash64(F.lit(i), "place", "code").cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)))
    general = ["leaf", "k", "h0", "h1"]
    masked = saved(masked.where(F.col("k") >= CONSTANT * F.col("plain")).select(*_KEY, "doc", "last", *general), "masked")
    shared = masked.groupBy(*general).agg(F.min("doc").alias("first"), F.max("last").alias("last"), F.count("*").alias("c")).where(f"c >= {GENERAL_LINES} and first <> last")
    out = saved(masked.join(shared.select(*general, "first"), general).select(*_KEY, "first"), "general")
    dropped(held, masked)
    return out


def drop_lines(docs: DataFrame, text_col: str = "text", short: bool = False, variable: bool = True) -> DataFrame:
    """docs with the text without its recurring lines, n_lines (before) and n_dropped.

    short: whether lines under MIN_TOKENS tokens go, too; variable: whether lines go that differ in words without digits.
    """
    df = docs.drop("n_lines", "n_dropped")
    lines = saved(_lines(df, text_col, 1 if short else MIN_TOKENS), "lines")
    stats = saved(lines.groupBy("leaf", *_KEY).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("n").alias("n")), "templates")
    recurring = stats.where("first <> last").select(*_KEY, "first")
    general = None
    if variable:
        general = _generalised(lines, stats.where(F.col("n") >= MIN_TOKENS).select("leaf", *_KEY, "first", "last"))
        # a template that recurs both ways goes but for the first document of all
        recurring = recurring.unionByName(general).groupBy(*_KEY).agg(F.min("first").alias("first"))
    swept(df.sparkSession)
    keys = ["__aspectra_doc", "__aspectra_text"]
    gone = lines.select("doc", "text", "line", *_KEY).join(recurring, _KEY).where("doc <> first").groupBy(F.col("doc").alias(keys[0]), F.col("text").alias(keys[1])).agg(F.collect_set("line").alias("__aspectra_drop"))
    gone = saved(gone, "gone")
    dropped(lines, stats, general)
    swept(df.sparkSession)
    out = _keyed(df, text_col).join(gone, keys, "left").drop(*keys)
    kind = with_fields(df, "n_lines long, n_dropped long")
    kind[text_col].nullable = True
    own = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in sliced(whole, text_col):
                kept, many, less = [], [], []
                null = batch.column(text_col).is_null().to_pylist()
                for t, none, drop in zip(texts, null, batch.column("__aspectra_drop").to_pylist(), strict=True):
                    many.append(0 if none else t.count(b"\n") + 1)
                    less.append(len(drop or ()))
                    if drop:
                        drop = set(drop)
                        t = b"\n".join([x for i, x in enumerate(t.split(b"\n")) if i not in drop])
                    kept.append(None if none else t)
                columns = {n: batch.column(n) for n in own} | {text_col: pa.array(kept, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(many, pa.int64()), pa.array(less, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

    return map_arrow(out, run, kind)
