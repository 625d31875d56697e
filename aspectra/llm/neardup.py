"""MinHash near-duplicates by a multi-index Hamming join.

A text's set is its distinct word shingles (64-bit hashes cut to 52 bits). Texts with equal sets form one class, whose
representative is its smallest doc_id. A representative's signature has SLOTS b-bit (16-bit) MinHash
values, split into chunks of WIDTH. If two signatures differ in at most SLOTS/2 - 1 slots, then by
pigeonhole some chunk differs in at most one of its slots; so each chunk is entered once for each slot
that may be wrong, with the other slots as key, and all pairs within that distance share a key. At the
Jaccard similarity 0.85 a pair lies beyond it with a chance of 3e-6; below that WIDE_SLOTS are taken, which
at 0.8 leave a chance of 3e-6.

Pairs that share a key are confirmed on full sets. Only components are asked for, so a pair within one
component need not be looked at again. In each of TURNS turns all members of a key meet one of them, a
pivot. What components then leave open (keys whose members are in more than one component) is settled
exactly: keys of at most BUCKET members give all their pairs between components; members of larger keys meet in a prefix
join on their rarest shingles, between components. Nothing is capped.

Defined results: null, empty and wordless texts have no shingles, are linked with nothing and stay;
their component is their own doc_id. Rows with the same doc_id count as one document. Rows without
doc_id take part through their class, but are never a component's id: they stay only if no row with an
id has the same set. Rows and columns stay, and columns n_shingles, component_id and kept of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, map_arrow, saved, swept
from .components import components
from .textkernel import BLANK, mix, shingle_sets, slices, words

SLOTS, WIDE_SLOTS, WIDTH = 32, 48, 4
BUCKET, TURNS = 16, 3
#: Bits of a set's parities.
BITS = 1024
_RANDOM = np.random.default_rng(31337)
_A = _RANDOM.integers(1, 1 << 63, WIDE_SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(1, 1 << 63, WIDE_SLOTS, dtype=np.uint64)


class Measure(NamedTuple):
    """What links two texts: words of a shingle, and the least similarity in percent."""

    size: int
    percent: int

    @property
    def slots(self) -> int:
        return SLOTS if self.percent >= 85 else WIDE_SLOTS


def _percent(measures: list[Measure], m: str) -> str:
    """SQL: the percentage of the measure whose number is m."""
    if len(measures) == 1:
        return str(measures[0].percent)
    return f"(CASE {m} {' '.join(f'WHEN {k} THEN {x.percent}' for k, x in enumerate(measures))} END)"


def sets(texts: pa.Array, sizes: list[int], code: np.ndarray = BLANK) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first text, texts, (starts, hashes) for each size): the sorted sets of runs of texts; set i is hashes[starts[i]:starts[i + 1]]."""
    for at, data, offsets in slices(texts):
        n = len(offsets) - 1
        w, out = words(data, offsets, code), []
        for size in sizes:
            doc, x = shingle_sets(w, size, n)
            out.append((np.searchsorted(doc, np.arange(n + 1)), x))
        yield at, n, out


def signatures(starts: np.ndarray, x: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """`slots` 16-bit MinHash values for each set; those of empty sets mean nothing."""
    n = len(starts) - 1
    out = np.zeros((n, slots), np.uint16)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        for k in range(slots):
            out[full, k] = mix(np.minimum.reduceat(x * _A[k] + _B[k], starts[full])) >> np.uint64(48)
    return out


def keys(signature: np.ndarray) -> np.ndarray:
    """For each signature the keys of all chunks, each with one slot left out."""
    slots = signature.shape[1]
    out = []
    for c in range(slots // WIDTH):
        part = signature[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for j in range(WIDTH):
            h = np.full(len(part), c * WIDTH + j + 1, np.uint64)
            for i in range(WIDTH):
                if i != j:
                    h = (h << np.uint64(16)) | part[:, i]
            out.append(mix(h))
    return np.stack(out, 1) if out else np.zeros((0, slots), np.uint64)


def _sketch(docs: DataFrame, text_col: str, measures: list[Measure]) -> DataFrame:
    """(doc_id, n0, k0, l0, keys0, ...): for each measure the size of each row's set, 128 bits that stand for it, and its keys."""
    names = ["doc_id", *(f"{c}{m}" for m in range(len(measures)) for c in ("n", "k", "l", "keys"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, found in sets(batch.column(text_col), [m.size for m in measures]):
                columns = [batch.column("doc_id").slice(at, n)]
                for m, (starts, x) in enumerate(found):
                    total = [np.zeros(len(x) + 1, np.uint64) for _ in range(2)]
                    for t, salt in zip(total, (np.uint64(0), np.uint64(0x5DEECE66D)), strict=True):
                        np.cumsum(mix(x + salt), out=t[1:])
                    slots = measures[m].slots
                    k = (keys(signatures(starts, x, slots)) + np.uint64(m)).view(np.int64)
                    columns += [pa.array((starts[1:] - starts[:-1]).astype(np.int64)), *(pa.array((t[starts[1:]] - t[starts[:-1]]).view(np.int64)) for t in total)]
                    columns.append(pa.FixedSizeListArray.from_arrays(pa.array(k.ravel()), slots).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"n{m} long, k{m} long, l{m} long, keys{m} array<long>" for m in range(len(measures)))
    return map_arrow(docs.select("doc_id", text_col), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")


def parities(starts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each set BITS bits: the parity of the number of its hashes that fall on each bit.

    An element that only one of two sets has changes one bit at most, so two sets differ in at least as many elements as bits.
    """
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    out = np.zeros((n, BITS), np.uint8)
    for at in range(0, n, 512):
        s, e = starts[at], starts[min(at + 512, n)]
        count = np.bincount((owner[s:e] - at) * BITS + (x[s:e] % np.uint64(BITS)).astype(np.int64), minlength=min(512, n - at) * BITS)
        out[at : at + 512] = (count & 1).reshape(-1, BITS)
    return np.packbits(out, axis=1).view(np.int64)


_BIT_COLUMNS = [f"b{k}" for k in range(BITS // 64)]


def _full_sets(docs: DataFrame, ids: DataFrame, text_col: str, measures: list[Measure]) -> DataFrame:
    """(id, m, n, set, b0, b1, ...) of the documents in ids, by each measure m; a set is its sorted hashes as bytes, and b0, b1, ... are its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, found in sets(batch.column("text"), [m.size for m in measures]):
                for m, (starts, x) in enumerate(found):
                    raw, bits = x.tobytes(), parities(starts, x)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(at, n), pa.array(np.full(n, m, np.int32)), pa.array((starts[1:] - starts[:-1]).astype(np.int64)), pa.array([raw[8 * s : 8 * e] for s, e in zip(starts[:-1], starts[1:], strict=True)], pa.binary())] + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(bits.shape[1])],
                        names=["id", "m", "n", "set", *_BIT_COLUMNS],
                    )

    some = docs.select(F.col("doc_id").alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    return map_arrow(some, run, f"id {docs.schema['doc_id'].dataType.simpleString()}, m int, n long, set binary, {', '.join(f'{c} long' for c in _BIT_COLUMNS)}")


def _may_link(x: str, y: str, percent: str) -> str:
    """SQL: whether two sets, by their sizes and parities, can be similar enough; never false for sets that are."""
    differ = " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in _BIT_COLUMNS)
    return f"{_alike(f'{x}.n', f'{y}.n', percent)} and (100 - {percent}) * ({x}.n + {y}.n) >= (100 + {percent}) * ({differ})"


def _confirmed(pairs: DataFrame, full: DataFrame, measures: list[Measure]) -> DataFrame:
    """(a, b) of those pairs (a, b, m) whose full sets are similar enough by measure m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("m").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                keep.append(both > 0 and 100 * both >= measures[m].percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    bits = full.drop("set")
    p, x, y = pairs.alias("p"), bits.alias("x"), bits.alias("y")
    on = F.expr(f"p.b = y.id and p.m = y.m and {_may_link('x', 'y', _percent(measures, 'p.m'))}")
    left = p.join(x, F.expr("p.a = x.id and p.m = x.m")).join(y, on).select("a", "b", "p.m").distinct()
    first, second = (full.select(F.col("id").alias(c), "m", F.col("set").alias(d)) for c, d in (("a", "x"), ("b", "y")))
    return map_arrow(left.join(first, ["a", "m"]).join(second, ["b", "m"]).select("a", "b", "m", "x", "y"), run, f"a {kind}, b {kind}").distinct()


def _prefix_pairs(full: DataFrame, component: DataFrame, measures: list[Measure]) -> DataFrame:
    """Exactly the pairs (a, b, m) of different components that can reach a similarity: they share one of their rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in enumerate(batch.column("set").to_pylist()):
                x = np.frombuffer(s, np.int64)
                if len(x):
                    one = lambda c: batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(x), np.int32)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([one("id"), one("m"), one("component"), pa.array(np.full(len(x), len(x), np.int64)), pa.array(x)], names=["id", "m", "component", "n", "shingle"])

    kind = full.schema["id"].dataType.simpleString()
    rows = map_arrow(full.join(component, "id").select("id", "m", "component", "set"), run, f"id {kind}, m int, component {kind}, n long, shingle long")
    count = rows.groupBy("m", "shingle").agg(F.count("*").alias("df"))
    w = Window.partitionBy("id", "m")
    # of n shingles, ceil(percent n / 100) at least are shared: one of the first n - that + 1 then is, too
    prefix = rows.join(count.where("df > 1"), ["m", "shingle"], "left").withColumn("_r", F.row_number().over(w.orderBy(F.coalesce("df", F.lit(1)), "shingle")))
    prefix = prefix.where(f"_r <= n - ceil({_percent(measures, 'm')} * n / 100) + 1 and df is not null").select("id", "m", "component", "n", "shingle")
    mixed = prefix.groupBy("m", "shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("m", "shingle")
    some = prefix.join(mixed, ["m", "shingle"]).drop("n").join(full.drop("set"), ["id", "m"])
    x, y = some.alias("x"), some.alias("y")
    on = F.expr(f"x.shingle = y.shingle and x.m = y.m and x.id < y.id and x.component <> y.component and {_may_link('x', 'y', _percent(measures, 'x.m'))}")
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x.m").distinct()


def _split(entry: DataFrame, part: DataFrame | None) -> DataFrame:
    """(key, id, m, n, c, component): the members of keys that are in more than one component."""
    if part is None:
        return entry.withColumn("component", F.col("id"))
    member = entry.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return member.join(split, "key")


def _alike(n: str, m: str, percent: str) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _pivot_pairs(member: DataFrame, turn: int, measures: list[Measure]) -> DataFrame:
    """(a, b, m): each member with one member of its key, the same for all of the key, if that is in another component."""
    pivot = member.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n", "component")).alias("p"))
    df = member.join(pivot.select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.component").alias("other")), "key")
    df = df.where("component <> other").where(_alike("n", "pivot_n", _percent(measures, "m")))
    return df.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), "m").distinct()


def _all_pairs(member: DataFrame, measures: list[Measure]) -> DataFrame:
    """(a, b, m): all pairs of different components within keys."""
    x, y = member.alias("x"), member.alias("y")
    on = F.expr(f"x.key = y.key and x.m = y.m and x.id < y.id and x.component <> y.component and {_alike('x.n', 'y.n', _percent(measures, 'x.m'))}")
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), "x.m").distinct()


def classes(docs: DataFrame, text_col: str = "text", size: int = 3, percent: int = 85, bucket: int = BUCKET, turns: int = TURNS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    return classes_by_any(docs, [Measure(size, percent)], text_col, bucket, turns)


def classes_by_any(docs: DataFrame, measures: list[Measure], text_col: str = "text", bucket: int = BUCKET, turns: int = TURNS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs, linked where any of the measures links; n_shingles is the first measure's."""
    spark = docs.sparkSession
    swept(spark)
    rows = saved(_sketch(docs, text_col, measures), "sketch")
    groups, buckets = [], []
    for m in range(len(measures)):
        one = rows.select("doc_id", F.col(f"n{m}").alias("n"), F.col(f"k{m}").alias("k1"), F.col(f"l{m}").alias("k2"), F.col(f"keys{m}").alias("keys"))
        group = one.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
        group = saved(group.where("rep is not null"), "groups")
        groups.append(group)
        # equal rows of one doc_id give the same keys
        own = one.join(group.select(F.col("rep").alias("doc_id"), "n", "k1", "k2"), ["doc_id", "n", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "n", "k1", "k2"])
        some = own.select(F.col("doc_id").alias("id"), F.lit(m).alias("m"), "n", F.explode("keys").alias("key"))
        many = some.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
        buckets.append(saved(some.join(many, "key"), "buckets"))
        swept(spark)
    entry = reduce(DataFrame.unionByName, buckets)
    full = saved(_full_sets(docs, entry.select("id").distinct(), text_col, measures), "sets")
    swept(spark)

    def of_group(df: DataFrame, m: int, name: str) -> DataFrame:
        """df, which has the sketch's columns, with the representative by measure m (null: none)."""
        return df.join(groups[m].toDF(f"n{m}", f"k{m}", f"l{m}", name), [f"n{m}", f"k{m}", f"l{m}"], "left")

    links, part = None, None
    old: list[DataFrame] = []  # tables that nothing reads in the end
    for m in range(1, len(measures)):
        # a row's representatives by different measures are one document's
        tie = of_group(of_group(rows.drop(*(f"keys{k}" for k in range(len(measures)))), 0, "a"), m, "b").where("a <> b").select("a", "b").distinct()
        old.append(tie := saved(tie, "ties"))
        links = tie if links is None else links.unionByName(tie)
    for turn in range(turns):
        found = saved(_confirmed(_pivot_pairs(_split(entry, part), turn, measures), full, measures), "confirmed")
        swept(spark)
        old.append(found)
        if found.isEmpty() and (turn or links is None):
            break
        links = found if links is None else links.unionByName(found)
        old.append(part)
        part = saved(components(links), "components")
    # the rest, exactly: pairs of keys whose members are still in more than one component
    member = saved(_split(entry, part), "rest")
    if not member.isEmpty():
        pairs = _all_pairs(member.where(F.col("c") <= bucket), measures)
        large = saved(member.where(F.col("c") > bucket).select("id", "component").distinct(), "rest-large")
        if not large.isEmpty():
            pairs = pairs.unionByName(_prefix_pairs(full, large, measures)).distinct()
        found = saved(_confirmed(pairs, full, measures), "rest-links")
        old += [large, found]
        if not found.isEmpty() or (part is None and links is not None):
            old.append(part)
            part = saved(components(found if links is None else links.unionByName(found)), "components")
    elif part is None and links is not None:
        part = saved(components(links), "components")
    dropped(*buckets, full, member, *old)
    swept(spark)
    out = of_group(rows.select("doc_id", "n0", "k0", "l0"), 0, "rep")
    if part is None:
        out = out.withColumn("component_id", F.col("rep"))
    else:
        out = out.join(part.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    own_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n0").alias("n_shingles"), own_id.alias("component_id"), F.coalesce(F.col("doc_id") == own_id, own_id.isNull()).alias("kept"))
