"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, greedy graph search answers queries.

Equal vectors are one node (the smallest vec_id, with the smallest ids of its class). All nodes are in one graph. Building starts
from the nearest nodes within small blocks: nodes are ordered by on which side of random hyperplanes they lie, and a block is a run
of that order. It then joins neighbours of neighbours, ROUNDS times: each node meets the neighbours
of its neighbours, in both directions, and keeps its NEIGHBOURS nearest. Vectors travel as unit vectors in single precision
there and are compared in double precision, so that near copies keep their order. Equally near neighbours are chosen
by a hash of the pair: a group of them does not crowd around a few nodes. Scores come from the original vectors in double precision.

A search starts from the nearest nodes of the blocks that the query itself falls into (of lengths with less than 2 * BLOCK nodes, from
all of these). Each step expands the WIDTH
nearest nodes not yet expanded, for all queries at once: their edges are joined, then the vectors of the nodes found
that the query has not met. Each query keeps its BEAM nearest and ends when all of them are expanded, after STEPS steps at most. A step shuffles
no more than WIDTH * 2 * NEIGHBOURS vectors a query, whatever the number of nodes; nothing is broadcast or gathered.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without vec_id; equal rows count once; an id with several vectors is found once, by the nearest of them, and asks once, with the smallest of them
(as arrays compare); vectors are compared with those of their length only; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, map_arrow, saved, swept

NEIGHBOURS, ROUNDS = 24, 3
BLOCK, DEALS, PLANES = 128, 3, 16
BEAM, WIDTH, STEPS = 384, 64, 8


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _pack(unit: np.ndarray) -> list[bytes]:
    """Unit vectors in single precision."""
    return [r.tobytes() for r in unit.astype(np.float32)]


def _unpack(rows: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))  # rounding moves lengths by more than near copies differ


def nodes(vectors: DataFrame, id_col: str, vector_col: str, members: int) -> tuple[DataFrame, DataFrame]:
    """((id, dim, vector) for each distinct vector, (id, member) with the `members` smallest ids of its class)."""
    df = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("member"), F.col(vector_col).alias("vector")).distinct()
    # the window keeps the smallest ids of a class on each task before it shuffles
    w = Window.partitionBy("vector").orderBy("member")
    few = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= members)
    few = few.withColumn("id", F.min("member").over(Window.partitionBy("vector"))).drop("_r")
    # an id with several vectors stands for the first of them; the others' nodes take numbers of their own
    several = F.dense_rank().over(Window.partitionBy("id").orderBy("vector"))
    few = few.withColumn("first", F.col("id") == F.col("member")).withColumn("id", F.when(several == 1, F.col("id")).otherwise(F.xxhash64("id", "vector")))
    few = saved(few, "ann-nodes")
    return few.where("first").select("id", F.size("vector").alias("dim"), "vector"), few.select("id", "member")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `packed` and, for each deal, the sides of its hyperplanes as a number (column `sides`)."""
    for batch in batches:
        packed: list[bytes | None] = [None] * batch.num_rows
        sides = np.zeros((batch.num_rows, DEALS), np.int32)
        rows = batch.column("vector").to_pylist()
        for d in {len(r) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r) == d]
            unit = _unit([rows[i] for i in at])
            for i, p in zip(at, _pack(unit), strict=True):
                packed[i] = p
            planes = np.random.default_rng(d).normal(size=(d, DEALS, PLANES))
            bits = np.einsum("nd,dkp->nkp", unit, planes) > 0
            sides[at] = (bits * (1 << np.arange(PLANES))).sum(2)
        names = [n for n in batch.schema.names if n != "vector"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(packed, pa.binary()), pa.array(sides.tolist(), pa.list_(pa.int32()))], names=[*names, "packed", "sides"])


def _blocks(base: DataFrame, asked: DataFrame | None, k: int) -> DataFrame:
    """(u, v, sim): for each node, or each query if there are some, the k nearest nodes of its blocks, one block for each deal.

    base: (dim, id, packed, sides, rare); asked: the same.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: pa.Table | None = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            dims = held.column("dim").to_numpy()
            at = 0
            for cut in [*(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]:
                # the last run may go on in the next batch
                while cut - at >= 2 * BLOCK or (cut < len(dims) and cut > at):
                    size = BLOCK if cut - at >= 2 * BLOCK else cut - at
                    yield held.slice(at, size)
                    at += size
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x, ids, ask = _unpack(b.column("packed").to_pylist()), b.column("id").to_numpy(), b.column("ask").to_numpy()
            to = np.flatnonzero(~ask)
            by = to if own else np.flatnonzero(ask)
            few = min(k, len(to) - own)
            if few <= 0 or not len(by):
                continue
            s = x[by] @ x[to].T
            if own:
                np.fill_diagonal(s, -9)
            at = np.argpartition(-s, few - 1, 1)[:, :few]
            u = np.repeat(np.arange(len(by)), few)
            yield pa.RecordBatch.from_arrays([pa.array(ids[by][u]), pa.array(ids[to][at.ravel()]), pa.array(s[u, at.ravel()])], names=["u", "v", "sim"])

    own, rows = asked is None, base.withColumn("ask", F.lit(False))
    if asked is not None:
        rows = rows.unionByName(asked.withColumn("ask", F.lit(True)))
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, rows.count() // (4 * BLOCK)))
    edges = []
    for deal in range(DEALS):
        keys = ["dim", "side", "h"]
        # the few nodes of a rare length have one key, so that they stay together
        d = rows.select("dim", "id", "packed", "ask", F.when(F.col("rare"), 0).otherwise(F.element_at("sides", deal + 1)).alias("side"), F.when(F.col("rare"), 0).otherwise(F.xxhash64("id", F.lit(deal))).alias("h"))
        d = d.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("dim", "id", "packed", "ask")
        edges.append(map_arrow(d, run, "u long, v long, sim double"))
    return _nearest(reduce(DataFrame.unionByName, edges).dropDuplicates(["u", "v"]), "u", k)


def _nearest(edges: DataFrame, at: str, k: int) -> DataFrame:
    w = Window.partitionBy(at).orderBy(F.desc("sim"), F.xxhash64("u", "v"))
    return edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _both_ways(graph: DataFrame) -> DataFrame:
    """(u, v): the edges of the graph and the NEIGHBOURS nearest reversed ones of each node."""
    return graph.select("u", "v").unionByName(_nearest(graph, "v", NEIGHBOURS).select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _round(graph: DataFrame, base: DataFrame) -> DataFrame:
    """One step of NN-descent: neighbours of a common node meet, and each node keeps its nearest."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("c")).select(F.col("u").alias("v"), F.when(F.col("c") >= NEIGHBOURS, F.col("least")).otherwise(-9.0).alias("least"))
    known = base.select(F.col("id").alias("v"), "packed").join(worst, "v", "left")
    meet = _both_ways(graph).join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "packed", "least")).alias("near"))  # 2 * NEIGHBOURS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for near in batch.column("near").to_pylist():
                if len(near) < 2:
                    continue
                ids = np.array([x["v"] for x in near])
                least = np.array([-9.0 if x["least"] is None else x["least"] for x in near])
                x = _unpack([x["packed"] for x in near])
                s = x @ x.T
                np.fill_diagonal(s, -9)
                if len(ids) > NEIGHBOURS + 1:
                    # more than NEIGHBOURS of these no node can keep
                    least = np.maximum(least, np.nextafter(np.partition(s, -NEIGHBOURS, 1)[:, -NEIGHBOURS], -10))
                i, j = np.nonzero(s > least[:, None])
                out.append((ids[i], ids[j], s[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["u", "v", "sim"])

    better = map_arrow(meet, run, "u long, v long, sim double")
    merged = graph.unionByName(better).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return _nearest(merged, "u", NEIGHBOURS)


class Index:
    """A graph over all vectors: base (dim, id, packed, sides), vectors (id, vector), edges (u, near), members (id, member)."""

    def __init__(self, base: DataFrame, vectors: DataFrame, edges: DataFrame, members: DataFrame) -> None:
        self.base, self.vectors, self.edges, self.members = base, vectors, edges, members


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", members: int = 6, rounds: int = ROUNDS) -> Index:
    """Indexes every usable row. members: how many ids of equal vectors a search can return."""
    node, member = nodes(vectors, id_col, vector_col, members)
    sizes = node.groupBy("dim").agg((F.count("*") < 2 * BLOCK).alias("rare"))
    base = saved(map_arrow(node.join(sizes, "dim").select("id", "dim", "rare", "vector"), _signed, "id long, dim int, rare boolean, packed binary, sides array<int>"), "ann-base")
    graph = saved(_blocks(base, None, NEIGHBOURS), "ann-graph")
    for _ in range(rounds):
        before, graph = graph, saved(_round(graph, base), "ann-graph")
        dropped(before)
        swept(base.sparkSession)
    edges = saved(_both_ways(graph).groupBy("u").agg(F.collect_list("v").alias("near")), "ann-edges")
    dropped(graph)
    return Index(base, node.select("id", "vector"), edges, member)


def step(query: np.ndarray, met: np.ndarray, sim: np.ndarray, done: np.ndarray, ids: np.ndarray, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest nodes of a query (ids, nearness, whether expanded), after nodes with unit vectors x have been met."""
    at, s, d = np.concatenate([met, ids]), np.concatenate([sim, x @ query]), np.concatenate([done, np.zeros(len(ids), bool)])
    top = np.argsort(-s, kind="stable")[:beam]
    return at[top], s[top], d[top]


_STATE = "query long, packed binary, at array<long>, sim array<double>, done array<boolean>, seen array<long>, open array<long>"


def _advance(state: DataFrame, found: DataFrame, beam: int, width: int) -> DataFrame:
    """The state after queries have met the nodes (query, v, packed) found; open: what they expand next."""
    news = found.groupBy("query").agg(F.collect_list(F.struct("v", F.col("packed").alias("x"))).alias("new"))
    df = state.select("query", "packed", "at", "sim", "done", "seen").join(news, "query", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                out = []
                for r in rows:
                    held, sim, done = np.array(r["at"], np.int64), np.array(r["sim"], float), np.array(r["done"], bool)
                    new = sorted(r["new"] or [], key=lambda n: n["v"])
                    if new:
                        held, sim, done = step(_unpack([r["packed"]])[0], held, sim, done, np.array([n["v"] for n in new]), _unpack([n["x"] for n in new]), beam)
                    open_ = np.flatnonzero(~done)[:width]
                    done[open_] = True
                    out.append({"query": r["query"], "packed": r["packed"], "at": held.tolist(), "sim": sim.tolist(), "done": done.tolist(), "seen": r["seen"] + [n["v"] for n in new], "open": held[open_].tolist()})
                yield pa.RecordBatch.from_pylist(out, batch_schema)

    batch_schema = pa.schema([("query", pa.int64()), ("packed", pa.binary()), ("at", pa.list_(pa.int64())), ("sim", pa.list_(pa.float64())), ("done", pa.list_(pa.bool_())), ("seen", pa.list_(pa.int64())), ("open", pa.list_(pa.int64()))])
    return map_arrow(df, run, _STATE)


def search(index: Index, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, width: int = WIDTH, steps: int = STEPS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of queries, but for the query's own id."""
    asked = queries.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).groupBy(F.col(id_col).alias("id")).agg(F.min(vector_col).alias("vector"))
    asked = saved(asked.withColumn("dim", F.size("vector")), "ann-queries")
    rare = index.base.select("dim", "rare").distinct()
    signed = saved(map_arrow(asked.join(rare, "dim").select("id", "dim", "rare", "vector"), _signed, "id long, dim int, rare boolean, packed binary, sides array<int>"), "ann-asked")
    entry = _blocks(index.base, signed.where("not rare"), NEIGHBOURS).select(F.col("u").alias("query"), "v")
    # of a rare length (less than 2 * BLOCK nodes) a query meets all
    every = signed.where("rare").select(F.col("id").alias("query"), "dim").join(index.base.where("rare").select("dim", F.col("id").alias("v")), "dim")
    entry = entry.unionByName(every.select("query", "v"))
    none = {"at": "array<long>", "sim": "array<double>", "done": "array<boolean>", "seen": "array<long>", "open": "array<long>"}
    state = signed.select(F.col("id").alias("query"), "packed", *(F.array().cast(t).alias(c) for c, t in none.items()))
    vectors = index.base.select(F.col("id").alias("v"), "packed")
    state = saved(_advance(state, entry.join(vectors, "v"), beam, width), "ann-state")
    for _ in range(steps):
        front = state.select("query", F.explode("open").alias("u"))
        if front.isEmpty():
            break
        near = front.join(index.edges, "u").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # width * 2 * NEIGHBOURS at most
        fresh = state.select("query", "seen").join(near, "query").select("query", F.explode(F.array_except("near", "seen")).alias("v"))
        before, state = state, saved(_advance(state, fresh.join(vectors, "v"), beam, width), "ann-state")
        dropped(before)
        swept(state.sparkSession)
    most = k + 3
    best = state.select("query", F.explode(F.slice("at", 1, most)).alias("id")).join(index.vectors, "id").join(asked.select(F.col("id").alias("query"), F.col("vector").alias("asked")), "query")
    scored = map_arrow(best.select("query", "id", "vector", "asked"), _scored, "query long, id long, score double")
    found = scored.join(index.members, "id").where("member <> query").groupBy("query", "member").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "member")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("member").alias("vec_id"), "score")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = []
        for v, a in zip(batch.column("vector").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            v, a = np.array(v, np.float64), np.array(a, np.float64)
            v, a = (np.ldexp(x, -np.frexp(np.abs(x).max())[1]) for x in (v, a))  # exact, and squares neither overflow nor vanish
            score.append(float((v * a).sum() / (np.sqrt((v * v).sum()) * np.sqrt((a * a).sum()))))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(score, pa.float64())], names=["query", "id", "score"])
