"""Chat formatting by a prefix tree.

Conversations that begin with the same turns share these turns' nodes. The tree is emitted depth-first, as one stream: each
node's segment stands once in it, with position ids that count from the root of its own path, and with the intervals of
the stream that it may attend to besides itself, which are those of its ancestors.

Conversations are sorted by the hashes of their turns, over ranges of these; each task keeps one path at a time and emits what
differs from the conversation before. The first conversation of a range may share turns with the last one of the range before: these nodes are
emitted twice at first, and a second pass drops them, leads what refers to them to the nodes that stay, and turns a range's offsets into
the stream's. It takes the first and the last path of each range to the driver, no more. So every prefix stands
once, and none, however common, gathers in one task.

The template: `<|start|>role<|sep|>text<|end|>`. Within roles and texts a backslash is doubled, and one is put into
every control string, after its first character; taking backslashes away again is exact.

Units are tokens if a vocabulary is given, else code points. Defined results: null roles and texts are empty; turns are ordered by turn, role, text
(nulls first); repeated turns stay; a null conv_id is a conversation of its own. Turns are told apart by 128 bits. Other columns of the input are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, saved

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Beginnings and ends of control strings of this and other common templates, as a first character and what follows.
CONTROL = [("<", "|"), ("|", ">"), ("<", "s>"), ("<", "/s>"), ("[", "INST]"), ("[", "/INST]"), ("<", "<SYS>>"), ("<", "</SYS>>")]
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(a)}(?={re.escape(b)})" for a, b in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|start\|>(.*?)<\|sep\|>(.*?)<\|end\|>", re.S)
TRAINED = "assistant"

def escape(text: str) -> str:
    """No control string is left; unescape() gives the text again."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0]}\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands behind it."""
    return f"{START}{escape(role)}{SEP}", escape(text), END


def segment(role: str, text: str) -> str:
    return "".join(parts(role, text))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, path): the ordered turns of each conversation, and their hashes.

    A conversation is one record, as a document is: its turns meet in one task.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    df = conversations.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    return df.withColumn("path", F.transform("turns", lambda t: F.unhex(F.md5(F.concat_ws(":", F.length(t.role).cast("string"), t.role, t.text)))))


class Units:
    """What offsets count: tokens of a vocabulary (file name at the workers, pattern), or code points."""

    def __init__(self, vocabulary: tuple[str, str] | None) -> None:
        self.encoder = bpe.Encoder(bpe.load_ranks(SparkFiles.get(vocabulary[0])), vocabulary[1]) if vocabulary else None

    def sizes(self, pieces: tuple[str, str, str]) -> tuple[list[int] | None, list[int]]:
        """(ids, sizes of the pieces); each piece is encoded on its own."""
        if self.encoder is None:
            return None, [len(p) for p in pieces]
        ids = [self.encoder.encode(p) for p in pieces]
        return [i for x in ids for i in x], [len(x) for x in ids]

    def text(self, node: dict) -> tuple[str, str | None]:
        """(segment, text under the loss mask) of an emitted node."""
        a, b = (None, None) if node["loss_start"] is None else (node["loss_start"] - node["start"], node["loss_end"] - node["start"])
        if self.encoder is None:
            return node["segment"], None if a is None else node["segment"][a:b]
        decode = lambda ids: self.encoder.decode(ids).decode(errors="replace")
        return decode(node["ids"]), None if a is None else decode(node["ids"][a:b])


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NODE = {
    "start": pa.int64(), "end": pa.int64(), "parent": pa.int64(), "depth": pa.int32(), "position": pa.int64(), "role": pa.string(), "segment": pa.string(), "ids": pa.list_(pa.int32()),
    "positions": pa.list_(pa.int32()), "loss_start": pa.int64(), "loss_end": pa.int64(), "attends": _INTERVALS,
}
#: What a task emits: nodes; conversations, with the starts of their nodes; and its first and last path. Offsets count from the range's begin.
_ROW = {"kind": pa.string(), "part": pa.int32(), **_NODE, "conv_id": pa.int64(), "nodes": pa.list_(pa.int64()), "path": pa.list_(pa.binary())}
_ROWS_SCHEMA = (
    "kind string, part int, start long, end long, parent long, depth int, position long, role string, segment string, ids array<int>, positions array<int>, "
    "loss_start long, loss_end long, attends array<struct<start:long,end:long>>, conv_id long, nodes array<long>, path array<binary>"
)
_OUT_ROWS = 512


def _rows(rows: list[dict], schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(schema.items())))


class _Walk:
    """The path at hand of one range, and the rows emitted for it."""

    def __init__(self, part: int, units: Units) -> None:
        self.part, self.units, self.end = part, units, 0
        self.path: list[tuple[bytes, dict]] = []  # (hash, node) from the root down
        self.first: list[tuple[bytes, dict]] | None = None

    def add(self, conv_id, turns: list[dict], path: list[bytes]) -> list[dict]:
        same, out = 0, []
        while same < min(len(path), len(self.path)) and self.path[same][0] == path[same]:
            same += 1
        del self.path[same:]
        for t, h in zip(turns[same:], path[same:], strict=True):
            up = self.path[-1][1] if self.path else None
            pieces = parts(t["role"], t["text"])
            ids, (before, body, behind) = self.units.sizes(pieces)
            attends = []
            if up:
                attends = [*up["attends"]]
                if attends and attends[-1]["end"] == up["start"]:
                    attends[-1] = {"start": attends[-1]["start"], "end": up["end"]}
                else:
                    attends.append({"start": up["start"], "end": up["end"]})
            start, n = self.end, before + body + behind
            position = up["position"] + up["end"] - up["start"] if up else 0
            loss = t["role"] == TRAINED
            node = {
                "kind": "node", "part": self.part, "start": start, "end": start + n, "parent": up["start"] if up else None, "depth": len(self.path), "position": position, "role": t["role"],
                "segment": "".join(pieces) if ids is None else None, "ids": ids, "positions": None if ids is None else list(range(position, position + n)),
                "loss_start": start + before if loss else None, "loss_end": start + before + body if loss else None, "attends": attends,
            }
            self.end += n
            self.path.append((h, node))
            out.append(node)
        self.first = [*self.path] if self.first is None else self.first
        out.append({"kind": "conversation", "part": self.part, "conv_id": conv_id, "nodes": [node["start"] for _, node in self.path]})
        return out

    def ends(self) -> list[dict]:
        """The first and the last path, with the bounds of their nodes."""
        bounds = lambda p: [{"start": n["start"], "end": n["end"]} for _, n in p]
        return [{"kind": k, "part": self.part, "end": self.end, "path": [h for h, _ in p], "attends": bounds(p)} for k, p in (("first", self.first or []), ("last", self.path))]


class _Range(NamedTuple):
    base: int  # where the range's own nodes begin in the stream
    twice: int  # units at the range's begin that the range before has emitted
    stays: list[tuple[int, int]]  # where those nodes are in the stream, with their own
    was: list[tuple[int, int]]  # bounds in the range

    def place(self, at: int | None) -> int | None:
        """Where a node that begins at a place of the range begins in the stream."""
        if at is None:
            return None
        if at >= self.twice:
            return self.base + at - self.twice
        return self.stays[[s for s, _ in self.was].index(at)][0]

    def intervals(self, given: list[dict]) -> list[dict]:
        out: list[dict] = []
        for x in given:
            s, e = x["start"], x["end"]
            found = [stay for stay, was in zip(self.stays, self.was, strict=True) if was[0] >= s and was[1] <= e]
            if e > self.twice:
                found.append((self.base + max(s, self.twice) - self.twice, self.base + e - self.twice))
            for a, b in found:
                if out and out[-1]["end"] == a:
                    out[-1]["end"] = b
                else:
                    out.append({"start": a, "end": b})
        return out


def _ranges(ends: list) -> dict[int, _Range]:
    """What each range needs to know, from the first and last paths of all."""
    known: dict[int, dict[str, dict]] = {}
    for r in ends:
        known.setdefault(r["part"], {})[r["kind"]] = r
    out, base, stack = {}, 0, []  # stack: (hash, start, end) in the stream of the path at hand
    for part in sorted(known):
        first, last = known[part]["first"], known[part]["last"]
        same = 0
        while same < min(len(stack), len(first["path"])) and stack[same][0] == bytes(first["path"][same]):
            same += 1
        was = [(x["start"], x["end"]) for x in first["attends"][:same]]
        r = _Range(base, was[-1][1] if was else 0, [(s, e) for _, s, e in stack[:same]], was)
        place = lambda x, r=r: (r.place(x["start"]), r.place(x["start"]) + x["end"] - x["start"])
        stack = [(bytes(h), *place(x)) for h, x in zip(last["path"], last["attends"], strict=True)]
        out[part] = r
        base += last["end"] - r.twice
    return out


class Tree(NamedTuple):
    """nodes: (start, end, parent, depth, position, role, segment, ids, positions, loss_start, loss_end, attends); conversations: (conv_id, nodes).

    start, end, loss_start, loss_end and attends are offsets into the stream; nodes are known by their start, parent is one, and conversations list theirs from the root down. With
    a vocabulary ids are the segment's tokens and positions their position ids; without, segment is the text, and position that of its first character.
    """

    nodes: DataFrame
    conversations: DataFrame
    vocabulary: tuple[str, str] | None


def format_tree(conversations: DataFrame, vocabulary: tuple[str, str] | None = None) -> Tree:
    """The prefix tree of all conversations; vocabulary: (file of ranks, pattern)."""
    spark = conversations.sparkSession
    if vocabulary:
        spark.sparkContext.addFile(vocabulary[0])
        vocabulary = (vocabulary[0].rsplit("/", 1)[-1], vocabulary[1])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        walk, out = _Walk(TaskContext.get().partitionId(), Units(vocabulary)), []
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                out += walk.add(one.column("conv_id")[0].as_py(), one.column("turns")[0].as_py(), one.column("path")[0].as_py())
                if len(out) >= _OUT_ROWS:
                    yield _rows(out, _ROW)
                    out = []
        if walk.first is not None:
            yield _rows(out + walk.ends(), _ROW)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths(conversations).repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns", "path")
    rows = saved(map_arrow(ordered, emit, _ROWS_SCHEMA), "chat")
    ranges = _ranges(rows.where("kind in ('first', 'last')").select("kind", "part", "end", "path", "attends").collect())  # two paths a range

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                r = ranges[x.pop("part")]
                if x["start"] >= r.twice:
                    move = r.base - r.twice
                    for c in ("start", "end", "loss_start", "loss_end"):
                        x[c] = None if x[c] is None else x[c] + move
                    out.append(x | {"parent": r.place(x["parent"]), "attends": r.intervals(x["attends"])})
            if out:
                yield _rows(out, _NODE)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"conv_id": x["conv_id"], "nodes": [ranges[x["part"]].place(s) for s in x["nodes"]]} for x in batch.to_pylist()]
            yield _rows(out, {"conv_id": pa.int64(), "nodes": pa.list_(pa.int64())})

    own = [*_NODE]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in own)
    return Tree(
        map_arrow(rows.where("kind = 'node'").select("part", *own), nodes, schema),
        map_arrow(rows.where("kind = 'conversation'").select("part", "conv_id", "nodes"), members, "conv_id long, nodes array<long>"),
        vocabulary,
    )


def read_back(tree: Tree) -> DataFrame:
    """(conv_id, formatted, turns, loss): conversations from the emitted nodes, whatever the order of rows.

    formatted is what the nodes of a conversation hold; turns are parsed from it, and loss are the parts under the loss mask, unescaped.
    """
    vocabulary = tree.vocabulary

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(vocabulary)
        for batch in batches:
            found = [units.text(x) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["start", "said", "loss"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, found in zip(batch.column("conv_id").to_pylist(), batch.column("found").to_pylist(), strict=True):
                whole = "".join(x["said"] for x in found)
                out.append({"conv_id": conv_id, "formatted": whole, "turns": [{"role": unescape(a), "text": unescape(b)} for a, b in _TURN.findall(whole)], "loss": [unescape(x["loss"]) for x in found if x["loss"] is not None]})
            yield _rows(out, {"conv_id": pa.int64(), "formatted": pa.string(), "turns": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), "loss": pa.list_(pa.string())})

    node = map_arrow(tree.nodes.select("start", "segment", "ids", "loss_start", "loss_end"), texts, "start long, said string, loss string")
    place = tree.conversations.select("conv_id", F.posexplode("nodes").alias("at", "start"))
    found = place.join(node, "start").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "said", "loss"))).alias("found"))
    return map_arrow(found, run, "conv_id long, formatted string, turns array<struct<role:string,text:string>>, loss array<string>")
