"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts.

Texts are normalised byte by byte: A-Z are lower-cased, and ASCII letters, digits and all bytes from
0x80 make words; the rest parts them. Each item gives windows of `window` consecutive words (a shorter
item is one window). The automaton reads " w1 w2 ... " once; word numbers found there lead back to
character offsets of the original text.

The automaton is broadcast in parts of at most PART_BYTES of normalised item text, whatever the size of
the benchmark: beyond one part, a document passes through one scan for each part, in one narrow stage.

Defined results: null or wordless texts have no words and no hits; items without words, or with null text
or id, have no windows; equal item ids count as one item; documents keep all their rows and columns, repeated ones
too, and the added columns replace columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sliced, with_fields

WINDOW = 10
PART_BYTES = 8 << 20
#: Bytes to normalised bytes; what parts words becomes a blank.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

CARRIED = "__aspectra_runs array<struct<start:int,end:int>>, __aspectra_items array<string>"
ADDED_NAMES = ["n_words", "n_hit", "items", "hit_spans"]
ADDED = "n_words long, n_hit long, items array<string>, hit_spans array<struct<start:int,end:int>>"


def normalise(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(text: bytes, size: int = WINDOW) -> set[bytes]:
    """The normalised windows of an item."""
    w = normalise(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def automaton(items: list[tuple[str, bytes]], size: int = WINDOW) -> ahocorasick.Automaton:
    """One automaton over the windows of (item id, text) pairs; a window knows all items that have it."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows(text, size):
            found.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in found.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    if found:
        a.make_automaton()
    return a


def scan(text: bytes, a: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, merged half-open runs of hit words, items) of a text, read once."""
    w = normalise(text)
    if not w or not len(a):
        return len(w), [], set()
    line = f" {b' '.join(w).decode('latin-1')} "
    runs: list[list[int]] = []
    items: set[str] = set()
    blanks = last = 0
    for end, (n, ids) in a.iter(line):
        items.update(ids)
        blanks += line.count(" ", last, end)
        last = end
        # `blanks` blanks stand before the closing one: that many words have ended there
        start, stop = blanks - n, blanks
        while runs and runs[-1][0] >= start:
            stop = max(stop, runs.pop()[1])
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return len(w), [(s, e) for s, e in runs], items


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as offsets into the original text, in code points."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_NORMAL))]
    # code points before each byte: those that are no continuation bytes
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[at[s][0]]), int(before[at[e - 1][1]])) for s, e in runs]


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of at most about part_bytes; an item longer than that is a list of its own.

    The driver holds one list at a time.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("i is not null and t is not null")
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > part_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, bytes(r.t)))
        size += len(r.t)
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids whose windows occur) and hit_spans (code points, end exclusive)."""
    df = docs.drop(*ADDED_NAMES)
    base = df
    sc = docs.sparkSession.sparkContext
    ahead = parts(benchmark, part_bytes=part_bytes)
    part, first = next(ahead), True
    while part is not None:
        following = next(ahead, None)
        df = map_arrow(df, _scanner(sc.broadcast(part), text_col, window, first, following is None), with_fields(base, ADDED if following is None else CARRIED))
        part, first = following, False
    return df


def _scanner(held, text_col: str, window: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(held.value, window)
        for whole in batches:
            for batch, texts in sliced(whole, text_col):
                found = [scan(t, a) for t in texts]
                runs, items = [x[1] for x in found], [sorted(x[2]) for x in found]
                if not first:
                    runs = [_merged(r, [(x["start"], x["end"]) for x in o]) for r, o in zip(runs, batch.column("__aspectra_runs").to_pylist(), strict=True)]
                    items = [sorted({*i, *o}) for i, o in zip(items, batch.column("__aspectra_items").to_pylist(), strict=True)]
                kept = [n for n in batch.schema.names if n not in ("__aspectra_runs", "__aspectra_items")]
                columns = [batch.column(n) for n in kept]
                ids = pa.array(items, pa.list_(pa.string()))
                pairs = [spans(t, r) for t, r in zip(texts, runs, strict=True)] if last else runs
                pairs = pa.array([[{"start": s, "end": e} for s, e in r] for r in pairs], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                if last:
                    columns += [pa.array([x[0] for x in found], pa.int64()), pa.array([sum(e - s for s, e in r) for r in runs], pa.int64()), ids, pairs]
                    kept += ADDED_NAMES
                else:
                    columns += [pairs, ids]
                    kept += ["__aspectra_runs", "__aspectra_items"]
                yield pa.RecordBatch.from_arrays(columns, names=kept)

    return run
