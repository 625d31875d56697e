"""Byte-level BPE encoding and decoding as monoid tree reductions.

The elements of the monoid are texts with their encodings. A text of more than LEAF characters is halved, both halves are
encoded on their own, and the encodings are joined: a window around the boundary is encoded anew, which reaches back to
a *seam* of the left half and ahead to a seam of the right one, and takes the place of the tokens that it covers. A
seam is a place where a piece of the tokenizer's pattern begins whatever stands on either side of the two characters
that make it: white space after a letter, digit or mark, a mark after a letter or digit, a digit after a letter or a letter
after a digit. No piece crosses such a place, pieces before it are decided without what follows, and the pattern never looks back; so the
tokens before the first seam and behind the second one are final. If there is no seam within reach, the reach doubles;
at worst the window is all of both halves. Leaves and windows are encoded by the library's merge loop. A window of more than
WINDOW characters is cut into its pieces first, and a piece of more than WINDOW bytes is a tree again: its halves'
tokens are joined by encoding the tokens next to the boundary anew, ever more of them, until the pairs at the edges of that window are compatible
(encoding the bytes of the two tokens gives these two again): tokens are the encoding of their bytes exactly if all neighbours are compatible.

Decoding maps ids to bytes and concatenates halves up a tree.

Defined results: null and empty texts have no tokens and decode to no bytes. Bytes that are no UTF-8 count as U+FFFD. No special tokens
are made. Ids outside the vocabulary make decoding raise KeyError. Columns `ids` and `n_tokens` of the input are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import map_arrow, sliced, with_fields

#: Characters of a leaf of the tree, at most, and ids of a leaf when decoding.
LEAF, LEAF_IDS = 128, 512
WINDOW = 1 << 16
#: Characters on either side of a boundary that are searched for a seam at first.
REACH = 24
#: Letters and marks that all versions of Unicode agree on: libraries differ in the rest.
_LETTER = (
    "a-zA-ZÀ-ÖØ-öø-ɏΑ-Ρα-ωЀ-ҁא-תء-غف-ي"
    "ऄ-हก-ะぁ-ゖァ-ヺ一-龥가-힣"
)
_MARK = r"!-/:-@\[-`{-~，。、！？：；（）「」"
SEAM = re.compile(rf"(?<=[{_LETTER}0-9{_MARK}])(?=[ \t\n])|(?<=[{_LETTER}0-9])(?=[{_MARK}])|(?<=[{_LETTER}])(?=[0-9])|(?<=[0-9])(?=[{_LETTER}])")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 token, blank, rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes and decodes by the given ranks and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF) -> None:
        self.tokens = {i: b for b, i in ranks.items()}
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ordinary, self.merge = library.encode_ordinary, library._encode_single_piece
        self.pattern = regex.compile(pattern)
        self.leaf = max(leaf, 1)

    # one piece

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        return self.merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of one piece, from those of its two parts."""
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(b"".join([self.tokens[t] for t in left[a:] + right[:b]]))
            if (not a or self.compatible(left[a - 1], window[0])) and (b == len(right) or self.compatible(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    def piece(self, data: bytes) -> list[int]:
        """The encoding of one piece, by halves."""
        if len(data) <= WINDOW:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    # texts

    def base(self, text: str) -> list[int]:
        """The encoding of a leaf or a window."""
        if len(text) <= WINDOW:
            return self.ordinary(text)
        return [i for m in self.pattern.finditer(text) for i in self.piece(m[0].encode())]

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The monoid's product: the encoding of left + right, from those of both."""
        if not left or not right:
            return a or b
        reach = REACH
        while True:
            # a seam needs the character before it, too
            low, high = max(0, len(left) - reach), min(len(right), reach)
            begin = next((m.start() for m in SEAM.finditer(left, low) if m.start()), 0 if low == 0 else None)
            end = next((m.start() for m in SEAM.finditer(right, 1, min(high + 1, len(right)))), len(right) if high == len(right) else None)
            if begin is not None and end is not None:
                break
            reach *= 2
        tail, head = self.base(left[begin:]) if begin else a, self.base(right[:end]) if end < len(right) else b
        return a[: len(a) - len(tail)] + self.base(left[begin:] + right[:end]) + b[len(head) :]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, by halves."""
        if len(text) <= self.leaf:
            return self.base(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, by halves."""
        if len(ids) <= LEAF_IDS:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _ship(df: DataFrame, path: str) -> str:
    """Brings the vocabulary file to all executors; it has a fixed size (under a MB)."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_tokens and ids (array<int>) of the whole text; without the text if keep_text is false."""
    name = _ship(docs, vocabulary)
    df = docs.drop("n_tokens", "ids")
    schema = with_fields(df, "n_tokens long, ids array<int>", () if keep_text else (text_col,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(load_ranks(SparkFiles.get(name)), pattern)
        for batch in batches:
            for part, texts in sliced(batch, text_col):
                ids = [e.encode(t.decode(errors="replace")) for t in texts]
                kept = [n for n in part.schema.names if keep_text or n != text_col]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=[*kept, "n_tokens", "ids"])

    return map_arrow(df, run, schema)


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """docs with `bytes`, what the ids stand for."""
    name = _ship(docs, vocabulary)
    df = docs.drop("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(load_ranks(SparkFiles.get(name)), pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [e.decode(i or []) for i in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "bytes"])

    return map_arrow(df, run, with_fields(df, "bytes binary"))


def digests(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs, without the text, with n_tokens, ids_sha256 and decoded_sha256: encodes each text and decodes its ids, without moving ids."""
    name = _ship(docs, vocabulary)
    df = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    schema = with_fields(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", (text_col,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(load_ranks(SparkFiles.get(name)), pattern)
        for batch in batches:
            for part, texts in sliced(batch, text_col):
                many, said, decoded = [], [], []
                for t in texts:
                    ids = e.encode(t.decode(errors="replace"))
                    many.append(len(ids))
                    said.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(e.decode(ids)).hexdigest())
                kept = [n for n in part.schema.names if n != text_col]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + [pa.array(many, pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())], names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(df, run, schema)
