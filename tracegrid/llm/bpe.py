"""Exact byte-level BPE over whole texts by per-prefix dynamic programming.

For each prefix of a piece exactly one vocabulary token can end its encoding. An Aho-Corasick automaton over the
vocabulary gives, by its suffix links, every token that ends at a position; a token is the right one if it is compatible
with the stored last token of the prefix before it, i.e. if no merge of the vocabulary would have crossed the border
between the two. Following the stored tokens back from the end gives the ids. The work is linear in the text for any text,
also for one piece of millions of bytes, and no merge queue is kept.

Compatibility is decided on the trees of merges of both tokens and remembered per pair; pieces that recur, most of them,
are remembered with their ids in a table of bounded size.

Defined cases: null and empty texts give an empty list; blank texts are encoded as they are; strings of special tokens are
ordinary text; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that cuts a text into pieces for this vocabulary.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED_PIECES = 200_000
REMEMBERED_PAIRS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if printable, else one from 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A vocabulary file of the ``tokenizers`` library, ready to encode."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, pattern: str = PIECES, packed: bytes | None = None) -> None:
        import ahocorasick
        import regex

        if packed is None:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)["model"]
        else:
            model = json.loads(zlib.decompress(packed))["model"]
        byte = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        raw = {t: "".join(chr(byte[c]) for c in t) for t in vocab if all(c in byte for c in t)}
        self.rank: dict[int, int] = {vocab[t]: -1 for t in raw}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        made = {vocab[t] for t, b in raw.items() if len(b) == 1}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b] = r
            if c not in made:
                made.add(c)
                self.rank[c], self.halves[c] = r, (a, b)
        self.automaton = ahocorasick.Automaton()
        for t, b in raw.items():
            if vocab[t] in made:
                self.automaton.add_word(b, (vocab[t], len(b)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as a, b.

        Undo the merges of both tokens from the latest to the earliest. Before a merge of rank r was made, the border lay
        between smaller tokens; had these a merge that comes before r, it would have been taken. Among equal ranks the
        leftmost comes first: it wins over a merge inside b, and loses to one inside a.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, limit, ok = a, b, float("inf"), True
        while True:
            r = self.merge.get((x, y))
            if r is not None and r < limit:
                ok = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, self.halves[x][1]
            else:
                limit, y = ry + 1, self.halves[y][0]
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def encode_bytes(self, text: str) -> list[int]:
        """Ids of one piece, given as a string with one character per byte."""
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        compatible = self.compatible
        for end, (token, n) in self.automaton.iter(text):
            if size[end + 1] == 0:
                start = end + 1 - n
                if start == 0 or (size[start] and compatible(last[start], token)):
                    last[end + 1], size[end + 1] = token, n
        out, at = [], len(text)
        while at > 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for m in self.pieces.finditer(text):
            piece = m.group()
            ids = known.get(piece)
            if ids is None:
                ids = self.encode_bytes(piece.encode().decode("latin-1"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED_PIECES:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(shipped: Broadcast[tuple[str, bytes]]) -> Encoder:
    """The encoder of this process for a vocabulary that came with the job; built once for each content."""
    digest, packed = shipped.value
    if (digest, PIECES) not in _ENCODERS:
        _ENCODERS[digest, PIECES] = Encoder(packed=packed)
    return _ENCODERS[digest, PIECES]


def shipped(df: DataFrame, path: str) -> Broadcast[tuple[str, bytes]]:
    """A vocabulary file as a broadcast value, so that only the driver needs the file. It is about a megabyte, whatever the data."""
    with open(path, "rb") as f:
        raw = f.read()
    return df.sparkSession.sparkContext.broadcast((hashlib.md5(raw).hexdigest(), zlib.compress(raw, 6)))


def _lists(each: Iterable[list[int]]) -> pa.ListArray:
    each = list(each)
    offsets = np.zeros(len(each) + 1, np.int32)
    np.cumsum([len(x) for x in each], out=offsets[1:])
    flat = np.fromiter((i for x in each for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a hash of their key where the input has fewer splits than the cluster has use for.

    Encoding is bound by the processor. A large input has splits enough and is left where it lies, without a shuffle.
    """
    wanted = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted // 2 else df


def encode_table(df: DataFrame, id_col: str, text: Column, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and ids: the token ids of every text; one row per row."""
    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            ids = _lists(enc.encode(t) for t in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_table(df: DataFrame, id_col: str, text: Column, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id and n_tokens: the size of every text."""
    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = pa.array([len(enc.encode(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
