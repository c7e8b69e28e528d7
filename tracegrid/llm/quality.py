"""Per-document text statistics and the classes list, table and junk against prose.

Each text is reduced to a vector of statistics that name no language and no script (``textstats``). Gradient-boosted trees
are trained on the vectors of a bounded sample. Their labels are weak: labelling functions (``weak``) that read the texts by
rules of their own, none of which is an input of the trees, vote or abstain. The probabilities are then calibrated by vector
scaling on a hand-checked holdout (labelled documents), which takes no part in training the trees.

Bounds: at most ``SAMPLE`` vectors train the trees and at most ``HOLDOUT`` calibrate them; every document is scored.

Defined cases: null, empty and blank texts have no class and give no row; a missing or null label is not used; without
labels the probabilities stay as trained, and without a text that the functions label all are prose; ties go to prose, then
in the order of ``CLASSES``; texts of any length are read whole; repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.llm import textstats, weak
from tracegrid.llm.bpe import spread
from tracegrid.llm.weak import CLASSES, COMMON

SAMPLE = 8_000
HOLDOUT = 3_000
#: One weakly labelled text of prose in so many also trains in its variants.
VARIED = 4
NAMES = textstats.NAMES


class Trees:
    """Gradient-boosted trees for several classes over binned features (softmax loss, second-order leaves)."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, bag: float = 0.5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.bag = rounds, depth, rate, bins, ridge, bag

    def fit(self, x: np.ndarray, y: np.ndarray, k: int) -> Trees:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = self._bin(x)
        prior = (np.bincount(y, minlength=k) + 1) / (n + k)
        self.base, self.trees = np.log(prior), []
        score = np.tile(self.base, (n, 1))
        one = np.eye(k)[y]
        width = self.bins
        flat = b + np.arange(d) * width
        rng = np.random.default_rng(n)
        for _ in range(self.rounds):
            p = softmax(score)
            grown = []
            # Each round grows its trees on a part of the rows; all rows then move by them.
            bag = np.flatnonzero(rng.random(n) < self.bag) if n > 1000 else np.arange(n)
            for c in range(k):
                g, h = p[:, c] - one[:, c], np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree = self._grow(flat[bag], b[bag], g[bag], h[bag], d, width)
                score[:, c] += self._walk(tree, b)
                grown.append(tree)
            self.trees.append(grown)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1).astype(np.int64)

    def _grow(self, flat: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, d: int, width: int) -> tuple:
        n = len(g)
        node = np.zeros(n, np.int64)
        feature, at = np.full(2 ** (self.depth + 1), -1), np.zeros(2 ** (self.depth + 1), np.int64)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            live = local >= 0
            if not live.any():
                break
            key = (local[live, None] * (d * width) + flat[live]).ravel()
            gs = np.bincount(key, np.repeat(g[live], d), minlength=count * d * width).reshape(count, d, width)
            hs = np.bincount(key, np.repeat(h[live], d), minlength=count * d * width).reshape(count, d, width)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
            gain = np.where((hl > 0.5) & (ht - hl > 0.5), gain, 0).reshape(count, -1)
            pick = gain.argmax(1)
            good = gain[np.arange(count), pick] > 1e-3
            feature[first : first + count] = np.where(good, pick // width, -1)
            at[first : first + count] = pick % width
            f = feature[node]
            move = live & (f >= 0)
            right = np.zeros(n, bool)
            right[move] = b[move, f[move]] > at[node[move]]
            node = np.where(move, 2 * node + 1 + right, node)
            # Rows in nodes that do not split stay there: such a node is a leaf.
        size = 2 ** (self.depth + 1)
        gs, hs = np.bincount(node, g, minlength=size), np.bincount(node, h, minlength=size)
        value = -self.rate * gs / (hs + self.ridge)
        return feature, at, value

    def _walk(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, at, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (b[rows, np.maximum(f, 0)] > at[node]), node)
        return value[node]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.tile(self.base, (len(x), 1))
        for grown in self.trees:
            for c, tree in enumerate(grown):
                out[:, c] += self._walk(tree, b)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(scores: np.ndarray, y: np.ndarray, k: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Scale and shift of the scores that fit the holdout best (vector scaling by gradient descent, drawn to 1 and 0)."""
    a, s = np.ones(k), np.zeros(k)
    if not len(y):
        return a, s
    one = np.eye(k)[y]
    for _ in range(steps):
        e = softmax(scores * a + s) - one
        a -= 0.1 * ((e * scores).mean(0) + 0.01 * (a - 1))
        s -= 0.1 * (e.mean(0) + 0.01 * s)
    return a, s


class Model:
    """Trees with the calibration of their probabilities. y and held_y: indices of classes, -1 for none."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, held_y: np.ndarray) -> None:
        k = len(CLASSES)
        self.trees = Trees().fit(x[y >= 0], y[y >= 0], k) if (y >= 0).any() else None
        self.scale, self.shift = np.ones(k), np.zeros(k)
        if self.trees and (held_y >= 0).any():
            self.scale, self.shift = calibrate(self.trees.scores(held[held_y >= 0]), held_y[held_y >= 0], k)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.tile(np.eye(len(CLASSES))[0], (len(x), 1))
        return softmax(self.trees.scores(x) * self.scale + self.shift)


def vectors(rows: DataFrame) -> DataFrame:
    """doc_class, x, weak of every row (text, doc_class) whose text is not blank, and of variants of weakly labelled prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            keep = [i for i, t in enumerate(texts) if t and t.strip()]
            kept = [texts[i] for i in keep]
            classes = b.column(1).take(pa.array(keep, pa.int64())).to_pylist()
            # A labelled text calibrates and does not train.
            y = [weak.label(t) if c is None else -1 for t, c in zip(kept, classes, strict=True)]
            more = [v for t, k in zip(kept, y, strict=True) if k == 0 and zlib.crc32(t.encode("utf-8", "replace")) % VARIED == 0 for v in weak.varied(t)]
            x = pa.array(list(textstats.statistics(kept + more)), pa.list_(pa.float64()))
            y += [0] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(classes + [None] * len(more), pa.string()), x, pa.array(y, pa.int32())], ["doc_class", "x", "weak"])

    return rows.select("text", "doc_class").mapInArrow(run, "doc_class string, x array<double>, weak int")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text: Column, n_docs: int) -> Model:
    """The model of a corpus, from one pass over it.

    What reaches the driver are SAMPLE + 2 * HOLDOUT vectors and their variants at most. Both are picked by a hash of the id and, in that
    order, cut to the bound, so they are the same for any partitioning.
    """
    every = max(1, -(-n_docs // SAMPLE))
    known = labels.where(F.col("doc_class").isin(*CLASSES)).select(F.col(id_col).alias("_id"), "doc_class").orderBy(F.xxhash64("_id"), "_id", "doc_class").limit(HOLDOUT)
    rows = docs.select(F.col(id_col).alias("_doc"), text.alias("text")).where("text is not null").withColumn("sampled", F.pmod(F.xxhash64("_doc"), F.lit(every)) == 0)
    # The labels are bounded by HOLDOUT, so they may be broadcast.
    rows = rows.join(F.broadcast(known), F.col("_doc") == F.col("_id"), "left").where("sampled or doc_class is not null")
    picked = rows.orderBy(F.xxhash64("_doc"), "_doc", F.md5("text")).limit(SAMPLE + 2 * HOLDOUT).select("text", "doc_class", "_doc")
    found = vectors(spread(picked, "_doc")).collect()
    x = np.array([r["x"] for r in found]).reshape(-1, len(NAMES))
    y = np.array([r["weak"] for r in found], np.int64)
    held = np.array([CLASSES.index(r["doc_class"]) if r["doc_class"] else -1 for r in found], np.int64)
    return Model(x, y, x, held)


def classified(docs: DataFrame, id_col: str, text: Column, model: Model) -> DataFrame:
    """doc_id, doc_class, probability of every text that is not blank."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).where(F.col("text").isNotNull()), "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if t.strip()]
            p = model.probabilities(textstats.statistics([texts[i] for i in keep]))
            best = p.argmax(1)
            names, sure = pa.array([CLASSES[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), names, sure], ["doc_id", "doc_class", "probability"])

    return rows.mapInArrow(run, f"doc_id {kind}, doc_class string, probability double")


def statistics(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The plain statistics of every text, without Python: words, their mean length, symbols, line ends, common words.

    Null, empty and blank texts have no words and null shares.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    words, lines = F.filter(F.split("t", r"[ \t\r\n]+"), lambda w: w != ""), F.filter(F.split("t", r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0)
    rows = rows.select("doc_id", "t", words.alias("w"), lines.alias("l"))
    size = F.coalesce(F.size("w"), F.lit(0))
    n, m = F.nullif(F.size("w"), F.lit(0)), F.nullif(F.size("l"), F.lit(0))
    plain = F.transform("w", lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", "")))
    return rows.select(
        "doc_id",
        F.when(F.col("t").isNull(), 0).otherwise(size).alias("word_count"),
        F.round(F.length(F.array_join("w", "")) / n, 6).alias("mean_word_length"),
        F.round(F.length(F.regexp_replace("t", r"[\p{L}\p{N} \t\r\n]", "")) / F.nullif(F.length("t"), F.lit(0)), 6).alias("symbol_ratio"),
        F.round(F.size(F.filter("l", lambda x: F.trim(x).rlike(r"[.!?:;]$"))) / m, 6).alias("punctuated_lines"),
        F.round(F.size(F.filter(plain, lambda w: w.isin(*sorted(COMMON)))) / n, 6).alias("common_words"),
    )
