"""Quality classifier: a generalised additive model with pairwise interactions over features of a text.

Each feature has a lookup table over its bins, learned by cyclic boosting: in each round the features take turns,
and each adds a shallow tree of its own bins to its table. The pairs of features whose bins explain most of what is
left then get tables of two dimensions the same way. A text's score is the sum of the table entries of its bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .labelled import held_out, sample

#: At most so many labelled rows are learned from.
TRAIN_ROWS = 20_000
MODULUS, REST, THRESHOLD = 3, 1, 0.5
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAF = 48, 120, 60, 8, 0.1, 8

FEATURES = ("size", "words", "word_size", "upper", "digit", "space", "stop_marks", "other_marks", "beyond_ascii", "varied_words", "top_word", "stutter", "varied_pairs", "lines", "varied_lines", "line_words", "marked_words", "control")
_CLASS = np.zeros((256, 8))
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c, 0 if "A" <= _ch <= "Z" else 1 if "0" <= _ch <= "9" else 2 if _ch in " \t\n\r\x0b\x0c" else 3 if _ch in ".,;:'\"()-?" else 4 if _c >= 0x80 else 7 if "a" <= _ch <= "z" else 6 if _c < 0x20 or _c == 0x7F else 5] = 1
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def features(data: bytes) -> list[float]:
    """Numbers that describe a whole text, given as UTF-8; all are finite, for an empty text too."""
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    upper, digit, space, stops, beyond, marks, control, _ = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / n).tolist()
    words = data.split()
    k = max(1, len(words))
    counts: dict[bytes, int] = {}
    get = counts.get
    for w in words:
        counts[w] = get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - space * n) / k, upper, digit, space, stops, marks, beyond,
        len(counts) / k ** 0.8, max(counts.values(), default=0) / k, sum(map(eq, words, words[1:])) / k, len({*zip(words, words[1:])}) / k,
        float(np.log1p(len(lines))), len({*lines}) / m, len(words) / m, sum(1 for w in counts if w[-1] in _MARKS) / max(1, len(counts)), control,
    ]


@dataclass
class AdditiveModel:
    """score = base + a table entry for each feature's bin + one for each chosen pair's bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values for each bin of the best tree of this depth over one ordered feature."""
    out = np.full(len(g), float(_step(g.sum(), h.sum())))
    if not depth or len(g) < 2:
        return out
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
    gain[(left_n < LEAF) | (n.sum() - left_n < LEAF)] = -1
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + 1) + 1e-9:
        return out
    out[:at], out[at:] = _shallow_tree(g[:at], h[:at], n[:at], depth - 1), _shallow_tree(g[at:], h[at:], n[at:], depth - 1)
    return out


def _cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Values for each pair of bins of the best two cuts, one in each feature; and what they gain."""
    cg, ch, cn = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h, n))
    gain, parts = 0.0, []
    for pick in range(4):
        def quarter(c: np.ndarray) -> np.ndarray:
            a, rows, cols, whole = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
            return (a, rows - a, cols - a, whole - rows - cols + a)[pick]

        q = quarter(cg), quarter(ch), quarter(cn)
        parts.append(q)
        gain = gain + np.where(q[2] >= LEAF, q[0] ** 2 / (q[1] + 1), 0)
    if not np.size(gain):
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    for (qg, qh, qn), where in zip(parts, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))), strict=True):
        if qn[i, j] >= LEAF:
            out[where] = _step(qg[i, j], qh[i, j])
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """x: rows of features; y: 0 or 1. Without both labels the model is the labels' mean alone, 0.5 where there are none."""
    model = AdditiveModel()
    n = len(y)
    mean = (y.sum() + 0.5) / (n + 1)
    model.base = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    counts = [np.bincount(b[:, j], minlength=s) for j, s in enumerate(sizes)]
    model.tables = [np.zeros(s) for s in sizes]
    f = np.full(n, model.base)
    for _ in range(ROUNDS):
        for j, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-f))
            tree = RATE * _shallow_tree(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s), counts[j])
            model.tables[j] += tree
            f += tree[b[:, j]]
    p = 1 / (1 + np.exp(-f))

    def grids(i: int, j: int, p: np.ndarray) -> list[np.ndarray]:
        cell, shape = b[:, i] * sizes[j] + b[:, j], (sizes[i], sizes[j])
        return [np.bincount(cell, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p), np.ones(n))]

    ranked = sorted(((-_cross(*grids(i, j, p))[1], i, j) for i, j in combinations(range(len(sizes)), 2) if min(sizes[i], sizes[j]) > 1))
    model.pairs = [(i, j) for _, i, j in ranked[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            p = 1 / (1 + np.exp(-f))
            tree = RATE * _cross(*grids(i, j, p))[0]
            t += tree
            f += tree[b[:, i], b[:, j]]
    return model


def _features_of(b: pa.RecordBatch, i: int) -> np.ndarray:
    return np.array([features(t.as_py() or b"") for t in b.column(i)], float).reshape(b.num_rows, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = TRAIN_ROWS, modulus: int = MODULUS, rest: int = REST, doc_id: str = "doc_id", text: str = "text") -> AdditiveModel:
    """Learn from at most `rows` labelled documents; only their features reach the driver."""
    chosen = sample(docs, labels, label, modulus, rest, rows, doc_id=doc_id, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_features_of(b, 0).tolist(), pa.list_(pa.float64())), b.column(1)], ["x", "label"])

    got = chosen.select(F.col("text").cast("binary"), "label").transform(mapped, run, "x array<double>, label int").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    order = np.lexsort(x.T)  # the same model in whatever order rows come
    return fit(x[order], (got["label"].to_numpy()[order] > 0).astype(float))


def score(docs: DataFrame, model: AdditiveModel, *, threshold: float = THRESHOLD, modulus: int = MODULUS, rest: int = REST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    A null text is scored as an empty one. Null ids count as held out; repeated rows are scored alike; an
    empty table gives no rows. Further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"), held_out(doc_id, modulus, rest).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(_features_of(b, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return chosen.transform(mapped, run, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, score double, predicted int")
