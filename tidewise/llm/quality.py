"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text gives a row of numeric features (shares of byte classes, word and line repetition,
word and line lengths).  Features are cut into quantile bins.  Training boosts in cycles: one shallow
tree on one feature at a time, each adding its leaf values to that feature's lookup table; then the pairs
of features with the strongest left-over signal get two-dimensional tables in the same way.  A
score is the logistic function of a sum of table entries, one look-up a feature and a pair.

The model is fitted on a bounded sample of labelled rows (about ``max_train_rows``, chosen by a hash of the id)
whose crc32(id as text) mod 5 is not 0; the features of all rows are computed in one pass by Spark tasks.

Defined results: null and empty texts have all features 0 and are scored like any text; null ids count as
held out (crc32 of the empty string); without labels every score is 0.5; with labels of one class only it
tends to that class; repeated rows get equal scores; extra columns are ignored (``score``) or kept
(``keep_good``).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch

FEATURES = ("log_words", "mean_word", "long_words", "upper", "digit", "symbol", "stop", "space", "line_rate", "distinct", "same_next", "top_word", "dup_lines", "odd_ends", "short_words")
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3

_UPPER, _DIGIT, _SPACE, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP[[ord(","), ord(".")]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[65:91] = _SYMBOL[97:123] = _SYMBOL[48:58] = False
_SYMBOL &= ~_STOP
_CLASSES = np.stack([_UPPER, _DIGIT, _SYMBOL, _STOP, _SPACE]).astype(np.float64)
_ODD_END = frozenset(b"!#$%&*|~^=_?;:")


def features(text: bytes) -> list[float]:
    """Features of one whole text."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(text), len(words)
    classes = (_CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)) / n
    lengths = np.fromiter(map(len, words), np.int64, m)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    odd = sum(w[-1] in _ODD_END for w in words)
    return [
        float(np.log1p(m)),
        float(lengths.mean()),
        float((lengths > 14).mean()),
        *map(float, classes),
        len(lines) / m,
        float(np.log1p(len(seen)) / np.log1p(m)),
        sum(map(operator.eq, words[1:], words)) / m,
        max(seen.values()) / m,
        1 - len(set(lines)) / len(lines),
        odd / m,
        float((lengths <= 2).mean()),
    ]


def held_out(ident: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@dataclass
class Gam:
    """Bin edges, one table a feature, and one table a pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def raw(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Leaf values by bin of a tree of ``leaves`` leaves over sums of gradients and curvatures by bin."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], a + k + 1
        if where is None:
            break
        cuts = sorted([*cuts, where])
    return np.concatenate([np.full(b - a, _leaf(g[a:b].sum(), h[a:b].sum())) for a, b in zip(cuts, cuts[1:], strict=False)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best cut of a pair of features into four quadrants."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = slice(0, -1), slice(0, -1)
    parts = [(cg[a, b], ch[a, b]), (cg[a, -1:] - cg[a, b], ch[a, -1:] - ch[a, b]), (cg[-1:, b] - cg[a, b], ch[-1:, b] - ch[a, b])]
    parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [float(_leaf(x[i, j], y[i, j])) for x, y in parts]
    table = np.empty(g.shape)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, cycles: int = 80, n_pairs: int = 6, pair_cycles: int = 30, rate: float = 0.15) -> Gam:
    """Boost in cycles over the features, then over the chosen pairs."""
    model = Gam()
    if not len(y):
        return model
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(p0 / (1 - p0)))
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1])) for c in x.T]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for j, s in enumerate(sizes):
            if s < 2:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s))
            model.tables[j] += step
            f += step[b[:, j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    all_pairs = [(i, j) for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
    model.pairs = sorted(all_pairs, key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[0])[:n_pairs]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_cycles):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            model.pair_tables[k] += step
            f += step[b[:, i], b[:, j]]
    return model


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<double>) of every whole text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, features array<double>")


def train(table: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS, label_col: str = "quality") -> Gam:
    """Fit on about ``max_train_rows`` labelled rows that are not held out (all, if there are fewer), chosen by a hash of the id."""
    marks = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    # The share is taken before the join, so that no more than the sample moves.
    share = min(1.0, max_train_rows / max(1, marks.count()))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    sample = table.join(marks.filter(place < share), "doc_id").select("features", "y").toPandas()
    x, y = np.array(sample["features"].tolist(), float).reshape(len(sample), len(FEATURES)), sample["y"].to_numpy(float)
    order = np.lexsort([y, *x.T])  # the order of rows is part of the sums
    return fit(x[order], y[order])


def apply(table: DataFrame, model: Gam, columns: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``score`` to a table with ``features`` (which it drops)."""
    names = [c for c in table.columns if c != "features"]
    at = table.columns.index("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(model.score(x), pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in names) + ", score double"
    return table.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    table = Scratch(docs.sparkSession, "quality").write(feature_table(docs, id_col, text_col), "features")
    out = apply(table, train(table, labels, max_train_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``; the columns are those of ``docs``."""
    table = Scratch(docs.sparkSession, "quality").write(feature_table(docs, id_col, text_col), "features")
    model = train(table, labels, max_train_rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()], float).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
