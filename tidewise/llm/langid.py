"""Language identification by a byte convolutional network, trained in numpy.

A text is lower-cased, encoded as UTF-8 and cut into windows of ``WINDOW`` bytes (all of them, the last
one padded).  Filters of several widths slide over a window; as inputs are bytes, a filter is a
table of values by place and byte.  The maximum of each filter over the window goes through a softmax layer.
A document's probabilities are the mean over its windows, weighted by their bytes.

The network is fitted on a bounded sample: about ``docs_per_lang`` documents a language, fewer where there are so many languages
that these would be over ``MAX_TRAIN_DOCS`` (chosen by a hash of the id, crc32(id as text) mod 5 not 0), and
``WINDOWS_PER_DOC`` windows of each, spaced over the whole text.  Every language of the sample is learned.

Defined results: null texts and texts without a letter are ``und`` with score 0; null langs teach nothing;
without any labelled document everything is ``und``; null ids are held out; repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.quality import held_out
from tidewise.plans.scratch import Scratch, join_checked

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DOCS_PER_LANG = 600
WINDOWS_PER_DOC = 4
#: Documents of the sample at most, shared by all languages.
MAX_TRAIN_DOCS = 20_000
_CHUNK = 128


def windows(text: str | None) -> np.ndarray:
    """All windows of a text, one a row, padded with zero bytes."""
    raw = np.frombuffer((text or "").lower().encode(), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


class ByteCnn:
    """Filter tables by width, and a softmax layer."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False):
        """Maxima of all filters, and the places of these if asked for."""
        top, places = [], []
        for w, t in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - w + 1
            conv = t[0][x[:, :n]]
            for j in range(1, w):
                conv += t[j][x[:, j : n + j]]
            if where:
                at = conv.argmax(1)
                places.append(at)
                top.append(np.take_along_axis(conv, at[:, None, :], 1)[:, 0])
            else:
                top.append(conv.max(1))
        return np.concatenate(top, 1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), _CHUNK):
            z = np.tanh(self.pooled(x[i : i + _CHUNK])[0]) @ self.dense + self.bias
            e = np.exp(z - z.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.02, seed: int = 7) -> None:
        """Adam on the cross-entropy; gradients reach a filter's table at the place of its maximum only."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.dense, self.bias]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 64):
                xb, yb = x[order[i : i + 64]], y[order[i : i + 64]]
                raw, places = self.pooled(xb, where=True)
                a = np.tanh(raw)
                z = a @ self.dense + self.bias
                e = np.exp(z - z.max(1, keepdims=True))
                dz = e / e.sum(1, keepdims=True)
                dz[np.arange(len(yb)), yb] -= 1
                dz /= len(yb)
                da = (dz @ self.dense.T) * (1 - a * a)
                grads, rows, cols = [], np.arange(len(xb))[:, None], np.arange(FILTERS)[None]
                for k, (w, t) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g = np.zeros_like(t)
                    for j in range(w):
                        np.add.at(g[j], (xb[rows, places[k] + j], np.broadcast_to(cols, places[k].shape)), da[:, k * FILTERS : (k + 1) * FILTERS])
                    grads.append(g)
                grads += [a.T @ dz, dz.sum(0)]
                step += 1
                for p, g, mi, vi in zip(params, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.01 * (g * g - vi)
                    p -= (rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def sample_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int) -> tuple[np.ndarray, list[str]]:
    """Windows and langs of the bounded training sample."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    rows = rows.filter(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count()
    docs_per_lang = min(docs_per_lang, max(1, MAX_TRAIN_DOCS // max(1, counts.count())))
    shares = counts.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(float(docs_per_lang)) / F.col("count")).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang")), F.lit(2**31)) / F.lit(float(2**31))
    shares = Scratch(docs.sparkSession, "langid").write(shares, "shares")
    picked = join_checked(rows, shares, F.col("lang") == F.col("l")).filter(place < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = windows(text)
                for i in sorted(set(np.linspace(0, len(x) - 1, WINDOWS_PER_DOC).astype(int))):
                    langs.append(lang)
                    out.append(x[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    got = picked.mapInArrow(run, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    return np.stack([np.frombuffer(w, np.uint8) for w in got["window"]]) if len(got) else np.zeros((0, WINDOW), np.uint8), got["lang"].tolist()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> ByteCnn | None:
    x, y = sample_windows(docs, id_col, text_col, lang_col, docs_per_lang)
    if not y:
        return None
    langs = sorted(set(y))
    model = ByteCnn(langs)
    model.fit(x, np.array([langs.index(v) for v in y]))
    return model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, id_col, text_col, lang_col, docs_per_lang)
    src = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike("\\p{L}"), F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for i, text in enumerate(texts):
                if text is None or model is None:
                    continue
                x = windows(text)
                p = (x != 0).sum(1) @ model.probabilities(x)
                k = int(p.argmax())
                langs[i], scores[i] = model.langs[k], float(min(1.0, p[k] / max(1e-9, p.sum())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
