"""Passages of many words that stand in several documents.

A window is ``words`` consecutive words, whatever blanks stand between them.  As in the suffix index, windows are sampled by
content: in each window the gram of least hash is its anchor, and neighbouring windows with one anchor are a run.  A run that several
texts have as a whole is shared in all its windows; of other runs, those whose anchor several texts have are looked at window by
window, together with one of each of the shared runs of that anchor.  No step lists pairs, and all counts are summed before the shuffle, so a passage that a third of all documents share is no
heavy key.

Texts are known by a 128-bit hash, as in the suffix index; a text that several documents have stands in several documents as a whole.
Defined results: texts of fewer words have no passage; repeats within one document alone do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.suffix import _BYTES, _ROWS, T, _longs, _powers
from tidewise.plans.scratch import Scratch, join_checked

WORDS, GRAM_WORDS = 51, 24
WORD = "[^\\x20\\x09-\\x0D]+"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _spans(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the word hashes from each first place to each end."""
    up, down = _powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return _mixed((sums[end] - sums[first]) * down[first])


def _grams(values: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(0, len(values) - n + 1))
    return _spans(values, at, at + n)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a text."""
    arr = np.frombuffer(raw, np.uint8)
    word = ~((arr == 32) | ((arr >= 9) & (arr <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    starts, ends, out = edge[::2], edge[1::2], []
    for i in range(0, len(starts), 1 << 14):
        a, z = starts[i : i + (1 << 14)], ends[i : i + (1 << 14)]
        part = arr[a[0] : z[-1]]
        up, down = _powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * up[: len(part)], dtype=np.uint64)])
        out.append(_mixed((sums[z - a[0]] - sums[a - a[0]]) * down[a - a[0]]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def anchors(values: np.ndarray, words: int, gram: int) -> np.ndarray:
    """The hash of the anchor gram of every window of word hashes."""
    h, w = _grams(values, gram), words - gram + 1
    count = len(values) - words + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(h)] = h
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[w - 1 : w - 1 + count])


def runs(values: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor and hash (of all words) of each run."""
    g = anchors(values, words, gram)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(g)]]) - 1 if len(g) else first
    return first, last, g[first].view(np.int64), _spans(values, first, last + words).view(np.int64)


def passages(texts: DataFrame, scratch: Scratch, words: int = WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(t0, t1, text), a row a document -> (t0, t1, n_passage_words): words inside windows that another document has too, where there are any."""

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t0, t1, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                found = runs(word_hashes(raw), words, gram)
                if n := len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t0)), pa.array(np.full(n, t1)), *map(pa.array, found)], [*T, "first", "last", "g", "d"])

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t0, t1, raw, some in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                values = word_hashes(raw)
                at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in some])
                known = np.concatenate([np.full(r["last"] - r["first"] + 1, r["known"]) for r in some])
                h = _spans(values, at, at + words).view(np.int64)
                out += [(t0, t1, *row) for row in zip(at.tolist(), h.tolist(), known.tolist(), strict=True)]
                if len(out) > _ROWS:
                    yield _longs(out, [*T, "at", "h", "known"])
                    out = []
            yield _longs(out, [*T, "at", "h", "known"])

    long_texts = texts.filter(F.octet_length("text") >= 2 * words - 1)
    found = scratch.write(long_texts.select(*T, "text").mapInArrow(run_rows, "t0 long, t1 long, first long, last long, g long, d long"), "runs")
    several = lambda t, key: t.groupBy(key).agg(F.min("t0").alias("a"), F.max("t0").alias("z")).filter("a <> z").select(key)
    near = scratch.write(join_checked(found, scratch.write(several(found, "g"), "anchors"), "g", "left_semi", 2_000_000), "near")
    whole = scratch.write(several(near, "d"), "whole")
    as_one = scratch.write(join_checked(near, whole, "d", "left_semi", 2_000_000), "as-one")
    mixed = scratch.write(near.groupBy("g").agg(F.min("d").alias("a"), F.max("d").alias("z")).filter("a <> z").select("g"), "mixed")
    part = lambda t, known: t.select(*T, F.struct("first", "last", F.lit(known).cast("long").alias("known")).alias("run"))
    ones = part(join_checked(as_one, mixed, "g", "left_semi", 2_000_000).dropDuplicates(["d"]), 1)
    lists = part(join_checked(near, whole, "d", "left_anti", 2_000_000), 0).unionByName(ones).distinct().groupBy(*T).agg(F.collect_list("run").alias("some"))
    involved = join_checked(long_texts, scratch.write(lists, "lists"), T).groupBy(*T).agg(F.first("text").alias("text"), F.first("some").alias("some"))
    windows = scratch.write(involved.mapInArrow(window_rows, "t0 long, t1 long, at long, h long, known long"), "windows")
    shared = windows.groupBy("h").agg(F.min("t0").alias("a"), F.max("t0").alias("z"), F.max("known").alias("known")).filter("a <> z or known = 1").select("h")
    hit = windows.join(shared, "h", "left_semi").select(*T, F.col("at").alias("first"), F.col("at").alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.greatest(p["last"] + words - F.greatest(p["first"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(p["last"] + words, acc["upto"]).alias("upto"))
    covered = F.aggregate(F.array_sort("at"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), step)["n"]
    parts = as_one.select(*T, "first", "last").unionByName(hit).groupBy(*T).agg(F.collect_set(F.struct("first", "last")).alias("at")).select(*T, covered.alias("n_passage_words"))
    copies = scratch.write(long_texts.groupBy(*T).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*T), "copies")
    copied = join_checked(long_texts, copies, T, "left_semi").select(*T, F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_passage_words")).filter(F.col("n_passage_words") >= words)
    return scratch.write(parts.unionByName(copied).groupBy(*T).agg(F.max("n_passage_words").alias("n_passage_words")), "passages")
