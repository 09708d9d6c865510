"""Runs of periodic words by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical) that is at least ``max(least, 2 * q)`` words long and
that no neighbour extends.  The dictionary names, for every power of two L, the factor of L words at each place, so that
factors are equal where their names are.  A run of period q, L <= q < 2 * L, holds a factor of L words and its copy q words on, so
on each level only occurrences within 2 * L of one another propose periods.  Successive occurrences at most L / 2 apart form an arithmetic
progression (the factor itself has that period); a pair of progressions within reach proposes the progression of
distances between them, and one pair of places stands for each distance.  Proposals are extended to both sides by the names of
all levels, from the longest down; of equal stretches the smallest period stays.

Documents are dealt into tasks by Spark; a task lays some documents behind one another (words of different documents are never equal) and
runs each level for all of them at once.  Only factors that occur again within their document keep a name, and
levels end when none is left, so that prose without repeats costs a few short levels.  Memory is some 4 bytes a word and level
of the documents laid together, about ``CHUNK_WORDS`` or one document, whichever is more.

Defined results: null, empty and wordless texts have no words and no runs; a null id leaves the text as it is (``periodic_tail``);
repeated rows get equal results; ties of the longest run go to the smallest start, then period; an empty table gives an empty
table; extra columns are ignored, or kept where ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words of documents that are laid behind one another.
CHUNK_WORDS = 100_000


class Factors:
    """The dictionary: ``names[k][i]`` names the factor of 2**k words at place i; -1 where it occurs once."""

    def __init__(self, words: np.ndarray):
        self.names = [_renamed(words)]
        while (last := self.names[-1]).size and last.max() >= 0:
            at = 1 << (len(self.names) - 1)
            if at >= len(last):
                break
            a, b = last[:-at], last[at:]
            both = np.flatnonzero((a >= 0) & (b >= 0))
            named = np.full(len(a), -1, np.int32)
            if len(both):
                named[both] = _renamed(a[both].astype(np.int64) * (int(b.max()) + 1) + b[both])
            self.names.append(named)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        i, j = i.copy(), j.copy()
        from_ = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            ok = j < len(names)
            a, b = names[np.where(ok, i, 0)], names[np.where(ok, j, 0)]
            step = np.where(ok & (a >= 0) & (a == b), 1 << k, 0)
            i, j = i + step, j + step
        return j - from_

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        i, j = i.copy(), j.copy()
        from_ = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            ok = i >= size
            a, b = names[np.where(ok, i - size, 0)], names[np.where(ok, j - size, 0)]
            step = np.where(ok & (a >= 0) & (a == b), size, 0)
            i, j = i - step, j - step
        return from_ - i


def _renamed(keys: np.ndarray) -> np.ndarray:
    """Small numbers for keys that occur more than once, -1 for the others."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    return np.where(again, np.cumsum(again) - 1, -1)[inverse].astype(np.int32)


def _proposals(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances (size <= distance < 2 * size) of equal factors of ``size`` words, one place for each stretch of matches."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    if not len(at):
        return at, at
    name, gap = names[at], np.diff(at)
    cut = np.flatnonzero((name[1:] != name[:-1]) | (gap > size // 2)) + 1
    start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]]) - 1
    first, last, name = at[start], at[end], name[start]
    step = np.where(end > start, at[np.minimum(start + 1, len(at) - 1)] - first, 1)
    places, distances = [], []
    for t in range(1, 5):  # progressions are over size / 2 apart: the fourth after one is out of reach
        a = np.flatnonzero(name[:-t] == name[t:])
        b = a + t
        a, b = a[near := first[b] - last[a] < 2 * size], b[near]
        # The distances first[b] - last[a] + i * step that lie in [size, 2 * size).
        p, low = np.maximum(step[a], step[b]), first[b] - last[a]
        from_ = np.maximum(0, -(-(size - low) // p))
        upto = np.minimum((2 * size - 1 - low) // p, (last[b] - first[a] - low) // p)
        n = np.maximum(upto - from_ + 1, 0)
        of = np.repeat(np.arange(len(a)), n)
        i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + from_[of]
        d = low[of] + i * p[of]
        places.append(np.maximum(first[b][of], first[a][of] + d) - d)
        distances.append(d)
    place, distance = np.concatenate(places), np.concatenate(distances)
    order = np.lexsort((place, distance))
    place, distance = place[order], distance[order]
    # Matches of one distance that touch belong to one stretch.
    new = np.concatenate([[True], (distance[1:] != distance[:-1]) | (np.diff(place) > size)]) if len(place) else np.zeros(0, bool)
    return place[new], distance[new]


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs of a sequence of word numbers: rows (start, length, period), by start, then period."""
    factors, found = Factors(words), [np.zeros((0, 3), np.int64)]
    for k, names in enumerate(factors.names):
        place, d = _proposals(names, 1 << k)
        if not len(place):
            continue
        before, after = factors.left(place, place + d), factors.right(place, place + d)
        length = before + after + d
        ok = length >= np.maximum(least, 2 * d)
        found.append(np.stack([place[ok] - before[ok], length[ok], d[ok]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])[: len(rows)]
    rows = rows[new]  # of equal stretches, the smallest period
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_tail(words: list[bytes], doc_id) -> list[bytes]:
    """The words with a tail made periodic for one id in ten, as the crc32 of the id decides."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _numbers(words: list[bytes], base: int) -> tuple[np.ndarray, int]:
    """Numbers of words from ``base`` on, and the next free number."""
    seen: dict[bytes, int] = {}
    out = np.fromiter((seen.setdefault(w, base + len(seen)) for w in words), np.int64, len(words))
    return out, base + len(seen)


def _row(words: list[bytes], runs: np.ndarray) -> tuple:
    """What a document's runs give: (n_runs, start, length, period, exponent, hash of the runs, hash of the words kept)."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = words if not len(runs) else [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if g == 0]
    said = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    best = (None,) * 4
    if len(runs):
        s, n, q = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        best = (s, n, q, 1000 * n // q)
    return len(runs), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept)


def _chunk(docs: list[tuple[list[bytes], np.ndarray]], least: int) -> Iterator[tuple]:
    """Rows of documents whose words and word numbers are given; one number stands between two documents."""
    if not docs:
        return
    ends = np.cumsum([len(n) + 1 for _, n in docs])
    laid = np.concatenate([x for i, (_, n) in enumerate(docs) for x in (n, np.array([-1 - i]))])
    runs = runs_of(laid, least)
    of = np.searchsorted(ends, runs[:, 0], side="right")
    for i, (words, numbers) in enumerate(docs):
        own = runs[of == i] if len(runs) else runs
        own = own - np.array([ends[i] - len(numbers) - 1, 0, 0])
        yield _row(words, own)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tail: bool = False, least: int = LEAST, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed, and ``keep``.

    ``collapsed`` (null unless ``texts``) is the text without the repeats: of each run its first q words stay.  ``tail`` first
    makes the tails periodic that ``periodic_tail`` says.
    """
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, chunk, size, base = [], [], 0, 0
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = raw.split() if raw else []
                words = periodic_tail(words, doc_id) if tail else words
                numbers, base = _numbers(words, base)
                if chunk and size + len(words) > CHUNK_WORDS:
                    rows += _chunk(chunk, least)
                    chunk, size = [], 0
                chunk.append((words, numbers))
                size += len(words)
            rows += _chunk(chunk, least)
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            cols[-1] = [x.decode() if texts else None for x in cols[-1]]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, *[b.column(2 + i) for i in range(len(keep))]], names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed", *[f"__keep_{c}" for c in keep]]
    kind = lambda c: src.schema[c].dataType.simpleString()
    schema = f"doc_id {kind('__id')}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    schema += "".join(f", `__keep_{c}` {kind(f'__keep_{c}')}" for c in keep)
    return src.mapInArrow(run, schema).withColumnsRenamed({f"__keep_{c}": c for c in keep})
