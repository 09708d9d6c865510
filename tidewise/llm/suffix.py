"""Removal of long repeated passages with a logarithmic family of sampled suffix arrays.

A byte is removed if a string of ``MATCH`` bytes that covers it starts anywhere else in the corpus too.

*Sampling.*  A full suffix array of the corpus takes many times its size, so suffixes are sampled by content: in each
window of MATCH bytes the gram (GRAM bytes) of least hash is its anchor.  Equal windows have equal anchors at equal
places, and the windows that share an anchor are neighbours; these *runs* (first to last window start, and the bytes
they cover) are the entries of the arrays, one in about 120 bytes.  An array is kept in the order of a 128-bit
digest of the entry's bytes, not of the bytes themselves: all that is asked of it is which entries are equal.

*Index family.*  Documents come in ``BATCHES`` batches.  A batch's array is sorted, scanned against each existing level for entries that are
there too, and flushed as a level of what is new; levels of equal size merge into one of twice the size.  An entry
that a level has as well, or that its batch has twice, is a match of all its windows.

*Refinement.*  Runs that are equal only in part have the same anchor gram but different digests.  For anchors that have
several different runs, one run of each digest is cut into gaps of at most GAP windows at fixed distances from the anchor.
Equal gaps match as a whole; gaps that share only their core (the bytes common to all windows of the gap) with a
different gap are compared window by window.  No step lists pairs: all steps count digests, with partial sums
before the shuffle, so a passage that a third of all documents share is no heavy key.

Documents are known by a 128-bit hash of their text: copies share marks, and no row numbers are needed.

Defined results: null texts are empty; texts under MATCH bytes keep all; repeated rows repeat each other; null ids are
rows like any other; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch, join_checked

MATCH, GRAM, GAP = 400, 160, 16
BATCHES = 3
_PIECE = 1 << 22
#: Rows an Arrow batch of entries, gaps or windows goes out with.
_ROWS = 200_000
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
U = ["u0", "u1"]
T = ["t0", "t1"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        for name, base in (("up", _MUL), ("down", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _piece_runs(raw: np.ndarray, match: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and anchor place of each run in one piece of at least ``match`` bytes."""
    n, w = len(raw), match - gram + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # Hash above, place below: the least of a window is its anchor, the leftmost of equals.
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    full = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    count = n - match + 1
    anchor = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return first, np.concatenate([first[1:], [count]]) - 1, anchor[first]


def runs(raw: bytes, match: int = MATCH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(first window start, last window start, anchor place) of all runs of a text."""
    out = []
    for at in range(0, max(0, len(raw) - match + 1), _PIECE):
        part = np.frombuffer(raw[at : at + _PIECE + match - 1], np.uint8)
        out += [(int(a) + at, int(b) + at, int(x) + at) for a, b, x in zip(*_piece_runs(part, match, gram), strict=True)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(view: memoryview) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(view)
    return _signed(d >> 64), _signed(d & ((1 << 64) - 1))


def _gram(view: memoryview, seed: int = 0) -> int:
    return _signed(xxhash.xxh3_64_intdigest(view, seed))


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    a = np.array(rows, np.int64).reshape(-1, len(names))
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, i])) for i in range(len(names))], names)


def suffix_entries(texts: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """(t0, t1, text) -> one entry a run: t0, t1, first, last, anchor, u0, u1 (digest of its bytes), g (of its anchor gram)."""
    names = [*T, "first", "last", "anchor", *U, "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t0, t1, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                v = memoryview(raw)
                out += [(t0, t1, a, z, x, *_digest(v[a : z + match]), _gram(v[x : x + gram])) for a, z, x in runs(raw, match, gram)]
                if len(out) > _ROWS:
                    yield _longs(out, names)
                    out = []
            yield _longs(out, names)

    return texts.select(*T, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


class SuffixLevels:
    """Levels of distinct entry digests (u0, u1), each in their order, no digest in two; two of a size merge into the next."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.matches = scratch, {}, []

    def add(self, entries: DataFrame) -> None:
        """Scan the array of a batch against the levels, and flush what is new as a level."""
        array = entries.groupBy(*U).agg(F.count(F.lit(1)).alias("n"))
        for i, level in self.levels.items():  # a merge of sorted tables: the array moves once, for its sums and for all levels
            array = array.join(level.withColumn(f"in{i}", F.lit(True)), U, "left")
        known = reduce(lambda a, b: a | b, [F.coalesce(f"in{i}", F.lit(False)) for i in self.levels], F.lit(False))
        scanned = self.scratch.write(array.select(*U, "n", known.alias("known")), "scanned")
        self.matches.append(scanned.filter("n > 1 or known").select(*U))
        new, size = self.scratch.write(scanned.filter("not known").select(*U).sortWithinPartitions(*U), "level"), 0
        while (other := self.levels.pop(size, None)) is not None:
            merged = self.scratch.write(new.unionByName(other).repartition(*U).sortWithinPartitions(*U), "level")
            self.scratch.drop(new)
            self.scratch.drop(other)
            new, size = merged, size + 1
        self.levels[size] = new

    def repeated(self) -> DataFrame:
        """Digests of entries that occur more than once."""
        return reduce(DataFrame.unionByName, self.matches).distinct()


def _several(table: DataFrame, key: str) -> DataFrame:
    """Keys that have entries of different digests."""
    return table.groupBy(key).agg(F.min("u0").alias("a"), F.max("u0").alias("b")).filter("a <> b").select(key)


def _gaps(involved: DataFrame, match: int, gap: int) -> DataFrame:
    """Gaps of the listed runs: t0, t1, lo, hi (window starts), u0, u1 (digest of their bytes), c (of their core)."""
    names = [*T, "lo", "hi", *U, "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t0, t1, raw, parts in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                v = memoryview(raw)
                for p in parts or ():
                    a, z, x = p["first"], p["last"], p["anchor"]
                    for k in range((x - z) // gap, (x - a) // gap + 1):
                        lo, hi = max(a, x - gap * k - gap + 1), min(z, x - gap * k)
                        out.append((t0, t1, lo, hi, *_digest(v[lo : hi + match]), _gram(v[x - gap * k : x - gap * k - gap + 1 + match], k + 1)))
                    if len(out) > _ROWS:
                        yield _longs(out, names)
                        out = []
            yield _longs(out, names)

    return involved.select(*T, "text", "parts").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _windows(involved: DataFrame, match: int) -> DataFrame:
    """Single windows of the listed gaps: t0, t1, lo, hi (= lo), u0, u1."""
    names = [*T, "lo", "hi", *U]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t0, t1, raw, parts in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                v = memoryview(raw)
                for g in parts or ():
                    out += [(t0, t1, p, p, *_digest(v[p : p + match])) for p in range(g["lo"], g["hi"] + 1)]
                    if len(out) > _ROWS:
                        yield _longs(out, names)
                        out = []
            yield _longs(out, names)

    return involved.select(*T, "text", "parts").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of a text without the spans, and the number of maximal removed runs."""
    kept, at, n, end = [], 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            kept.append(raw[at:lo])
            n += 1
        end = at = max(end, hi)
    kept.append(raw[max(at, 0) :])
    return b"".join(kept), n


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, gram: int = GRAM, gap: int = GAP, batches: int = BATCHES, keep_text: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the text's bytes, with keep_text)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(1), text).alias("t1"))
    long_texts = src.filter(F.octet_length("text") >= match)
    entries = scratch.write(suffix_entries(long_texts, match, gram), "entries")

    index = SuffixLevels(scratch)
    for i in range(batches):
        index.add(entries.filter(F.pmod("t0", F.lit(batches)) == i))
    repeated = scratch.write(index.repeated(), "repeated")
    marks = scratch.write(join_checked(entries, repeated, U, "left_semi", 1_000_000).select(*T, F.col("first").alias("lo"), F.col("last").alias("hi")).distinct(), "marks")

    several = scratch.write(_several(entries, "g"), "several")
    chosen = scratch.write(join_checked(entries, several, "g", "left_semi", 2_000_000).select(*T, "first", "last", "anchor", *U).dropDuplicates(U), "chosen")
    lists = chosen.groupBy(*T).agg(F.collect_list(F.struct("first", "last", "anchor")).alias("parts"))
    wanted = scratch.write(marks.select(*T).unionByName(chosen.select(*T)).distinct(), "wanted")
    texts = join_checked(long_texts, wanted, T, "left_semi", 1_000_000).groupBy(*T).agg(F.first("text").alias("text"))
    involved = scratch.write(texts.join(lists, T, "left").select(*T, "text", "parts"), "involved")

    gaps = scratch.write(_gaps(involved.filter("parts is not null"), match, gap), "gaps")
    twice = lambda t: t.groupBy(*U).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*U)
    more = [join_checked(gaps, scratch.write(twice(gaps), "gaps2"), U, "left_semi", 1_000_000).select(*T, "lo", "hi")]
    open_gaps = join_checked(gaps, scratch.write(_several(gaps, "c"), "cores"), "c", "left_semi", 2_000_000).select(*T, "lo", "hi", *U).dropDuplicates(U)
    open_lists = scratch.write(open_gaps.groupBy(*T).agg(F.collect_list(F.struct("lo", "hi")).alias("parts")), "open")
    windows = scratch.write(_windows(join_checked(involved.select(*T, "text"), open_lists, T), match), "windows")
    more.append(join_checked(windows, scratch.write(twice(windows), "windows2"), U, "left_semi", 1_000_000).select(*T, "lo", "hi"))

    spans = marks.unionByName(more[0]).unionByName(more[1]).groupBy(*T).agg(F.collect_set(F.struct("lo", (F.col("hi") + match).alias("hi"))).alias("parts"))
    spans = scratch.write(spans, "spans")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for raw, parts in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                kept, n = cut(raw, [(p["lo"], p["hi"]) for p in parts])
                rows.append((len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], [*T, "removed", "spans", "sha", "kept"])

    done = join_checked(involved.select(*T, "text"), spans, T).select(*T, "text", "parts")
    done = scratch.write(done.mapInArrow(run, "t0 long, t1 long, removed long, spans long, sha string, kept binary"), "done")
    rows = src.select("doc_id", *T, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"), *([F.col("text")] if keep_text else []))
    out = join_checked(rows, done if keep_text else done.drop("kept"), T, "left")
    cols = ["doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")]
    if keep_text:
        cols.append(F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))
    return out.select(*cols)
