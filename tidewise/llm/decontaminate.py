"""Benchmark decontamination by a broadcast set of test n-grams.

Words of the benchmark get numbers; a window is ``n`` consecutive word numbers of an item (an item
of fewer words, but not none, is one window).  Items are measured before anything is broadcast: a benchmark of at most
``BLOCK_BYTES`` is one broadcast set and one pass.  A larger one is dealt into blocks of that size, and each block is a pass
of its own over the documents; hits of all passes are then united by document, so that no task and not the
driver ever holds more than one block.  The set of a block is built once, as sorted arrays, and broadcast as such.  Tasks scan the windows of each whole text, verify each hash hit on the word numbers, and
mark the words inside it.  Documents are reported (``scan``), dropped (``remove_contaminated``) or relieved of the marked
spans (``remove_spans``).

Defined results: null or wordless texts have no words and no hits; null or wordless items have no
windows; items are counted by distinct item id (a null id counts as the empty string); long texts are
scanned whole; repeated rows get equal results; extra columns are ignored by ``scan`` and kept by
``remove_contaminated`` and ``remove_spans``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch

N_WORDS = 10
#: Bytes of items that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Bytes that are no word bytes become blanks; A-Z are lower-cased first.
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_WORDS).split()


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word numbers (polynomial, modulo 2**64)."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * _BASE + ids[i : len(ids) - n + 1 + i].astype(np.uint64) + np.uint64(1)
    return out


class WindowSet:
    """Windows of some items, as arrays: by length, the sorted hashes of distinct windows, where each stands in the items, and its items."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = N_WORDS):
        self.vocab: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in items})
        name, number = {item: i for i, item in enumerate(self.names)}, self.vocab.setdefault
        rows = [(name[item], np.fromiter((number(w, len(self.vocab)) for w in words(text)), np.int32)) for item, text in items]
        rows = [(item, ids) for item, ids in rows if len(ids)]
        self.flat = np.concatenate([ids for _, ids in rows]) if rows else np.zeros(0, np.int32)
        starts = np.cumsum([0, *[len(ids) for _, ids in rows]])
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for (item, ids), at in zip(rows, starts, strict=False):
            k = min(n, len(ids))
            h = _hashes(ids, k)
            parts.setdefault(k, []).append((h, np.arange(len(h)) + at, np.full(len(h), item, np.int32)))
        self.known = {k: self._distinct(k, *map(np.concatenate, zip(*p, strict=True))) for k, p in sorted(parts.items())}

    def _distinct(self, k: int, hashes: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and places of distinct windows, and the items of each (bounds into a list)."""
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        if not new.all():  # equal hashes of windows that differ would be windows of their own
            first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
            for i in np.flatnonzero(~self._equal(first, self.flat, at, k)).tolist():
                new[i : i + 2] = True
        start = np.flatnonzero(new)
        return hashes[start], at[start], np.append(start, len(item)), item

    def _equal(self, at: np.ndarray, ids: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
        """Whether the k words of the items from each place on are those of ``ids`` from the other place on."""
        same = np.ones(len(at), bool)
        for i in range(k):
            same &= self.flat[at + i] == ids[other + i]
        return same

    def scan(self, tokens: list[bytes], hit: np.ndarray, found: set[str]) -> None:
        """Mark words inside windows and gather the items of these."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int32, len(tokens))
        gaps = np.concatenate([[0], np.cumsum(ids < 0)])
        for k, (hashes, at, bounds, items) in self.known.items():
            if len(ids) < k:
                continue
            starts = np.flatnonzero(gaps[k:] == gaps[:-k])
            if not len(starts):
                continue
            h = np.zeros(len(starts), np.uint64)
            for i in range(k):
                h = h * _BASE + ids[starts + i].astype(np.uint64) + np.uint64(1)
            place = np.searchsorted(hashes, h)
            while len(place):  # once, but where hashes of distinct windows are equal
                ok = place < len(hashes)
                starts, h, place = starts[ok], h[ok], place[ok]
                ok = hashes[place] == h
                starts, h, place = starts[ok], h[ok], place[ok]
                same = self._equal(at[place], ids, starts, k)
                for i in range(k):
                    hit[starts[same] + i] = True
                for w in np.unique(place[same]).tolist():
                    found.update(self.names[i] for i in items[bounds[w] : bounds[w + 1]].tolist())
                place = place + 1


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).filter("text is not null")


def _blocks(items: DataFrame, block_bytes: int) -> int:
    """Blocks that the items are dealt into, none of them over ``block_bytes`` in the mean."""
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0
    return max(1, -(-size // block_bytes))


def _block(items: DataFrame, i: int, n: int) -> list[tuple[str, bytes]]:
    return sorted((r["item"], r["text"].encode()) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect())


def _hits(docs: DataFrame, block: list[tuple[str, bytes]], n: int, keep: list[str], text: str) -> DataFrame:
    """(keep, ..., n_words, items, spans) of every document for one block: spans are pairs of a first word and the word after the last."""
    shared, n_kept = docs.sparkSession.sparkContext.broadcast(WindowSet(block, n)), len(keep)
    src = docs.select(*keep, *([] if text in keep else [text]))
    at = src.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            n_words, items, spans = [], [], []
            for raw in b.column(at).cast(pa.binary()).to_pylist():
                tokens = words(raw) if raw else []
                hit, found = np.zeros(len(tokens), bool), set()
                known.scan(tokens, hit, found)
                n_words.append(len(tokens))
                items.append(sorted(found))
                spans.append(np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist() if found else [])
            cols = [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_kept)), *cols], [*keep, "n_words", "items", "spans"])

    kept = "".join(f"`{c}` {src.schema[c].dataType.simpleString()}, " for c in keep)
    return src.mapInArrow(run, f"{kept}n_words long, items array<string>, spans array<long>")


def _united(spans: Column) -> Column:
    """Pairs in one flat array, from several passes, as sorted pairs that do not touch."""
    places = F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1)
    pairs = F.array_sort(F.transform(places, lambda i: F.struct(F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("z"))))
    none = F.array().cast("array<bigint>")

    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.greatest(last, p["z"])))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1) >= p["a"]), longer).otherwise(F.concat(out, F.array(p["a"], p["z"])))

    return F.when(F.size(spans) > 2, F.aggregate(pairs, none, step)).otherwise(spans)


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted ids), spans (word start and end pairs), and the columns of ``keep``."""
    text = f"__keep_{text_col}" if text_col in keep else "__text"
    src = docs.select(F.col(id_col).alias("doc_id"), *([] if text_col in keep else [F.col(text_col).alias(text)]), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    items = _items(benchmark, item_col, item_text_col)
    n_blocks, kept = _blocks(items, block_bytes), ["doc_id", *[f"__keep_{c}" for c in keep]]
    if n_blocks == 1:
        found = _hits(src, _block(items, 0, 1), n, kept, text)
    else:
        scratch = Scratch(docs.sparkSession, "decontaminate")
        rows = scratch.write(src.withColumn("__row", F.monotonically_increasing_id()), "rows")
        every, hits = None, []
        for i in range(n_blocks):
            part = _hits(rows, _block(items, i, n_blocks), n, ["__row"] if i else ["__row", *kept], text)
            part = scratch.write(part.filter(F.size("items") > 0) if i else part, "hits")
            every = part if every is None else every
            hits.append(part.filter(F.size("items") > 0).select("__row", "items", "spans"))
        of_row = reduce(DataFrame.unionByName, hits).groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        joined = every.drop("items", "spans").join(of_row, "__row", "left")
        found = joined.select(*kept, "n_words", F.coalesce("items", none("string")).alias("items"), F.coalesce(_united(F.col("spans")), none("bigint")).alias("spans"))
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", *[F.col(f"__keep_{c}").alias(c) for c in keep])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, text_col: str = "text", max_hit_share: float = 0.0, **kw) -> DataFrame:
    """Documents whose share of hit words is at most ``max_hit_share``; the columns are those of ``docs``."""
    cols = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*cols)
    found = scan(named, benchmark, n, cols[0], cols[docs.columns.index(text_col)], tuple(cols), **kw)
    return found.filter(F.col("n_hit") <= F.lit(max_hit_share) * F.col("n_words")).select(*[F.col(c).alias(name) for c, name in zip(cols, docs.columns, strict=True)])


def cut_words(raw: bytes, spans: list[int]) -> bytes:
    """A text without the words of the spans, and without what stands between them."""
    at = np.frombuffer(raw.lower().translate(_TO_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], at, [False]]).astype(np.int8)))
    kept, done = [], 0
    for a, z in zip(spans[::2], spans[1::2], strict=True):
        kept.append(raw[done : edges[2 * a]])
        done = int(edges[2 * z - 1])
    return b"".join([*kept, raw[done:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, text_col: str = "text", **kw) -> DataFrame:
    """All documents, with the text of hit words cut out (a null text stays null); the columns are those of ``docs``."""
    cols = [f"c{i}" for i in range(len(docs.columns))]
    place = docs.columns.index(text_col)
    found = scan(docs.toDF(*cols), benchmark, n, cols[0], cols[place], tuple(cols), **kw).select(*cols, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or not spans else cut_words(t, spans).decode() for t, spans in zip(b.column(place).cast(pa.binary()).to_pylist(), b.column(len(cols)).to_pylist(), strict=True)]
            texts = [t.decode() if isinstance(t, bytes) else t for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else b.column(i) for i in range(len(cols))], cols)

    return found.mapInArrow(run, docs.toDF(*cols).schema).toDF(*docs.columns)
