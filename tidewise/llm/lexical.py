"""Ranked lexical search over bit-sliced Bloom signatures.

Index.  Documents of like size stand together in blocks.  A block has ``m`` slices; slice p is a bitmap over its documents, with the bit
of each document that has a key hashed to p.  Keys are a document's terms, and a term again for each frequency level (2, 3, 4, 6, 8,
12, ...) that it reaches.  A document has a key only if all ``HASHES`` slices of the key have its bit, so that the AND of the slices
overestimates the presence of a term, and its frequency.  Beside the blocks, the index has a dictionary of terms with the number of
documents that hold them, and the lengths of the documents.

Search.  For a block, the bitmaps of all query terms are read off the slices, level by level, and weighted by what a term of that
frequency can add to the score of a document of that length: their sums over an item's terms are upper bounds of the scores (exact ones, where
no bit is set by chance and levels are single frequencies).  A first pass over the blocks takes the ``k`` documents of the highest bounds of each
item, which are scored exactly; their k-th score is a limit.  A second pass takes every document whose bound is not below the
limit (at the limit, ties go by id), and all of these are scored exactly from their texts.  So no document is left out that is not
provably excluded; results are exact.

Items are a stated query set: they are dealt into blocks of at most ``QUERY_BYTES`` (an item is never split), each of which is broadcast and searched
in turn against all rows.  The index is written once.

Scores are whole numbers: a term adds w * ((10**9 * tf) div (1000 * tf + 20 * m)), with w = floor(1000 * ln((2N + 2) / (2df + 1)))
and m = 50 + ((50 * n * N) div L).

Defined results: null and termless texts are no documents (N, L and df do not count them); items without terms have no rows; rows of one
item id are one item, a null id too; repeated rows are documents of their own and tie; null document ids come after all
others in ties; an empty table of either kind gives an empty table; long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewise.plans.scratch import Scratch, join_checked

TOP = 50
#: Slices of a key, bits of a signature for each key (between this and twice this), documents and bits of a block.
HASHES, BITS_A_KEY, BLOCK_DOCS, BLOCK_BITS = 6, 18, 1024, 1 << 25
#: Terms that a task gathers before it gives them to the dictionary.
VOCABULARY = 500_000
#: Bytes of items that are broadcast at once, and terms whose bitmaps are unpacked at once.
QUERY_BYTES, UNPACKED = 32 << 20, 8192
#: Frequency levels: 1, 2, 3, then powers of two and what lies halfway.
LEVELS = np.array([1, 2, 3, *[x for i in range(2, 40) for x in (1 << i, 3 << (i - 1))]], np.int64)
_NULL_ID = (1 << 63) - 1
#: Bytes that are no term bytes become blanks; A-Z are lower-cased first.
_TO_TERMS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    return raw.lower().translate(_TO_TERMS).split() if raw else []


def slices_of(hashes: np.ndarray, levels: np.ndarray | int, m: int) -> np.ndarray:
    """The ``HASHES`` slices of each key (a row each), m a power of two."""
    x = (hashes ^ (np.asarray(levels).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(m - 1)).astype(np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_part(n, docs: int, total: int):
    """m of documents of n terms."""
    return 50 + (50 * n * docs) // total


class _Blocks:
    """Documents gathered into blocks of one signature size."""

    def __init__(self):
        self.open: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def add(self, doc_id: int, n: int, hashes: np.ndarray, tf: np.ndarray) -> tuple | None:
        reached = np.searchsorted(LEVELS, tf, side="right")
        level = np.arange(int(reached.sum())) - np.repeat(np.cumsum(reached) - reached, reached)
        m = 1 << max(6, int(BITS_A_KEY * len(level) - 1).bit_length())
        mine = self.open.setdefault(m, [])
        mine.append((doc_id, n, slices_of(np.repeat(hashes, reached), level, m).ravel()))
        return self.close(m) if len(mine) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // m)) else None

    def close(self, m: int) -> tuple:
        mine = self.open.pop(m)
        width = -(-len(mine) // 8)
        flat = np.zeros(m * width, np.uint8)
        for i, (_, _, at) in enumerate(mine):
            at = at * width + i // 8
            flat[at] |= np.uint8(128 >> i % 8)  # a slice that stands twice is set twice to the same
        return m, flat.tobytes(), [d for d, _, _ in mine], [n for _, n, _ in mine], None, None

    def rest(self) -> list[tuple]:
        return [self.close(m) for m in sorted(self.open)]


class Index:
    """Written tables: ``blocks`` (m, slices, ids, lens) and ``dictionary`` (term, df: partial counts); N and L."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        """Ids are whole numbers."""
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.scratch = Scratch(docs.sparkSession, "lexical")
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        names = ["m", "slices", "ids", "lens", "term", "df"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, vocab, hashes, df = _Blocks(), {}, np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

            def counted() -> Iterator[pa.RecordBatch]:
                words = list(vocab)
                for i in range(0, len(words), 50_000):
                    some = words[i : i + 50_000]
                    none = [None] * len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([none, none, none, none, some, df[i : i + len(some)]], kinds, strict=True)], names)

            for b in batches:
                for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    tokens = terms(raw)
                    if not tokens:
                        continue
                    counts, known = Counter(tokens), len(vocab)
                    at = np.fromiter((vocab.setdefault(t, len(vocab)) for t in counts), np.int64, len(counts))
                    if len(vocab) > len(df):
                        more = max(len(vocab), 2 * len(df)) - len(df)
                        hashes, df = np.concatenate([hashes, np.zeros(more, np.uint64)]), np.concatenate([df, np.zeros(more, np.int64)])
                    if len(vocab) > known:
                        new = [t for t, i in zip(counts, at.tolist(), strict=True) if i >= known]
                        hashes[known : len(vocab)] = [xxhash.xxh3_64_intdigest(t) for t in new]
                    df[at] += 1
                    tf = np.fromiter(counts.values(), np.int64, len(counts))
                    row = blocks.add(_NULL_ID if doc_id is None else doc_id, len(tokens), hashes[at], tf)
                    if row is not None:
                        yield batch([row])
                    if len(vocab) > VOCABULARY:
                        yield from counted()
                        vocab, df = {}, np.zeros(len(df), np.int64)
            for row in blocks.rest():
                yield batch([row])
            yield from counted()

        made = self.docs.filter("text is not null").mapInArrow(run, "m int, slices binary, ids array<long>, lens array<long>, term binary, df long")
        made = self.scratch.write(made, "index")
        self.blocks = made.filter("m is not null").select("m", "slices", "ids", "lens")
        self.dictionary = made.filter("term is not null").select("term", "df")
        n, total = self.blocks.select(F.size("ids").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
        self.n_docs, self.n_terms = n or 0, total or 0


class Queries:
    """Items of one block as broadcast: terms, their weights, and the terms of each item."""

    def __init__(self, rows: list):
        self.numbers = [r["no"] for r in rows]
        self.terms: dict[bytes, int] = {}
        self.items = [np.array([self.terms.setdefault(bytes(t["term"]), len(self.terms)) for t in r["terms"]], np.int64) for r in rows]
        self.weights = np.zeros(len(self.terms), np.int64)
        for r in rows:
            for t in r["terms"]:
                self.weights[self.terms[bytes(t["term"])]] = t["w"]
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms], np.uint64)

    def parts(self) -> Iterator[tuple[range, np.ndarray, list[np.ndarray]]]:
        """Items in parts of about ``UNPACKED`` terms: their places, their terms, and each item's places among these."""
        start, size = 0, 0
        for i, own in enumerate(self.items):
            size += len(own)
            if size >= UNPACKED or i == len(self.items) - 1:
                used = np.unique(np.concatenate(self.items[start : i + 1]))
                yield range(start, i + 1), used, [np.searchsorted(used, x) for x in self.items[start : i + 1]]
                start, size = i + 1, 0

    def bounds(self, used: np.ndarray, items: list[np.ndarray], m: int, slices: bytes, lengths: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of a block's documents (columns) for the items (rows); whole numbers, exact as floats below 2**53."""
        n = len(lengths)
        table = np.frombuffer(slices, np.uint8).reshape(m, -1)
        rows, bits, before = np.arange(len(used)), None, np.zeros(n, np.int64)
        value = np.zeros((len(used), n))
        for level, (_, most) in enumerate(zip(LEVELS, LEVELS[1:] - 1, strict=False)):
            at = slices_of(self.hashes[used[rows]], np.full(len(rows), level), m)
            there = table[at[:, 0]]
            for i in range(1, HASHES):
                there = there & table[at[:, i]]
            bits = there if bits is None else bits & there
            some = bits.any(axis=1)
            rows, bits = rows[some], bits[some]
            if not len(rows):
                break
            now = gain(np.int64(most), lengths)
            value[rows] += np.unpackbits(bits, axis=1, count=n) * (now - before).astype(np.float64)
            before = now
        return np.stack([self.weights[used[x]].astype(np.float64) @ value[x] for x in items])


def _items(items: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    """(no, item_id, terms (term, w), bytes) of items with terms that documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t))) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    src = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    own = src.mapInArrow(run, f"item_id {src.schema['item_id'].dataType.simpleString()}, terms array<binary>")
    own = index.scratch.write(own.select("item_id", F.explode("terms").alias("term")).distinct(), "terms")
    asked = index.scratch.write(own.select("term").distinct(), "asked")
    df = join_checked(index.dictionary, asked, "term").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    df = index.scratch.write(df.select("term", w.alias("w")).filter("w > 0"), "weights")
    of = join_checked(own, df, "term").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    of = of.withColumn("bytes", F.aggregate("terms", F.lit(100).cast("long"), lambda n, t: n + F.octet_length(t["term"]) + 120))
    return index.scratch.write(of.withColumn("no", F.row_number().over(W.orderBy("item_id"))), "items")


def _best(block: DataFrame, queries, k: int) -> DataFrame:
    """(no, id): the k documents of the highest bounds of each item."""
    docs, total = queries["n"], queries["l"]
    shared = queries["shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = shared.value, {}
        parts = list(q.parts())
        for b in batches:
            for m, slices, ids, lens in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                ids, m_of = ids.values.to_numpy(), length_part(lens.values.to_numpy(), docs, total)
                raw = slices.as_buffer()
                for p, (places, used, items) in enumerate(parts):
                    bound = q.bounds(used, items, m, raw, m_of)
                    who = np.broadcast_to(ids, bound.shape)
                    if p in best:
                        bound, who = np.concatenate([best[p][0], bound], 1), np.concatenate([best[p][1], who], 1)
                    if bound.shape[1] > k:
                        at = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                        bound, who = np.take_along_axis(bound, at, 1), np.take_along_axis(who, at, 1)
                    best[p] = bound, who
        for p, (bound, who) in best.items():
            i, j = np.nonzero(bound > 0)
            no = np.array([q.numbers[x] for x in parts[p][0]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(no[i]), pa.array(who[i, j]), pa.array(bound[i, j])], ["no", "id", "bound"])

    found = block.mapInArrow(run, "no long, id long, bound double")
    place = F.row_number().over(W.partitionBy("no").orderBy(F.desc("bound"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k).select("no", "id")


def _left(block: DataFrame, queries, limits) -> DataFrame:
    """(no, id): every document that its bound and the item's limit (score, id) do not exclude."""
    docs, total, shared = queries["n"], queries["l"], queries["shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, known = shared.value, limits.value
        least = np.array([known.get(no, (1, _NULL_ID)) for no in q.numbers], np.int64).reshape(-1, 2)
        parts = list(q.parts())
        for b in batches:
            for m, slices, ids, lens in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                ids, m_of = ids.values.to_numpy(), length_part(lens.values.to_numpy(), docs, total)
                raw = slices.as_buffer()
                for places, used, items in parts:
                    bound, own = q.bounds(used, items, m, raw, m_of), least[places.start : places.stop]
                    i, j = np.nonzero((bound > own[:, :1]) | ((bound == own[:, :1]) & (ids[None, :] <= own[:, 1:])))
                    if len(i):
                        no = np.array([q.numbers[x] for x in places], np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(no[i]), pa.array(ids[j])], ["no", "id"])

    return block.mapInArrow(run, "no long, id long")


def _scored(docs: DataFrame, wanted: DataFrame, queries) -> DataFrame:
    """(no, id, score) of all documents of the wanted (no, id), exact, from their texts."""
    n_docs, total, shared = queries["n"], queries["l"], queries["shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        names, place = list(q.terms), {no: i for i, no in enumerate(q.numbers)}
        for b in batches:
            out = []
            for doc_id, raw, asked in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                counts = Counter(terms(raw))
                m = length_part(counts.total(), n_docs, total)
                for no in asked:
                    score = 0
                    for t in q.items[place[no]].tolist():
                        if tf := counts.get(names[t]):
                            score += int(q.weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                    if score:
                        out.append((no, doc_id, score))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["no", "id", "score"])

    by_doc = queries["scratch"].write(wanted.groupBy("id").agg(F.sort_array(F.collect_set("no")).alias("asked")), "wanted")
    rows = docs.withColumn("key", F.coalesce("id", F.lit(_NULL_ID)))
    texts = join_checked(rows, by_doc.withColumnRenamed("id", "key"), "key").select("id", "text", "asked")
    return queries["scratch"].write(texts.mapInArrow(run, "no long, id long, score long"), "scored")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k highest documents of each item with a score above 0: item_id, rank (int, from 1), doc_id, score."""
    spark, scratch = items.sparkSession, index.scratch
    if not index.n_docs:
        src = items.select(F.col(id_col).alias("item_id"))
        return src.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    asked = _items(items, index, id_col, text_col)
    done = F.sum("bytes").over(W.orderBy("no").rowsBetween(W.unboundedPreceding, -1))
    dealt = scratch.write(asked.withColumn("block", F.floor(F.coalesce(done, F.lit(0)) / query_bytes)), "dealt")
    out = None
    for (block,) in sorted(dealt.select("block").distinct().collect()):
        shared = spark.sparkContext.broadcast(Queries(dealt.filter(F.col("block") == block).select("no", "terms").collect()))
        queries = {"shared": shared, "n": index.n_docs, "l": index.n_terms, "scratch": scratch}
        first = _ranked(_scored(index.docs, _best(index.blocks, queries, k), queries), k)
        limits = {r["no"]: (r["score"], _NULL_ID if r["id"] is None else r["id"]) for r in first.filter(F.col("rank") == k).collect()}
        left = _left(index.blocks, queries, spark.sparkContext.broadcast(limits))
        found = _scored(index.docs, left, queries)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "no long, id long, score long")
    return join_checked(_ranked(out, k), dealt.select("no", "item_id"), "no").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
