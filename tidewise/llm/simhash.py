"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of ``width`` bits is cut into s segments.  Two fingerprints that differ in at most 2*s - 1 bits agree, in
at least one segment, up to one bit (else each of the s segments would differ in two).  So each fingerprint is
indexed, for every bit, under the bit's segment with that bit wiped out (a one-wildcard variant); equal variants are
found by shuffling on them and verified on the whole fingerprint.  4 bits of 64 need 3 segments: 64 variants.

Distinct fingerprints are indexed, not documents.  A bucket (fingerprints that share a variant) gives no list
of pairs: a task compares its fingerprints and keeps a spanning forest of the links, fewer rows than the bucket has.
Buckets of more than ``BLOCK`` members are set aside, cut into blocks, and each pair of blocks becomes a
task key of its own, so no task holds an unbounded bucket.  Components then grow on tables (see ``components``).

``keep_one`` is defined on the sets of five-word shingles themselves: Jaccard similarity of at least 0.8.  Its candidates come from
the same index over fingerprints of 256 bits of the set: such pairs differ in 15 % of the bits, so 16 segments of 16 bits are cut, each
with its 16 wildcards, and a pair of similarity 0.8 shares a variant with probability 0.995 (0.85: 0.999, 0.5: 0.22).  An entry
carries a word of the fingerprint that its segment is not part of; pairs of a bucket that differ in at most ``FAR`` bits of it
are candidates, and become links when all bits and then their whole sets have been compared.  Copies of one
another must cost no square, so this goes in two passes.  In the first a bucket gives a spanning forest of what differs in at most
``NEAR`` bits, and the fingerprints that have a candidate outside of their tree.  When the forest has been verified, these fingerprints and
those of trees with a pair that is not similar are indexed once more, and all candidates that are not joined by then are
compared.  Segments of 16 bits suit some ten million texts a run; buckets
grow with the corpus, so a larger one wants longer segments of more words (``words64``, ``segments``).

Defined results: null and wordless texts have the fingerprint 0 (an empty set) and are linked like any other; repeated rows are
documents of one fingerprint; null ids never name a component unless it has no other, and ``keep_one`` keeps rows
without an id; an empty table gives an empty table; texts are hashed whole; extra columns are ignored
(``near_duplicates``) or kept (``keep_one``).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewise.llm.components import components
from tidewise.plans.scratch import Scratch, join_checked

SEED = 42
BITS, SEGMENTS = 4, 3
#: The setting of ``keep_one``: words a shingle, similarity as a fraction, 64-bit words and segments of a fingerprint.
WIDE_SHINGLE, SIMILAR = 5, (4, 5)
WIDE_WORDS, WIDE_SEGMENTS = 4, 16
#: Differing bits of a word up to which pairs are candidates, and up to which they are taken to be similar until compared; and
#: the share of all bits up to which sets are compared (similar pairs differ in 15 %, with a deviation of 2 %).
FAR, NEAR, ALL_BITS = 14, 9, 0.21
BLOCK = 4096
#: Bytes of shingle sets that a block of a family holds about.
BLOCK_BYTES = 32 << 20
_DENSE = 32
#: Pairs of families that a task merges before it returns them.
HELD = 100_000


def fingerprint(text: bytes | None, shingle: int, words64: int = 1) -> list[int]:
    """SimHash of the word shingles, repeats included, as signed 64-bit words (one a hash seed)."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return [0] * words64
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    k = min(shingle, len(tokens))
    starts = [0, *ends[: len(tokens) - k].tolist()]
    parts = [joined[a:b] for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
    h, out = xxhash.xxh64_intdigest, []
    for seed in range(SEED, SEED + words64):
        counts = np.zeros(64, np.int64)
        hashes = np.array([h(p, seed) for p in parts], np.uint64)
        for i in range(0, len(hashes), 4096):
            some = hashes[i : i + 4096]
            counts += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(len(some), 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, words64: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0, f1) of every whole text; f1 is 0 for fingerprints of 64 bits."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([(fingerprint(t, shingle, words64) + [0])[:2] for t in b.column(1).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps[:, 0]), pa.array(fps[:, 1])], ["doc_id", "f0", "f1"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, f0 long, f1 long")


def variants(fps: DataFrame, words64: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """(f0, ...) -> (key, f0, ...): a row a bit; the key is the bit's number and its segment without the bit.

    Segments lie within one 64-bit word.
    """
    keys, each = [], segments // words64
    for word in range(words64):
        cuts = [round(i * 64 / each) for i in range(each + 1)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for p in range(lo, hi):
                mask = ((1 << (hi - lo)) - 1) & ~(1 << (p - lo))
                rest = F.shiftrightunsigned(F.col(f"f{word}"), lo).bitwiseAND(F.lit(mask).cast("long"))
                keys.append(rest.bitwiseOR(F.lit((word * 64 + p) << 48).cast("long")))
    return fps.select(F.explode(F.array(*keys)).alias("key"), *fps.columns)


def node(f0: Column, f1: Column) -> Column:
    """One number for a fingerprint; only near-equal fingerprints, which link anyway, may share one."""
    return f0.bitwiseXOR(F.shiftleft(f1, 17).bitwiseOR(F.shiftrightunsigned(f1, 47)))


def _node(f: np.ndarray) -> np.ndarray:
    g = f[1].view(np.uint64)
    return f[0] ^ ((g << np.uint64(17)) | (g >> np.uint64(47))).view(np.int64)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; arrays of shape (2, ...). Counted unsigned: of signed numbers numpy counts the absolute value."""
    out = np.bitwise_count((a[0] ^ b[0]).view(np.uint64))
    return out + np.bitwise_count((a[1] ^ b[1]).view(np.uint64)) if a[1].any() or b[1].any() else out


def forest(a: np.ndarray, b: np.ndarray | None, bits: int) -> np.ndarray:
    """Places (i, j) of a spanning forest of the links within ``a``, or between ``a`` and ``b`` (places after those of a)."""
    n, other, shift = a.shape[1], (a if b is None else b), (0 if b is None else a.shape[1])
    label, out = np.arange(n + (0 if b is None else b.shape[1])), []
    for i in range(n):
        near = np.flatnonzero(_far(other, a[:, i : i + 1]) <= bits) + shift
        if (label[near] == label[i]).all():
            continue
        new, first = np.unique(label[near], return_index=True)
        joins = [(x, j) for x, j in zip(new.tolist(), first.tolist(), strict=True) if x != label[i]]
        out += [(i, int(near[j])) for _, j in joins]
        label[np.isin(label, [x for x, _ in joins])] = label[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _scan(keys: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Links (two nodes a row) of rows sorted by key; buckets are whole and of at most BLOCK rows."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size, nodes, out = np.diff(edge), _node(fps), []
    of_row = np.repeat(size, size)
    for shift in range(1, min(int(size.max()), _DENSE)):  # all small buckets at once
        i = np.flatnonzero((keys[:-shift] == keys[shift:]) & (of_row[:-shift] <= _DENSE))
        i = i[_far(fps[:, i], fps[:, i + shift]) <= bits]
        out.append(np.stack([nodes[i], nodes[i + shift]], 1))
    for g in np.flatnonzero(size > _DENSE):
        at = slice(edge[g], edge[g + 1])
        out.append(nodes[at][forest(fps[:, at], None, bits)])
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return np.unique(found, axis=0)


def links(fps: DataFrame, scratch: Scratch, bits: int = BITS, words64: int = 1, segments: int = SEGMENTS) -> DataFrame:
    """(f0, f1) distinct -> (u, v) nodes: links that join the same components as all links within ``bits`` bits."""

    def batch(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
        keys = pa.nulls(len(u), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([keys, pa.array(u), pa.array(v)], ["key", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, large = np.zeros((3, 0), np.int64), None
        for b in batches:
            t = np.concatenate([left, np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])], 1)
            if large is not None:  # goes on with a bucket that is set aside
                n = int(np.searchsorted(t[0], large, side="right"))
                yield batch(t[1, :n], t[2, :n], t[0, :n])
                t = t[:, n:]
                large = None if t.shape[1] else large
            starts = np.flatnonzero(np.concatenate([[True], t[0, 1:] != t[0, :-1]])) if t.shape[1] else np.zeros(0, np.int64)
            ends = np.concatenate([starts[1:], [t.shape[1]]]) if len(starts) else starts
            cut = int(starts[-1]) if len(starts) else 0
            wide = np.repeat(ends - starts > BLOCK, ends - starts)
            if wide.any():
                yield batch(t[1, wide], t[2, wide], t[0, wide])
                if wide[-1]:
                    large, cut = int(t[0, -1]), t.shape[1]
            whole = ~wide[:cut]
            if whole.any():
                found = _scan(t[0, :cut][whole], t[1:, :cut][:, whole], bits)
                yield batch(found[:, 0], found[:, 1])
            left = t[:, cut:]
        if left.shape[1]:
            found = _scan(left[0], left[1:], bits)
            yield batch(found[:, 0], found[:, 1])

    index = variants(fps, words64, segments)
    first = scratch.write(index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, u long, v long"), "links")
    out = first.filter("key is null").select("u", "v")
    aside = first.filter("key is not null").select("key", F.col("u").alias("f0"), F.col("v").alias("f1"))
    if not aside.isEmpty():
        counts = scratch.write(aside.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
        cut = join_checked(aside, counts, "key").withColumn("block", F.pmod(F.xxhash64("f0", "f1"), F.col("blocks")).cast("int"))
        pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "f0", "f1")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            f, block, i, j = pdf[["f0", "f1"]].to_numpy(np.int64).T.copy(), pdf["block"].to_numpy(), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
            a = f[:, block == i]
            b = None if i == j else f[:, block == j]
            nodes = _node(a if b is None else np.concatenate([a, b], 1))
            return pd.DataFrame(nodes[forest(a, b, bits)].reshape(-1, 2), columns=["u", "v"])

        out = out.unionByName(pairs.groupBy("key", "i", "j").applyInPandas(compare, "u long, v long"))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = BITS, words64: int = 1, segments: int = SEGMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, f0, f1, component_id (smallest doc_id reachable over links of at most ``bits`` bits)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, shingle, words64, id_col, text_col), "prints")
    classes = scratch.write(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("f0", "f1"), scratch, bits, words64, segments), scratch)
    members = scratch.write(classes.withColumn("node", node(F.col("f0"), F.col("f1"))).join(roots, "node", "left").select("f0", "f1", "least", F.coalesce("root", "node").alias("root")), "members")
    # Both sides are tables, so that adaptive execution can split a component with very many fingerprints.
    least = scratch.write(members.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.write(members.join(least, "root").select("f0", "f1", "component_id"), "named")
    return join_checked(prints, named, ["f0", "f1"]).select("doc_id", "f0", "f1", "component_id")


def shingle_set(text: bytes | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles (a text of fewer words is one shingle)."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    k = min(shingle, len(tokens))
    starts = [0, *ends[: len(tokens) - k].tolist()]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def set_print(hashes: np.ndarray, words64: int = WIDE_WORDS) -> np.ndarray:
    """SimHash of a set: each 64-bit word takes the majority of a mixing of the hashes of its own."""
    out = np.zeros(words64, np.int64)
    for i in range(words64 if len(hashes) else 0):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 4096):
            x = (hashes[at : at + 4096] ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
            counts += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), 8), axis=1).sum(0, dtype=np.int64)
        out[i] = int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)
    return out


def wide_node(f: np.ndarray) -> np.ndarray:
    """One number for each fingerprint of several words (shape (words, n))."""
    out = np.zeros(f.shape[1], np.uint64)
    for word in f.view(np.uint64):
        out = (out ^ word) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over all words (rows)."""
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(0, dtype=np.int64)


def _limit(words: np.ndarray) -> int:
    """Bits up to which rows are candidates: of one word, or of all."""
    return FAR if len(words) == 1 else int(ALL_BITS * 64 * len(words))


def bucket_forest(word: np.ndarray, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket, or of pairs between its first ``first`` rows and the others: a forest (i, j) of near words, and the rows that
    have a candidate in another tree."""
    word = np.atleast_2d(word)
    n, out = word.shape[1], []
    label, free = np.arange(n), np.zeros(n, bool)
    for i in range(1 if first is None else first, n):
        bits = _differ(word[:, : i if first is None else first], word[:, i : i + 1])
        at = np.flatnonzero(bits <= FAR)
        if not len(at):
            continue
        near = at[bits[at] <= NEAR][::-1]  # the last row of each tree, so that trees grow long rather than wide
        trees, where = np.unique(label[near], return_index=True)
        out += [(int(j), i) for j in near[where]]
        label[np.isin(label, trees)] = label[i]
        other = at[label[at] != label[i]]
        free[other] = True
        free[i] |= len(other) > 0
    return np.array(out, np.int64).reshape(-1, 2), np.flatnonzero(free)


def bucket_families(word: np.ndarray, first: int | None = None) -> np.ndarray:
    """A spanning forest (i, j) of the candidates of one bucket, or of those between its first ``first`` rows and the others."""
    word, out = np.atleast_2d(word), []
    label = np.arange(word.shape[1])
    for i in range(1 if first is None else first, word.shape[1]):
        at = np.flatnonzero(_differ(word[:, : i if first is None else first], word[:, i : i + 1]) <= _limit(word))[::-1]
        trees, where = np.unique(label[at], return_index=True)
        out += [(int(j), i) for j in at[where]]
        label[np.isin(label, trees)] = label[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _small_buckets(keys: np.ndarray, word: np.ndarray, families: bool, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest and rows with other candidates (or, for families, all pairs and no rows) of all small buckets of sorted rows at once."""
    word = np.atleast_2d(word)
    up, found = np.arange(len(keys)), [np.zeros((2, 0), np.int64)]
    for shift in range(1, min(int(size.max(initial=1)), _DENSE)):
        i = np.flatnonzero((keys[:-shift] == keys[shift:]) & (size[:-shift] <= _DENSE))
        bits = _differ(word[:, i], word[:, i + shift])
        i, bits = i[bits <= _limit(word)], bits[bits <= _limit(word)]
        found.append(np.stack([i, i + shift]))
        if not families:  # a tree's row hangs on the nearest row before it
            new = i[(bits <= NEAR) & (up[i + shift] == i + shift)]
            up[new + shift] = new
    pairs, tree = np.concatenate(found, 1), up
    if families:
        return pairs.T, np.zeros(0, np.int64)
    while (tree[tree] != tree).any():
        tree = tree[tree]
    own = np.flatnonzero(up != np.arange(len(up)))
    return np.stack([up[own], own], 1), np.unique(pairs[:, tree[pairs[0]] != tree[pairs[1]]])


def _named(nodes: np.ndarray, pairs: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Distinct (u, v) of pairs and (u, u) of single rows, as two columns."""
    p = np.concatenate([np.zeros((0, 2), np.int64), *pairs, *[np.stack([r, r], 1) for r in rows]])
    return np.unique(np.sort(nodes[p], axis=1), axis=0).T


def stars(pairs: np.ndarray) -> np.ndarray:
    """Pairs of nodes (n, 2) -> (least node, node) for each other node of their components, as two columns."""
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        a, b = a[x != y], b[x != y]
    own = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[label[own]], ids[own]])


def _bucket_rows(t: np.ndarray, families: bool) -> Iterator[np.ndarray]:
    """Candidates (u, v) of sorted rows (key, node, word; or key, node, all words) in whole buckets of at most BLOCK rows."""
    keys, nodes, word = t[0], t[1], t[2:]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(edge)
    few, rows = _small_buckets(keys, word, families, np.repeat(size, size))
    pairs, rows = [few], [rows]
    # Families are named by their components, so buckets are merged: each node hangs on one other.
    told = (lambda: stars(nodes[np.concatenate(pairs)])) if families else (lambda: _named(nodes, pairs, rows))
    for g in np.flatnonzero(size > _DENSE):
        a, b = edge[g], edge[g + 1]
        if families:
            p = bucket_families(word[:, a:b])
        else:
            p, r = bucket_forest(word[:, a:b])
            rows.append(r + a)
        pairs.append(p + a)
        if sum(map(len, pairs)) + sum(map(len, rows)) > 100_000:
            yield told()
            pairs, rows = [np.zeros((0, 2), np.int64)], []
    yield told()


def candidates(prints: DataFrame, scratch: Scratch, words64: int, segments: int, families: bool = False) -> tuple[DataFrame, DataFrame]:
    """(node, f0, ...), one row a node -> (u, v, far): candidate pairs of nodes, far if all bits rule them out; and (node) with candidates
    that are not listed.

    The pairs are a forest in every bucket, never all of it.  An entry carries one word, and trees hang on near words; for ``families`` it
    carries all words (these entries are few), and the pairs are no candidates themselves, but have the components of all candidates: the
    buckets of a task are merged, and each node hangs on the least one of its component.
    """
    words = [f"f{i}" for i in range(words64)]
    columns = ["key", "node", *(words if families else ["word"])]
    names = ["key", *(f"x{i}" for i in range(max(2, len(columns) - 1)))]

    def batch(cols: list[np.ndarray], key: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(cols[0]), pa.int64())
        long = lambda c: pa.array(np.ascontiguousarray(c))
        return pa.RecordBatch.from_arrays([none if key is None else long(key), *map(long, cols), *[none] * (len(names) - 1 - len(cols))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, large, held = np.zeros((len(columns), 0), np.int64), None, np.zeros((2, 0), np.int64)
        for b in batches:
            t = np.concatenate([left, np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])], 1)
            if large is not None:  # goes on with a bucket that is set aside
                n = int(np.searchsorted(t[0], large, side="right"))
                yield batch(list(t[1:, :n]), t[0, :n])
                t = t[:, n:]
                large = None if t.shape[1] else large
            starts = np.flatnonzero(np.concatenate([[True], t[0, 1:] != t[0, :-1]])) if t.shape[1] else np.zeros(0, np.int64)
            ends = np.concatenate([starts[1:], [t.shape[1]]]) if len(starts) else starts
            cut = int(starts[-1]) if len(starts) else 0
            wide = np.repeat(ends - starts > BLOCK, ends - starts)
            if wide.any():
                yield batch(list(t[1:, wide]), t[0, wide])
                if wide[-1]:
                    large, cut = int(t[0, -1]), t.shape[1]
            whole = t[:, :cut][:, ~wide[:cut]]
            if whole.shape[1]:
                for p in _bucket_rows(whole, families):
                    if families:
                        held = stars(np.concatenate([held, p], 1).T)
                    else:
                        yield batch(list(p))
            if held.shape[1] > HELD:
                yield batch(list(held))
                held = held[:, :0]
            left = t[:, cut:]
        if left.shape[1]:
            yield from (batch(list(p)) for p in _bucket_rows(left, families))
        if held.shape[1]:
            yield batch(list(held))

    # The rows are few and the index is large: they are spread before it is made.
    index = variants(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))), words64, segments)
    # A segment is compared on the word after its own.
    of = F.floor(F.shiftright("key", 48) / 64).cast("int")
    index = index.withColumn("word", F.get(F.array(*[F.col(f"f{(i + 1) % words64}") for i in range(words64)]), of)).select(*columns)
    found = scratch.write(index.repartition("key").sortWithinPartitions("key").mapInArrow(run, ", ".join(f"{c} long" for c in names)), "candidates")
    out = found.filter("key is null").select(F.col("x0").alias("u"), F.col("x1").alias("v"))
    large = found.filter("key is not null").select("key", *[F.col(f"x{i}").alias(c) for i, c in enumerate(columns[1:])])
    if not large.isEmpty():
        counts = scratch.write(large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
        cut = join_checked(large, counts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block")
            block, i, j, word = pdf["block"].to_numpy(), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), np.ascontiguousarray(pdf[columns[2:]].to_numpy(np.int64).T)
            first = None if i == j else int((block == i).sum())
            p, rows = (bucket_families(word, first), np.zeros(0, np.int64)) if families else bucket_forest(word, first)
            nodes = pdf["node"].to_numpy()
            return pd.DataFrame(dict(zip("uv", stars(nodes[p]) if families else _named(nodes, [p], [rows]), strict=True)))

        out = out.unionByName(pairs.select("i", "j", "block", *columns).groupBy("key", "i", "j").applyInPandas(compare, "u long, v long"))
    out = scratch.write(out.distinct(), "near")
    if families:
        return out.withColumn("far", F.lit(False)), out.select(F.col("u").alias("node")).limit(0)
    # All bits of both ends.
    left = out.filter("u <> v").join(prints.select(F.col("node").alias("u"), *[F.col(w).alias(f"a_{w}") for w in words]), "u")
    both = left.join(prints.select(F.col("node").alias("v"), *words), "v")
    bits = reduce(operator.add, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"a_{w}"))) for w in words])
    return scratch.write(both.select("u", "v", (bits > int(ALL_BITS * 64 * words64)).alias("far")), "pairs"), out.filter("u = v").select(F.col("u").alias("node"))


def _sets(wanted: DataFrame, rows: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """(id, rid) of one row of each set -> (id, hashes): whole shingle sets, sorted as unsigned numbers."""

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hashes, pa.list_(pa.int64()))], ["id", "hashes"])

    texts = join_checked(rows.select("rid", "text"), scratch.write(wanted, "wanted"), "rid", max_rows=2_000_000)
    return scratch.write(texts.select("id", "text").mapInArrow(set_rows, "id long, hashes array<long>"), "sets")


def _verified(pairs: DataFrame, places: DataFrame, rows: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs whose whole shingle sets are similar enough; places: (id, rid) of one row of each set."""
    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    sets = _sets(places.join(wanted, "id"), rows, shingle, scratch)
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    # common / (|a| + |b| - common) >= p / q
    p, q = SIMILAR
    return scratch.write(both.filter((p + q) * common >= p * (F.size("a") + F.size("b"))).select("u", "v"), "verified")


def similar_forest(nodes: np.ndarray, root: np.ndarray, word: np.ndarray, sets: list[np.ndarray], first: int | None = None) -> np.ndarray:
    """Links (u, v) of similar sets that join roots: of all rows, or between the first ``first`` and the others.

    A pair is compared if all bits allow it and its roots are not joined yet, so at most one link a root is returned.
    """
    (p, q), out, size = SIMILAR, [], np.array([len(x) for x in sets])
    label = np.unique(root, return_inverse=True)[1]
    for i in range(1 if first is None else first, len(nodes)):
        upto = i if first is None else first
        less, both = np.minimum(size[:upto], size[i]), size[:upto] + size[i]
        for j in np.flatnonzero((_differ(word[:, :upto], word[:, i : i + 1]) <= _limit(word)) & (label[:upto] != label[i]) & ((p + q) * less >= p * both)):
            if label[i] != label[j] and (p + q) * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= p * both[j]:
                out.append((nodes[j], nodes[i]))
                label[label == label[j]] = label[i]
    return np.array(out, np.int64).reshape(-1, 2)


def _within_families(prints: DataFrame, families: DataFrame, sets: DataFrame, words: list[str], scratch: Scratch) -> DataFrame:
    """(node, root, words), (node, root: family) and (id, hashes) -> links (u, v) of similar sets that join different roots of a family.

    A family is cut into blocks of bounded rows and bytes; a task compares two of them, each set held once, and returns a forest, so no
    join lists the pairs of a family.
    """
    size = F.size("hashes").cast("long") * 8 + 64
    named = prints.join(families.select("node", F.col("root").alias("family")), "node").join(sets.withColumnRenamed("id", "node"), "node")
    named = scratch.write(named, "family-rows")
    counts = named.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    counts = scratch.write(counts.filter("lo <> hi").select("family", "blocks"), "families")
    cut = join_checked(named, counts, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "root", "node"])
        i, j, sets = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), [np.asarray(h, np.int64) for h in pdf["hashes"]]
        word = np.ascontiguousarray(pdf[words].to_numpy(np.int64).T)
        found = similar_forest(pdf["node"].to_numpy(), pdf["root"].to_numpy(), word, sets, None if i == j else int((pdf["block"] == i).sum()))
        return pd.DataFrame(found, columns=["u", "v"])

    found = pairs.select("family", "i", "j", "block", "node", "root", *words, "hashes").groupBy("family", "i", "j").applyInPandas(compare, "u long, v long")
    return scratch.write(found, "within")


def similar_links(rows: DataFrame, shingle: int, scratch: Scratch, words64: int = WIDE_WORDS, segments: int = WIDE_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, text) -> (rid, doc_id, id) of every row, and (id, root) of the components of similar sets.

    Equal sets have one id: the node of their fingerprint, or, where sets that differ share a fingerprint, a hash of the set for all but
    the first of them.
    """
    words = [f"f{i}" for i in range(words64)]

    def print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            f = np.array([set_print(h, words64) for h in sets], np.int64).reshape(-1, words64).T.copy()
            own = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own), pa.array(wide_node(f)), *map(pa.array, f)], ["rid", "doc_id", "own", "node", *words])

    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = rows.select("rid", "text", "doc_id").mapInArrow(print_rows, f"rid long, doc_id {kind}, own long, node long, " + ", ".join(f"{c} long" for c in words))
    prints = scratch.write(prints, "prints")
    sets = scratch.write(prints.groupBy("node", "own").agg(F.min("rid").alias("rid"), *[F.first(c).alias(c) for c in words]), "sets")
    first = scratch.write(sets.groupBy("node").agg(F.min(F.struct("rid", "own", *words)).alias("s")).select("node", "s.*"), "first")
    # Sets that differ and share a fingerprint are candidates as they are.
    mates = scratch.write(sets.select("node", "own", "rid").join(first.select("node", F.col("own").alias("of")), "node").filter("own <> of").select("node", "own", "rid"), "mates")
    places = first.select(F.col("node").alias("id"), "rid").unionByName(mates.select(F.col("own").alias("id"), "rid"))
    forest_, free = candidates(first.select("node", *words), scratch, words64, segments)
    tested = scratch.write(forest_.filter("not far").select("u", "v").unionByName(mates.select(F.col("node").alias("u"), F.col("own").alias("v"))), "tested")
    found = _verified(tested, places, rows, shingle, scratch)
    roots = components(found, scratch)

    failed = scratch.write(forest_.select("u", "v").join(found, ["u", "v"], "left_anti"), "failed")
    if not failed.isEmpty():
        trees = scratch.write(components(forest_, scratch), "trees")
        broken = trees.join(failed.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select("root").distinct()
        free = free.unionByName(trees.join(broken, "root", "left_semi").select("node"))
    free = scratch.write(free.distinct(), "free")
    if not free.isEmpty():
        again = first.join(free, "node", "left_semi").join(roots, "node", "left").select("node", *words, F.coalesce("root", "node").alias("root"))
        again = scratch.write(again, "again")
        families = components(candidates(again, scratch, words64, segments, families=True)[0].select("u", "v"), scratch)
        families = scratch.write(families, "named-families")
        asked = places.join(families.select(F.col("node").alias("id")), "id", "left_semi")
        within = _within_families(again, families, _sets(asked, rows, shingle, scratch), words, scratch)
        # Of the links found before only the components count.
        roots = components(within.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), scratch)
    ids = join_checked(prints, mates.select("own", F.lit(True).alias("mate")), "own", "left").select("rid", "doc_id", F.when(F.col("mate"), F.col("own")).otherwise(F.col("node")).alias("id"))
    return ids, scratch.write(roots.select(F.col("node").alias("id"), "root"), "roots")


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar rows stays, that of the smallest id (of equal ids, one row); the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    # Rows are numbered in a table, so that a number means the same row whenever it is read; the columns go by place, whatever their names.
    cols = [f"c{i}" for i in range(len(docs.columns))]
    at = lambda c: F.col(cols[docs.columns.index(c)])
    rows = scratch.write(docs.toDF(*cols).withColumn("rid", F.monotonically_increasing_id()), "rows")
    ids, roots = similar_links(rows.select("rid", at(id_col).alias("doc_id"), at(text_col).alias("text")), shingle, scratch)
    groups = scratch.write(join_checked(ids, roots, "id", "left", max_rows=2_000_000).select("rid", "doc_id", F.coalesce("root", "id").alias("root")).filter("doc_id is not null"), "groups")
    best = scratch.write(groups.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("best")).select("best.rid"), "best")
    drop = scratch.write(groups.select("rid").join(best, "rid", "left_anti"), "drop")
    return join_checked(rows, drop, "rid", "left_anti", max_rows=2_000_000).select(*cols).toDF(*docs.columns)
