"""The pipeline's stages against plain versions of what they decide."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tidewise.llm import decontaminate, quality, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small documents with near copies, a benchmark passage, hard rows and clashing columns."""
    d = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    long = [r for r in docs.orderBy("doc_id").collect() if len(r.text) > 1500][:10]
    extra = [(5000 + i, r.text + " appended words here", r.lang, r.source, 1) for i, r in enumerate(long)]
    extra += [(5100, long[0].text[:1400] + " " + bench.first().text, "en", "src1", 1), (5101, None, None, None, None), (5102, "", "en", "src2", 0), (None, "no id", "en", "src0", 5), (5103, "x" * 200000, "en", None, 1)]
    docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "7L as row", "'s' as key").write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]

    good = stages["quality"](spark, docs, folder)
    want = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect()}
    rows = good.collect()
    assert good.columns == columns and {r.doc_id for r in rows} == want

    kept = stages["near_dedup"](spark, docs, folder).collect()
    ids = {r.doc_id for r in kept}
    assert len(kept) == len(ids) and None in ids
    every = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None)
    assert ids - {None} == {every[i][0] for i in set(jaccard_groups([t for _, t in every]))}
    assert all(5000 + i not in ids for i in range(10))

    clean = stages["decontaminate"](spark, docs, folder).collect()
    items = [decontaminate.words((r.text or "").encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(t[i : i + 10]) for t in items if t for i in range(max(1, len(t) - 9))}

    def dirty(text):
        t = decontaminate.words((text or "").encode())
        return any(tuple(t[i : i + k]) in windows for k in {len(w) for w in windows} for i in range(len(t) - k + 1))

    assert {r.doc_id for r in clean} == {r.doc_id for r in docs.collect() if not dirty(r.text)} and 5100 not in {r.doc_id for r in clean}

    mixed = stages["mixing"](spark, docs, folder)
    assert mixed.columns == columns
    sizes, takes = {r.doc_id: (r.source, len((r.text or "").split())) for r in docs.collect()}, Counter(r.doc_id for r in mixed.collect())
    total = defaultdict(int)
    for i, n in takes.items():
        assert n <= 3 and sizes[i][1] > 0
        total[sizes[i][0]] += n * sizes[i][1]
    assert sum(total.values()) == pytest.approx(sum(s for _, s in sizes.values()), rel=0.1)

    shards = stages["sharding"](spark, mixed, folder).collect()
    assert len(shards) == sum(takes.values())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert out.columns == [*docs.columns, "shard_id", "shard_depth", "shard_bytes", "shard_docs"]
    assert 0 < out.select("doc_id").distinct().count() < docs.count()


def test_run_without_rows(spark, folder, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def jaccard_groups(texts, limit=0.8):
    """For each text the least place of its component, by all pairs of shingle sets."""
    def shingles(text):
        t = (text or "").encode().lower().split()
        k = min(5, len(t))
        return {tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if t else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if a == b or len(a & b) >= limit * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_near_dedup_against_all_pairs(spark):
    """Copies of all degrees around the limit, a copied text with repeats, and a chain."""
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10**6))
    texts = [None, "", "one", "one", "two words"]
    for i in range(60):
        base = [word() for _ in range(rng.choice((40, 150, 400)))]
        texts.append(" ".join(base))
        for changed in (0.01, 0.02, 0.025, 0.03, 0.04, 0.06):
            texts.append(" ".join(word() if rng.random() < changed else w for w in base))
    line = "the same line again and again "
    texts += [line * 300 + " ".join(word() for _ in range(80)), line * 300 + " ".join(word() for _ in range(80))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    root = jaccard_groups(texts)
    assert sorted(r.doc_id for r in simhash.keep_one(docs.repartition(3)).collect()) == sorted(set(root))


def test_buckets_leave_nothing_out():
    """The ends of every pair within the limit are in one tree of the forest, or both are listed; families span all pairs."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-(2**63), 2**63 - 1, 9, np.int64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 12), replace=False)) for _ in range(300)], np.int64)
    word = rng.choice(centres, 300) ^ flips
    bits = np.bitwise_count((word[:, None] ^ word[None]).view(np.uint64))
    buckets = np.sort(np.repeat(np.arange(30), 10))
    within = lambda i, j: bits[i, j] <= simhash.FAR

    def check(found, near):
        (trees, free), up = found, list(range(300))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in trees:
            assert top(i) != top(j) and bits[i, j] <= simhash.NEAR
            up[top(i)] = top(j)
        apart = [(i, j) for i, j in near if top(i) != top(j)]
        assert apart and {x for p in apart for x in p} <= set(free.tolist())

    pairs = [(i, j) for j in range(300) for i in range(j) if within(i, j)]
    check(simhash.bucket_forest(word), pairs)
    same = [(i, j) for i, j in pairs if buckets[i] == buckets[j]]
    check(simhash._small_buckets(buckets, word, False, np.full(300, 10)), same)
    assert {tuple(p) for p in simhash._small_buckets(buckets, word, True, np.full(300, 10))[0]} == set(same)

    def parts(found):
        label = list(range(300))
        for i, j in found:
            label = [label[i] if x == label[j] else x for x in label]
        return [label.index(x) for x in label]

    forest = simhash.bucket_families(word)
    assert set(map(tuple, forest)) <= set(pairs) and parts(forest) == parts(pairs) and len(forest) == 300 - len(set(parts(pairs)))
    halves = np.concatenate([np.arange(0, 300, 2), np.arange(1, 300, 2)])
    across = [(i, j) for i in range(150) for j in range(150, 300) if within(halves[i], halves[j])]
    assert parts(simhash.bucket_families(word[halves], 150)) == parts(across)
    trees, free = simhash.bucket_forest(word[halves], 150)
    assert all((i < 150) != (j < 150) for i, j in trees) and len(free)


def test_families_of_similar_sets():
    """Links of a family join the roots that similar pairs join, in one block and in pairs of blocks; no more than one link a root."""
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 200, np.int64)
    sets = [np.unique(np.where(rng.random(200) < c, rng.integers(-(2**63), 2**63 - 1, 200, np.int64), base)) for c in rng.uniform(0, 0.15, 60)]
    word = np.zeros((4, 60), np.int64)
    root, nodes = np.arange(60) // 2, np.arange(60)
    alike = lambda i, j: 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))

    def parts(links):
        label = root.copy()
        for i, j in links:
            label[label == label[i]] = label[j]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    want = parts([(i, j) for j in range(60) for i in range(j) if alike(i, j)])
    found = simhash.similar_forest(nodes, root, word, sets)
    assert parts(found) == want and len(found) == 30 - len(want) and 1 < len(want) < 30
    first = simhash.similar_forest(nodes[:20], root[:20], word[:, :20], sets[:20])
    last = simhash.similar_forest(nodes[20:], root[20:], word[:, 20:], sets[20:])
    assert parts([*first, *last, *simhash.similar_forest(nodes, root, word, sets, 20)]) == want


def test_near_dedup_in_blocks_and_again(spark, monkeypatch):
    """Buckets cut into blocks, and a forest of which many pairs are not similar."""
    for name, value in (("BLOCK", 12), ("_DENSE", 4), ("NEAR", 14)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(10**6))
    base = [word() for _ in range(300)]
    texts = [" ".join(word() if rng.random() < c else w for w in base) for c in (0.0, 0.01, 0.02, 0.03, 0.04, 0.05) for _ in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs.repartition(3)).collect()) == sorted(set(jaccard_groups(texts)))


def test_near_dedup_keeps_rows_of_equal_ids(spark):
    """A row goes for its own text, not for its id."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one), (2, one), (2, two), (2, three), (None, one)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame([rows[0], *rows[2:]], "doc_id long, text string").collect())


def test_pairs_of_families_grow_with_rows(spark):
    """Near copies share hundreds of buckets, and yet a task returns one pair a row and family."""
    rng = np.random.default_rng(5)
    for n in (300, 600):
        centre = rng.integers(-(2**63), 2**63, (4, 3), dtype=np.int64)  # three groups of near copies
        word = centre[:, np.arange(n) % 3]
        for _ in range(6):
            word[rng.integers(0, 4, n), np.arange(n)] ^= np.int64(1) << rng.integers(0, 63, n)
        node = rng.permutation(10**6)[:n]
        prints = spark.createDataFrame([(int(v), *map(int, w)) for v, w in zip(node, word.T, strict=True)], "node long, f0 long, f1 long, f2 long, f3 long")
        pairs = [(r.u, r.v) for r in simhash.candidates(prints, simhash.Scratch(spark, "grow"), 4, 16, families=True)[0].collect()]
        u, v = np.searchsorted(np.sort(node), np.array(pairs).T)
        label = np.arange(n)
        for _ in range(n):
            low = np.minimum(label[u], label[v])
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
        group = (np.arange(n) % 3)[np.argsort(node)]
        assert [set(group[label == r]) for r in np.unique(label)] == [{g} for g in group[np.unique(label)]] and len(np.unique(label)) == 3
        assert len(pairs) <= 4 * n  # four tasks
