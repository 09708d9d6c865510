"""Rows keep columns whose names are those of inner ones; window sets with equal hashes; shards as folders."""

import random

import numpy as np
import pytest

from tidewise.llm import decontaminate, sharding, simhash

CLASH = "doc_id long, text string, rid long, row long, __rid long, __row long, c0 long, key string, root long"


def rows_of(spark):
    text = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(1, text, 7, 77, 777, 8, 9, "k", 5), (2, text + " x", 17, 177, 1777, 18, 19, "l", 6), (3, "other words here", 27, 277, 2777, 28, 29, "m", 7), (None, None, 37, 377, 3777, 38, 39, None, None)], CLASH)


def test_keep_one_and_shard_leave_all_columns_alone(spark):
    docs = rows_of(spark)
    before = {tuple(r) for r in docs.collect()}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {r for r in before if r[0] != 2}
    out = sharding.shard(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert {tuple(r)[: len(docs.columns)] for r in out.collect()} == before


def test_write_shards(spark, tmp_path):
    docs, path = rows_of(spark), f"file://{tmp_path}/shards"
    sharding.write_shards(docs, path, max_bytes=300)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("shard_id").distinct().count() > 1
    assert {(r.doc_id, r.rid, r.row) for r in back.collect()} == {(r.doc_id, r.rid, r.row) for r in docs.collect()}


@pytest.mark.parametrize("base", [0x9E3779B97F4A7C15, 0])
def test_window_sets_against_all_windows(monkeypatch, base):
    """With a base of 0 a hash knows the last word only, so that most hashes of windows that differ are equal."""
    monkeypatch.setattr(decontaminate, "_BASE", np.uint64(base))
    rng = random.Random(1)
    for _ in range(300):
        vocab, n = [f"w{i}".encode() for i in range(rng.choice([2, 4, 9]))], rng.choice([2, 3, 4])
        items = [(rng.choice("abcd"), b" ".join(rng.choices(vocab, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 6))]
        tokens = rng.choices([*vocab, b"zz"], k=rng.randint(0, 30))
        hit, found = np.zeros(len(tokens), bool), set()
        decontaminate.WindowSet(items, n).scan(tokens, hit, found)
        want, names = np.zeros(len(tokens), bool), set()
        for item, text in items:
            w = decontaminate.words(text)
            k = min(n, len(w))
            for i in range(len(tokens) - k + 1 if k else 0):
                if any(tokens[i : i + k] == w[j : j + k] for j in range(len(w) - k + 1)):
                    want[i : i + k] = True
                    names.add(item)
        assert (hit == want).all() and found == names
