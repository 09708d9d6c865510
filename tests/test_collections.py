"""Feature collections read in ranges of any size, against the whole file."""

import json
import random

import pytest

from tidewise.sources import collections, features


def collection(n, seed, indent=None):
    rng = random.Random(seed)
    odd = ['a "quoted" {', "back\\slash\\", "[{", "é😀", '\\"', "", "}]", '{"type": "Feature"}', " \\\\ "]
    feats = []
    for i in range(n):
        own = {"name": "".join(rng.choice(odd) for _ in range(rng.randrange(4))), "list": [{"deep": [1, {"k": "]"}]}], "i": i, "long": "x" * rng.choice([0, 0, 900])}
        f = {"type": "Feature", "properties": own, "geometry": {"type": "Point", "coordinates": [i, i / 2]}}
        feats.append(dict(sorted(f.items(), key=lambda _: rng.random())))
    return json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x {"}}, "features": feats, "bbox": [0, 1]}, indent=indent, ensure_ascii=seed % 2 == 0), feats


@pytest.mark.parametrize(("size", "indent", "seed"), [(7, None, 1), (300, 2, 2), (1000, None, 3), (1 << 20, 1, 4)])
def test_ranges(spark, tmp_path, size, indent, seed):
    text, feats = collection(4 if size < 10 else 30, seed, indent)
    (tmp_path / "a b.geojson").write_text(text, encoding="utf-8")
    got = collections.feature_texts(spark, str(tmp_path / "a b.geojson"), size).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(feats))) and [json.loads(r.value) for r in got] == feats
    if 10 < size < len(text) // 3:
        assert collections.feature_texts(spark, str(tmp_path), size).rdd.getNumPartitions() > 2


def test_files_empty_and_broken(spark, tmp_path):
    a, feats = collection(5, 5)
    (tmp_path / "1.geojson").write_text(a, encoding="utf-8")
    (tmp_path / "2.geojson").write_text('{"features": []}')
    (tmp_path / "3.geojson").write_text("")
    (tmp_path / "4.geojson").write_text('{"features": [{"type": "Feature", "properties": {"i": 9}, "geometry": null}, {"type": "Other"}, {"type": "Feature", "prop')
    got = features.read_features(spark, str(tmp_path), range_bytes=100).orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 1, 2, 3, 4, 5] and json.loads(got[5].properties) == {"i": 9} and got[5].geom_type is None
    assert features.read_features(spark, str(tmp_path / "2.geojson")).count() == 0 and features.read_features(spark, str(tmp_path / "3.geojson")).count() == 0
