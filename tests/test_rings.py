"""Rings from outlines, against cells that are flooded one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.operators import geometry, rings

UNIT = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]


def layer(spark, geoms):
    rows = [(i, f"part {i}", None if g is None else [[[(float(x), float(y)) for x, y in r] for r in p] for p in g]) for i, g in enumerate(geoms)]
    return spark.createDataFrame(rows, f"ord long, name string, geom {geo.MULTI}")


def square(i, j, side=1, turn=1):
    return [(i + x * side, j + y * side) for x, y in UNIT][::turn]


def parts_of(cells, near):
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            i, j = todo.pop()
            part.add((i, j))
            for di, dj in near:
                if (i + di, j + dj) in left:
                    left.remove((i + di, j + dj))
                    todo.append((i + di, j + dj))
        out.append(part)
    return out


def holes_of(part, m):
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    free = {(i, j) for i in range(-1, m + 1) for j in range(-1, m + 1)} - part
    return len(parts_of(free, near)) - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_polygons_of_cells(spark, seed):
    rng, m = random.Random(seed), 14
    cells = {(i, j) for i in range(m) for j in range(m) if rng.random() < 0.62}
    src = layer(spark, [[[square(i, j, turn=rng.choice([1, -1]))]] for i, j in sorted(cells)])
    got = rings.polygons(geometry.dissolve_outline(src, directed=True), 3.0).collect()
    want = [(float(len(p)), holes_of(p, m)) for p in parts_of(cells, [(1, 0), (-1, 0), (0, 1), (0, -1)])]
    assert sorted((r.area, r.n_holes) for r in got) == sorted(want)
    for r in got:
        for ring in r.geom[0]:
            assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1 > 2


def test_island_in_a_hole_and_attributes(spark):
    frame = [square(0, 0, 9), square(1, 1, 7)]
    src = layer(spark, [None, [frame], [[square(2, 2, 5), square(3, 3, 3)]], [[square(4, 4)]]])
    got = rings.dissolve(src, ["name"], size=2.0).collect()
    assert [r.name for r in got] == ["part 0"] and sorted(len(p) for p in got[0].geom) == [1, 2, 2]
    area = lambda ring: sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:], strict=False)) / 2
    assert sorted([area(r) for r in p] for p in got[0].geom) == [[1.0], [25.0, -9.0], [81.0, -49.0]]
    assert rings.dissolve(src.limit(0), size=2.0).collect()[0].geom == []


def test_parts_that_overlap(spark):
    src = layer(spark, [[[square(0, 0, 2)]], [[square(1, 1, 2)]], [[square(3, 3, 1)]], [[square(10, 0, 1)]], [[square(10, 0, 1)]]])
    got = rings.polygons(geometry.union_outline(src, 2.0, directed=True), 2.0).collect()
    # The third square only touches the second at a corner: a part of its own.
    assert sorted((r.area, len(r.geom[0][0])) for r in got) == [(1.0, 5), (1.0, 5), (7.0, 9)]


def test_long_ring_in_few_rounds(spark):
    n = 3000
    ring = spark.range(n).select(*[f((F.col("id") + k) * (2 * 3.141592653589793 / n)).alias(c) if k == 0 else f(((F.col("id") + 1) % n) * (2 * 3.141592653589793 / n)).alias(c) for c, f, k in (("ax", F.cos, 0), ("ay", F.sin, 0), ("bx", F.cos, 1), ("by", F.sin, 1))])
    got = rings.assemble(ring.repartition(5, "ax")).orderBy("seq").collect()
    assert len({r.ring for r in got}) == 1 and [r.seq for r in got] == list(range(n))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) < 0.01 for a, b in zip(got, got[1:], strict=False))


def test_open_edges_raise(spark):
    with pytest.raises(ValueError, match="do not close"):
        rings.assemble(spark.createDataFrame([(0.0, 0.0, 1.0, 0.0)], "ax double, ay double, bx double, by double"))


def test_rounds_move_pieces_and_not_edges(spark, monkeypatch):
    """Rings run over many tiles: results stay, and rounds hold the pieces between borders of tiles only."""
    for name, n in (("TILE", 256), ("CHUNK", 64), ("LARGE", 500)):
        monkeypatch.setattr(rings, name, n, raising=False)
    written, write = [], rings.Scratch.write
    monkeypatch.setattr(rings.Scratch, "write", lambda self, df, name="t", **more: written.append((name, write(self, df, name, **more))) or written[-1][1])
    monkeypatch.setattr(rings.Scratch, "drop", lambda self, table: None)
    rng, m = random.Random(7), 48
    cells = {(i, j) for i in range(m) for j in range(m) if rng.random() < 0.64}
    outline = geometry.dissolve_outline(layer(spark, [[[square(i, j)]] for i, j in sorted(cells)]), directed=True)
    got = rings.polygons(outline, 8.0).collect()
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)]
    assert sorted((r.area, r.n_holes) for r in got) == sorted((float(len(p)), holes_of(p, m)) for p in parts_of(cells, near))
    moved = [t.count() for name, t in written if name == "pointers"]
    assert 0 < max(moved) < outline.count() / 3


def test_parts_as_rows_of_rings(spark):
    src = layer(spark, [[[square(0, 0, 9), square(1, 1, 3), square(5, 5, 3)]], [[square(2, 2)]]])
    got = rings.nested(geometry.dissolve_outline(src, directed=True), 2.0).collect()
    assert sorted((r.hole, r.area, len(r.ring)) for r in got) == [(False, 1.0, 5), (False, 81.0, 5), (True, -9.0, 5), (True, -9.0, 5)]
    assert sorted(len({r.part for r in got if r.hole == h}) for h in (True, False)) == [1, 2]
