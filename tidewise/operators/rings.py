"""Outline edges chained to closed rings, and rings nested to polygons.

Edges are directed, with the inside on their left.  The next edge of a ring is found at the common vertex by angle.  Edges are dealt by
tiles of the plane, and a task chains those that follow each other to pieces of rings; only the pieces, which number as the edges that
cross borders of tiles, are told apart by pointers of 1, 2, 4, ... pieces.  So the number of rounds grows with the logarithm of the
longest ring, what a round moves with the borders and not with the edges, and no task gathers more than the ring that it returns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions import geo
from tidewise.operators import geometry
from tidewise.plans.scratch import Scratch, join_checked

#: Edges of a tile, about; rows that a task chains at once, and rows of one tile from which it is cut.
TILE = 8_192
CHUNK = 65_536
LARGE = 524_288

_EDGE = ["e", "ax", "ay", "bx", "by", "next", "ways", "turn"]
_PIECE = "e long, ax double, ay double, bx double, by double, next long, ways long, turn double, piece long, at long, n long, jump long, lx double, ly double, mx double, my double, first long, off long"


def _side(edges: DataFrame) -> float:
    """Side of tiles that hold about TILE edges; from inner percentiles, so that a few far edges do not widen them."""
    n, xs, ys = edges.agg(F.count(F.lit(1)), F.percentile_approx("bx", [0.05, 0.95], 1000), F.percentile_approx("by", [0.05, 0.95], 1000)).first()
    if not n:
        return 1.0
    w, h, tiles = xs[1] - xs[0], ys[1] - ys[0], max(n / TILE, 1.0)
    return max((w * h / tiles) ** 0.5, max(w, h) / tiles) or 1.0


def _tile(side: float, x: str, y: str) -> list[Column]:
    return [F.floor(F.col(x) / side).cast("long").alias("tx"), F.floor(F.col(y) / side).cast("long").alias("ty")]


def _turned(leaving: DataFrame, coming: DataFrame, at: list[str], clockwise: bool) -> DataFrame:
    """Ends of edges by vertex (``at``) -> rows of ``coming`` with the edge that follows, the nearest one by angle from where the edge comes
    (``next``, its angle ``turn``), how many leave the vertex (``ways``) and how many more come than leave (``open``)."""
    window = Window.partitionBy(*at).orderBy(F.desc("angle") if clockwise else F.asc("angle"))
    after, all_ = window.rowsBetween(1, Window.unboundedFollowing), window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = F.when(F.col("out").isNotNull(), F.struct("out", "angle"))
    found = F.coalesce(F.first(out, ignorenulls=True).over(after), F.first(out, ignorenulls=True).over(all_))
    both = leaving.unionByName(coming, allowMissingColumns=True)
    # Dealt by the tile alone, rows of a vertex and vertices of a tile come together.
    both = both.repartition("tx", "ty") if "tx" in at else both
    ways = F.count("out").over(all_)
    return both.select("*", found.alias("found"), ways.alias("ways"), (F.count("e").over(all_) - ways).alias("open")).filter("e is not null").withColumns({"next": F.col("found.out"), "turn": F.col("found.angle")})


def _next(edges: DataFrame, side: float) -> DataFrame:
    """(e, ax, ay, bx, by) -> the same with tx, ty, next, turn, ways and open, tile by tile."""
    x, y = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    leaving = edges.select(*_tile(side, "ax", "ay"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.atan2(y, x).alias("angle"), F.col("e").alias("out"))
    coming = edges.select(*_tile(side, "bx", "by"), F.col("bx").alias("x"), F.col("by").alias("y"), F.atan2(-y, -x).alias("angle"), "e", "ax", "ay")
    # Turning towards the inside keeps each connected inside to rings of its own.
    return _turned(leaving, coming, ["tx", "ty", "x", "y"], True).withColumns({"bx": F.col("x"), "by": F.col("y")})


def chain(e: np.ndarray, following: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges, the edges that follow them, and the rank of each -> for each its piece (row of the first edge), steps from there on, and by
    first row the last row and the row of least rank.  A ring that closes among these edges begins at its least rank."""
    n = len(e)
    order = np.argsort(e)
    to = order[np.minimum(np.searchsorted(e[order], following), n - 1)]
    inside = np.flatnonzero(e[to] == following)
    before, rounds = np.arange(n), max(1, int(n).bit_length() + 1)
    before[to[inside]] = inside
    alone = before == np.arange(n)
    least, jump = place.copy(), before.copy()
    for _ in range(rounds):
        np.minimum(least, least[jump], out=least)
        jump = jump[jump]
    before = np.where(~alone[jump] & (least == place), np.arange(n), before)
    first, at = before, (before != np.arange(n)).astype(np.int64)
    for _ in range(rounds):
        at = at + at[first]
        first = first[first]
    last, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by = np.lexsort((at, first))
    end = np.flatnonzero(np.append(first[by][1:] != first[by][:-1], True))
    last[first[by][end]] = by[end]
    by = np.lexsort((place, first))
    begin = np.flatnonzero(np.append(True, first[by][1:] != first[by][:-1]))
    low[first[by][begin]] = by[begin]
    return first, at, last, low


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of edges by tile (tx, ty, then _EDGE) -> _EDGE, piece and at; the first edge of a piece also tells of the piece: n, the piece
    that follows (jump), its least edge (lx, ly, mx, my, first) and the steps to that (off).

    Which rows are chained at once changes how many pieces there are, and nothing else.
    """

    def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t.column(c).to_numpy() for c in ("e", "next", "ax", "ay", "bx", "by")}
        place = np.empty(len(t), np.int64)
        place[np.lexsort((col["by"], col["bx"], col["ay"], col["ax"]))] = np.arange(len(t))
        first, at, last, low = chain(col["e"], col["next"], place)
        begins = at == 0
        n, jump = at[last] + 1, col["next"][last]
        extra = {"piece": col["e"][first], "at": at} | {k: pa.array(v, mask=~begins) for k, v in {"n": n, "jump": jump, "lx": col["ax"][low], "ly": col["ay"][low], "mx": col["bx"][low], "my": col["by"][low], "first": col["e"][low], "off": at[low]}.items()}
        out = t.select(_EDGE)
        for k, v in extra.items():
            out = out.append_column(k, pa.array(v))
        yield from out.to_batches(10_000)

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < CHUNK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        x, y = t.column("tx").to_numpy(), t.column("ty").to_numpy()
        ends = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        cut = int(ends[-1]) if len(ends) else rows if rows >= LARGE else 0
        if cut:
            yield from told(t.slice(0, cut))
            t = t.slice(cut)
        held, rows = t.to_batches(), len(t)
    if rows:
        yield from told(pa.Table.from_batches(held).combine_chunks())


def _labelled(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Written rows of ``_pieces`` -> (piece, ring, off, total): the edge that begins the ring at its smallest vertex, the steps on to it, and
    the edges of the ring."""
    label = F.struct("lx", "ly", "mx", "my", "first").alias("label")
    pieces = edges.filter("n is not null").select("piece", label, "off", "jump", "n")
    whole = pieces.filter("piece = jump").select("piece", F.col("label.first").alias("ring"), "off", F.col("n").alias("total"))
    parts = scratch.write(pieces.filter("piece <> jump"), "parts")
    state = scratch.write(parts.select("piece", "label", "off", "jump", F.col("n").alias("span")), "pointers")
    while True:
        ahead = state.select(F.col("piece").alias("jump"), F.col("label").alias("far"), F.col("off").alias("far_off"), F.col("jump").alias("far_jump"), F.col("span").alias("far_span"))
        nearer = F.col("label") <= F.col("far")
        moved = state.join(ahead, "jump").select(
            "piece", F.when(nearer, F.col("label")).otherwise(F.col("far")).alias("label"), F.when(nearer, F.col("off")).otherwise(F.col("span") + F.col("far_off")).alias("off"), F.col("far_jump").alias("jump"), (F.col("span") + F.col("far_span")).alias("span"), (F.col("label") != F.col("far")).alias("open")
        )
        new = scratch.write(moved, "pointers")
        # Where all stretches of a ring hold the same smallest edge, it is the ring's.
        settled = new.filter("open").isEmpty()
        scratch.drop(state)
        state = new.drop("open")
        if settled:
            break
    of = scratch.write(state.select("piece", F.col("label.first").alias("ring"), "off").join(parts.select("piece", "n"), "piece"), "of")
    totals = of.groupBy("ring").agg(F.sum("n").alias("total"))
    return scratch.write(whole.unionByName(of.join(totals, "ring").select("piece", "ring", "off", "total")), "rings")


def _placed(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """Edges with ring, off and total of their piece."""
    return join_checked(edges.drop("off"), rings, "piece", max_rows=1_000_000)


def _vertices(edges: DataFrame) -> DataFrame:
    return edges.select("ring", F.pmod(F.col("at") - F.col("off"), F.col("total")).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def assemble(edges: DataFrame) -> DataFrame:
    """Directed edges (ax, ay, bx, by) -> (ring, seq, x, y): the vertices of closed rings, each from its smallest vertex on.

    Outer rings run counterclockwise, holes clockwise.  Parts that touch at a vertex are rings of their own, and so is a hole that touches
    its outer ring: no ring visits a vertex twice.  Repeated edges count once; edges that do not close raise ValueError.
    """
    scratch = Scratch(edges.sparkSession, "rings")
    plain = edges.select("ax", "ay", "bx", "by").filter("ax <> bx or ay <> by").distinct()
    plain = scratch.write(plain.withColumn("e", F.monotonically_increasing_id()), "edges")
    side = _side(plain)
    # An edge without a next one is told of by ``open``: where fewer come than leave, more come elsewhere.
    turned = _next(plain, side).select("tx", "ty", *[F.when(F.col("open") == 0, F.col("next")).otherwise(-1).alias(c) if c == "next" else F.col(c) for c in _EDGE])
    wide = scratch.write(turned.mapInArrow(_pieces, _PIECE), "pieces")
    if not wide.filter("next = -1").isEmpty():
        raise ValueError("edges do not close to rings")
    rings = _labelled(wide, scratch)

    # A vertex that a ring meets twice parts holes from it: there its edges turn the other way.
    met = scratch.write(_placed(wide.filter("ways > 1"), rings).select("ring", F.col("bx").alias("x"), F.col("by").alias("y"), "e", "ax", "ay", "next", "turn"), "met")
    twice = met.groupBy("ring", "x", "y").count().filter("count > 1").drop("count")
    met = scratch.write(met.join(twice, ["ring", "x", "y"]), "twice")
    if met.isEmpty():
        return _vertices(_placed(wide, rings))
    leaving = met.select("ring", "x", "y", F.col("turn").alias("angle"), F.col("next").alias("out"))
    coming = met.select("ring", "x", "y", F.atan2(F.col("ay") - F.col("y"), F.col("ax") - F.col("x")).alias("angle"), "e")
    other = scratch.write(_turned(leaving, coming, ["ring", "x", "y"], False).select("e", F.col("next").alias("other")), "other")
    parted = scratch.write(met.select("ring").distinct(), "parted")
    rings = scratch.write(join_checked(rings, parted.withColumn("again", F.lit(True)), "ring", "left"), "again")
    placed = _placed(wide, rings)
    again = join_checked(placed.filter("again").select(*_EDGE), other, "e", "left", max_rows=1_000_000).withColumn("next", F.coalesce("other", "next"))
    again = again.select(*_tile(side, "bx", "by"), *_EDGE).repartition("tx", "ty").sortWithinPartitions("tx", "ty")
    again = scratch.write(again.mapInArrow(_pieces, _PIECE), "pieces")
    return _vertices(placed.filter("again is null")).unionByName(_vertices(_placed(again, _labelled(again, scratch))))


def signed_area(ring: Column) -> Column:
    """Area of a closed ring, negative where it runs clockwise; taken from its first vertex, so that it keeps its digits."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return F.aggregate(geo.segments(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] - x0) * (e["b"]["y"] - y0) - (e["b"]["x"] - x0) * (e["a"]["y"] - y0)) / 2


def nested(edges: DataFrame, size: float = geometry.BIN) -> DataFrame:
    """Directed edges -> (part, hole, area, ring): a row for each ring, the outer one of each connected part and its holes (with areas
    below 0).  No row or task holds a part whole.

    A hole belongs to the smallest outer ring around it; ``size`` is the side of the bins in which it is looked for.
    """
    scratch = Scratch(edges.sparkSession, "nested")
    rows = assemble(edges).groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))
    open_ring = F.transform("v", lambda p: geo.point(p["x"], p["y"]))
    rings = rows.select(F.col("ring").alias("id"), F.concat(open_ring, F.slice(open_ring, 1, 1)).alias("ring"))
    rings = scratch.write(rings.withColumn("area", signed_area(F.col("ring"))), "rings")
    outer = rings.filter("area > 0").select(F.col("id").alias("ord"), "ring", "area")
    middle = lambda k: (F.col("ring")[0][k] + F.col("ring")[1][k]) / 2
    holes = rings.filter("area < 0").select("id", middle("x").alias("x"), middle("y").alias("y"))
    around = geometry.point_in_polygons(holes, outer.select("ord", F.array(F.array("ring")).alias("geom")), size)
    owner = around.join(outer.select("ord", "area"), "ord").groupBy("id").agg(F.min_by("ord", "area").alias("part"))
    within = rings.join(owner, "id").select("part", F.lit(True).alias("hole"), "area", "ring")
    return outer.select(F.col("ord").alias("part"), F.lit(False).alias("hole"), "area", "ring").unionByName(within)


def polygons(edges: DataFrame, size: float = geometry.BIN) -> DataFrame:
    """Directed edges -> (part, n_holes, area, geom): one row for each connected part, its outer ring first, then its holes.

    ``nested`` is the form for parts that are too large for one row.
    """
    rings = Scratch(edges.sparkSession, "polygons").write(nested(edges, size), "nested")
    held = rings.filter("hole").groupBy("part").agg(F.sort_array(F.collect_list("ring")).alias("holes"), F.sum("area").alias("lost"))
    none = F.array().cast(f"array<{geo.LINE}>")
    out = rings.filter("not hole").join(held, "part", "left")
    return out.select("part", F.coalesce(F.size("holes"), F.lit(0)).alias("n_holes"), (F.col("area") + F.coalesce("lost", F.lit(0.0))).alias("area"), F.array(F.concat(F.array("ring"), F.coalesce("holes", none))).alias("geom"))


def dissolve(parts: DataFrame, columns: list[str] | None = None, overlapping: bool = False, size: float = geometry.BIN) -> DataFrame:
    """(ord, geom, ...) -> one row: the attributes of the first part and ``geom``, the union as one multipolygon.

    ``overlapping`` parts are cut where they cross (``union_outline``); else neighbours must share whole edges.  Null parts are skipped;
    no parts give an empty geometry.  ``polygons`` is the form for unions that are too large for one row.
    """
    edges = geometry.union_outline(parts, size, directed=True) if overlapping else geometry.dissolve_outline(parts, directed=True)
    whole = polygons(edges, size).agg(F.flatten(F.sort_array(F.collect_list("geom"))).alias("geom"))
    return geometry.dissolve_attributes(parts, columns).join(whole, how="cross") if columns else whole
