"""Road graphs and routing: whole tables of origins are solved at once by batched relaxation.

Costs.  A search asks, for every group (``of``) of goals, what the way from each node to its cheapest goal costs (``nearest``).  Chains of nodes with two
neighbours are first contracted: doubling pointers along the chains turn each into an edge between the junctions at its
ends.  Junctions are dealt into blocks of neighbouring numbers; a round follows the rows that improved last to the end of their blocks, one task a block,
and hands what leads out of a block to the next round.  So a search takes about as many rounds as a way has changes of block, with any
numbering, and fewest where numbers that are close lie close.  What is known is a family of written tables, each holding only the rows that a round
improved.  A round follows rows up to a cost when they are many (the others wait, where they are); the family is merged when it has
grown.  A group may name a node until which it searches: rows beyond a multiple of that node's cost are neither followed nor kept.

Ways.  Costs say which edge to take from each node (the cheapest; of equal ones that to the smallest node), so no path rides in the
rows of a search.  Ways are read off by doubling such pointers: tables of 1, 2, 4, ... edges ahead, in as many joins as the number of edges has bits.

Alternatives of a path (``k_shortest_paths``) turn off at one of its nodes.  The way on from each neighbour is known already: where the cheapest of
these avoids the nodes before the turn, it is the answer.  Only the other turns are searched (``detours``), with the
known rest of the way as a lower bound and a cost that k paths do not exceed as an upper one.

Ties are settled by cost, then the node sequence (between alternatives: cost, target, node sequence); edges that cost nothing are taken only where no other
edge will do, towards fewer of them.  Negative costs raise.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewise.operators.geometry import nearest_node
from tidewise.operators.mcda import or_value
from tidewise.plans.scratch import BROADCAST_ROWS, Scratch, hinted, join_checked, sized, small

MAX_ROUNDS = 10_000
#: Relaxation steps a round of ``detours``, between two written tables.
STEPS = 4
#: Nodes of a block, and groups that a task searches in one.
BLOCK_NODES, BLOCK_GROUPS = 1 << 16, 64
#: Tables of improved rows that are kept before they are merged, and rows that are followed in one round without regard to their cost.
LEVELS, FRONT = 8, 2_000_000
#: Rows up to which a round is one task without a shuffle, and takes so many times the steps.
FEW, MORE_STEPS = 20_000, 2
#: How far beyond the cheapest path alternatives are looked for at first.
REACH = 2.0


def nodes_from_edges(roads: DataFrame) -> DataFrame:
    """(node, ord, lon, lat): ends of roads of at least two vertices; the last road sets coordinates, the first the order.

    Null ends are dropped.
    """
    n = F.size("pts")
    ends = F.array(
        F.struct(F.col("u").alias("node"), (F.col("ord") * 2).alias("seq"), F.get("pts", F.lit(0)).alias("p")),
        F.struct(F.col("v").alias("node"), (F.col("ord") * 2 + 1).alias("seq"), F.get("pts", n - 1).alias("p")),
    )
    t = roads.filter(n >= 2).select(F.inline(ends)).filter("node is not null")
    return t.groupBy("node").agg(F.min("seq").alias("ord"), F.max_by("p", "seq").alias("p")).select("node", "ord", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))


def undirected_edges(roads: DataFrame, weight: Column | None = None) -> DataFrame:
    """(src, dst, weight, edge_ord) in both directions; null ends are dropped, parallels and loops stay."""
    w = (or_value(F.col("length"), 1.0) if weight is None else weight).alias("weight")
    ok = roads.filter("u is not null and v is not null")
    return ok.select(F.col("u").alias("src"), F.col("v").alias("dst"), w, F.col("ord").alias("edge_ord")).unionAll(ok.select("v", "u", w, "ord"))


def cheapest_parallel(edges: DataFrame) -> DataFrame:
    """One edge a direction and pair of nodes, without loops: only these can lie on a shortest path."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("weight", "edge_ord")).alias("e")).select("src", "dst", "e.weight", "e.edge_ord")


def prepared(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The cheapest parallels, written; negative costs raise, as nothing would ever settle."""
    out = scratch.write(cheapest_parallel(edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("double"), "edge_ord")), "edges")
    if not out.filter("weight < 0").isEmpty():
        raise ValueError("negative costs")
    return out


# --- costs ------------------------------------------------------------------------------------------------------------


def contracted(edges: DataFrame, fixed: DataFrame, scratch: Scratch) -> DataFrame:
    """Prepared edges -> (src, dst, weight, edge_ord, end, total, hops, inner): the end of the chain that each edge begins, and the cost to it.

    A node is inside a chain if it has two neighbours, each with an edge to and from it, and is not ``fixed`` (node).  ``inner`` tells whether the edge
    begins at such a node.  Edges of closed chains without an end are dropped, as nothing leads to or from them.
    """
    ends = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("m"), F.min("src").alias("c"), F.max("src").alias("d"))
    inner = ends.join(back, "node").filter("n = 2 and m = 2 and a = c and b = d").select("node", "a", "b")
    inner = scratch.write(inner.join(fixed.select("node").distinct(), "node", "left_anti"), "inner")
    plain = edges.select("*", F.col("dst").alias("end"), F.col("weight").alias("total"), F.lit(1).cast("long").alias("hops"))
    n_inner = inner.count()
    if not n_inner:
        return plain.withColumn("inner", F.lit(False))
    inner = F.broadcast(inner) if n_inner <= BROADCAST_ROWS else inner.hint("merge")
    mark = inner.select(F.col("node").alias("src"), F.lit(True).alias("inner"))
    # An edge into a chain goes on with the edge to the other neighbour: (at, next) is the last edge so far.
    state = plain.select("src", "dst", "weight", "edge_ord", F.col("src").alias("at"), F.col("dst").alias("end"), "total", "hops")
    inside = inner.select(F.col("node").alias("end"), "a", "b")
    while True:
        # An edge with more hops than nodes inside goes round a closed chain for ever.
        state = scratch.write(state.drop("a", "b").filter(F.col("hops") <= n_inner + 1).join(inside, "end", "left"), "chains")
        if state.filter("a is not null").isEmpty():
            break
        # The next edge of one that ends inside, with all that it leads to by now.
        more = state.select(F.col("src").alias("end"), F.col("dst").alias("onto"), F.col("at").alias("at2"), F.col("end").alias("end2"), F.col("total").alias("total2"), F.col("hops").alias("hops2"))
        going = state.filter("a is not null").withColumn("onto", F.when(F.col("a") == F.col("at"), F.col("b")).otherwise(F.col("a")))
        gone = going.join(more, ["end", "onto"]).select("src", "dst", "weight", "edge_ord", F.col("at2").alias("at"), F.col("end2").alias("end"), (F.col("total") + F.col("total2")).alias("total"), (F.col("hops") + F.col("hops2")).alias("hops"))
        state = state.filter("a is null").select(*gone.columns).unionByName(gone)
    return scratch.write(state.select("src", "dst", "weight", "edge_ord", "end", "total", "hops").join(mark, "src", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "contracted")


class _Known:
    """The family of written tables of improved rows: (of, node, dist, block, open), open if they lead out of what was searched."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.upto = scratch, [], []
        #: Rows written.
        self.rows = 0

    def add(self, rows: DataFrame) -> None:
        table = self.scratch.write(rows, "improved")
        n, n_open = table.agg(F.count(F.lit(1)), F.count_if("open")).first()
        self.rows += n
        self.levels.append((table, n_open))
        self.upto.append(None if n_open else float("inf"))

    def all(self) -> DataFrame:
        out = self.levels[0][0]
        for t, _ in self.levels[1:]:
            out = out.unionByName(t)
        return out

    def best(self) -> DataFrame:
        return self.all().groupBy("of", "node").agg(F.min("dist").alias("dist"))

    def front(self, most: int) -> DataFrame | None:
        """Open rows that have not been followed yet: all, or the cheaper half while they are over ``most``."""
        left = [i for i in range(len(self.levels)) if self.upto[i] != float("inf")]
        if not left:
            return None
        parts = [self.levels[i][0] if self.upto[i] is None else self.levels[i][0].filter(F.col("dist") > self.upto[i]) for i in left]
        front = parts[0]
        for p in parts[1:]:
            front = front.unionByName(p)
        front = front.filter("open").drop("open")
        cut = float("inf")
        if sum(self.levels[i][1] for i in left) > most:
            n, half = front.agg(F.count(F.lit(1)), F.percentile_approx("dist", 0.5, 1000)).first()
            cut = cut if n <= most else half
        for i in left:
            self.upto[i] = cut
        return front if cut == float("inf") else front.filter(F.col("dist") <= cut)

    def merge(self) -> None:
        """One table of the family, if all its rows have been followed but the last ones."""
        done = [i for i in range(len(self.levels) - 1) if self.upto[i] == float("inf")]
        if len(done) < LEVELS:
            return
        old = self.levels[done[0]][0]
        for i in done[1:]:
            old = old.unionByName(self.levels[i][0])
        whole = old.groupBy("of", "node").agg(F.min("dist").alias("dist"), F.first("block").alias("block")).withColumn("open", F.lit(False))
        whole = self.scratch.write(whole, "merged")
        for i in done:
            self.scratch.drop(self.levels[i][0])
        keep = [i for i in range(len(self.levels)) if i not in done]
        self.levels, self.upto = [(whole, 0), *[self.levels[i] for i in keep]], [float("inf"), *[self.upto[i] for i in keep]]


def _block_steps(chains: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Contracted edges -> (node, block), and the edges walked backwards, from an end to where the chain begins: (node, to, total, block, to_block).

    Nodes are dealt by ranges of their numbers.
    """
    step = chains.filter("not inner").filter(F.col("src") != F.col("end")).groupBy(F.col("end").alias("node"), F.col("src").alias("to")).agg(F.min("total").alias("total"))
    step = scratch.write(step, "steps")
    nodes = scratch.write(step.select("node").unionByName(step.select(F.col("to").alias("node"))).distinct(), "nodes")
    blocks = max(1, -(-nodes.count() // BLOCK_NODES))
    nodes = scratch.write(nodes.repartitionByRange(blocks, "node").withColumn("block", F.spark_partition_id()), "blocks")
    step = step.join(sized(nodes), "node").join(sized(nodes.select(F.col("node").alias("to"), F.col("block").alias("to_block"))), "to")
    return nodes, scratch.write(step.select("node", "to", "total", "to_block", "block").repartition(blocks, "block"), "block_steps", by="block")


def _search_block(rows: pd.DataFrame, steps: pd.DataFrame, reach: float) -> pd.DataFrame:
    """Known rows (of, node, dist, fresh, most) and marked nodes (dist null), and edges of a block -> what the fresh rows improve in it and at the nodes
    that its edges lead out to."""
    columns = ["of", "node", "dist", "block", "open"]
    if rows.empty or steps.empty:
        return pd.DataFrame(columns=columns)
    steps = steps.sort_values("node")
    block, to, to_block, total = steps["block"].iloc[0], steps["to"].to_numpy(), steps["to_block"].to_numpy(), steps["total"].tolist()
    names, first = np.unique(steps["node"].to_numpy(), return_index=True)
    first = [*first.tolist(), len(total)]
    # Ends inside the block by their place in it; ends outside, and ends that lead nowhere, after these.
    outer, place = np.unique(to, return_inverse=True)
    at = np.searchsorted(names, outer).clip(max=len(names) - 1)
    inside, n = names[at] == outer, len(names)
    ends = np.where(inside, at, n + np.arange(len(outer)))[place].tolist()
    every = np.concatenate([names, outer])
    where = np.full(len(every), block)
    where[n + place] = to_block
    out = []
    for of, own in rows.groupby("of", sort=False):
        spot = np.searchsorted(names, own["node"].to_numpy()).clip(max=n - 1)
        own = own.assign(spot=spot)[names[spot] == own["node"].to_numpy()]
        limit = own["most"].min() if own["most"].notna().any() else np.inf
        marked, old = set(own["spot"][own["dist"].isna()].tolist()), own[own["dist"].notna()]
        dist = dict(old.groupby("spot")["dist"].min())
        heap = [(d, i) for d, i, f in zip(old["dist"].tolist(), old["spot"].tolist(), old["fresh"].tolist(), strict=True) if f and d <= min(limit, dist[i])]
        heapq.heapify(heap)
        better = set()
        while heap:
            d, i = heapq.heappop(heap)
            if d > limit:
                break
            if d > dist[i] or i >= n:
                continue
            if i in marked:
                limit = min(limit, d * reach)
            for e in range(first[i], first[i + 1]):
                j, far = ends[e], d + total[e]
                if far <= limit and far < dist.get(j, np.inf):
                    dist[j] = far
                    better.add(j)
                    heapq.heappush(heap, (far, j))
        found = np.array(sorted(better), np.int64)
        found = found[[dist[i] <= limit for i in found.tolist()]] if len(found) else found
        out.append(pd.DataFrame({"of": of, "node": every[found], "dist": [dist[i] for i in found.tolist()], "block": where[found], "open": where[found] != block}))
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def nearest(
    goals: DataFrame, chains: DataFrame, scratch: Scratch, until: DataFrame | None = None, reach: float = 1.0, max_rounds: int = MAX_ROUNDS, steps: int = STEPS, front_rows: int = FRONT
) -> DataFrame:
    """(of, target), contracted edges -> (of, node, dist) of the ends of chains from which a goal is reached, written.

    ``until`` (of, node): a group that reaches it keeps only what costs at most ``reach`` times as much.  Goals and these nodes must not lie inside chains.
    A round has no steps of its own (``steps`` is not used): blocks are searched to their end.
    """
    nodes, step = _block_steps(chains, scratch)
    known = _Known(scratch)
    start = goals.select("of", F.col("target").cast("long").alias("node")).distinct()
    start = start.join(sized(nodes), "node", "left").select("of", "node", F.lit(0.0).alias("dist"), "block", F.col("block").isNotNull().alias("open"))
    known.add(start)
    groups = start.select("of").distinct().count()
    part = F.pmod(F.xxhash64("of"), F.lit(-(-groups // BLOCK_GROUPS) or 1)).cast("int")
    marked = None if until is None else hinted(scratch.write(until.select("of", "node").distinct().join(sized(nodes), "node"), "until"))
    schema, none = f"of {start.schema['of'].dataType.simpleString()}, node long, dist double, block int, open boolean", F.lit(None).cast("double")
    bound = None
    for _ in range(max_rounds):
        front = known.front(front_rows)
        if front is None:
            return scratch.write(known.best(), "known") if len(known.levels) > 1 else known.levels[0][0].select("of", "node", "dist")
        # The numbers of blocks that rows wait in, so that only these are read.
        active = [r.block for r in front.select("block").distinct().collect()]
        here = F.col("block").isin(active)
        rows = front.withColumn("fresh", F.lit(True)).unionByName(known.all().filter(here).select("of", "node", "dist", "block", F.lit(False).alias("fresh")))
        if marked is None:
            rows = rows.withColumn("most", none)
        else:
            rows = rows.unionByName(marked.filter(here).select("of", "node", none.alias("dist"), "block", F.lit(False).alias("fresh")))
            bound = known.all().join(marked.select("of", "node"), ["of", "node"], "left_semi").groupBy("of").agg((F.min("dist") * reach).alias("most"))
            rows = rows.join(bound, "of", "left")
        rows = rows.withColumn("part", part)
        edges = step.filter(here).join(F.broadcast(front.select("block", part.alias("part")).distinct()), "block")
        found = rows.groupBy("block", "part").cogroup(edges.groupBy("block", "part")).applyInPandas(lambda a, b: _search_block(a, b, reach), schema)
        # Of equal costs the one that was searched on from stands.
        found = found.groupBy("of", "node").agg(F.min(F.struct("dist", "open", "block")).alias("b")).select("of", "node", "b.*")
        found = scratch.write(found if bound is None else found.join(bound, "of", "left").filter("most is null or dist <= most").drop("most"), "reached")
        # Only what stands for the nodes reached is compared, so that what is known stays in place.
        was = known.all().select("of", "node", F.col("dist").alias("old")).join(sized(found.select("of", "node"), 1_000_000), ["of", "node"], "left_semi")
        was = was.groupBy("of", "node").agg(F.min("old").alias("old"))
        known.add(found.join(was, ["of", "node"], "left").filter("old is null or dist < old").select("of", "node", "dist", "block", "open"))
        known.merge()
    raise RuntimeError(f"costs still improve after {max_rounds} rounds")


def _onward(goals: DataFrame, known: DataFrame, chains: DataFrame, scratch: Scratch) -> DataFrame:
    """(of, node, dist, next, edge_ord, weight), written: the cost of every node that reaches a goal, and the edge to take from it; null at goals."""
    ahead = known.select("of", F.col("node").alias("end"), F.col("dist").alias("rest"))
    at_goal = goals.select("of", F.col("target").cast("long").alias("node")).distinct().withColumn("goal", F.lit(True))
    option = F.struct((F.col("rest") + F.col("total")).alias("dist"), F.col("dst").alias("next"), "edge_ord", "weight")
    options = chains.join(sized(ahead), "end").select("of", F.col("src").alias("node"), option.alias("o"), (F.col("total") > 0).alias("costs"))
    # Where an edge that costs nothing is among the cheapest, one that costs something goes before it.
    best = options.groupBy("of", "node").agg(F.min("o.dist").alias("dist"), F.min(F.when(F.col("costs"), F.col("o"))).alias("o"))
    both = best.join(at_goal, ["of", "node"], "full").withColumns({"goal": F.coalesce("goal", F.lit(False))})
    taken = F.when(~F.col("goal") & (F.col("o.dist") == F.col("dist")), F.col("o"))
    both = scratch.write(both.select("of", "node", "goal", F.when(F.col("goal"), F.lit(0.0)).otherwise(F.col("dist")).alias("dist"), taken.alias("o")), "onward")
    free = chains.filter("total = 0").select(F.col("src").alias("node"), "dst", "end", "edge_ord", "weight")
    open_ = both.filter("not goal and o is null")
    # Layers of nodes that only an edge without cost leads on from, towards those that are settled.
    while not open_.isEmpty():
        settled = both.filter("goal or o is not null").select("of", F.col("node").alias("end"), F.col("dist").alias("rest"))
        step = open_.select("of", "node", "dist").join(free, "node").join(settled, ["of", "end"]).filter(F.col("rest") == F.col("dist"))
        step = step.groupBy("of", "node").agg(F.min(F.struct("dist", F.col("dst").alias("next"), "edge_ord", "weight")).alias("p"))
        both = scratch.write(both.join(step, ["of", "node"], "left").select("of", "node", "goal", "dist", F.coalesce("o", "p").alias("o")), "onward")
        open_ = both.filter("not goal and o is null")
    return both.select("of", "node", "dist", "o.next", "o.edge_ord", "o.weight")


def distances(sources: DataFrame, edges: DataFrame, scratch: Scratch | None = None, steps: int = STEPS) -> DataFrame:
    """(problem_id, src) -> (problem_id, node, dist) for every node reached.

    As edges run both ways, one problem with all sites as sources gives every node's distance from its nearest site.
    """
    scratch = scratch or Scratch(sources.sparkSession, "distances")
    sources = scratch.write(sources.select(F.col("problem_id").alias("of"), F.col("src").cast("long").alias("target")).distinct(), "sources")
    # From the sources outwards: the same as towards them, with all edges turned round.
    turned = prepared(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "edge_ord"), scratch)
    chains = contracted(turned, sources.select(F.col("target").alias("node")), scratch)
    known = nearest(sources, chains, scratch, steps=steps)
    inside = chains.filter("inner")
    if inside.isEmpty():
        return known.select(F.col("of").alias("problem_id"), "node", "dist")
    every = known.unionByName(inside.join(sized(known.select("of", F.col("node").alias("end"), "dist")), "end").select("of", F.col("src").alias("node"), (F.col("dist") + F.col("total")).alias("dist")))
    return every.groupBy(F.col("of").alias("problem_id"), "node").agg(F.min("dist").alias("dist"))


# --- ways -------------------------------------------------------------------------------------------------------------


class Ways:
    """Pointers of 1, 2, 4, ... edges ahead, over a written (of, node, dist, next, edge_ord, weight)."""

    def __init__(self, onward: DataFrame, scratch: Scratch):
        self.scratch, self.onward = scratch, onward
        self.jumps = [self.onward.filter("next is not null").select("of", "node", F.col("next").alias("to"))]
        #: No table of pointers has more rows than this one.
        self.large = not small(self.onward.select("of", "node"))
        while True:
            last = self.jumps[-1]
            further = scratch.write(last.join(self._shuffled(last.select("of", F.col("node").alias("to"), F.col("to").alias("beyond"))), ["of", "to"]).select("of", "node", F.col("beyond").alias("to")), "jumps")
            if further.isEmpty():
                break
            self.jumps.append(further)

    def _shuffled(self, table: DataFrame) -> DataFrame:
        return table.hint("merge") if self.large else table

    def _met(self, places: DataFrame, table: DataFrame, few: bool) -> DataFrame:
        """Places with their rows of a table of all nodes, which stays where it is while they are few."""
        return table.join(F.broadcast(places), ["of", "at"]) if few else places.join(self._shuffled(table), ["of", "at"])

    def read(self, asked: DataFrame) -> DataFrame:
        """(of, node) -> (of, node, target, rest, way, edge_ords, cum) of nodes that reach a goal: the nodes from there to it, the edges, and costs so far."""
        own = asked.select("of", "node").distinct()
        places = own.select("of", "node", F.col("node").alias("at"), F.lit(0).cast("long").alias("pos"))
        few = False
        if self.large:
            places = self.scratch.write(places, "places")
            few = small(places, BROADCAST_ROWS // 4)
        for k in range(len(self.jumps) - 1, -1, -1):
            ahead = self.jumps[k].select("of", F.col("node").alias("at"), "to")
            places = places.unionByName(self._met(places, ahead, few).select("of", "node", F.col("to").alias("at"), (F.col("pos") + F.lit(1 << k)).alias("pos")))
            if k % 2 == 0:
                places = self.scratch.write(places, "places")
                # Before they are looked at again they can double twice.
                few = self.large and small(places, BROADCAST_ROWS // 4)
        rows = self._met(places, self.onward.withColumnsRenamed({"node": "at", "dist": "left"}), few)
        one = W.partitionBy("of", "node").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.select("of", "node", "pos", "at", "left", "edge_ord", F.coalesce(F.sum("weight").over(one), F.lit(0.0)).alias("done"))
        whole = rows.groupBy("of", "node").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "edge_ord", "done"))).alias("w"), F.min(F.struct("pos", "left")).alias("first"))
        return self.scratch.write(
            whole.select("of", "node", F.element_at("w.at", -1).alias("target"), F.col("first.left").alias("rest"), F.col("w.at").alias("way"), F.filter("w.edge_ord", lambda e: e.isNotNull()).alias("edge_ords"), F.col("w.done").alias("cum")), "ways"
        )


def shortest_to_targets(
    problems: DataFrame, targets: DataFrame, edges: DataFrame, excluded_nodes: DataFrame | None = None, excluded_edges: DataFrame | None = None, scratch: Scratch | None = None, max_rounds: int = MAX_ROUNDS, steps: int = STEPS
) -> DataFrame:
    """(problem_id, src), (target) or (problem_id, target), edges -> (problem_id, target, total_cost, nodes, edge_ords, cum).

    The cheapest target of each problem; problems without a path have no row.  Exclusions are (problem_id, node)
    and (problem_id, src, dst), the latter for all parallels.  A source that is excluded has no path; one that is a
    target has a path of length 0.
    """
    scratch = scratch or Scratch(problems.sparkSession, "routes")
    if excluded_nodes is not None or excluded_edges is not None:
        return detours(problems, targets, prepared(edges, scratch), excluded_nodes, excluded_edges, scratch, max_rounds, max(1, steps // 2))
    edges = prepared(edges, scratch)
    shared = "problem_id" not in targets.columns
    own = scratch.write(problems.select("problem_id", F.col("src").cast("long").alias("node"), (F.lit(0) if shared else F.col("problem_id")).alias("of")), "problems")
    goals = scratch.write(targets.select((F.lit(0) if shared else F.col("problem_id")).alias("of"), F.col("target").cast("long").alias("target")).distinct(), "targets")
    fixed = goals.select(F.col("target").alias("node")) if shared else goals.select(F.col("target").alias("node")).unionByName(own.select("node"))
    chains = contracted(edges, fixed, scratch)
    known = nearest(goals, chains, scratch, None if shared else own, max_rounds=max_rounds, steps=steps)
    found = Ways(_onward(goals, known, chains, scratch), scratch).read(own)
    return own.join(found, ["of", "node"]).select("problem_id", "target", F.element_at("cum", -1).alias("total_cost"), F.col("way").alias("nodes"), "edge_ords", "cum")


def detours(
    problems: DataFrame,
    targets: DataFrame,
    edges: DataFrame,
    excluded_nodes: DataFrame | None,
    excluded_edges: DataFrame | None,
    scratch: Scratch,
    max_rounds: int = MAX_ROUNDS,
    steps: int = 2,
    rest: DataFrame | None = None,
) -> DataFrame:
    """As ``shortest_to_targets``, over prepared edges and with exclusions: a search from the sources, whose rows carry their short paths.

    ``rest`` (node, rest), or (of, node, rest) if problems have a column ``of``: the least cost from a node to a target; nodes without it reach
    none. With it, problems may have ``most``: paths of a higher cost are not asked for.  Only rows that improved are written.
    """
    problems = scratch.write(problems, "problems")
    of = ["problem_id", "node"] if "problem_id" in targets.columns else ["node"]
    goals = scratch.write(targets.withColumnRenamed("target", "node").select(*of).distinct(), "targets")
    # Sizes are looked at once, before the loop.
    near = edges.select(F.col("src").alias("node"), "dst", "weight", "edge_ord")
    if rest is not None:
        # Edges to nodes beyond the costs that are asked for are never taken.
        most, without = problems.agg(F.max("most"), F.count_if(F.col("most").isNull())).first() if "most" in problems.columns else (None, 1)
        if not without and most is not None:
            rest = scratch.write(rest.filter(F.col("rest") <= most * (1 + 1e-9) + 1e-9), "within")
        near = near.join(sized(rest.select(F.col("node").alias("dst"))), "dst", "left_semi").select("node", "dst", "weight", "edge_ord")
    # Each node also leads to itself, so that a step keeps what it had.
    stay = near.select("node").unionByName(near.select(F.col("dst").alias("node"))).distinct()
    near = near.unionByName(stay.select("node", F.col("node").alias("dst"), F.lit(0.0).alias("weight"), F.lit(None).cast(near.schema["edge_ord"].dataType).alias("edge_ord")))
    near, marked = hinted(scratch.write(near, "near")), hinted(goals.withColumn("goal", F.lit(True)))
    no_nodes = None if excluded_nodes is None else hinted(scratch.write(excluded_nodes.select("problem_id", "node"), "no_nodes"))
    no_edges = None if excluded_edges is None else hinted(scratch.write(excluded_edges.select("problem_id", "src", F.col("dst").alias("node")), "no_edges"))
    limits = hinted(problems.select("problem_id", *[c for c in ("of", "most") if c in problems.columns]))
    left = None if rest is None else sized(rest)
    is_goal = lambda t: t.join(marked, of, "left").withColumn("goal", F.coalesce("goal", F.lit(False)))
    no = F.array().cast("array<bigint>")
    start = problems.select("problem_id", F.col("src").cast("long").alias("node"))
    if no_nodes is not None:
        start = start.join(no_nodes, ["problem_id", "node"], "left_anti")
    first = F.struct(F.lit(0.0).alias("cost"), F.array("node").alias("nodes"), no.alias("edge_ords"), F.array(F.lit(0.0)).alias("cum"))
    new = scratch.write(is_goal(start.distinct()).select("problem_id", "node", "goal", first.alias("path")), "improved")
    state, n_new = [new], new.count()
    n_all = n_new

    def stepped(front: DataFrame) -> DataFrame:
        step = front.join(near, "node").filter("dst = node or (not goal and not array_contains(path.nodes, dst))")
        if left is not None:
            step = step.join(limits, "problem_id").join(left.withColumnRenamed("node", "dst"), [c if c == "of" else "dst" for c in left.columns if c != "rest"])
            if "most" in problems.columns:
                step = step.filter("most is null or path.cost + weight + rest <= most * (1 + 1e-9) + 1e-9")
        cost = F.col("path.cost") + F.col("weight")
        path = F.struct(cost.alias("cost"), F.concat("path.nodes", F.array("dst")).alias("nodes"), F.concat("path.edge_ords", F.array("edge_ord")).alias("edge_ords"), F.concat("path.cum", F.array(cost)).alias("cum"))
        step = step.select("problem_id", F.col("node").alias("src"), F.col("dst").alias("node"), F.when(F.col("dst") == F.col("node"), F.col("path")).otherwise(path).alias("path"))
        if no_edges is not None:
            step = step.join(no_edges, ["problem_id", "src", "node"], "left_anti")
        if no_nodes is not None:
            step = step.join(no_nodes, ["problem_id", "node"], "left_anti")
        return is_goal(step.groupBy("problem_id", "node").agg(F.min("path").alias("path"))).select("problem_id", "node", "goal", "path")

    def every() -> DataFrame:
        out = state[0]
        for t in state[1:]:
            out = out.unionByName(t)
        return out

    for _ in range(max_rounds):
        # What costs more than the best target so far is not followed.
        few = n_new <= FEW and n_all <= FEW
        one = lambda t, few=few: t.coalesce(1) if few else t
        best = one(every()).filter("goal").groupBy("problem_id").agg(F.min("path.cost").alias("bound"))
        reached = one(new).filter("not goal").join(best, "problem_id", "left").filter("bound is null or path.cost < bound").select("problem_id", "node", "goal", "path")
        for _ in range(steps):
            reached = stepped(reached)
        reached = reached.join(best, "problem_id", "left").filter("bound is null or path.cost <= bound")
        both = reached.select("problem_id", "node", "goal", "path", F.lit(True).alias("fresh")).unionByName(one(every()).select("problem_id", "node", "goal", "path", F.lit(False).alias("fresh")))
        path = F.col("path")
        merged = one(both).groupBy("problem_id", "node").agg(F.first("goal").alias("goal"), F.min(F.when(F.col("fresh"), path)).alias("path"), F.min(F.when(~F.col("fresh"), path)).alias("was"))
        new = scratch.write(merged.filter("path is not null and (was is null or path < was)").drop("was"), "improved")
        n_new = new.count()
        if not n_new:
            break
        state.append(new)
        n_all += n_new
        if len(state) > LEVELS:
            state = [scratch.write(every().groupBy("problem_id", "node").agg(F.first("goal").alias("goal"), F.min("path").alias("path")), "merged")]
    else:
        raise RuntimeError(f"paths still improve after {max_rounds} rounds")
    found = every().filter("goal").groupBy("problem_id").agg(F.min(F.struct("path.cost", F.col("node").alias("target"), "path")).alias("b"))
    return found.select("problem_id", "b.target", F.col("b.cost").alias("total_cost"), "b.path.nodes", "b.path.edge_ords", "b.path.cum")


def route_pairs(pairs: DataFrame, roads: DataFrame) -> DataFrame:
    """(problem_id, src, target) -> the shortest path of each pair in plain metres; pairs without one have a null cost."""
    found = shortest_to_targets(pairs.select("problem_id", "src"), pairs.select("problem_id", "target"), undirected_edges(roads))
    return pairs.join(found.drop("target"), "problem_id", "left")


def path_edges(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Paths with an array of edges -> (keys, seq, edge_ord)."""
    return paths.select(*keys, F.posexplode("edge_ords").alias("seq", "edge_ord"))


# --- alternatives ------------------------------------------------------------------------------------------------------


def _turns(spurs: DataFrame, edges: DataFrame, ways: DataFrame) -> DataFrame:
    """(problem_id, of, src, root) -> each edge that leaves src for a node outside of the root, with the way on: dst, weight, edge_ord, lower, free.

    ``lower``: the least that a path over this edge costs; ``free``: the known way avoids the root, so that it is such a path.
    """
    out = join_checked(spurs, edges.select("src", "dst", "weight", "edge_ord"), "src").filter(~F.array_contains("root", F.col("dst")))
    out = out.join(ways.select("of", F.col("node").alias("dst"), "target", "rest", "way", F.col("edge_ords").alias("way_edges"), F.col("cum").alias("way_cum")), ["of", "dst"])
    return out.withColumns({"lower": F.col("weight") + F.col("rest"), "free": ~F.arrays_overlap("root", "way")})


def k_shortest_paths(origins: DataFrame, targets: DataFrame, edges: DataFrame, k: int = 3, reach: float = REACH) -> DataFrame:
    """(origin_id, src), and (target) or (origin_id, target) -> up to k loopless paths an origin: origin_id, path_id, target, total_cost, nodes, edge_ords.

    Yen's method, with the spurs of all origins of a round solved at once: from each node of the last accepted path, next hops of
    accepted paths with the same root are excluded in both directions, and so are the root's nodes.  Targets of an origin's own are searched up to
    ``reach`` times its cheapest cost; where k paths do not lie within that, again without a limit.
    """
    scratch = Scratch(origins.sparkSession, "yen")
    edges = prepared(edges, scratch)
    shared = "origin_id" not in targets.columns
    group = lambda: F.lit(0) if shared else F.col("origin_id")
    goals = scratch.write(targets.select(group().alias("of"), F.col("target").cast("long").alias("target")).distinct(), "targets")
    start = scratch.write(origins.select("origin_id", F.col("src").cast("long").alias("node"), group().alias("of")), "start")
    if shared:
        return _alternatives(start, goals, True, edges, scratch, k, None).drop("cum")
    near = scratch.write(_alternatives(start, goals, False, edges, scratch, k, reach), "near")
    full = near.groupBy("origin_id").agg(F.count(F.lit(1)).alias("n"), F.min("total_cost").alias("least"), F.max("total_cost").alias("most"), F.max(F.size("nodes")).alias("size"))
    full = full.filter(((F.col("n") == k) & (F.col("most") <= F.col("least") * reach)) | (F.col("size") == 1)).select("origin_id")
    # A second search only for those that have fewer paths, or paths that the limit may have hidden.
    again = scratch.write(start.join(near.select("origin_id").distinct(), "origin_id", "left_semi").join(full, "origin_id", "left_anti"), "again")
    if again.isEmpty():
        return near.drop("cum")
    more = _alternatives(again, goals.join(again.select("of").distinct(), "of", "left_semi"), False, edges, scratch, k, None)
    return near.join(full, "origin_id", "left_semi").unionByName(more).drop("cum")


def _alternatives(start: DataFrame, goals: DataFrame, shared: bool, edges: DataFrame, scratch: Scratch, k: int, reach: float | None) -> DataFrame:
    """(origin_id, node, of), (of, target) -> the paths, with ``cum``; what costs over ``reach`` times the cheapest may be missing."""
    fixed = goals.select(F.col("target").alias("node"))
    chains = contracted(edges, fixed if reach is None else fixed.unionByName(start.select("node")), scratch)
    known = nearest(goals, chains, scratch, None if reach is None else start, reach or 1.0)
    ways = Ways(_onward(goals, known, chains, scratch), scratch)
    rest = ways.onward.select("of", "node", F.col("dist").alias("rest"))
    cols = ["origin_id", "of", "target", "total_cost", "nodes", "edge_ords", "cum"]
    first = start.join(ways.read(start), ["of", "node"]).select("origin_id", "of", "target", F.element_at("cum", -1).alias("total_cost"), F.col("way").alias("nodes"), "edge_ords", "cum")
    accepted = scratch.write(first.select(*cols, F.lit(1).alias("path_id")), "accepted")
    pool = scratch.write(accepted.select(*cols).limit(0), "pool")
    for round_ in range(2, k + 1):
        last = accepted.filter(F.col("path_id") == round_ - 1)
        spurs = last.filter(F.size("nodes") > 1).select("origin_id", "of", "nodes", "edge_ords", "cum", F.explode(F.expr("sequence(0, size(nodes) - 2)")).alias("i"))
        spurs = spurs.select(
            "origin_id", "of", "i", F.get("nodes", F.col("i")).alias("src"), F.expr("slice(nodes, 1, i + 1)").alias("root"), F.expr("slice(edge_ords, 1, i)").alias("root_edges"), F.expr("slice(cum, 1, i + 1)").alias("root_cum"),
            F.concat_ws("/", F.col("origin_id").cast("string"), F.col("i").cast("string")).alias("problem_id"),
        )
        spurs = scratch.write(spurs, "spurs")
        if spurs.isEmpty():
            break
        same_root = spurs.select("origin_id", "problem_id", "i", "root").join(accepted.select("origin_id", "nodes"), "origin_id").filter(F.expr("slice(nodes, 1, i + 1) = root and size(nodes) > i + 1"))
        hops = scratch.write(same_root.select("problem_id", F.expr("nodes[i]").alias("src"), F.expr("nodes[i + 1]").alias("dst")).distinct(), "hops")
        asked = join_checked(spurs.select("of", "src"), edges.select("src", "dst"), "src").select("of", F.col("dst").alias("node"))
        turns = _turns(spurs.select("problem_id", "origin_id", "of", "src", "root", F.element_at("root_cum", -1).alias("base")), edges, ways.read(asked))
        turns = scratch.write(turns.join(hops, ["problem_id", "src", "dst"], "left_anti"), "turns")
        # A cost that the paths still asked for do not exceed: that of so many free turns and of paths that wait.
        waiting = pool.select("origin_id", "nodes", F.col("total_cost").alias("cost")).unionByName(turns.filter("free").select("origin_id", F.concat("root", "way").alias("nodes"), (F.col("base") + F.col("lower")).alias("cost")))
        most = waiting.dropDuplicates(["origin_id", "nodes"]).join(accepted.select("origin_id", "nodes"), ["origin_id", "nodes"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy("origin_id").orderBy("cost"))).filter(F.col("n") == k - round_ + 1).select("origin_id", F.col("cost").alias("most"))
        turns = turns.join(scratch.write(most, "most"), "origin_id", "left").withColumn("most", F.col("most") - F.col("base")).filter("most is null or lower <= most * (1 + 1e-9) + 1e-9")
        option = F.struct("lower", "target", "way", "edge_ord", "weight", "way_edges", "way_cum")
        by_spur = turns.groupBy("problem_id").agg(F.min(F.when(F.col("free"), option)).alias("b"), F.min(F.when(~F.col("free"), F.col("lower"))).alias("blocked"), F.first("most").alias("most"))
        by_spur = scratch.write(by_spur, "by_spur")
        solved = by_spur.filter("b is not null and (blocked is null or b.lower < blocked)").select(
            "problem_id", "b.target", F.concat(F.array(F.lit(None).cast("long")), "b.way").alias("nodes"), F.concat(F.array("b.edge_ord"), "b.way_edges").alias("edge_ords"),
            F.concat(F.array(F.lit(0.0)), F.transform("b.way_cum", lambda c: c + F.col("b.weight"))).alias("cum"),
        )
        open_ = by_spur.filter("blocked is not null and (b is null or b.lower >= blocked)").select("problem_id", F.least("most", "b.lower").alias("most"))
        open_ = scratch.write(spurs.join(open_, "problem_id").select("problem_id", "of", "src", "root", "i", "most"), "open")
        found = solved.select("problem_id", "target", F.col("nodes"), "edge_ords", "cum")
        if not open_.isEmpty():
            both_ways = hops.join(open_.select("problem_id"), "problem_id", "left_semi")
            both_ways = both_ways.unionByName(both_ways.select("problem_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
            no_nodes = open_.filter("i > 0").select("problem_id", F.explode(F.expr("slice(root, 1, i)")).alias("node"))
            own = goals.select("target") if shared else join_checked(open_.select("of", "problem_id"), goals, "of").select("problem_id", "target")
            searched = detours(open_.select("problem_id", "of", "src", "most"), own, edges, no_nodes, both_ways, scratch, rest=rest)
            found = found.unionByName(searched.select("problem_id", "target", "nodes", "edge_ords", "cum"))
        base = F.element_at("root_cum", -1)
        new = found.join(spurs.select("origin_id", "of", "problem_id", "root", "root_edges", "root_cum"), "problem_id").select(
            "origin_id", "of", "target", (base + F.element_at("cum", -1)).alias("total_cost"), F.concat("root", F.expr("slice(nodes, 2, size(nodes))")).alias("nodes"), F.concat("root_edges", "edge_ords").alias("edge_ords"),
            F.concat("root_cum", F.transform(F.expr("slice(cum, 2, size(cum))"), lambda c: base + c)).alias("cum"),
        )
        pool = scratch.write(pool.unionByName(new.select(*cols)).dropDuplicates(["origin_id", "nodes"]).join(accepted.select("origin_id", "nodes"), ["origin_id", "nodes"], "left_anti").select(*cols), "pool")
        best = pool.groupBy("origin_id").agg(F.min(F.struct("total_cost", "target", "nodes", "edge_ords", "cum", "of")).alias("b")).select("origin_id", "b.*")
        accepted = scratch.write(accepted.unionByName(best.select(*cols, F.lit(round_).alias("path_id"))), "accepted")
    return accepted.drop("of")


def snap(points: DataFrame, nodes: DataFrame, keys: list[str], x: str = "lng", y: str = "lat") -> DataFrame:
    """Rows with the node nearest to them; ``keys`` must name a row."""
    ids = points.select(F.struct(*keys).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    near = nearest_node(ids, nodes)
    return points.withColumn("id", F.struct(*keys)).join(near, "id").drop("id")


def evacuation_paths(origins: DataFrame, sites: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(origin_id, lat, lng) and (ord, name, lat, lng) -> (origin_id, src), and the k routes of each src: src, path_id, target, site, site_lat, site_lng, ...

    Origins that snap to one node share its routes.  Several sites may share a node: the first names it. Targets without a name are "Evacuation Site".
    """
    snapped = snap(sites.select("ord", "name", "lat", "lng"), nodes, ["ord"]).filter("node is not null")
    at = snapped.groupBy("node").agg(F.min_by(F.struct(F.col("name").alias("site"), F.col("lat").alias("site_lat"), F.col("lng").alias("site_lng")), "ord").alias("s")).select("node", "s.*")
    at = Scratch(origins.sparkSession, "sites").write(at, "sites")
    start = snap(origins.select("origin_id", "lat", "lng"), nodes, ["origin_id"]).filter("node is not null").select("origin_id", F.col("node").alias("src"))
    start = Scratch(origins.sparkSession, "origins").write(start, "origins")
    # All sites are targets of every origin: one set, shared.
    paths = k_shortest_paths(start.select(F.col("src").alias("origin_id"), "src").distinct(), at.select(F.col("node").alias("target")), edges, k)
    paths = paths.join(at, paths["target"] == at["node"], "left")
    return start, paths.select(F.col("origin_id").alias("src"), "path_id", "target", F.coalesce("site", F.lit("Evacuation Site")).alias("site"), "site_lat", "site_lng", "total_cost", "nodes", "edge_ords")


def evacuation_routes(origins: DataFrame, sites: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """As ``evacuation_paths``, a row for each origin and route: origin_id, path_id, target, site, total_cost, nodes, edge_ords."""
    start, paths = evacuation_paths(origins, sites, nodes, edges, k)
    return start.join(sized(paths), "src").select("origin_id", "path_id", "target", "site", "total_cost", "nodes", "edge_ords")
