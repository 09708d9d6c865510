import heapq
import random

import pytest

from tidewise.operators import graph

E = "src long, dst long, weight double, edge_ord long"


def both(rows):
    return [(u, v, w, i) for i, (u, v, w) in enumerate(rows)] + [(v, u, w, i) for i, (u, v, w) in enumerate(rows)]


def dijkstra(edges, src):
    out, heap, done = {}, [(0.0, src)], {}
    for u, v, w, _ in edges:
        out.setdefault(u, []).append((v, w))
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done[n] = d
        for v, w in out.get(n, ()):
            heapq.heappush(heap, (d + w, v))
    return done


def simple_paths(edges, src, targets):
    """All loopless paths up to the first target on them, cheapest parallels, in the order of cost, target, nodes."""
    best = {}
    for u, v, w, _ in edges:
        if u != v:
            best[u, v] = min(w, best.get((u, v), w))
    found = []

    def walk(path, cost):
        if path[-1] in targets:
            found.append((round(cost, 9), path[-1], path))
            return
        for (u, v), w in best.items():
            if u == path[-1] and v not in path:
                walk([*path, v], cost + w)

    walk([src], 0.0)
    return sorted(found)


def random_graph(rng, n, m):
    return both([(rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 20))) for _ in range(m)])


def test_shortest_against_heap(spark):
    rng = random.Random(4)
    edges = random_graph(rng, 30, 60)
    pairs = [(i, rng.randrange(30), rng.randrange(33)) for i in range(12)]
    got = graph.shortest_to_targets(spark.createDataFrame([p[:2] for p in pairs], "problem_id long, src long"), spark.createDataFrame([(p[0], p[2]) for p in pairs], "problem_id long, target long"), spark.createDataFrame(edges, E)).collect()
    want = {i: d[t] for i, s, t in pairs if t in (d := dijkstra(edges, s))}
    assert {r.problem_id: r.total_cost for r in got} == want
    cheap = {(u, v, o): w for u, v, w, o in edges}
    for r in got:
        assert sum(cheap[u, v, o] for u, v, o in zip(r.nodes, r.nodes[1:], r.edge_ords, strict=False)) == pytest.approx(r.total_cost)
    far = {(r.problem_id, r.node): r.dist for r in graph.distances(spark.createDataFrame([(0, 3), (0, 5)], "problem_id long, src long"), spark.createDataFrame(edges, E)).collect()}
    a, b = dijkstra(edges, 3), dijkstra(edges, 5)
    assert far == {(0, n): min(a.get(n, 1e9), b.get(n, 1e9)) for n in a.keys() | b.keys()}


def test_exclusions_and_edge_cases(spark):
    edges = spark.createDataFrame(both([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (0, 2, 4.0), (2, 2, 1.0), (7, 8, 1.0)]), E)
    run = lambda src, target, **kw: graph.shortest_to_targets(spark.createDataFrame([(1, src)], "problem_id long, src long"), spark.createDataFrame([(1, target)], "problem_id long, target long"), edges, **kw).collect()
    assert run(0, 2)[0].nodes == [0, 1, 2] and run(0, 2)[0].cum == [0, 1, 2]
    assert run(0, 0)[0].total_cost == 0 and run(0, 0)[0].edge_ords == []
    assert run(0, 7) == []
    nodes = spark.createDataFrame([(1, 1)], "problem_id long, node long")
    assert run(0, 2, excluded_nodes=nodes)[0].edge_ords == [3]
    assert run(1, 2, excluded_nodes=nodes) == []
    hop = spark.createDataFrame([(1, 0, 1)], "problem_id long, src long, dst long")
    assert run(0, 2, excluded_edges=hop)[0].total_cost == 4
    with pytest.raises(ValueError):
        graph.shortest_to_targets(spark.createDataFrame([(1, 0)], "problem_id long, src long"), spark.createDataFrame([(1, 1)], "problem_id long, target long"), spark.createDataFrame([(0, 1, -1.0, 0)], E))


def test_shared_targets_and_steps(spark):
    """One set of targets for all problems is the same as that set for each, however many steps a round has."""
    rng = random.Random(9)
    edges = spark.createDataFrame(random_graph(rng, 25, 45), E)
    starts = spark.createDataFrame([(i, rng.randrange(25)) for i in range(8)], "problem_id long, src long")
    goals = spark.createDataFrame([(3,), (17,), (21,)], "target long")
    each = starts.select("problem_id").crossJoin(goals)
    key = lambda df: sorted((r.problem_id, r.target, round(r.total_cost, 9), tuple(r.nodes)) for r in df.collect())
    want = key(graph.shortest_to_targets(starts, each, edges, steps=1))
    assert want and key(graph.shortest_to_targets(starts, goals, edges, steps=3)) == want
    with pytest.raises(RuntimeError):
        graph.shortest_to_targets(starts, goals, edges, max_rounds=1, steps=1)


@pytest.mark.parametrize("seed", [1, 2])
def test_k_paths_against_enumeration(spark, seed):
    rng = random.Random(seed)
    edges = random_graph(rng, 7, 12)
    origins = [(i, i) for i in range(4)]
    targets = [(i, t) for i in range(4) for t in ((5, 6) if i % 2 else (6,))]
    got = graph.k_shortest_paths(spark.createDataFrame(origins, "origin_id long, src long"), spark.createDataFrame(targets, "origin_id long, target long"), spark.createDataFrame(edges, E)).collect()
    for i, s in origins:
        want = simple_paths(edges, s, {t for o, t in targets if o == i})[:3]
        mine = sorted((r for r in got if r.origin_id == i), key=lambda r: r.path_id)
        assert [r.total_cost for r in mine] == [w[0] for w in want]
        assert len({tuple(r.nodes) for r in mine}) == len(mine) and all(len(set(r.nodes)) == len(r.nodes) for r in mine)


def test_nodes_edges_and_sites(spark):
    roads = spark.createDataFrame(
        [(0, 1, 2, 10.0, [(0.0, 0.0), (1.0, 1.0)]), (1, 2, 3, 0.0, [(1.5, 1.5), (2.0, 2.0)]), (2, None, 3, 1.0, [(0.0, 0.0), (2.0, 2.0)]), (3, 4, 5, float("nan"), [(9.0, 9.0)])],
        "ord long, u long, v long, length double, pts array<struct<x:double,y:double>>",
    )
    nodes = {r.node: (r.ord, r.lon) for r in graph.nodes_from_edges(roads).collect()}
    assert nodes == {1: (0, 0.0), 2: (1, 1.5), 3: (3, 2.0)}
    edges = {(r.src, r.dst): r.weight for r in graph.undirected_edges(roads).collect()}
    assert edges == {(1, 2): 10, (2, 1): 10, (2, 3): 1, (3, 2): 1, (4, 5): 1, (5, 4): 1}
    sites = spark.createDataFrame([(5, "late", 2.0, 2.0), (4, "early", 2.1, 2.1)], "ord long, name string, lat double, lng double")
    origins = spark.createDataFrame([(1, 0.1, 0.0)], "origin_id long, lat double, lng double")
    got = graph.evacuation_routes(origins, sites, graph.nodes_from_edges(roads), graph.undirected_edges(roads)).collect()
    assert [(r.origin_id, r.path_id, r.target, r.site, r.nodes) for r in got] == [(1, 1, 3, "early", [1, 2, 3])]
    pairs = graph.route_pairs(spark.createDataFrame([(1, 1, 3), (2, 1, 5)], "problem_id long, src long, target long"), roads).collect()
    assert {r.problem_id: r.total_cost for r in pairs} == {1: 11.0, 2: None}


def test_a_round_writes_what_improved(spark, monkeypatch):
    """Every table of a search holds rows that are better than all before, and no others; few or many, merged or not."""
    from tidewise.plans.scratch import Scratch

    rng = random.Random(12)
    edges = random_graph(rng, 60, 110)
    rows, write = [], Scratch.write

    def kept(self, df, name="t", **options):
        out = write(self, df, name, **options)
        if name == "improved":
            rows.append([(r.of, r.node, r.dist) for r in out.collect()])
        return out

    monkeypatch.setattr(Scratch, "write", kept)
    monkeypatch.setattr(graph, "LEVELS", 2)
    for few, front in ((graph.FEW, graph.FRONT), (-1, graph.FRONT), (-1, 4)):
        monkeypatch.setattr(graph, "FEW", few)
        rows.clear()
        scratch = Scratch(spark, "t")
        goals = spark.createDataFrame([(0, 3), (0, 40)], "of long, target long")
        chains = graph.contracted(graph.prepared(spark.createDataFrame(edges, E), scratch), goals.selectExpr("target as node"), scratch)
        got = {r.node: r.dist for r in graph.nearest(goals, chains, scratch, steps=1, front_rows=front).collect()}
        best = {}
        for table in rows:
            for of, node, dist in table:
                assert dist < best.get(node, float("inf"))
            best.update({node: dist for _, node, dist in table})
        assert got == best
        a, b = dijkstra(edges, 3), dijkstra(edges, 40)
        inner = {r.src for r in chains.filter("inner").collect()}
        assert got == {n: min(a.get(n, 1e9), b.get(n, 1e9)) for n in (a.keys() | b.keys()) - inner}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """5,000 hops between two junctions, a closed chain, and a ladder at the end."""
    from tidewise.plans.scratch import Scratch

    n, names, write = 5000, [], Scratch.write

    def named(self, df, name="t", **options):
        names.append(name)
        return write(self, df, name, **options)

    monkeypatch.setattr(Scratch, "write", named)
    rng = random.Random(3)
    rows = [(i, i + 1, float(rng.randint(1, 9))) for i in range(n)] + [(n, n + 1, 2.0), (n, n + 2, 3.0), (n + 1, n + 2, 2.0), (n + 2, n + 3, 1.0), (9001, 9002, 1.0), (9002, 9003, 1.0), (9003, 9001, 1.0)]
    edges = both(rows)
    far = {r.node: r.dist for r in graph.distances(spark.createDataFrame([(0, n + 3)], "problem_id long, src long"), spark.createDataFrame(edges, E)).collect()}
    assert far == dijkstra(edges, n + 3)
    assert names.count("improved") < 10 and names.count("chains") < 20
    names.clear()
    got = graph.shortest_to_targets(spark.createDataFrame([(1, 0), (2, 2500)], "problem_id long, src long"), spark.createDataFrame([(n + 3,)], "target long"), spark.createDataFrame(edges, E)).collect()
    assert {r.problem_id: (r.total_cost, len(r.nodes)) for r in got} == {1: (far[0], n + 3), 2: (far[2500], n - 2500 + 3)}
    for r in got:
        assert r.nodes[:2] == ([0, 1] if r.problem_id == 1 else [2500, 2501]) and r.nodes[-3:] == [n, n + 2, n + 3] and r.cum[-1] == r.total_cost and len(r.edge_ords) == len(r.nodes) - 1
    assert len(names) < 60


def test_edges_without_cost_and_ties(spark):
    edges = both([(0, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 3, 1.0), (3, 4, 0.0), (1, 5, 1.0), (5, 4, 0.0), (4, 6, 0.0)])
    got = graph.shortest_to_targets(spark.createDataFrame([(i, i) for i in range(7)], "problem_id long, src long"), spark.createDataFrame([(6,)], "target long"), spark.createDataFrame(edges, E)).collect()
    assert {r.problem_id: r.total_cost for r in got} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
    assert all(len(set(r.nodes)) == len(r.nodes) and r.nodes[-1] == 6 for r in got)
    tie = both([(0, 2, 1.0), (2, 3, 1.0), (0, 1, 1.0), (1, 3, 1.0)])
    run = lambda **kw: graph.shortest_to_targets(spark.createDataFrame([(1, 0)], "problem_id long, src long"), spark.createDataFrame([(1, 3)], "problem_id long, target long"), spark.createDataFrame(tie, E), **kw).collect()[0].nodes
    assert run() == [0, 1, 3]
    assert run(excluded_nodes=spark.createDataFrame([(1, 9)], "problem_id long, node long")) == [0, 1, 3]


def test_negative_costs_raise_everywhere(spark):
    bad, one = spark.createDataFrame(both([(0, 1, -1.0)]), E), spark.createDataFrame([(1, 0)], "problem_id long, src long")
    for run in (lambda: graph.distances(one, bad), lambda: graph.k_shortest_paths(one.toDF("origin_id", "src"), one.toDF("origin_id", "target"), bad), lambda: graph.shortest_to_targets(one, one.toDF("problem_id", "target"), bad)):
        with pytest.raises(ValueError):
            run()


def test_search_over_many_blocks(spark, monkeypatch):
    """Ways that leave their block and come back cost the same."""
    monkeypatch.setattr(graph, "BLOCK_NODES", 8)
    rng = random.Random(21)
    edges = both([(i, (i + 1) % 24, float(rng.randrange(1, 9))) for i in range(24)] + [(rng.randrange(24), rng.randrange(24), float(rng.randrange(9, 30))) for _ in range(14)])
    got = {r.node: r.dist for r in graph.distances(spark.createDataFrame([(0, 5)], "problem_id long, src long"), spark.createDataFrame(edges, E)).collect()}
    assert got == dijkstra(edges, 5)


def test_large_tables_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """Where no table counts as small, none goes through the driver because it is packed in few bytes; the routes stay the same."""
    from tidewise.plans import scratch as plans

    rng = random.Random(4)
    roads = [(i, i + 1, 1.0 + rng.random()) for i in range(40)] + [(i, i + 5, 6.0 + rng.random()) for i in range(35)]
    edges = spark.createDataFrame([(a, b, w, k) for k, (u, v, w) in enumerate(roads) for a, b in ((u, v), (v, u))], "src long, dst long, weight double, edge_ord long")
    problems, targets = spark.createDataFrame([(i, i) for i in range(0, 41, 4)], "problem_id long, src long"), spark.createDataFrame([(7,), (33,)], "target long")
    want = {i: min((d, t) for t, d in dijkstra([tuple(e) for e in edges.collect()], i).items() if t in (7, 33)) for i in range(0, 41, 4)}
    seen, write = set(), plans.Scratch.write

    def looked_at(self, df, name="t", *args, **kwargs):
        seen.add((name, "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name, *args, **kwargs)

    monkeypatch.setattr(plans.Scratch, "write", looked_at)
    for module in (plans, graph):
        monkeypatch.setattr(module, "small", lambda *a, **k: False, raising=False)
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1, raising=False)
    found = graph.shortest_to_targets(problems, targets, edges).collect()
    assert {r.problem_id: (pytest.approx(r.total_cost), r.target) for r in found} == want
    assert {(n, False) for n in ("block_steps", "onward", "jumps", "places", "ways")} <= seen
    assert not {n for n, sent in seen if sent} & {"block_steps", "onward", "jumps", "places", "ways"}
