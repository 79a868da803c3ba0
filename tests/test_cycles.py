"""Depths, components and shortest cycles against plain versions over random graphs, long chains and rings."""

import random

import pytest

from heddle.operators import cycles, graph


def frame(spark, edges):
    return spark.createDataFrame([("p", a, b) for a, b in edges] + [("q", b, a) for a, b in edges], "project string, src bigint, dst bigint")


def reach(edges):
    nodes, to = {n for e in edges for n in e}, {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)
    out = {}
    for n in nodes:
        seen, todo = set(), list(to.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        out[n] = seen
    return nodes, to, out


def plain(edges):
    """depth of each node; component of each node on a cycle; shortest cycle of each component."""
    nodes, to, far = reach(edges)
    part = {n: min(m for m in far[n] if n in far[m]) for n in nodes if n in far[n]}
    depths = {}

    def deep(n):
        if n not in depths:
            depths[n] = float("inf") if n in part or far[n] & part.keys() else max((deep(m) + 1.0 for m in to.get(n, ())), default=0.0)
        return depths[n]

    for n in nodes:
        deep(n)
    paths = {}
    for c in set(part.values()):
        dist, level = {c: 0}, [c]
        while level:
            level = sorted({m for n in level for m in to[n] if part.get(m) == c} - dist.keys())
            dist |= {m: max(dist.values()) + 1 for m in level}
        last = min((n for n in dist if c in to[n]), key=lambda n: (dist[n], n))
        way = [last]
        while way[-1] != c:
            way.append(min(n for n in dist if dist[n] == dist[way[-1]] - 1 and way[-1] in to[n]))
        paths[c] = way[::-1]
    return depths, part, paths


def check(spark, edges):
    """Both projects at once: the edges, and the edges turned round."""
    e = frame(spark, edges).cache()
    found = cycles.components(e)
    deep, rows = graph.depth(e).collect(), cycles.shortest_cycles(e, found).collect()
    found = found.collect()
    for project, turned in (("p", edges), ("q", [(b, a) for a, b in edges])):
        depths, part, paths = plain(turned)
        assert {r.node: r.depth for r in deep if r.project == project} == depths
        assert {r.node: r.cycle for r in found if r.project == project} == part
        assert {r.cycle: r.path for r in rows if r.project == project} == paths
    assert all(r.length == len(r.path) for r in rows)
    assert len(deep) == len({(r.project, r.node) for r in deep}) and len(found) == len({(r.project, r.node) for r in found})


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = [14, 50][seed]
    edges = {(r.randrange(n), r.randrange(n)) for _ in range([22, 60][seed])}
    chain = [1000 + k for k in range(9)]
    edges |= set(zip(chain, chain[1:], strict=False)) | {(3, 1000), (1008, r.randrange(n))}
    edges |= {(2000 + k, 2001 + k) for k in range(12)} | {(2100 + k, 2000 + k) for k in range(12)}  # a spine with legs
    check(spark, sorted(edges))


def test_rings_chords_loops_and_bridges(spark):
    ring = lambda ns: list(zip(ns, [*ns[1:], ns[0]], strict=True))
    a, b = list(range(20, 40)), [50, 44, 47, 41]
    edges = ring(a) + ring(b) + [(25, 33), (33, 90), (90, 91), (91, 92), (92, 44), (7, 7), (8, 8), (8, 20), (41, 6), (60, 61), (61, 60), (61, 62), (62, 60)]
    check(spark, edges)


def parts(spark, n):
    """Halves and thirds, and some doubles: ways down are short, most lead into a cycle."""
    return spark.range(n).selectExpr("'p' as project", "id as src", "explode(array(id div 2, if(id % 97 = 0, id * 2, id div 3))) as dst").filter("src <> dst").distinct()


@pytest.fixture
def staged(monkeypatch):
    """Tags of the tables that are staged."""
    tags, real = [], cycles.stage

    def noted(df, tag):
        tags.append(tag)
        return real(df, tag)

    monkeypatch.setattr(cycles, "stage", noted)
    return tags


def test_depth_stages_one_table_a_round_where_ways_are_short(spark, staged):
    e = parts(spark, 800)
    depths, _, _ = plain([(r.src, r.dst) for r in e.collect()])
    assert {r.node: r.depth for r in graph.depth(e).collect()} == depths
    assert len(staged) <= 3 + 2 + max(d for d in depths.values() if d < float("inf"))


def test_components_gather_colours_before_chains_where_ways_are_short(spark, staged):
    e = parts(spark, 800)
    _, part, _ = plain([(r.src, r.dst) for r in e.collect()])
    assert {r.node: r.cycle for r in graph.cycles(e).collect()} == part
    assert "short" not in staged


def test_report_of_short_ways_follows_no_chains(spark, staged):
    e = parts(spark, 800)
    _, part, _ = plain([(r.src, r.dst) for r in e.collect()])
    files = spark.range(800).selectExpr("'p' as project", "id as path")
    assert tuple(graph.analysis_summary(e, files).first()) == ("p", 800, 799, len(set(part.values())), float("inf"))
    assert "links" not in staged


def test_components_in_short_phases(spark):
    r = random.Random(5)
    ring, chain = list(range(100, 112)), list(range(200, 212))
    edges = {(r.randrange(25), r.randrange(25)) for _ in range(35)} | set(zip(ring, [*ring[1:], 100], strict=True)) | {(104, 109), (106, 102), (300, 300)}
    edges |= set(zip(chain, chain[1:], strict=False)) | {(b, a) for a, b in zip(chain, chain[1:], strict=False)} | {(211, 104), (112, 300), (101, 112)}
    edges = sorted(edges)
    found = cycles.components(frame(spark, edges), 1).collect()
    for project, turned in (("p", edges), ("q", [(b, a) for a, b in edges])):
        assert {x.node: x.cycle for x in found if x.project == project} == plain(turned)[1]
    assert len(found) == len({(x.project, x.node) for x in found})


@pytest.mark.parametrize("rounds", [1, 3])
def test_depth_in_short_phases(spark, rounds):
    for seed in range(2):
        r = random.Random(seed)
        ring, chain = list(range(100, 106)), list(range(200, 240))
        edges = {(r.randrange(30), r.randrange(30 * (seed % 2) + 1, 60)) for _ in range(45)}
        edges |= set(zip(ring, [*ring[1:], 100], strict=True)) | set(zip(chain, chain[1:], strict=False))
        edges |= {(300, 102), (300, 301), (301, 200), (302, 300), (302, 239), (303, 302), (303, 205), (304, 303), (304, 102), (r.randrange(30), 200)}
        edges |= {(400 + k, 401 + k) for k in range(15)} | {(500 + k, 400 + k) for k in range(15)} | {(400 + k, 600) for k in range(0, 15, 2)}
        edges = sorted(edges)
        found = graph.depth(frame(spark, edges), rounds).collect()
        for project, turned in (("p", edges), ("q", [(b, a) for a, b in edges])):
            assert {x.node: x.depth for x in found if x.project == project} == plain(turned)[0]
        assert len(found) == len({(x.project, x.node) for x in found})


def test_no_edges(spark):
    e = frame(spark, [])
    assert graph.depth(e).collect() == graph.cycles(e).collect() == graph.shortest_cycles(e).collect() == []


def test_no_cycles(spark):
    e = frame(spark, [(1, 2), (2, 3), (1, 3)])
    assert graph.cycles(e).collect() == graph.shortest_cycles(e).collect() == []


def test_a_chain_of_a_million_nodes_and_a_long_ring(spark):
    n = 1_000_000
    one = spark.range(n).selectExpr("'p' as project", "id as src", "id + 1 as dst")
    assert tuple(graph.depth(one).selectExpr("count(*)", "max(depth)", "min(depth)").first()) == (n + 1, float(n), 0.0)
    n = 100_000
    tail = one.filter(f"src < {n}").unionAll(spark.createDataFrame([("p", n, 10)], "project string, src bigint, dst bigint"))
    parts = graph.cycles(tail)
    assert tuple(parts.selectExpr("count(*)", "min(node)", "max(cycle)").first()) == (n - 9, 10, 10)


def test_the_path_of_a_long_ring(spark):
    n = 20_000
    ring = spark.range(n).selectExpr("'p' as project", "id + 10 as src", f"(id + 1) % {n} + 10 as dst")
    parts = ring.selectExpr("project", "src as node", "10L as cycle")
    assert tuple(cycles.shortest_cycles(ring, parts).selectExpr("cycle", "length", "path[0]", "path[1]", "element_at(path, -1)").first()) == (10, n, 10, 11, n + 9)


def test_closure_joins_no_more_than_its_result_on_a_chain(spark, monkeypatch):
    joined, beyond = [], graph._beyond

    def counted(*given):
        step = beyond(*given)
        joined.append(step.count())
        return step

    monkeypatch.setattr(graph, "_beyond", counted)
    chain = spark.range(100).selectExpr("'p' as project", "id as src", "id + 1 as dst")
    assert graph.closure(chain).count() == 5050
    assert len(joined) == 7 and sum(joined) <= 5050  # pairs joined at every node between would be some 60,000


def test_closure_of_random_graphs(spark):
    random.seed(7)
    for n, m in ((12, 14), (30, 45)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)]
        found = graph.closure(frame(spark, edges)).collect()
        _, _, far = reach(edges)
        want = {("p", a, b) for a in far for b in far[a]}
        assert len(found) == len(set(found)) and set(map(tuple, found)) == want | {("q", b, a) for _, a, b in want}
