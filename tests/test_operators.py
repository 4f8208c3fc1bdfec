"""Operators on small cases, against brute force and against each other."""

from __future__ import annotations

import heapq
import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfinder.functions import geometry as G
from wayfinder.operators import graph, joins, labels, merge, report, route, search, separators
from wayfinder.sources import catalog, features, files
from wayfinder.streaming import live


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def ring(points):
    return F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def points(spark, n, seed=0, side=100):
    r = random.Random(seed)
    rows = [(i, r.randrange(side), r.randrange(side)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x long, y long")


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_segments_meet(spark):
    cases = {
        ((0, 0), (2, 2), (0, 2), (2, 0)): True, ((0, 0), (1, 1), (1, 1), (2, 0)): True,  # ends count
        ((0, 0), (2, 0), (1, 0), (3, 0)): False, ((0, 0), (2, 0), (0, 1), (2, 1)): False, ((1, 1), (1, 1), (0, 0), (2, 2)): False, ((0, 0), (1, 0), (2, -1), (2, 1)): False,
    }
    got = one(spark, *[G.segments_meet(*[F.lit(v) for p in k for v in p]) for k in cases])
    assert list(got) == list(cases.values())


def test_rings(spark):
    closed = [(0, 0), (0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    got = one(spark, G.signed_area(ring(SQUARE)), G.signed_area(ring(SQUARE[::-1])), F.size(G.clean_ring(ring(closed))), G.bbox(ring(closed))["maxx"], G.inside_ring(G.point(F.lit(1.0), F.lit(1.0)), ring(SQUARE)), G.inside_ring(G.point(F.lit(5.0), F.lit(1.0)), ring(SQUARE)))
    assert list(got) == [16.0, -16.0, 4, 4.0, True, False]
    p = lambda x, y: G.point(F.lit(float(x)), F.lit(float(y)))
    assert list(one(spark, G.meets_ring(p(1, 1), p(2, 2), ring(SQUARE)), G.meets_ring(p(1, 1), p(9, 1), ring(SQUARE)))) == [False, True]


def test_offsets_and_boxes(spark):
    spike = [(0, 0), (10, 0), (0, 1)]
    got = one(spark, G.offset_ring(ring(SQUARE), 1.0), G.offset_ring(ring(SQUARE[::-1]), 1.0), F.size(G.offset_ring(ring(spike), 1.0)), F.size(G.offset_ring(ring(SQUARE[:2]), 1.0)), G.segment_boxes(ring([(0, 0), (0, 0), (3, 0)]), 0.5), G.square(G.point(F.lit(0.0), F.lit(0.0)), 1.0, crossed=True))
    assert {(round(p.x, 9), round(p.y, 9)) for p in got[0]} == {(-1, -1), (5, -1), (5, 5), (-1, 5)} == {(round(p.x, 9), round(p.y, 9)) for p in got[1]}
    assert got[2] == 4 and got[3] == 2  # the sharp corner is bevelled; two points stay
    assert len(got[4]) == 1 and {(p.x, p.y) for p in got[4][0]} == {(-0.5, -0.5), (3.5, -0.5), (3.5, 0.5), (-0.5, 0.5)}
    assert [(p.x, p.y) for p in got[5]] == [(-1, -1), (-1, 1), (1, -1), (1, 1)]


def test_projection_goldens_and_round_trip(spark):
    rows = [(55.783118890865836, 12.520150801914532, 648319.09, 1184560.355), (55.791325337950084, 12.5273370836679, 648759.694, 1185479.03)]
    df = spark.createDataFrame(rows, "lat double, lon double, ex double, ey double")
    x, y = G.project("lat", "lon")
    df = df.withColumns({"x": x, "y": y})
    la, lo = G.unproject("x", "y")
    for r in df.withColumns({"la": la, "lo": lo}).collect():
        assert abs(r.x - r.ex) < 0.01 and abs(r.y - r.ey) < 0.01 and abs(r.la - r.lat) < 1e-8 and abs(r.lo - r.lon) < 1e-8


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.booleans())
def test_knn_equals_brute_force(spark, seed, k, with_self):
    rows, df = points(spark, 60, seed)
    q = [(1000 + i, x, y) for i, x, y in points(spark, 8, seed + 1, 300)[0]] + rows[:20]
    got = {(r.id, r.rank): (r.other, r.d2) for r in joins.knn_join(spark.createDataFrame(q, "id long, x long, y long"), df, k, with_self).collect()}
    want = {}
    for i, x, y in q:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if with_self or j != i)[:k]
        want |= {(i, n + 1): (j, d) for n, (d, j) in enumerate(near)}
    assert got == want


def test_knn_of_uneven_points(spark):
    """One far point, clusters of different density, and many points on one place."""
    r = random.Random(6)
    rows = [(i, round(1e5 * (i % 3) + r.gauss(0, 10 ** (i % 3)), 3), round(r.gauss(0, 10 ** (i % 3)), 3)) for i in range(150)]
    rows += [(200 + i, 5.0, 5.0) for i in range(40)] + [(300, 1e8, -1e8)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {(x.id, x.rank): x.other for x in joins.knn_join(df, df, 4).collect()}
    for i, x, y in rows:
        near = sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, a, b in rows if j != i)[:4]
        assert [got[i, n] for n in range(1, 5)] == [j for _, j in near], i


def test_radius_and_matches(spark):
    rows, df = points(spark, 80, 3)
    got = {(r.id, r.other) for r in joins.radius_join(df, df, 12.0).collect()}
    assert got == {(a, b) for (a, x, y), (b, u, v) in itertools.permutations(rows, 2) if (x - u) ** 2 + (y - v) ** 2 <= 144}
    loose = {(r.id, r.other) for r in joins.radius_join(df, df, 12.0, reference=True).collect()}
    xy = {i: (x, y) for i, x, y in rows}
    assert loose == {(a, b) for a, b in got if xy[a][0] != xy[b][0] and xy[a][1] != xy[b][1]}
    box = {r.id: r.other for r in joins.box_match(df, df, 5).collect()}
    assert box == {i: min(j for j, u, v in rows if abs(x - u) < 5 and abs(y - v) < 5) for i, x, y in rows}
    q = spark.createDataFrame([(0, 10.004, 10.0), (1, 3.2, 7.9)], "id long, x double, y double")
    p = spark.createDataFrame([(5, 10.0, 10.0), (6, 3.0, 8.0)], "id long, x double, y double")
    assert {r.id: (r.other, r.exact) for r in joins.rounded_match(q, p).collect()} == {0: (5, True), 1: (6, False)}


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "id long, x double, y double")
    p = spark.createDataFrame([(1, 1.0, 1.0)], "id long, x double, y double")
    assert joins.knn_join(p, e, 3).count() == joins.knn_join(e, p, 3).count() == joins.radius_join(e, e, 1.0).count() == merge.grid_merge(e).count() == merge.dbscan_labels(e, 1.0, 1).count() == 0
    assert merge.greedy_merge(e, 1.0).count() == 0 and search.perimeter(e).count() == 0


def naive_dbscan(rows, eps, least, count_self):
    near = {i: {j for j, u, v in rows if j != i and (x - u) ** 2 + (y - v) ** 2 <= eps * eps} for i, x, y in rows}
    core = {i for i in near if len(near[i]) + count_self >= least}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core]
    return {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in near}


@pytest.mark.parametrize(("eps", "least"), [(8, 4), (10, 3), (5, 2)])
def test_dbscan(spark, eps, least):
    rows, df = points(spark, 90, eps)
    assert {r.id: r.label for r in merge.dbscan_labels(df, float(eps), least).collect()} == naive_dbscan(rows, eps, least, 1)


def test_greedy_merge(spark):
    rows, df = points(spark, 90, 11)
    gone, want = set(), {}
    for i, x, y in rows:
        if i not in gone:
            own = [(u, v, j) for j, u, v in rows if (x - u) ** 2 + (y - v) ** 2 <= 100]
            gone |= {j for *_, j in own}
            want[i] = (sum(u for u, *_ in own) / len(own), sum(v for _, v, _ in own) / len(own), len(own))
    got = {r.id: (r.x, r.y, r.n) for r in merge.greedy_merge(df, 10.0).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_merge_strategies(spark):
    _, df = points(spark, 30, 2)
    assert merge.merge(df).count() == 30 and merge.merge(df, "grid").count() <= 30 and merge.merge(df, merge.Merge.DBSCAN).count() <= 30
    with pytest.raises(ValueError, match="nonsense"):
        merge.merge(df, "nonsense")


def test_optics_separates_dense_groups(spark):
    r = random.Random(1)
    rows = [(i, 10 * (i % 2) + r.random(), r.random()) for i in range(60)] + [(60, 5.0, 40.0)]
    got = merge.optics_merge(spark.createDataFrame(rows, "id long, x double, y double"), 5, 0.05, 0.1, 3.0).collect()
    assert any(abs(p.x - 5) < 0.1 and p.y == 40 for p in got) and len(got) < 61


@pytest.mark.parametrize("kind", ["even", "lattice", "clusters", "line"])
@pytest.mark.parametrize("least", [1, 4, 16])
def test_optics_order_equals_that_of_all_distances(kind, least):
    r = np.random.default_rng(least)
    xy = {"even": r.uniform(0, 100, (300, 2)), "lattice": r.integers(0, 15, (300, 2)).astype(float), "clusters": np.concatenate([r.normal(c, s, (100, 2)) for c, s in ((0, 1), (20, 5), (60, 0.2))]), "line": np.stack([np.arange(300) * 3.0, np.zeros(300)], 1)}[kind]
    far = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    core = np.partition(far, least - 1, axis=1)[:, least - 1]
    reached, open_, run = np.full(300, np.inf), np.ones(300, bool), []
    for _ in range(300):
        i = int(np.flatnonzero(open_)[reached[open_].argmin()])
        open_[i] = False
        run.append(i)
        reached = np.where(open_, np.minimum(reached, np.maximum(core[i], far[i])), reached)
    near = np.argsort(far + np.diag(np.full(300, np.inf)), axis=1, kind="stable")
    for known in (near[:, : max(2, least - 1)], near[:, :20], near[:, :299]):
        got, at = merge._reachability(xy, known, least, 100.0)
        assert got.tolist() == run and at.tolist() == reached[run].tolist()


def test_density_integrates_to_one(spark):
    _, df = points(spark, 200, 5)
    b = report.bounds(df).first()
    area = (b.maxx - b.minx) * (b.maxy - b.miny) / 900
    assert abs(sum(r.density for r in merge.density_grid(df).collect()) * area - 1) < 1e-9


def boxes(spark, places, half=3):
    sides = []
    for i, (x, y) in enumerate(places):
        c = [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]
        sides += [(i, *c[k], *c[(k + 1) % 4]) for k in range(4)]
    return spark.createDataFrame([tuple(map(int, s)) for s in sides], "poly_id long, ax long, ay long, bx long, by long")


def test_visibility_and_buffer(spark):
    rows, df = points(spark, 60, 8)
    sides = boxes(spark, [(20, 20), (50, 60), (80, 30)])
    near = graph.knn_graph(df, 4)
    seen = {(r.src, r.dst) for r in joins.visible_knn(df, sides, 4, 10.0, 1000.0).collect()}
    assert seen <= {(r.src, r.dst) for r in near.collect()} and all((b, a) in seen for a, b in seen)
    seg = spark.createDataFrame([(0, 0, 20, 40, 20), (1, 0, 0, 10, 0), (2, 19, 19, 21, 21), (3, 0, 24, 40, 24)], "id long, ax long, ay long, bx long, by long")
    assert {r.id for r in joins.blocked(seg, sides, 10.0).collect()} == {0}
    assert {r.id for r in joins.visible(seg, sides, 10.0).collect()} == {1, 2, 3}
    assert {r.id for r in graph.near_obstacle(seg, sides, 10.0, 0.5).collect()} == {0, 2}  # wholly inside counts here
    assert {r.id for r in graph.near_obstacle(seg, sides, 10.0, 1.0).collect()} == {0, 2, 3}


def test_segment_cells_hold_every_point_of_the_segment(spark):
    r = random.Random(4)
    rows = [(i, *[r.uniform(-50, 50) for _ in range(4)]) for i in range(20)]
    got = {(c.id, c.cx, c.cy) for c in joins.segment_cells(spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double"), 7.0).collect()}
    for i, ax, ay, bx, by in rows:
        for k in range(201):
            t = k / 200
            assert (i, math.floor((ax + t * (bx - ax)) / 7), math.floor((ay + t * (by - ay)) / 7)) in got


@pytest.fixture(scope="module")
def network(spark):
    rows, df = points(spark, 120, 21, 200)
    edges = graph.knn_graph(df, 4, F.ceil(F.sqrt("d2") * 100).cast("long"))
    return {i: (x, y) for i, x, y in rows}, df.cache(), edges.cache()


def dijkstra(edges, s):
    out, heap, done = {}, [(0, s)], {s: 0}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    best = {}
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in out.get(u, []):
            if v not in best and d + w < done.get(v, math.inf):
                done[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return best


def test_searches_agree(spark, network):
    at, nodes, edges = network
    rows = [(r.src, r.dst, r.w) for r in edges.collect()]
    asked = [(k, k, (k * 37 + 11) % 120) for k in range(12)] + [(90, 5, 5), (91, 3, 100000)]
    q = spark.createDataFrame(asked, "query_id long, source long, target long")
    marks = search.landmark_distances(edges, search.select_landmarks(nodes, 8)).cache()
    runs = {
        "dijkstra": search.shortest_paths(edges, q), "astar": search.astar_paths(edges, nodes, q.where("query_id < 91"), 100.0), "alt": search.alt_paths(edges, q.where("query_id < 91"), marks), "both": search.bidirectional_paths(edges, q),
        "both_astar": search.bidirectional_paths(edges, q, search.euclidean_ahead(nodes, 100.0)), "both_alt": search.bidirectional_paths(edges, q, search.landmark_ahead(marks)),
    }
    weight = {(a, b): w for a, b, w in rows}
    visited = {}
    for name, run in runs.items():
        got = {r.query_id: r for r in run.collect()}
        visited[name] = sum(r.visited for r in got.values())
        for k, s, t in asked:
            if k not in got:
                continue
            want = 0 if s == t else dijkstra(rows, s).get(t)
            assert got[k].d == want, (name, k)
            if want is not None:
                path = got[k].path
                assert path[0] == s and path[-1] == t and sum(weight[e] for e in itertools.pairwise(path)) == want
    assert visited["astar"] < visited["dijkstra"] and visited["alt"] < visited["dijkstra"]


def test_searches_beyond_one_task_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    at = {i: (i % 6 + r.random() / 3, i // 6 + r.random() / 3) for i in range(36)}
    ways = [(a, b, math.dist(at[a], at[b])) for a in at for b in at if a < b and math.dist(at[a], at[b]) < 1.2 and r.random() < 0.8] + [(100, 101, 1.0)]
    edges = spark.createDataFrame([*ways, *[(b, a, w) for a, b, w in ways]], "src long, dst long, w double").cache()
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, x double, y double")
    q = spark.createDataFrame([(0, 0, 35), (1, 30, 5), (2, 7, 7), (3, 0, 100), (4, 999, 0), (5, 0, 999), (6, 999, 999), (7, 0, 35), (7, 3, 9)], "query_id long, source long, target long")
    marks = search.landmark_distances(edges, search.select_landmarks(nodes, 4)).cache()
    runs = {"dijkstra": lambda: search.shortest_paths(edges, q), "astar": lambda: search.astar_paths(edges, nodes, q), "both_alt": lambda: search.bidirectional_paths(edges, q, search.landmark_ahead(marks))}
    rows = lambda run: sorted((x.query_id, x.source, x.target, -1 if x.d is None else round(x.d, 9), x.path) for x in run().collect())
    want = {k: rows(run) for k, run in runs.items()}
    visited = sorted((x.query_id, x.source, x.visited) for x in runs["dijkstra"]().collect())
    monkeypatch.setattr(search, "SMALL_EDGES", 10)
    assert {k: rows(run) for k, run in runs.items()} == want
    assert sorted((x.query_id, x.source, x.visited) for x in runs["dijkstra"]().collect()) == visited
    still = [(a, b, 0.0) for a in range(4) for b in range(4) if a != b] + [(3, 4, 2.0), (4, 3, 2.0)]  # ways without length
    x = search.shortest_paths(spark.createDataFrame(still, "src long, dst long, w double"), spark.createDataFrame([(0, 2, 4)], q.schema)).first()
    assert (x.d, x.path) == (2.0, [2, 3, 4])


def test_both_ways_of_sssp_agree(spark, network):
    _, _, edges = network
    rows = [(r.src, r.dst, r.w) for r in edges.collect()]
    sources = spark.createDataFrame([(0,), (7,), (55,), (999,)], "source long")
    small = {(r.source, r.node): (r.d, r.prev) for r in search.sssp(edges, sources, distributed=False).collect()}
    large = {(r.source, r.node): (r.d, r.prev) for r in search.sssp(edges, sources, distributed=True).collect()}
    want = {(s, n): d for s in (0, 7, 55) for n, d in dijkstra(rows, s).items()}
    assert {k: d for k, (d, _) in small.items()} == want == {k: d for k, (d, _) in large.items() if k != (999, 999)}
    assert {k: v for k, v in large.items() if k != (999, 999)} == small
    near = {(r.source, r.node) for r in search.sssp(edges, sources, 3000.0, distributed=True).collect()} - {(999, 999)}
    assert near == {k for k, d in want.items() if d <= 3000}
    tree = search.sssp(edges, sources.where("source = 0"))
    ends = spark.createDataFrame([(0, t) for t in (5, 50, 111) if (0, t) in want], "source long, target long")
    for t in [r.target for r in ends.collect()]:
        path = [r.node for r in search.paths_from(tree, ends).where(F.col("target") == t).orderBy(F.desc("seq")).collect()]
        weight = {(a, b): w for a, b, w in rows}
        assert path[0] == 0 and path[-1] == t and sum(weight[e] for e in itertools.pairwise(path)) == want[0, t]


def test_both_ways_of_sssp_agree_without_lengths(spark):
    """Ways without length go round; following prev doesn't."""
    r = random.Random(9)
    ways = [(10, 7, 5.0), (7, 3, 0.0), (3, 7, 0.0), (3, 3, 0.0)] + [(r.randrange(30), r.randrange(30), float(r.choice([0, 0, 1, 2]))) for _ in range(90)]
    edges = spark.createDataFrame(ways, "src long, dst long, w double").cache()
    sources = spark.createDataFrame([(10,), (0,), (5,)], "source long")
    small, large = ({(x.source, x.node): (x.d, x.prev) for x in search.sssp(edges, sources, distributed=d).collect()} for d in (False, True))
    assert small == large and {k: d for k, (d, _) in small.items()} == {(s, n): d for s in (10, 0, 5) for n, d in dijkstra(ways, s).items()}
    tree = spark.createDataFrame([(*k, *v) for k, v in small.items()], "source long, node long, d double, prev long")
    ends = tree.select("source", F.col("node").alias("target"))
    walked = search.paths_from(tree, ends).groupBy("source", "target").agg(F.max_by("node", "seq").alias("first")).collect()
    assert len(walked) == len(small) and all(x.first == x.source for x in walked)


def test_landmark_bounds_never_exceed_distances(spark, network):
    _, nodes, edges = network
    marks = search.landmark_distances(edges, search.select_landmarks(nodes, 8)).cache()
    pairs = spark.createDataFrame([(a, b) for a in range(0, 120, 13) for b in range(5, 120, 17)], "source long, target long")
    d = search.sssp(edges, pairs.select("source")).withColumnRenamed("node", "target")
    assert search.lower_bounds(pairs, marks).join(d, ["source", "target"]).where("bound > d").isEmpty()
    with pytest.raises(ValueError, match="at least 4"):
        search.perimeter(nodes, 3)


def test_graph_upkeep(spark, network):
    _, nodes, edges = network
    g = graph.SpatialGraph(nodes, edges)
    n = edges.count()
    e = edges.first()
    assert g.remove_edges(spark.createDataFrame([(e.src, e.dst)], "src long, dst long")).edges.count() == n - 2
    less = g.remove_points(spark.createDataFrame([(e.src,)], "id long"))
    assert less.nodes.count() == 119 and less.edges.where((F.col("src") == e.src) | (F.col("dst") == e.src)).isEmpty()
    more = g.add_edges(spark.createDataFrame([(0, 119, 1)], "src long, dst long, w long"))
    assert more.neighbor_cost(119, 0).first().w == 1 and more.neighbors(119).where("dst = 0").count() == 1
    assert g.closest(spark.createDataFrame([(0, -5, -5)], "id long, x long, y long")).count() == 1
    assert graph.seed_of(nodes, edges) is not None
    s = graph.statistics(nodes, edges).first()
    assert (s.nodes, s.edges) == (120, n // 2)
    assert graph.grid_graph(3, 2, spark).count() == 22


def test_components(spark):
    nodes = spark.range(0, 50)
    edges = spark.createDataFrame([(i, i + 5) for i in range(0, 20)] + [(30, 30), (41, 40)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: i % 5 if i < 25 else 40 if i == 41 else i for i in range(50)}
    assert {r.id for r in graph.component_of(7, nodes, edges).collect()} == {2, 7, 12, 17, 22}
    assert {r.id for r in graph.largest_component(nodes, edges).collect()} == {0, 5, 10, 15, 20}


def lines(spark, rows):
    return spark.createDataFrame([(q, k, float(x), float(y)) for q, path in rows.items() for k, (x, y) in enumerate(path)], "query_id long, seq int, x double, y double")


def place(spark, rows):
    return spark.createDataFrame([(q, float(x), float(y)) for q, (x, y) in rows.items()], "query_id long, x double, y double")


def test_attach_tiers_and_stitching(spark):
    paths = lines(spark, {0: [(0, 0), (10, 0), (20, 0), (30, 0)], 1: [(0, 0), (10, 0)], 2: [(0, 0), (100, 0)]})
    wall = spark.createDataFrame([(0, 5.0, 2.0, 40.0, 2.0)], "poly_id long, ax double, ay double, bx double, by double")
    at = {r.query_id: (r.seq, r.tier) for r in route.attach(place(spark, {0: (2, 5), 1: (9, 3), 2: (500, 500)}), paths, wall, 10.0, 25.0).collect()}
    assert at == {0: (0, 0), 1: (1, 1), 2: (1, 2)}  # past the wall's end the first vertex is seen; behind it, and far away, the nearest stands
    closed = spark.createDataFrame([(0, -100.0, 2.0, 100.0, 2.0)], "poly_id long, ax double, ay double, bx double, by double")
    assert route.attach(place(spark, {0: (19, 5)}), paths, closed, 10.0, 25.0).first()[1::3] == (2, 1)
    none = wall.limit(0)
    full = route.continuous_paths(place(spark, {0: (0, 1)}), place(spark, {0: (30, 1)}), paths.where("query_id = 0"), none, 10.0, 5.0)
    assert [(r.x, r.y) for r in full.orderBy("seq").collect()] == [(0, 1), (0, 0), (10, 0), (20, 0), (30, 0), (30, 1)]
    direct = route.continuous_paths(place(spark, {7: (0, 1)}), place(spark, {7: (3, 5)}), paths.limit(0), none, 10.0)
    assert route.path_lengths(direct).first().length == 5.0


def test_project_and_progress(spark):
    paths = lines(spark, {0: [(0, 0), (10, 0), (10, 10)], 1: [(0, 0), (0, 0)]})
    r = route.project_onto(place(spark, {0: (4, 3), 1: (3, 4)}), paths).orderBy("query_id").collect()
    assert [(x.seg, x.t, x.x, x.y, x.d) for x in r] == [(0, 0.4, 4, 0, 3), (0, 0, 0, 0, 5)]
    p = route.split_progress(place(spark, {0: (22, 5)}), paths).first()
    assert (p.traveled, p.remaining, p.off_route) == (15, 5, True)


def test_labels(spark):
    names = spark.createDataFrame([("Hall",), ("hall B",), ("",)], "name string")
    index = labels.substring_index(names)
    assert {r.substr for r in index.where("name = 'Hall'").collect()} == {"h", "a", "l", "ha", "al", "ll", "hal", "all", "hall"}
    assert labels.substring_index(names, lower=False).where("substr = 'H'").count() == 1
    _, nodes = points(spark, 20, 1)
    near = labels.label_points(spark.createDataFrame([("Hall", 5, 5)], "name string, x long, y long"), nodes, 3)
    assert len(labels.nested_labels(near).first().nodes) == 3
    got = labels.suggest(spark.createDataFrame([(" HALL ",), ("q",)], "q string"), index, near).collect()
    assert {(r.name, r.node is None) for r in got} == {("Hall", False), ("hall B", True)}
    met = labels.contains(spark.createDataFrame([("HAL",), ("l",), ("",), ("ll b",), ("hx",)], "q string"), names).collect()
    assert {(r.q, r.name, r.rank) for r in met} == {("HAL", "Hall", 1), ("HAL", "hall B", 2), ("l", "Hall", 1), ("l", "hall B", 2), ("", "", 1), ("", "Hall", 2), ("", "hall B", 3), ("ll b", "hall B", 1)}
    both = spark.createDataFrame([("a", 1.0, 1.0, 1), ("a", 2.0, 2.0, 2)], "name string, x double, y double, order int")
    assert labels.last_of_each(both).first()[1:] == (2.0, 2.0)


GEOMETRIES = [
    ("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0, 9], [1, 1, 9]]), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]), ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]),
    ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5, 5], [5.5, 5], [5.5, 5.5], [5, 5]]]]), ("LineString", []),
]


def test_geojson(spark, tmp_path):
    fs = [{"geometry": {"type": t, "coordinates": c}, "properties": {"n": str(i)}} for i, (t, c) in enumerate(GEOMETRIES)]
    fs += [{"geometry": None, "properties": None}, {"geometry": {"type": "GeometryCollection", "geometries": [{"type": t, "coordinates": c} for t, c in GEOMETRIES[:3]]}, "properties": {}}]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    (tmp_path / "b.json").write_text("not json")
    f = features.read_layers(spark, {"parker": str(tmp_path / "a.json"), "forareal": str(tmp_path / "b.json"), "llyn_bro": str(tmp_path / "none.json")})
    got = {r.feature_id: [p.role for p in r.parts] for r in f.collect()}
    assert got == {0: ["point"], 1: ["point"] * 2, 2: ["line"], 3: ["line"] * 2, 4: ["outer", "hole"], 5: ["outer", "outer", "hole"], 6: [], 7: [], 8: ["point"] * 3 + ["line"]}
    assert features.polygons(f).count() == 1 + 2 + 1 + 2 + 1 + 2 + 0 + 4 and features.polylines(f).count() == 4
    assert features.of_role(f, "walkable").count() == 9 and features.of_role(f, "obstacle").count() == 0
    b = features.building_points(f, "n").where("number = '4'").first()
    assert (b.x, b.y) == (2, 2)
    features.register(spark)
    server = spark.read.format("wfs").option("url", f"file:{tmp_path}/{{layer}}.json").option("layers", "a, b, c")
    with pytest.raises(Exception, match="can't be read"):
        server.load().collect()
    raw = server.option("skip", "true").load()
    assert [r.layer for r in raw.collect()] == ["a"] and features.from_geojson(raw).count() == 9


def test_capabilities(spark):
    old = '<WMT_MS_Capabilities><Layer><Title>r</Title><Layer><Name>w:a</Name><Title>A</Title><Abstract>x</Abstract><SRS>E1</SRS><LatLonBoundingBox minx="1" miny="2" maxx="3" maxy="4"/></Layer><Layer><Title>no name</Title></Layer></Layer></WMT_MS_Capabilities>'
    new = '<wms:WMS xmlns:wms="u"><wms:Layer><wms:Layer><wms:Name>b</wms:Name><wms:CRS>E2</wms:CRS></wms:Layer></wms:Layer></wms:WMS>'
    got = {r.name: r for r in catalog.from_capabilities(spark.createDataFrame([(old,), (new,)], "xml string")).collect()}
    assert got["a"].workspace == "w" and got["a"].bbox.maxy == "4" and got["a"].crs == ["E1"] and got["a"].abstract == "x"
    assert got["b"].workspace is None and got["b"].bbox is None and got["b"].crs == ["E2"] and len(got) == 2
    layers = spark.createDataFrame([("w:bygning_x", "bygning_x", "T"), ("w:zz", "zz", "q"), ("w:parkering", "parkering", "")], "full_name string, name string, title string")
    assert {r.name: r.category for r in catalog.categorized(layers).collect()} == {"bygning_x": "buildings", "zz": "other", "parkering": "parking"}


def test_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 9.0, 9.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 1, 5.0)], "src long, dst long, w double")
    g = graph.SpatialGraph(nodes, edges)
    files.write_adjacency(g, str(tmp_path / "adj"))
    text = {}
    for p in (tmp_path / "adj").glob("part-*"):
        for line in p.read_text().splitlines():
            text |= json.loads(line)
    assert text == {"0.0,0.0": [[5.0, [3.0, 4.0]]], "3.0,4.0": [[5.0, [0.0, 0.0]]]}
    (tmp_path / "g.json").write_text(json.dumps(text))
    back = files.read_adjacency(spark, str(tmp_path / "g.json"))
    assert back.nodes.count() == 2 and {r.w for r in back.edges.collect()} == {5.0} and back.edges.count() == 2
    files.write_graph(g, str(tmp_path / "pq"))
    assert files.read_graph(spark, str(tmp_path / "pq")).edges.count() == 2
    assert files.read_points(spark, str(tmp_path / "none.json")) == (None, False)
    built = []
    build = lambda: built.append(1) or nodes
    assert [files.load_or_build(spark, str(tmp_path / "t"), build).count() for _ in range(2)] == [3, 3] and built == [1]
    (tmp_path / "c.json").write_text('{"a": "true", "b": "False", "c": "x", "d": 3}')
    assert files.settings(str(tmp_path / "c.json")) == {"a": True, "b": False, "c": "x", "d": 3}


def test_result_files(spark, tmp_path):
    paths = spark.createDataFrame([("a", "g", 0, 1.0, 2.005)], "algorithm string, type string, seq int, x double, y double")
    runs = spark.createDataFrame([("a", "g", 2, 3.14159, 5, 6, 7, 1.5), ("b", "g", 0, None, 1, 1, 1, 0.25)], "algorithm string, type string, nodes int, d double, visited int, relaxed int, heap_ops int, time_ms double")
    files.write_results(paths, runs, str(tmp_path))
    back = spark.read.option("header", True).csv(str(tmp_path / "algorithm_summary"))
    assert {(r.algorithm, r.distance, r.time_ms) for r in back.collect()} == {("a", "3.14", "1.500"), ("b", "inf", "0.250")}
    layers = spark.createDataFrame([("w:bygning", "bygning", "T"), ("w:q", "q", "")], "full_name string, name string, title string")
    files.write_catalogue(layers, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c" / "categories").glob("category=*")} == {"category=buildings", "category=other"}
    p = lambda x: G.point(F.lit(x), F.lit(1.0))
    assert list(one(spark, G.nearly_equal(p(1.0), p(1.0 + 1e-12)), G.nearly_equal(p(1.0), p(1.1)))) == [True, False]


def test_streams(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, 7, timestamp'2024-01-01 00:00:00', 1D, 0D, 5D), (2, 7, timestamp'2024-01-01 00:30:00', 2D, 0D, 30D), (3, 7, timestamp'2024-01-01 00:40:00', 3D, 0D, 31D), (4, 7, timestamp'2024-01-01 02:00:00', 9D, 0D, 0D), (5, 7, timestamp'2024-01-01 02:30:00', 9D, 3D, 25D), (6, 8, timestamp'2024-01-01 01:00:00', 4D, 1D, 1D) AS t(event_id, route_id, ts, x, y, d)").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = lambda: live.as_stream(spark, str(tmp_path), "events")
    assert {(r.route_id, r.x, r.y) for r in live.run_to_end(live.latest(stream()), "complete").collect()} == {(7, 9, 3), (8, 4, 1)}
    assert {(r.route_id, r.start.hour, r.n) for r in live.run_to_end(live.windows(stream()), "complete").collect()} == {(7, 0, 3), (7, 2, 2), (8, 1, 1)}
    assert [(r.version, r.x) for r in live.run_to_end(live.reroutes(stream().select("route_id", "ts", "x", "y", "d"), 20.0)).orderBy("version").collect()] == [(1, 2), (2, 9)]
    seen = []
    paths = lines(spark, {7: [(0, 0), (20, 0)], 8: [(0, 0), (8, 0)]})
    live.progress(spark, stream(), paths, lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert {(r.query_id, r.traveled, r.remaining) for r in seen} == {(7, 9, 11), (8, 4, 4)}


def test_windows_leave_their_rows_in_files(spark, tmp_path):
    spark.range(300).select((F.col("id") % 90).alias("route_id"), F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = live.run_to_end(live.windows(live.as_stream(spark, str(tmp_path), "events")), "complete")
    assert got.inputFiles() and got.agg(F.sum("n")).first()[0] == 300  # a table in the driver's memory has no files


def test_debounced_leave_their_rows_in_files(spark, tmp_path):
    spark.range(200).select((F.col("id") % 2).alias("session_id"), F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("ts"), F.col("id").cast("string").alias("q")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = live.run_to_end(live.debounced(live.as_stream(spark, str(tmp_path), "events"), "3 minutes"), "complete")
    assert got.inputFiles() and {(r.session_id, r.q) for r in got.collect()} == {(0, "198"), (1, "199")}
    none = live.run_to_end(live.as_stream(spark, str(tmp_path), "events").where("session_id > 5"))
    assert none.count() == 0 and none.columns == ["session_id", "ts", "q"]


def _links(rows, radius, reference):
    return {(i, j) for (i, x, y), (j, u, v) in itertools.permutations(rows, 2) if (x - u) ** 2 + (y - v) ** 2 <= radius**2 and not (reference and (x == u or y == v))}


def _naive_components(ids, links):
    least = {i: i for i in ids}
    while True:
        new = dict(least)
        for a, b in links:
            new[a] = min(new[a], new[b], least[b])
        if new == least:
            return least
        least = new


@pytest.mark.parametrize(("reference", "n", "wide", "radius", "seed"), [(False, 70, 40, 5.0, 1), (True, 90, 12, 4.0, 2), (True, 60, 4, 9.0, 3)])
def test_components_and_clusters_without_pairs(spark, reference, n, wide, radius, seed):
    r = random.Random(seed)
    rows = [(i, float(r.randrange(wide)), float(r.randrange(max(2, wide // (1 + seed % 2 * 9))))) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    links = _links(rows, radius, reference)
    assert {x.node: x.component for x in graph.radius_components(df, radius, reference).collect()} == _naive_components(range(n), links)
    count = {i: sum(a == i for a, _ in links) for i in range(n)}
    assert {x.id for x in graph.crowded(df, radius, 4, reference).collect()} == {i for i in count if count[i] >= 4}
    if not reference:
        assert {x.id for x in merge.without_outliers(df, radius, 5).collect()} == {i for i in count if count[i] >= 4}
    core = {i for i in count if count[i] >= 3}
    label = _naive_components(core, {(a, b) for a, b in links if a in core and b in core})
    want = {i: label.get(i, min((label[b] for a, b in links if a == i and b in core), default=-1)) for i in range(n)}
    got = merge.dbscan_labels(df, radius**0.5 if reference else radius, 3 if reference else 4, reference)
    assert {x.id: x.label for x in got.collect()} == want


def test_rows_of_points_that_share_an_axis(spark):
    """A cross and a corner, where reference mode links little, and two far groups whose nearest points aren't the outermost."""
    for rows in ([(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 0, 1), (4, 0, 2)], [(0, 5, 5), (1, 6, 6), (2, 5, 6), (3, 5, 7)], [(0, 1, 1), (1, 1, 1), (2, 1, 2)]):
        df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, x double, y double")
        assert {x.node: x.component for x in graph.radius_components(df, 9.0, True).collect()} == _naive_components([i for i, *_ in rows], _links(rows, 9.0, True))
    rows = [(0, 0.0, 0.0), (1, 6.0, 6.9), (2, 6.0, 0.0), (3, 14.5, 0.0), (4, 16.0, 6.9), (5, 20.0, 3.0)]
    df = spark.createDataFrame([(i, x, y) for i, x, y in rows], "id long, x double, y double")
    assert {x.node: x.component for x in graph.radius_components(df, 10.0).collect()} == _naive_components(range(6), _links(rows, 10.0, False))


def test_dense_points_make_few_pairs(spark, monkeypatch):
    df = spark.range(3000).select("id", ((F.col("id") * 7) % 61 / 10).alias("x"), ((F.col("id") * 11) % 53 / 10).alias("y"))
    plain = joins.radius_join

    def few(*args):
        assert plain(*args).count() <= 30 * 3000, "all pairs were made"
        return plain(*args)

    monkeypatch.setattr(joins, "radius_join", few)
    monkeypatch.setattr(merge, "radius_join", few)
    assert {r.label for r in merge.dbscan_labels(df, 10.0, 4).collect()} == {0}
    assert merge.without_outliers(df, 10.0, 12).count() == 3000


def test_ring_hits_and_ends_inside_rings(spark):
    r = random.Random(8)
    boxes = {i: (r.uniform(0, 60), r.uniform(0, 60), r.uniform(1, 5)) for i in range(40)}
    corners = {i: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)] for i, (x, y, h) in boxes.items()}
    rings = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in c]) for i, c in corners.items()], f"poly_id long, ring {G.RING}")
    lines_ = [(k, r.uniform(0, 60), r.uniform(0, 60), r.uniform(0, 60), r.uniform(0, 60)) for k in range(60)]
    seg = spark.createDataFrame(lines_, "id long, ax double, ay double, bx double, by double")
    every = seg.crossJoin(rings).where(G.meets_ring(G.point("ax", "ay"), G.point("bx", "by"), F.col("ring"))).select("id", "poly_id").collect()
    assert {tuple(x) for x in joins.ring_hits(seg, rings, 10.0).collect()} == {tuple(x) for x in every}
    sides = rings.select("poly_id", F.explode(G.ring_sides(F.col("ring"))).alias("s")).select("poly_id", "s.*")
    tiny = spark.createDataFrame([(k, a, b, a + 0.01, b) for k, a, b, *_ in lines_], seg.schema)
    found = graph.near_obstacle(tiny, sides, 10.0, 0.001)
    inside = {k for k, a, b, *_ in lines_ if any(abs(a - x) < h and abs(b - y) < h for x, y, h in boxes.values())}
    assert inside and {x.id for x in found.collect()} >= inside
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("cx#" in x for x in plan.splitlines() if "Join" in x and "cy#" in x), "ends meet all rings of a row of cells"


def test_searches_of_one_file_go_to_all_tasks(spark, network):
    _, nodes, edges = network
    q = spark.createDataFrame([(k, k, 119 - k) for k in range(40)], "query_id long, source long, target long").coalesce(1)
    marks = search.landmark_distances(edges, search.select_landmarks(nodes, 8))
    for run in (search.shortest_paths(edges, q), search.bidirectional_paths(edges, q), search.bidirectional_paths(edges, q, search.landmark_ahead(marks))):
        assert run.rdd.getNumPartitions() > 1


def test_visited_counts_equal_those_of_the_tree(spark, network):
    _, _, edges = network
    ends = spark.createDataFrame([(k, (k * 37 + 11) % 120) for k in range(20)] + [(5, 5), (3, 99999)], "source long, target long")
    want = {tuple(x) for x in search.nodes_visited(search.sssp(edges, ends.select("source").distinct()), ends).collect()}
    got = search.visited_counts(edges, ends)
    assert want and {tuple(x) for x in got.collect()} == want
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as _dealt asks for, where Spark would drop its exchange
    spark.conf.set("spark.sql.shuffle.partitions", 2 * spark.sparkContext.defaultParallelism)
    try:
        assert search.visited_counts(edges, ends).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", many)


def test_landmarks_of_edges_that_come_by_a_shuffle(spark, network, monkeypatch):
    _, _, edges = network
    sources = spark.createDataFrame([(k,) for k in (0, 5, 17, 80, 99999)], "source long")
    want = {tuple(x) for x in search.sssp(edges, sources.where("source < 200"), distributed=True).collect()}
    monkeypatch.setattr(search, "SMALL_EDGES", 10)
    monkeypatch.setattr(search, "_loop", None)
    assert {tuple(x) for x in search.sssp(edges, sources).collect()} == want
    assert {tuple(x) for x in search._middle(edges, [0, 5, 17, 80], None, each=1).collect()} == want


def test_pairs_of_edges_that_come_by_a_shuffle(spark, network, monkeypatch):
    _, nodes, edges = network
    asked = [(k, k, (k * 37 + 11) % 120) for k in range(40)] + [(90, 5, 5), (91, 3, 100000), (92, 100000, 3), (93, 100000, 100000)]
    q = spark.createDataFrame(asked, "query_id long, source long, target long")
    oneway = edges.where("src < dst OR src % 3 > 0")
    marks = search.landmark_distances(edges, search.select_landmarks(nodes, 8)).cache()
    runs = {
        "dijkstra": lambda: search.shortest_paths(edges, q), "astar": lambda: search.astar_paths(edges, nodes, q, 100.0), "alt": lambda: search.alt_paths(edges, q, marks), "both": lambda: search.bidirectional_paths(edges, q),
        "both_astar": lambda: search.bidirectional_paths(edges, q, search.euclidean_ahead(nodes, 100.0)), "oneway": lambda: search.astar_paths(oneway, nodes, q, 100.0),
    }
    rows = lambda run: sorted((x.query_id, x.source, x.target, -1 if x.d is None else round(x.d, 6)) for x in run().collect())
    want = {k: rows(run) for k, run in runs.items()}
    weight = {(r.src, r.dst): r.w for r in edges.collect()}
    monkeypatch.setattr(search, "SMALL_EDGES", 10)
    with monkeypatch.context() as m:
        m.setattr(search, "_far", None)
        assert {k: rows(run) for k, run in runs.items()} == want
        for r in runs["both_astar"]().where("path IS NOT NULL").collect():
            assert (r.path[0], r.path[-1]) == (r.source, r.target) and sum(weight[e] for e in itertools.pairwise(r.path)) == r.d
    monkeypatch.setattr(search, "MIDDLE_EDGES", 10)
    assert rows(runs["astar"]) == want["astar"]


def test_guided_searches_of_any_length_go_side_by_side():
    n = 400
    a = np.arange(n)
    line = search._Adjacency(np.r_[a, a + 1], np.r_[a + 1, a], np.ones(2 * n))
    ends, calls = np.arange(40, n + 1, 40), []

    def ahead(v, t):
        calls.append(len(v))
        return np.abs(v - t).astype(float)

    dist, d, _ = line.many(np.zeros(len(ends), int), ends, ahead)
    assert d.tolist() == ends.tolist() and all(dist[i, : e + 1].tolist() == list(range(e + 1)) for i, e in enumerate(ends))
    assert len(calls) < 2 * n, "searches wait for shorter ones"  # all lengths together are 2,200


def test_distances_without_searches(spark, network, monkeypatch):
    _, nodes, edges = network
    more = spark.createDataFrame([(200, 201, 7), (201, 200, 7)], "src long, dst long, w long")
    edges = edges.select("src", "dst", F.col("w").cast("long").alias("w")).union(more).cache()
    asked = [(k, k, (k * 37 + 11) % 120) for k in range(40)] + [(90, 5, 5), (91, 3, 100000), (92, 100000, 3), (93, 100000, 100000), (94, 3, 200), (95, 201, 200)]
    q = spark.createDataFrame(asked, "query_id long, source long, target long")
    marks = search.landmark_distances(edges, search.select_landmarks(nodes, 8)).cache()
    runs = {
        "alt": lambda e: search.alt_paths(e, q, marks, paths=False), "both_astar": lambda e: search.bidirectional_paths(e, q, search.euclidean_ahead(nodes, 100.0), paths=False),
        "dijkstra": lambda e: search.shortest_paths(e, q, paths=False),
    }
    rows = lambda found: sorted((x.query_id, x.source, x.target, x.d) for x in found.collect())
    want = rows(search.shortest_paths(edges, q))
    oneway, halves = edges.where("src < dst OR src % 3 > 0"), edges.withColumn("w", F.col("w") / 2)
    others = [(e, rows(search.shortest_paths(e, q))) for e in (oneway, halves)]
    monkeypatch.setattr(search, "SMALL_EDGES", 10)
    monkeypatch.setattr(search, "_far", None)
    with monkeypatch.context() as m:
        m.setattr(search, "FEW_PAIRS", 0)
        for e, found in others:  # edges without an equal back, and lengths that aren't whole, are searched
            assert rows(search.shortest_paths(e, q, paths=False)) == found
    assert runs["dijkstra"](edges).where("visited IS NULL").isEmpty(), "few pairs need no separators"
    monkeypatch.setattr(search, "FEW_PAIRS", 0)
    for name, run in runs.items():
        assert rows(run(edges)) == want, name
        assert run(edges).where("visited IS NOT NULL").isEmpty(), "pairs are searched"


def test_all_algorithms_take_distances_without_searches_once(spark, network, monkeypatch):
    g, nodes, edges = network
    edges = edges.select("src", "dst", F.col("w").cast("long").alias("w"))
    q = spark.createDataFrame([(k, k, (k * 37 + 11) % 120) for k in range(40)] + [(91, 3, 100000)], "query_id long, source long, target long")
    want = sorted((x.query_id, x.d) for x in search.shortest_paths(edges, q).collect())
    shuffled, calls = search._shuffled, []
    monkeypatch.setattr(search, "SMALL_EDGES", 10)
    monkeypatch.setattr(search, "FEW_PAIRS", 0)
    monkeypatch.setattr(search, "_shuffled", lambda *a: calls.append(a[-1]) or shuffled(*a))
    got = report.compare_algorithms(spark, graph.SpatialGraph(nodes, edges), q, paths=False).collect()
    assert calls == [False], "distances are got once"
    assert {x.algorithm for x in got} == set(report.ALGORITHMS) and all(x.visited is None for x in got)
    for name in report.ALGORITHMS:
        assert sorted((x.query_id, x.d) for x in got if x.algorithm == name) == want


@pytest.mark.parametrize("name", ["shortest_path", "algorithm_summary", "bidirectional_path", "astar_path", "bidirectional_alt_path", "compare_algorithms"])
def test_queries_of_distances_ask_for_no_ways(spark, monkeypatch, name):
    from wayfinder.plans.queries import QUERIES

    shuffled, calls = search._shuffled, []
    monkeypatch.setattr(search, "SMALL_EDGES", 10)
    monkeypatch.setattr(search, "_shuffled", lambda *a: calls.append(a[-1]) or shuffled(*a))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert calls == [False]


def test_separators_of_any_places_and_too_wide_graphs(monkeypatch):
    r = np.random.default_rng(3)
    for n, k in ((60, 2), (500, 3)):
        xy = r.integers(0, 1000, (n, 2))
        a = np.repeat(np.arange(n), k)
        b = ((xy[:, None] - xy[None]) ** 2).sum(-1).argsort(axis=1, kind="stable")[:, 1 : k + 1].ravel()
        w = np.ceil(np.hypot(*(xy[a] - xy[b]).T)) + 1
        g = search._Adjacency(np.r_[a, b], np.r_[b, a], np.r_[w, w])
        source, target = np.arange(n), r.integers(0, n, n)
        want = [g.many(np.array([s]), np.array([t]))[1][0] for s, t in zip(source, target, strict=True)]
        for place in ([xy[:, 0], xy[:, 1]], [np.zeros(n)]):
            by = separators.Separators(g.start, g.to, g.w, place)
            got = by.distances(by.parts(np.arange(n)), source, target)
            assert np.where(got < separators.FAR, got, np.inf).tolist() == want
        assert len(np.unique(separators.pieces(g.start, g.to))) == len({tuple(np.isfinite(g.many(np.array([s]), np.array([-1]))[0][0])) for s in range(n)})
    monkeypatch.setattr(separators, "WIDEST", 50)
    assert separators.Separators(g.start, g.to, g.w, [xy[:, 0]]).parts(np.arange(n)) is None
    asked = list(zip(g.names[source].tolist(), g.names[target].tolist(), strict=True))
    assert search._apart(g, asked) is None
    monkeypatch.setattr(separators, "WIDEST", 6000)
    monkeypatch.setattr(search, "ENDS_BATCH", 10_000)  # pairs go in several batches
    assert [math.inf if d is None else d for d, _, _ in search._apart(g, asked)] == want
    far = search._Adjacency(np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.full(4, 2.0**30 - 2))
    assert search._apart(far, [(0, 1), (0, 2), (0, 5), (1, 1)]) == [(2.0**30 - 2, None, None), None, (None, None, None), (0.0, None, None)]


def test_many_near_obstacles_take_smaller_cells(spark, monkeypatch):
    r = np.random.default_rng(5)
    at, to = r.integers(0, 400, (300, 2)), r.integers(-6, 7, (300, 2))
    seg = spark.createDataFrame([(i, *map(float, (*p, *(p + q)))) for i, (p, q) in enumerate(zip(at, to, strict=True))], "id long, ax double, ay double, bx double, by double")
    rows, rings = [], []
    for k in range(60):  # of 4 sides, and of 20, which don't go along with their box
        n, (x, y), far = 4 if k % 2 else 20, r.integers(0, 400, 2), int(r.integers(4, 12))
        turn = 2 * math.pi * np.arange(n) / n
        ring_ = np.round(np.stack([x + far * np.cos(turn), y + far * np.sin(turn)], axis=1) * 8) / 8
        rings.append(ring_)
        rows += [(k, *map(float, (*p, *q))) for p, q in zip(ring_, np.roll(ring_, -1, axis=0), strict=True)]
    sides = spark.createDataFrame(rows, "poly_id long, ax double, ay double, bx double, by double")

    def inside(p, ring_):
        odd = 0
        for a, b in zip(ring_, np.roll(ring_, -1, axis=0), strict=True):
            odd += (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0])
        return odd % 2 == 1

    held = {i for i, (p, q) in enumerate(zip(at, to, strict=True)) if any(inside(e, x) for e in (p, p + q) for x in rings)}
    near = {x.id for x in seg.crossJoin(sides.toDF("k", "px", "py", "qx", "qy")).where(G.segment_distance(*[G.point(x, y) for x, y in (("ax", "ay"), ("bx", "by"), ("px", "py"), ("qx", "qy"))]) <= 0.5).select("id").distinct().collect()}
    assert held - near and near - held
    made, sizes = joins.with_cells, []
    monkeypatch.setattr(joins, "with_cells", lambda *a: sizes.append(a[-1]) or made(*a))
    assert {x.id for x in graph.near_obstacle(seg, sides, 500.0, 0.5).collect()} == held | near
    assert max(sizes) < 100, "all meet all in one cell"


def test_queries_of_the_same_places_are_routed_once(spark, network, monkeypatch):
    _, nodes, edges = network
    q = spark.createDataFrame([(k, float(k % 2), 5.0, 150.0, 20.0) for k in range(5)], "query_id long, sx double, sy double, tx double, ty double")
    sides = spark.createDataFrame([], "poly_id long, ax double, ay double, bx double, by double")
    found, asked = search.shortest_paths, []
    monkeypatch.setattr(search, "shortest_paths", lambda e, a: asked.append(a.count()) or found(e, a))
    lines, rows = route.route(q, nodes, edges, sides, 50.0)
    rows, lines = {r.query_id: tuple(r)[1:] for r in rows.select("query_id", "source", "target", "graph_distance", "length").collect()}, lines.select("query_id", "seq", "x", "y").collect()
    assert asked == [2] and set(rows) == set(range(5))
    line = {k: sorted(tuple(x)[1:] for x in lines if x.query_id == k) for k in range(5)}
    for k in range(5):
        assert line[k][0][1:] == (k % 2, 5.0) and line[k][-1][1:] == (150.0, 20.0)
        assert rows[k] == rows[k % 2] and line[k] == line[k % 2]
        assert math.isclose(rows[k][-1], sum(math.dist(a[1:], b[1:]) for a, b in itertools.pairwise(line[k])))
