"""Depth-first order, paths and the order in which edges go, against plain walks on random graphs."""

import itertools
import random
import time

import pytest

from codeweft.graph import Graph
from codeweft.operators import community as C
from codeweft.operators import traverse as T


def random_graph(spark, seed, n=11, m=18):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    links = [(rng.choice(["DEPENDS_ON", "EXTENDS"]), *(f"n{i:02d}" for i in p)) for p in pairs]
    nodes = spark.createDataFrame([(f"class:n{i:02d}", "CLASS", f"n{i:02d}", f"n{i:02d}", False, None, "PENDING") for i in range(n)], "id string, kind string, fqn string, simple_name string, external boolean, community_id long, status string")
    edges = spark.createDataFrame([(t, f"class:{a}", f"class:{b}", 1.0, "EXTRACTED", 1.0) for t, a, b in links], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    return Graph(nodes, edges), links


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_depth_first_equals_a_plain_walk(spark, seed):
    graph, links = random_graph(spark, seed)
    near = {}
    for t, a, b in links:
        near.setdefault(a, set()).add((("DEPENDS_ON", "EXTENDS").index(t), b, t))
        near.setdefault(b, set()).add((("DEPENDS_ON", "EXTENDS").index(t), a, t))
    start = links[0][1]
    seen, want = set(), []

    def walk(node, depth, parent, via):
        if node in seen:
            return
        seen.add(node)
        if depth <= 3:
            want.append((node, depth, parent, via))
            for _, other, t in sorted(near.get(node, ())):
                walk(other, depth + 1, node, t)

    walk(start, 0, None, None)
    got = [tuple(r)[1:] for r in T.depth_first(graph, start, 3, ("DEPENDS_ON", "EXTENDS")).orderBy("place").collect()]
    assert got == want


def test_depth_first_takes_no_task_for_the_whole_walk(spark):
    graph, links = random_graph(spark, 4)
    walk = T.depth_first(graph, links[0][1], 3, ("DEPENDS_ON", "EXTENDS"))
    assert "InPandas" not in walk._jdf.queryExecution().toString()
    assert [tuple(r) for r in T.depth_first(graph, "nowhere", 3).collect()] == [(0, "nowhere", 0, None, None)]


def all_shortest(near, a, b):
    level, found = [[a]], []
    while level and not found:
        found = [p for p in level if p[-1] == b]
        level = [p + [w] for p in level for w in sorted(near[p[-1]]) if w not in p]
    return found


def test_edges_go_by_the_shortest_paths_through_them(spark):
    graph, links = random_graph(spark, 5, 9, 13)
    names = C.components(graph)
    rows = C.removal_order(graph, names).orderBy("component", "place").collect()
    for component in {r["component"] for r in rows}:
        own = [r for r in rows if r["component"] == component]
        near = {}
        for r in own:
            near.setdefault(r["a"], set()).add(r["b"])
            near.setdefault(r["b"], set()).add(r["a"])
        for r in own:
            flow = {}
            for a, b in itertools.permutations(near, 2):
                paths = all_shortest(near, a, b)
                for p in paths:
                    for e in zip(p, p[1:]):
                        key = min(e), max(e)
                        flow[key] = flow.get(key, 0.0) + 1 / len(paths)
            best = min(flow, key=lambda e: (-round(flow[e], 9), e))
            assert (min(r["a"], r["b"]), max(r["a"], r["b"])) == best and r["betweenness"] == pytest.approx(flow[best])
            near[r["a"]].discard(r["b"])
            near[r["b"]].discard(r["a"])


@pytest.mark.parametrize("seed", [1, 4])
def test_paths_are_the_least_of_the_shortest(spark, seed):
    graph, links = random_graph(spark, seed)
    near = {}
    for _, a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a, b in [(links[0][1], links[-1][2]), (links[1][1], links[-2][1])]:
        found = all_shortest(near, a, b)
        assert T.shortest_path(graph, a, b).first()["hops"] == (min(found) if found else [])


@pytest.mark.parametrize("seed", range(6))
def test_betweenness_beside_hanging_trees(seed):
    rng, near = random.Random(seed), {i: set() for i in range(12)}
    for v in range(1, 12):
        near[v].add(w := rng.randrange(v))
        near[w].add(v)
    for a, b in [rng.sample(range(12), 2) for _ in range(seed)]:
        near[a].add(b)
        near[b].add(a)
    flow = {}
    for a, b in itertools.permutations(near, 2):
        paths = all_shortest(near, a, b)
        for p in paths:
            for e in zip(p, p[1:]):
                key = min(e), max(e)
                flow[key] = flow.get(key, 0.0) + 1 / len(paths)
    assert C._betweenness(near) == pytest.approx(flow)


def test_edges_of_a_component_go_in_seconds(spark):
    rng = random.Random(3)
    pairs = sorted({(f"a{rng.randrange(300):03d}", f"b{rng.randrange(30):03d}") for _ in range(600)})
    edges = spark.createDataFrame([("DEPENDS_ON", f"class:{a}", f"class:{b}", 1.0, "EXTRACTED", 1.0) for a, b in pairs], "type string, from_id string, to_id string, weight double, provenance string, confidence_score double")
    one = spark.createDataFrame([(a, "all") for a in {a for a, _ in pairs}], "fqn string, component string")
    began = time.time()
    rows = C.removal_order(Graph(edges.limit(0), edges), one).collect()
    assert time.time() - began < 20 and sorted((r["a"], r["b"]) for r in rows) == pairs
