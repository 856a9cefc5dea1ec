import numpy as np
import pytest

from peergraph.operators import graph as G
from peergraph.operators.components import connected_components


def edges(spark, text):
    return spark.createDataFrame([tuple(e.split(">")) for e in text.split()], "a string, b string")


def groups(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.component, set()).add(r.node)
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize(
    ("text", "least", "want"),
    [
        ("a>b b>c", 2, []),
        ("a>b b>a", 2, [["a", "b"]]),
        ("a>b b>a c>d d>c", 3, []),
        ("a>b b>a c>d d>c", 2, [["a", "b"], ["c", "d"]]),
        ("a>b b>c c>a x>y y>x", 2, [["a", "b", "c"], ["x", "y"]]),
        ("a>a", 2, []),
        ("a>b a>missing b>a", 2, [["a", "b"]]),
        ("a>b", 1, [["a"], ["b"]]),
    ],
)
def test_components(spark, text, least, want):
    assert groups(G.strongly_connected(edges(spark, text), least)) == want


def test_a_long_ring_is_one_component():
    n = 50_001
    a = np.arange(n)
    assert set(G.strong_labels(a, (a + 1) % n, n).tolist()) == {0}


def test_labels_against_reachability():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = 9
        a, b = rng.integers(0, n, 14), rng.integers(0, n, 14)
        reach = np.eye(n, dtype=bool)
        reach[a, b] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k], :]
        both = reach & reach.T
        assert G.strong_labels(a, b, n).tolist() == [int(np.flatnonzero(both[i])[0]) for i in range(n)]


def test_shortest_cycle_prefers_small_neighbours():
    a, b = np.array([0, 0, 1, 2, 3]), np.array([2, 1, 3, 3, 0])
    assert G.shortest_cycle(a, b, 4, 0) == [0, 1, 3]
    assert G.shortest_cycle(np.array([0, 0]), np.array([0, 1]), 2, 0) == []


def test_cycles_carry_members_and_path(spark):
    found = G.cycles(edges(spark, "a>b b>c c>a c>d d>a b>a"), "project").collect()
    assert [(r.size, r.members, r.path, r.path_covers_every_member) for r in found] == [(4, ["a", "b", "c", "d"], ["a", "b"], False)]
    assert found[0].id.startswith("set|project\\|a|")


def test_layers_and_folding(spark):
    e = edges(spark, "api>svc svc>data")
    nodes = spark.createDataFrame([("api",), ("svc",), ("data",)], "node string")
    assert {r.node: r.layer for r in G.layers(e, nodes).collect()} == {"api": 2, "svc": 1, "data": 0}
    e = edges(spark, "p1>core p2>core p3>core")
    nodes = spark.createDataFrame([(x,) for x in ("p1", "p2", "p3", "core", "alone")], "node string")
    boxes = {tuple(r.projects): (r.depends_on, r.layer, r.is_cycle) for r in G.fold(G.layers(e, nodes), e).collect()}
    assert boxes == {("p1", "p2", "p3"): (["core"], 1, False), ("core",): ([], 0, False), ("alone",): ([], 0, False)}


def test_a_cycle_is_one_box(spark):
    e = edges(spark, "a>b b>c c>a c>core")
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "core")], "node string")
    boxes = {tuple(r.projects): (r.depends_on, r.layer, r.is_cycle) for r in G.fold(G.layers(e, nodes), e).collect()}
    assert boxes == {("a", "b", "c"): (["core"], 1, True), ("core",): ([], 0, False)}


@pytest.mark.parametrize("seed", [1])
def test_large_components_are_searched_by_joins(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (22, 2)).tolist()] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    e = spark.createDataFrame([*pairs, ("r3", "n1"), ("r1", None)], "a string, b string")
    want = sorted(map(tuple, G.cycles(e, "type").collect()))
    assert len(want) > 1
    assert sorted(map(tuple, G.cycles(e, "type", most_edges=0).collect())) == want
    assert sorted(map(tuple, G.cycles(e, "type", most_edges=8).collect())) == want
    assert groups(G.strongly_connected(e, 1, most_edges=0)) == groups(G.strongly_connected(e, 1))


def test_the_edge_bound_of_empty_tables(spark):
    assert G.cycles(edges(spark, "a>b").limit(0), "type", most_edges=0).count() == 0
    assert G.strongly_connected(edges(spark, "a>b b>c"), 2, most_edges=0).count() == 0


def test_connected_components(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 200), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
