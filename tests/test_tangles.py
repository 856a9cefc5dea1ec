"""Tangles: what is said of them, by hand, and what a row on the way to it holds."""

import pytest
from pyspark.sql import functions as F

from peergraph.operators import graph as G
from peergraph.operators import projects as P
from peergraph.plans.model import Model
from peergraph.plans.queries import QUERIES

RING = 400


@pytest.fixture(scope="module")
def type_refs(spark):
    """A ring of RING types with one pair that refers to each other most, a ring of three, and an edge between them."""
    rows = [(f"t{i:04}", f"t{(i + 1) % RING:04}", 3 + i % 2) for i in range(RING)] + [("t0008", "t0007", 5)] * 3
    rows += [("u1", "u2", 1), ("u2", "u3", 1), ("u3", "u1", 1), ("u3", "u1", 8), ("t0001", "u1", 4)]
    return spark.createDataFrame(rows, "from_type string, to_type string, kind int")


@pytest.fixture(scope="module")
def edges(type_refs):
    return type_refs.groupBy("from_type", "to_type").agg(F.count("*").alias("weight"), F.array_sort(F.collect_set("kind")).alias("kinds")).localCheckpoint()


@pytest.fixture(scope="module")
def tangles(edges):
    return G.cycles(edges.select(F.col("from_type").alias("a"), F.col("to_type").alias("b")), "", 3).localCheckpoint()


def longest(rows):
    """Characters of the longest row."""
    return rows.agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0]


def test_heaviest_pairs(edges, tangles):
    inner = P.tangle_edges(tangles, edges)
    assert inner.count() == RING + 1 + 3
    assert longest(inner) < 200  # not the names of all members on each edge
    ids = {r.members[0]: r.id for r in tangles.collect()}
    found = P.with_id(P.heaviest_pairs(inner), tangles)
    assert sorted(map(tuple, found.collect())) == [(ids["t0000"], "t0007", "t0008", 4), (ids["u1"], "u1", "u3", 2)]


def test_tangle_kinds(type_refs, edges, tangles):
    found = P.tangle_kinds(P.tangle_edges(tangles, edges), type_refs)
    assert longest(found) < 200
    ids = {r.members[0]: r.id for r in tangles.collect()}
    assert sorted(map(tuple, P.with_id(found, tangles).collect())) == sorted([(ids["t0000"], 3, RING // 2), (ids["t0000"], 4, RING // 2), (ids["t0000"], 5, 3), (ids["u1"], 1, 3), (ids["u1"], 8, 1)])


def test_tangle_kinds_by_edges(spark, type_refs, tangles, monkeypatch):
    """The query takes the counts from the edges, which are checkpointed, and doesn't make the references again."""
    sites = type_refs.withColumns({"file": F.when(F.col("kind") > 3, "b.cs").otherwise("a.cs"), "line": F.col("kind") - 1})
    more = spark.createDataFrame([("u1", "u2", None, "", 0), ("u1", "u2", 1, "0.cs", 7)], sites.schema)
    read = spark.sparkContext.accumulator(0)

    def seen(rows):
        for batch in rows:
            read.add(len(batch))
            yield batch

    refs = sites.unionByName(more).mapInPandas(seen, sites.schema)
    model = Model(dict.fromkeys(("projects", "types", "members", "member_refs")) | {"type_refs": refs})
    model.types, model.tangles = sites.select(F.explode(F.array("from_type", "to_type")).alias("type_id")).distinct(), tangles
    monkeypatch.setattr("peergraph.plans.queries.model", lambda *_: model)
    ids = {r.members[0]: r.id for r in tangles.collect()}
    want = [(ids["t0000"], 3, RING // 2), (ids["t0000"], 4, RING // 2), (ids["t0000"], 5, 3), (ids["u1"], 1, 4), (ids["u1"], 8, 1), (ids["u1"], None, 1)]
    assert sorted(map(tuple, QUERIES["a16_tangle_kinds"](spark, "").collect()), key=str) == sorted(want, key=str)
    assert read.value == RING + 3 + 5 + 2
    edge = model.all_edges.where("from_type = 'u1' and to_type = 'u2'").select("weight", "kinds", "fields", "site").first()
    assert (edge.weight, edge.kinds, edge.fields, tuple(edge.site)) == (3, [1], 0, ("0.cs", 7))
    assert model.all_edges.agg(F.sum("weight"), F.sum("fields")).first()[:] == (RING + 3 + 5 + 2, RING // 2)


def test_tangle_shapes(edges, tangles, monkeypatch):
    model = Model(dict.fromkeys(("projects", "types", "members", "type_refs", "member_refs")))
    model.tangles, model.edges = tangles, edges
    held = []
    monkeypatch.setattr("peergraph.plans.model.cut", lambda df: held.append(df) or df.localCheckpoint())
    found = model.tangle_shapes
    # u1, u2, u3 refer to each other by inheritance alone, but for what comes with it
    assert {r.members[0]: (r["size"], r["shape"]) for r in found.collect()} == {"t0000": (RING, "Entangled"), "u1": (3, "Hierarchy")}
    assert found.columns == [*tangles.columns, "shape"]
    assert all(longest(df) < 200 for df in held)


def test_namespace_cycles(spark):
    """A ring below one namespace, whose shape is a folder layout, and one of namespaces that hold each other."""
    names = {0: ("p", "app"), **{i: ("p", f"app.n{i:04}") for i in range(1, RING)}}
    types = spark.createDataFrame([(p, n) for p, n in names.values()] + [("q", "x"), ("p", "y")], "project string, namespace string")
    ring = [names[i][1] for i in range(RING)]
    found = spark.createDataFrame([("|".join(ring), RING, ring), ("x|y", 2, ["x", "y"])], "id string, size int, members array<string>")
    held = spark.createDataFrame([("x", "y", 2), ("y", "x", 1), ("app", "app.n0001", 1), ("app.n0001", "app", 1)], "a string, b string, held long")
    pairs = P.pairs_within(found, held)
    assert longest(pairs) < 200
    assert sorted((r.first, r.second, r.siblings) for r in pairs.collect()) == [("app", "app.n0001", False), ("x", "y", True)]
    shapes = {r.members[0]: (r["shape"], r.anchor, r.projects, r.mutual, r.siblings) for r in P.cycle_shapes(found, types, held).collect()}
    assert shapes == {"app": ("FolderLayout", "app", ["p"], 1, 0), "x": ("Coupling", None, ["p", "q"], 1, 1)}
