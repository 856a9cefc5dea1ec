"""Every query with SQL against DuckDB on the smallest tables; the rest against what must hold."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from peergraph.operators import detectors as N
from peergraph.operators import graph as G
from peergraph.plans import queries as Q
from peergraph.plans import sinks
from peergraph.plans.model import Model
from peergraph.policy import Policy
from peergraph.sources import star

DATA = "/root/testdata/sf0.001"
QUICK = [n for n in Q.ORACLE if n[0] in "fs"] + ["c01_classification", "a01_edges", "a10_couplings", "h04_reconcile", "w08_cohort_statistics", "p05_judged", "g03_namespace_cycles", "g10_project_layers", "d01_spans_layers", "d02_concealed_method", "d03_concealed_type", "d04_blast_radius", "d12_no_references", "k03_edges_table"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def model(spark):
    return Model(star.facts(spark, DATA))


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sql, name):
    frame = Q.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    relation = sql.sql(Q.ORACLE[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == want


def test_order_of_rows_changes_nothing(spark, model):
    facts = star.facts(spark, DATA)
    shuffled = Model({k: v.orderBy(F.rand(3)).repartition(3) for k, v in facts.items()})
    key = ["kind", "subject", "o1", "o2", "o3"]
    assert Counter(map(tuple, shuffled.detected.select(*key).collect())) == Counter(map(tuple, model.detected.select(*key).collect()))


def test_findings_have_unique_keys_and_known_gates(model):
    assert N.repeated_keys(model.detected).count() == 0
    gates = {r.gate for r in model.detected.select(F.explode("receipts").alias("r")).select("r.gate").distinct().collect() if r.gate}
    assert gates <= {n for n, _ in Policy().values()}


def test_type_components_against_reachability(model):
    pairs = [(r.a, r.b) for r in model.type_edges.collect()]
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [] for n in nodes}
    for a, b in pairs:
        out[a].append(b)

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    reached = {n: reach(n) for n in nodes}
    want = {n: min([m for m in reached[n] if n in reached[m]] + [n]) for n in nodes if any(n in reached[m] and m != n for m in reached[n])}
    found = {r.node: r.component for r in G.strongly_connected(model.type_edges, 2).collect()}
    assert found == want


@pytest.mark.parametrize(("low", "high", "kind"), [({"hub_min": 3}, {"hub_min": 9}, "HubOrGodObject"), ({"outlier_factor": 2.0}, {"outlier_factor": 6.0}, "ConcealedDecisionMethod"), ({"min_fan_in": 2}, {"min_fan_in": 12}, "BugBlastRadius")])
def test_a_notch_of_policy_narrows_what_is_found(spark, model, low, high, kind):
    counts = []
    for change in (low, {}, high):
        m = Model(star.facts(spark, DATA), Policy(**change))
        m.__dict__.update({k: model.__dict__[k] for k in ("all_edges", "classified", "assigned", "full") if k in model.__dict__})
        counts.append(m.nominations[kind].frame.count())
    assert counts[0] >= counts[1] >= counts[2]
    assert counts[0] > counts[2]


def test_csv_dialect(spark, model, tmp_path):
    sinks.write_csv(sinks.types_table(model.full).coalesce(1), str(tmp_path / "types"), "Id")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "types").glob("part-*")))
    lines = raw.split(b"\r\n")
    assert lines[0].decode().split(",") == list(sinks.TYPE_COLUMNS)
    assert len(sinks.TYPE_COLUMNS) == 47
    assert not raw.startswith(b"\xef\xbb\xbf")
    assert b'""' not in lines[1]


def test_empty_facts(spark):
    m = Model({k: v.limit(0) for k, v in star.facts(spark, DATA).items()})
    assert m.detected.count() == 0
    assert m.tangles.count() == 0
    assert m.project_layers.count() == 0
