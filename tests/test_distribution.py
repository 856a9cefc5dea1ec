import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peergraph.operators import distribution as D


def readings(spark, values):
    rows = spark.createDataFrame([("p", float(v)) for v in values], "p string, v double")
    return {r.v: r for r in D.readings(rows, ["p"], "v").collect()}


@pytest.mark.parametrize(
    ("values", "x", "percentile", "median"),
    [([1] * 8, 1, 50, 1), ([1, 1, 1, 1, 9], 9, 90, 1), ([2, 4], 4, 75, 3), ([1, 2, 3], 2, 50, 2), ([1, 2, 3, 4], 1, 12.5, 2.5), ([5], 5, 50, 5)],
)
def test_percentile_and_median(spark, values, x, percentile, median):
    r = readings(spark, values)[x]
    assert r.percentile == percentile
    assert r.median == median


def test_ties_rank_in_their_middle(spark):
    assert readings(spark, [9, 9, 1])[9].rank == 1.5
    assert readings(spark, [9, 1])[9].rank == 1


def test_times_median_of_zero(spark):
    r = readings(spark, [0, 0, 3])
    assert r[3].times_median == float("inf")
    assert r[0].times_median == 1


def test_rank_and_percentile_say_the_same(spark):
    values = [random.Random(n).randrange(6) for n in range(40)]
    for r in readings(spark, values).values():
        assert abs(r["rank"] - (r.n * (100 - r.percentile) / 100 + 0.5)) < 1e-9


def test_a_value_outside_the_population(spark):
    values = spark.createDataFrame([("p", 1.0), ("p", 3.0)], "p string, v double")
    asked = spark.createDataFrame([("p", 2.0), ("p", 3.0)], "p string, x double")
    found = {r.x: r for r in D.read_outside(asked, values, ["p"], "v", "x").collect()}
    assert (found[2.0].percentile, found[2.0]["rank"]) == (50, 1.5)
    assert found[3.0].percentile == 75


def test_null_values_and_empty_tables(spark):
    rows = spark.createDataFrame([("p", None), ("p", 2.0)], "p string, v double")
    assert [r.n for r in D.readings(rows, ["p"], "v").collect()] == [1]
    assert D.readings(rows.limit(0), ["p"], "v").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_against_counting(spark, values):
    for x, r in readings(spark, values).items():
        below, equal = sum(v < x for v in values), sum(v == x for v in values)
        assert r.percentile == pytest.approx(100 * (below + equal / 2) / len(values))
