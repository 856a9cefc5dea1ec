import pytest
from pyspark.sql import functions as F

from peergraph.functions import scalars as S
from peergraph.policy import Policy


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "interface", "want"), [("HTTPClientFactory", False, "Factory"), ("IOrderService", True, "Service"), ("Single", False, None), ("FooIt", False, None), ("IThing", True, None), ("IOrderService", False, "Service")])
def test_trailing_word(spark, name, interface, want):
    assert value(spark, S.trailing_word(F.lit(name), F.lit(interface))) == want


def test_keys_are_escaped(spark):
    assert value(spark, S.canonical("type", F.lit("a|b"), F.lit("c\\d"))) == "type|a\\|b|c\\\\d"
    assert value(spark, S.set_key(F.array(F.lit("b"), F.lit("a|x"), F.lit("b")))) == "set|a\\|x|b"


@pytest.mark.parametrize(("x", "want"), [(3.0, "3"), (2.5, "2.5"), (2.345, "2.34"), (0.125, "0.12"), (100.0, "100"), (float("inf"), "undefined")])
def test_number(spark, x, want):
    assert value(spark, S.number(F.lit(x))) == want


@pytest.mark.parametrize(("x", "want"), [(2.5, "2"), (0.5, "0"), (1.5, "2")])
def test_whole_is_half_even(spark, x, want):
    assert value(spark, S.whole(F.lit(x))) == want


@pytest.mark.parametrize(("a", "i", "want"), [(0.06, 0.0, "Pain"), (0.9, 0.8, "Uselessness"), (0.5, 0.5, "NearMainSequence"), (0.1, 0.5, "None"), (0.1, None, "None")])
def test_zones(spark, a, i, want):
    assert value(spark, S.zone(F.lit(a), F.lit(i).cast("double"))) == want


@pytest.mark.parametrize(("name", "want"), [("Shop.Tests", True), ("Shop.UnitTests.Api", True), ("Contest", True), ("Shop.Testing", False), ("spec", True), ("Latest.Api", False)])
def test_test_projects(spark, name, want):
    assert value(spark, S.is_test_project(F.lit(name))) is want


def test_labels_and_plumbing(spark):
    assert value(spark, S.external_label(F.lit("System.Data.Common.X"))) == "System.Data.Common"
    assert value(spark, S.external_label(F.lit("Stripe.Checkout.Api"))) == "Stripe.Checkout"
    assert value(spark, S.external_label(F.lit(""))) is None
    assert value(spark, S.is_plumbing(F.lit("System.TextProcessing")))
    assert not value(spark, S.covers("System.Data", F.lit("System.DataX")))


def test_policy_values():
    assert len(Policy().values()) == 29
    assert Policy().roll_call_threshold == 5
    assert Policy(top=20).overrides() == [("top", 20)]
    assert Policy().is_default()
    assert Policy.flag_for("min_cohort") == "--min-cohort"
    for bad in ({"blast_top_fraction": 1.5}, {"global_fan_in_percentile": 101}, {"min_cohort": 1}, {"outlier_factor": float("nan")}, {"roll_call_divisor": 0}, {"boundary_top_fraction": 0}, {"hub_min": -1}):
        with pytest.raises(ValueError):
            Policy(**bad)
