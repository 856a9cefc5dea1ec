"""Rules that silence findings, judged on what was detected and not on what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import Policy

# Rule names in order.
RULES = ("breaks-alone-at-a-boundary", "breaks-alone-decides-something", "breaks-alone-is-unreferenced", "widest-surface-is-not-discriminating")


def judged(found: DataFrame, types: DataFrame, p: Policy) -> DataFrame:
    """found with ``silenced_by``: the first rule that applies, or null."""
    about = types.select("type_id", F.col("kind").alias("type_kind"), "fan_in")
    decides = found.where(F.col("kind").startswith("ConcealedDecision")).select("type_id").distinct().withColumn("decides", F.lit(True))
    named = found.where("kind = 'WidestContractSurface'").select(F.lit("WidestContractSurface").alias("kind")).groupBy("kind").agg(F.count("*").alias("surfaces"))
    joined = found.join(about, "type_id", "left").join(decides, "type_id", "left").join(named, "kind", "left")
    alone = F.col("kind") == "BreaksAlone"
    rule = (
        F.when(alone & F.col("type_kind").isin("ApiBoundary", "ExternalCall", "Contract"), RULES[0])
        .when(alone & F.col("decides"), RULES[1])
        .when(alone & (F.col("fan_in") < p.breaks_alone_min_fan_in), RULES[2])
        .when((F.col("kind") == "WidestContractSurface") & (F.col("surfaces") > p.max_named_surfaces), RULES[3])
    )
    return joined.withColumn("silenced_by", rule).drop("type_kind", "fan_in", "decides", "surfaces")


def kept(judgement: DataFrame) -> DataFrame:
    return judgement.where("silenced_by is null").drop("silenced_by")


def silenced(judgement: DataFrame) -> DataFrame:
    return judgement.where("silenced_by is not null")


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("kind") == kind)


def about(found: DataFrame, type_ids: DataFrame) -> DataFrame:
    """Findings about those types or their members."""
    return found.join(type_ids.select("type_id"), "type_id", "left_semi")
