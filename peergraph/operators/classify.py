"""What a type is in the architecture: the first rule that applies, with its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Names that mark a boundary.
BOUNDARY_ATTRIBUTES = ("ApiControllerAttribute", "RouteAttribute")
BOUNDARY_BASES = ("ApiController", "Controller", "ControllerBase")


def classification() -> Column:
    """struct(kind, evidence) of a type with attributes, bases, external, name and member counts."""
    attribute = F.get(F.filter("attributes", lambda a: a.isin(*BOUNDARY_ATTRIBUTES)), F.lit(0))
    base = F.get(F.filter("bases", lambda b: b.isin(*BOUNDARY_BASES)), F.lit(0))
    api, data, call = (S.first_match(F.col("external"), p) for p in (S.API_NAMESPACES, S.DATA_NAMESPACES, S.CALL_NAMESPACES))
    shape = (F.col("member_count") > 0) & (F.col("public_member_count") > 0) & (F.col("executable_member_count") == 0) & (F.col("ordinary_methods") == 0)

    def found(kind: str, evidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), evidence.alias("evidence"))

    return (
        F.when(attribute.isNotNull(), found("ApiBoundary", F.concat(F.lit("attribute:"), attribute)))
        .when(base.isNotNull(), found("ApiBoundary", F.concat(F.lit("base:"), base)))
        .when(F.endswith("name", F.lit("Controller")), found("ApiBoundary", F.lit("name-suffix:Controller")))
        .when(api.isNotNull(), found("ApiBoundary", F.concat(F.lit("external-ns:"), api)))
        .when(F.array_contains("bases", "DbContext"), found("DataAccess", F.lit("base:DbContext")))
        .when(data.isNotNull(), found("DataAccess", F.concat(F.lit("external-ns:"), data)))
        .when(call.isNotNull(), found("ExternalCall", F.concat(F.lit("external-ns:"), call)))
        .when(shape, found("Contract", F.lit("shape:no executable members")))
        .otherwise(found("Internal", F.lit("no classifying evidence")))
    )


def classify(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("c", classification()).withColumns({"kind": F.col("c.kind"), "evidence": F.col("c.evidence")}).drop("c")
