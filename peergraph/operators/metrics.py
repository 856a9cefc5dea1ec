"""Edges and per-type metrics from references and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import instability


def edges(type_refs: DataFrame) -> DataFrame:
    """References by (from, to): weight, kinds in order, the first known site (null if none is known), and counts, how many there are of each kind.

    They are counted by kind first, so that no later table needs the references themselves.
    """
    known = (F.col("file") != "") & (F.col("line") > 0)
    site = F.min(F.when(known, F.struct("file", "line")))
    by_kind = type_refs.groupBy("from_type", "to_type", "kind").agg(F.count("*").alias("n"), site.alias("site"))
    fields = F.sum(F.when(F.col("kind") == 3, F.col("n")).otherwise(0))
    grouped = by_kind.groupBy("from_type", "to_type").agg(
        F.sum("n").alias("weight"), F.min("site").alias("site"), fields.alias("fields"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("counts")
    )
    return grouped.withColumn("kinds", F.array_compact(F.col("counts.kind")))


def declared(all_edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges of which both ends are declared."""
    ids = types.select("type_id")
    return all_edges.join(ids.withColumnRenamed("type_id", "from_type"), "from_type", "left_semi").join(ids.withColumnRenamed("type_id", "to_type"), "to_type", "left_semi")


def dangling(all_edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges to a type that isn't declared."""
    return all_edges.join(types.select(F.col("type_id").alias("to_type")), "to_type", "left_anti")


def member_inbound(member_refs: DataFrame, members: DataFrame) -> DataFrame:
    """(member_id, inbound): references to each declared member that has any."""
    counts = member_refs.groupBy("to_member").agg(F.count("*").alias("inbound"))
    return counts.join(members.select(F.col("member_id").alias("to_member")), "to_member", "left_semi").withColumnRenamed("to_member", "member_id")


def dangling_member_refs(member_refs: DataFrame, members: DataFrame) -> DataFrame:
    """How many references name no declared member: counted by reference, not by pair."""
    return member_refs.join(members.select(F.col("member_id").alias("to_member")), "to_member", "left_anti").agg(F.count("*").alias("dangling_references"))


def fan(all_edges: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, fan_in, inbound_references, fan_out): fan-out counts undeclared targets too."""
    both = declared(all_edges, types)
    inward = both.groupBy(F.col("to_type").alias("type_id")).agg(F.count("*").alias("fan_in"), F.sum("weight").alias("inbound_references"))
    outward = all_edges.groupBy(F.col("from_type").alias("type_id")).agg(F.count("*").alias("fan_out"))
    found = types.select("type_id").join(inward, "type_id", "left").join(outward, "type_id", "left")
    return found.na.fill(0, ["fan_in", "inbound_references", "fan_out"])


def insulating() -> Column:
    """A dependency on it is no dependency on anything concrete."""
    return F.col("is_abstract") | (F.col("keyword") == "interface") | (F.col("kind") == "Contract")


def effective_fan_out(all_edges: DataFrame, classified: DataFrame) -> DataFrame:
    """(type_id, effective_fan_out): outbound edges but for those to declared insulating types."""
    skip = classified.where(insulating()).select(F.col("type_id").alias("to_type"))
    kept = all_edges.join(skip, "to_type", "left_anti").groupBy(F.col("from_type").alias("type_id")).agg(F.count("*").alias("effective_fan_out"))
    return classified.select("type_id").join(kept, "type_id", "left").na.fill(0, ["effective_fan_out"])


def is_data() -> Column:
    return F.col("kind").isin("Property", "Field")


def is_method_like() -> Column:
    return F.col("kind").isin("Method", "Constructor")


def member_metrics(members: DataFrame) -> DataFrame:
    """Sums, the greatest cyclomatic complexity and the member that has it (ties: file, line, id), and counts."""
    public = F.col("accessibility") == "Public"
    first = F.min(F.struct((-F.col("cyclomatic")).alias("c"), "file", "line", "member_id"))
    return members.groupBy("type_id").agg(
        F.sum("cyclomatic").alias("cyclomatic"),
        F.max("cyclomatic").alias("max_cc"),
        first.alias("first"),
        *[F.sum(c).alias(c) for c in ("dsm", "transform", "static_mutations", "lines_of_code", "parameter_count")],
        F.count("*").alias("member_count"),
        F.count_if(public).alias("public_member_count"),
        F.count_if(is_method_like()).alias("executable_member_count"),
        F.count_if(F.col("kind") == "Method").alias("ordinary_methods"),
        F.least(F.lit(100), F.count_if(public & is_data())).alias("data_shape"),
    ).withColumn("most_complex_member", F.col("first.member_id")).drop("first")


SUMS = ("cyclomatic", "max_cc", "dsm", "transform", "static_mutations", "lines_of_code", "parameter_count", "member_count", "public_member_count", "executable_member_count", "ordinary_methods", "data_shape")


def with_metrics(types: DataFrame, members: DataFrame, all_edges: DataFrame) -> DataFrame:
    found = types.join(member_metrics(members), "type_id", "left").na.fill(0, list(SUMS))
    return found.join(fan(all_edges, types), "type_id")


def with_instability(metrics: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Instability from the effective fan-out, and raw from the whole."""
    found = metrics.join(effective_fan_out(all_edges, metrics), "type_id")
    return found.withColumns({"instability": instability(F.col("fan_in"), F.col("effective_fan_out")), "instability_raw": instability(F.col("fan_in"), F.col("fan_out"))})
