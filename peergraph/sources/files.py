"""Fact tables from files: Parquet, and the CSV export that ``plans.sinks`` writes; and what of them to analyse.

A folder may hold a table ``left_out`` (what, name, count): projects, files and messages that extraction didn't get through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import projects as P


class FactsError(Exception):
    """Facts can't be read: the one error of all readers."""


def read_parquet(spark: SparkSession, folder: str, names: tuple[str, ...] = ("projects", "types", "members", "type_refs", "member_refs")) -> dict[str, DataFrame]:
    try:
        found = {n: spark.read.parquet(f"{folder}/{n}") for n in names}
    except AnalysisException as e:
        raise FactsError(str(e).splitlines()[0]) from e
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/left_out")
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        found["left_out"] = spark.read.parquet(f"{folder}/left_out")
    return found


def narrow(facts: dict[str, DataFrame], include_tests: bool = True, fragments: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Facts without test projects (unless asked for) and without types in files that a fragment excludes.

    What goes is listed in ``left_out`` (what, name, count): a row for each skipped project, one for the excluded types.
    """
    marked = P.selected(facts["projects"], include_tests)
    skipped = marked.where("skipped").select("project")
    seen = facts["types"].join(skipped, "project", "left_anti")
    excluded = S.excluded_path(F.coalesce("file", F.lit("")), fragments)
    types, gone = seen.where(~excluded), seen.where(excluded)
    kept = types.select("type_id")
    out = {
        "projects": marked.where("not skipped").drop("skipped"),
        "types": types,
        "members": facts["members"].join(kept, "type_id", "left_semi"),
        "type_refs": facts["type_refs"].join(kept.withColumnRenamed("type_id", "from_type"), "from_type", "left_semi"),
    }
    members = out["members"].select(F.col("member_id").alias("from_member"))
    out["member_refs"] = facts["member_refs"].join(members, "from_member", "left_semi")
    rows = skipped.select(F.lit("skipped test project").alias("what"), F.col("project").alias("name"), F.lit(1).cast("long").alias("count"))
    rows = rows.unionByName(gone.agg(F.count("*").alias("count")).select(F.lit(f"type excluded by {len(fragments)} path patterns").alias("what"), F.lit(None).cast("string").alias("name"), "count"))
    out["left_out"] = facts["left_out"].select("what", "name", "count").unionByName(rows) if "left_out" in facts else rows
    return out


def read_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable lines) of an exported table; empty cells are null."""
    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record").csv(path)
    except AnalysisException as e:
        raise FactsError(str(e).splitlines()[0]) from e
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record"), rows.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
