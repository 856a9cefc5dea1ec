"""Exports: three CSV tables and one JSON document of lines with all blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EDGE_KINDS
from ..operators import projects as P
from ..session import cut

# Columns of the exported tables.
TYPE_COLUMNS = (
    "Id", "Name", "FullyQualifiedName", "Namespace", "Assembly", "Project", "Keyword", "IsAbstract", "Kind", "KindEvidence", "Cohort", "CohortBasis", "CohortSize", "FanIn", "FanInPctl", "FanInXMedian",
    "FanOut", "FanOutPctl", "FanOutXMedian", "EffectiveFanOut", "InboundReferences", "Instability", "InstabilityRaw", "Cyclomatic", "CyclomaticPctl", "CyclomaticXMedian", "MaxMemberCyclomatic",
    "MaxMemberCyclomaticPctl", "MaxMemberCyclomaticXMedian", "MostComplexMember", "Dsm", "DsmPctl", "DsmXMedian", "Transform", "StaticMutations", "MemberCount", "PublicMemberCount", "ExecutableMemberCount",
    "ParameterCount", "DataShape", "DataShapePctl", "GlobalFanInPctl", "GlobalMaxCcPctl", "LinesOfCode", "ExternalNamespaces", "File", "Line",
)
MEMBER_COLUMNS = ("Id", "Name", "Signature", "Kind", "Accessibility", "DeclaringType", "Project", "Cyclomatic", "Dsm", "Transform", "StaticMutations", "MaxNestingDepth", "ParameterCount", "LinesOfCode", "File", "Line")


def _file(file: Column, line: Column) -> tuple[Column, Column]:
    known = (file != "") & (line > 0)
    return F.when(known, file), F.when(known, line)


def types_table(types: DataFrame) -> DataFrame:
    """types with statistics (plans.model) as the exported columns."""
    file, line = _file(F.col("file"), F.col("line"))
    source = {
        "Id": "type_id", "Name": "name", "FullyQualifiedName": "fqn", "Namespace": "namespace", "Assembly": "assembly", "Project": "project", "Keyword": "keyword", "IsAbstract": "is_abstract", "Kind": "kind", "KindEvidence": "evidence",
        "Cohort": "cohort", "CohortBasis": "cohort_basis", "CohortSize": "cohort_size", "FanIn": "fan_in", "FanInPctl": "stat_fan_in_percentile", "FanInXMedian": "stat_fan_in_times_median", "FanOut": "fan_out",
        "FanOutPctl": "stat_fan_out_percentile", "FanOutXMedian": "stat_fan_out_times_median", "EffectiveFanOut": "effective_fan_out", "InboundReferences": "inbound_references", "Instability": "instability", "InstabilityRaw": "instability_raw",
        "Cyclomatic": "cyclomatic", "CyclomaticPctl": "stat_cyclomatic_percentile", "CyclomaticXMedian": "stat_cyclomatic_times_median", "MaxMemberCyclomatic": "max_cc", "MaxMemberCyclomaticPctl": "stat_max_cc_percentile",
        "MaxMemberCyclomaticXMedian": "stat_max_cc_times_median", "MostComplexMember": "most_complex_member", "Dsm": "dsm", "DsmPctl": "stat_dsm_percentile", "DsmXMedian": "stat_dsm_times_median", "Transform": "transform",
        "StaticMutations": "static_mutations", "MemberCount": "member_count", "PublicMemberCount": "public_member_count", "ExecutableMemberCount": "executable_member_count", "ParameterCount": "parameter_count", "DataShape": "data_shape",
        "DataShapePctl": "stat_data_shape_percentile", "GlobalFanInPctl": "all_fan_in_percentile", "GlobalMaxCcPctl": "all_max_cc_percentile", "LinesOfCode": "lines_of_code",
    }
    made = {n: F.col(c) for n, c in source.items()} | {"ExternalNamespaces": F.array_join(F.array_sort(F.array_distinct("external")), ";"), "File": file, "Line": line}
    return types.select(*[made[c].alias(c) for c in TYPE_COLUMNS])


def members_table(members: DataFrame) -> DataFrame:
    file, line = _file(F.col("file"), F.col("line"))
    made = {
        "Id": "member_id", "Name": "name", "Signature": "name", "Kind": "kind", "Accessibility": "accessibility", "DeclaringType": "type_id", "Project": "project", "Cyclomatic": "cyclomatic", "Dsm": "dsm", "Transform": "transform",
        "StaticMutations": "static_mutations", "MaxNestingDepth": "max_nesting", "ParameterCount": "parameter_count", "LinesOfCode": "lines_of_code",
    }
    return members.select(*[F.col(made[c]).alias(c) for c in MEMBER_COLUMNS[:-2]], file.alias("File"), line.alias("Line"))


def edges_table(edges: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, EDGE_KINDS))
    kinds = F.array_join(F.transform("kinds", lambda k: F.get(names, k)), ";")
    return edges.select(F.col("from_type").alias("From"), F.col("to_type").alias("To"), F.col("weight").alias("Weight"), kinds.alias("Kinds"), F.col("site.file").alias("File"), F.col("site.line").alias("Line"))


def shortest(value: Column) -> Column:
    """A double without a needless fraction: 3, not 3.0."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def write_csv(table: DataFrame, path: str, *order: str) -> None:
    """Ordered part files in one dialect: CRLF, quotes only where needed, nulls empty, no byte order mark."""
    columns = [(shortest(F.col(c)) if t == "double" else F.col(c)).alias(c) for c, t in table.dtypes]
    table.orderBy(*order).select(*columns).write.mode("overwrite").options(header=True, lineSep="\r\n", escape='"', emptyValue="", nullValue="").csv(path)


def _camel(name: str) -> str:
    return name[0].lower() + name[1:]


def json_lines(types: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(block, id, json): the document's types (with their members) and edges, one JSON object a row."""
    inner = members_table(members)
    fields = [F.col(c).alias(_camel(c)) for c in MEMBER_COLUMNS if c != "DeclaringType"]
    held = inner.groupBy(F.col("DeclaringType").alias("Id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))
    rows = types_table(types).join(held, "Id", "left")
    type_json = F.to_json(F.struct(*[F.col(c).alias(_camel(c)) for c in TYPE_COLUMNS], "members"))
    edge_rows = edges_table(edges)
    edge_json = F.to_json(F.struct(*[F.col(c).alias(_camel(c)) for c in edge_rows.columns]))
    return rows.select(F.lit("types").alias("block"), F.col("Id").alias("id"), type_json.alias("json")).unionByName(
        edge_rows.select(F.lit("edges").alias("block"), F.concat_ws(">", "From", "To").alias("id"), edge_json.alias("json"))
    )


def document(model) -> DataFrame:
    """(block, id, json): the whole analysis (plans.model.Model) as one JSON document of lines, an object a row.

    Blocks: tool, policy, coverage, projects (coupling null where nothing was measured), types with members, edges,
    namespaceCycles, projectCycles, typeTangles, externalDependencies, boundary, findings.

    Blocks that take joins or counts are cut one group at a time: they have few rows, and a driver that plans and compiles
    all blocks at once needs memory for all. What has a row for each type, edge or finding is left to the returned plan.
    """
    one = model.types.sparkSession.range(1)

    def block(name: str, rows: DataFrame, key: Column, fields: dict[str, Column | str]) -> DataFrame:
        return rows.select(F.lit(name).alias("block"), key.alias("id"), F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("json"))

    policy = {_camel("".join(w.capitalize() for w in n.split("_"))): F.lit(float(v)) for n, v in model.policy.values()}
    fixed = block("tool", one, F.lit("tool"), {"name": F.lit("peergraph"), "schemaVersion": F.lit("1.0")}).unionByName(block("policy", one, F.lit("policy"), policy))
    coverage = cut(block("coverage", model.not_analysed, F.concat_ws("|", "what", "name"), {"what": "what", "name": "name", "count": "count"}))
    alone = P.unreferenced(model.projects, model.couplings, model.classified).withColumn("alone", F.lit(True))
    projects = model.projects.join(model.couplings.withColumn("measured", F.lit(True)), "project", "left").join(alone, "project", "left")
    coupling = F.when(F.col("measured"), F.struct(F.col("ca").alias("typesElsewhereReachingIn"), F.col("ce").alias("typesHereReachingOut"), F.col("abstract_types").alias("abstractTypes"), F.col("total_types").alias("totalTypes"), "abstractness", "instability", "distance", "zone"))
    projects = cut(block("projects", projects, F.col("project"), {"name": "project", "hasEntryPoint": "has_entry_point", "isLibrary": "is_library", "isUnreferenced": F.coalesce("alone", F.lit(False)), "coupling": coupling}))
    external = cut(block("externalDependencies", model.dependencies, F.col("namespace"), {"namespace": "namespace", "typesTouching": "types_touching"}))
    ring = {"id": "id", "size": "size", "members": "members", "path": "path", "pathCoversEveryMember": "path_covers_every_member"}
    namespaces = block("namespaceCycles", model.namespace_cycles, F.col("id"), ring | {"shape": "shape", "projects": "projects", "anchor": "anchor", "heldPairs": "mutual"})
    cycles = block("projectCycles", model.project_cycles, F.col("id"), ring)
    tangles = cut(block("typeTangles", model.tangle_shapes, F.col("id"), ring | {"shape": "shape"}))
    boundary = block("boundary", P.contact_points(model.classified), F.col("type_id"), {"type": "type_id", "direction": "direction"})
    findings = block("findings", model.findings, F.col("finding_key"), {"key": "finding_key", "kind": "kind", "subject": "subject", "type": "type_id", "receipts": "receipts", "qualifiers": "qualifiers"})
    found = json_lines(model.full, model.members, model.all_edges)
    for rows in (fixed, coverage, projects, namespaces, cycles, tangles, external, boundary, findings):
        found = found.unionByName(rows)
    return found
