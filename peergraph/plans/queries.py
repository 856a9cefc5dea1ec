"""One query for each operator, over the whole star schema, and DuckDB SQL beside it where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cohorts as H
from ..operators import detectors as N
from ..operators import distribution as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import projects as P
from ..operators import selection as V
from ..operators import suppression as X
from ..policy import Policy
from ..sources import star
from . import oracle, sinks
from .model import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@lru_cache(maxsize=1)
def _model(app: str, sf_dir: str, files: tuple, spark: SparkSession) -> Model:
    return Model(star.facts(spark, sf_dir))


def model(spark: SparkSession, sf_dir: str) -> Model:
    """The analysis of sf_dir's tables. Queries that follow each other on the same files in one session share it, and so its checkpointed tables."""
    return _model(spark.sparkContext.applicationId, sf_dir, star.files(spark, sf_dir), spark)


def add(name: str, of: Callable[[Model], DataFrame], select: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return of(model(spark, sf_dir))

    query.__name__ = name
    QUERIES[name] = query
    if select:
        ORACLE[name] = oracle.sql(select)


def scalar(name: str, column: Callable[[], Column], text: str, table: str = "types", key: str = "type_id") -> None:
    """One value for each row of a fact table."""

    def of(m: Model) -> DataFrame:
        rows = {"types": m.types, "projects": m.projects, "members": m.members}[table] if table != "dependencies" else m.dependencies
        return rows.select(key, column().alias("value"))

    add(name, of, f"SELECT {key}, {text} AS value FROM {table}")


def joined(c: str) -> Column:
    return F.array_join(c, ";")


# scalar functions
scalar("f01_canonical_key", lambda: S.canonical("type", F.concat("assembly", F.lit("|")), "fqn"), r"'type|' || replace(replace(assembly || '|', '\', '\\'), '|', '\|') || '|' || replace(replace(fqn, '\', '\\'), '|', '\|')")
scalar("f02_trailing_word", lambda: S.trailing_word(F.col("name"), F.col("keyword") == "interface"), r"CASE WHEN length(regexp_extract(CASE WHEN keyword = 'interface' AND regexp_matches(name, '^I\p{Lu}') THEN substring(name, 2) ELSE name END, '.*[^\p{Lu}](\p{Lu}.*)$', 1)) >= 3 THEN regexp_extract(name, '.*[^\p{Lu}](\p{Lu}.*)$', 1) END")
scalar("f03_simple_name", lambda: S.simple_name(F.concat("fqn", F.lit("<T.U>"))), "string_split(fqn, '.')[-1]")
scalar("f04_informative_interfaces", lambda: F.array_join(F.filter(F.transform("interfaces", S.simple_name), lambda i: ~i.isin(*S.UNINFORMATIVE_INTERFACES)), ";"), "array_to_string(list_filter(list_transform(string_split(interfaces, ';'), lambda x: string_split(string_split(x, '<')[1], '.')[-1]), lambda x: x NOT IN ('', 'IDisposable')), ';')")
scalar("f05_external_label", lambda: F.array_join(F.transform("external", S.external_label), ";"), "array_to_string(list_transform(string_split(external, ';'), lambda x: CASE WHEN string_split(x, '.')[1] IN ('System', 'Microsoft') THEN array_to_string(string_split(x, '.')[1:3], '.') ELSE array_to_string(string_split(x, '.')[1:2], '.') END), ';')")
scalar("f06_covers", lambda: S.covers("Brand#1", F.col("namespace")), "namespace = 'Brand#1' OR starts_with(namespace, 'Brand#1.')")
scalar("f07_first_match", lambda: S.first_match(F.col("external"), S.DATA_NAMESPACES), "list_sort(list_filter(string_split(external, ';'), lambda x: x = 'System.Data' OR starts_with(x, 'System.Data.')))[1]")
scalar("f08_is_plumbing", lambda: S.is_plumbing(F.col("namespace")), "plumbing", "dependencies", "namespace")
ORACLE["f08_is_plumbing"] = oracle.sql("SELECT namespace, plumbing AS value FROM plumbed")
scalar("f09_is_test_project", lambda: S.is_test_project(F.concat("project", F.when(F.col("n_types") % 2 == 0, ".UnitTests").otherwise(".Testing"))), "n_types % 2 = 0", "projects", "project")
scalar("f10_namespace_or_global", lambda: S.namespace_or_global(F.when(F.col("keyword") == "class", F.col("namespace")).otherwise("")), "CASE WHEN keyword = 'class' THEN namespace ELSE '<global>' END")
scalar("f11_effective_threshold", lambda: F.greatest(F.col("line") * 1.5, F.lit(1.0)), "greatest(line * 1.5, 1.0)::DOUBLE")
scalar("f12_top_rank_limit", lambda: S.top_rank_limit(0.05, F.col("line")), "greatest(1.0::DOUBLE, 0.05::DOUBLE * line + 0.5::DOUBLE)")
scalar("f13_times_median", lambda: S.finite(S.times_median(F.col("line"), F.col("line") % 4)), "CASE WHEN line % 4 <= 0 THEN CASE WHEN line > 0 THEN NULL ELSE 1 END ELSE line / (line % 4)::DOUBLE END")
scalar("f14_instability", lambda: S.instability(F.col("line") % 3, F.col("line") % 2), "CASE WHEN line % 3 + line % 2 > 0 THEN (line % 2) / (line % 3 + line % 2)::DOUBLE END")
scalar("f17_number", lambda: S.number(F.col("line") / 8.0), "regexp_replace(regexp_replace(printf('%.2f', round_even(line / 8.0, 2)), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')")
scalar("f17_whole", lambda: S.whole(F.col("line") / 2.0), "round_even(line / 2.0, 0)::BIGINT::VARCHAR")
scalar("f17_plural", lambda: S.plural(F.col("line"), "line", "lines"), "line::VARCHAR || ' ' || CASE WHEN line = 1 THEN 'line' ELSE 'lines' END")
scalar("f17_top_percent", lambda: S.top_percent(F.col("line") * 2.25), "greatest(1, round_even(100 - line * 2.25, 0)::BIGINT)")
scalar("f18_cut_label", lambda: S.cut_label(F.col("fqn"), F.col("line") % 2 == 0), "CASE WHEN length(fqn) <= 20 THEN fqn WHEN line % 2 = 0 AND length(string_split(fqn, '.')[-1]) <= 20 THEN string_split(fqn, '.')[-1] ELSE substring(fqn, 1, 19) || '…' END")
scalar("f19_html", lambda: S.html(F.concat(F.lit("<b> & '"), "name")), "'&lt;b&gt; &amp; &#39;' || name")
scalar("f20_flag", lambda: S.flag_for(F.lit("MinCohort")), "'--min-cohort'")
scalar("f20_signature", lambda: S.signature_in(F.col("type_id")), "fqn")
scalar("f20_version", lambda: S.without_revision(F.concat("name", F.lit("+abc"))), "name")
scalar("f21_shape_breadth", lambda: S.shape_breadth(F.col("line") * 5 - 10, F.col("keyword") == "struct", F.lit(True)), "CASE WHEN keyword = 'struct' THEN 1 ELSE least(100, greatest(1, line * 5 - 10)) END")
scalar("f22_externally_visible", lambda: S.externally_visible(F.array(F.lit("Public"), F.col("accessibility"))), "accessibility IN ('Public', 'Protected')", "members", "member_id")

# sources
add("s03_select_projects", lambda m: P.selected(m.projects.withColumn("project", F.concat("project", F.when(F.col("is_library"), "").otherwise(".Tests")))).select("project", "skipped"), "SELECT project || CASE WHEN is_library THEN '' ELSE '.Tests' END AS project, NOT is_library AS skipped FROM projects")
scalar("s06_excluded", lambda: S.excluded_path(F.concat(F.lit("C:\\Obj\\"), "file"), S.EXCLUDED_PATHS), "true")
scalar("s07_origin", lambda: S.origin_of(F.concat(F.when(F.col("keyword") == "class", "/home/.NuGet/packages/").when(F.col("keyword") == "struct", "C:\\dotnet\\packs\\").otherwise("/lib/"), "name")), "CASE keyword WHEN 'class' THEN 2 WHEN 'struct' THEN 1 ELSE 0 END")
add("s10_entry_points", lambda m: m.members.where("is_entry_point").select("member_id", "type_id"), "SELECT member_id, type_id FROM members WHERE is_entry_point")

# classification, joins and aggregates
add("c01_classification", lambda m: m.classified.select("type_id", "kind", "evidence"), "SELECT type_id, kind, evidence FROM kinds")
add("j01_inbound", lambda m: m.edges.select("from_type", "to_type", "weight"), "SELECT from_type, to_type, weight FROM edges")
add("j02_dangling_edges", lambda m: M.dangling(m.all_edges, m.types).agg(F.count("*").alias("dangling_edges")), "SELECT count(*) AS dangling_edges FROM all_edges e ANTI JOIN types t ON e.to_type = t.type_id")
add("j03_dangling_member_references", lambda m: M.dangling_member_refs(m.member_refs, m.members), "SELECT count(*) AS dangling_references FROM member_refs r ANTI JOIN members m ON r.to_member = m.member_id")
add("j04_effective_fan_out", lambda m: m.classified.select("type_id", "effective_fan_out"), "SELECT type_id, effective_fan_out FROM classified")
add("j05_cohort_sizes", lambda m: m.assigned.select("type_id", "cohort", "cohort_size"), "SELECT type_id, cohort, cohort_size FROM cohorts")
add("j06_project_edges", lambda m: m.project_edges, "SELECT a, b FROM project_edges")
add("j07_namespace_edges", lambda m: m.namespace_edges, "SELECT a, b FROM namespace_edges")
add("j08_significant_outbound", lambda m: m.all_edges.join(m.classified.where(F.col("kind").isin("ApiBoundary", "DataAccess", "ExternalCall")).select(F.col("type_id").alias("to_type"), "kind"), "to_type").groupBy("from_type", "kind").agg(F.count("*").alias("n")), "SELECT from_type, kind, count(*) AS n FROM d01_reached GROUP BY 1, 2")
add("j09_projects_with_coupling", lambda m: m.projects.join(m.couplings.select("project", "ca", "ce"), "project", "left").select("project", "ca", "ce"), "SELECT project, ca, ce FROM projects LEFT JOIN couplings USING (project)")
add("j10_unreferenced_projects", lambda m: P.unreferenced(m.projects, m.couplings, m.classified), "SELECT project FROM projects p SEMI JOIN (SELECT project FROM couplings WHERE ca = 0) c USING (project) ANTI JOIN (SELECT project FROM kinds WHERE kind = 'ApiBoundary') k USING (project) WHERE is_library AND NOT has_entry_point")
add("j11_findings_by_type", lambda m: m.detected.groupBy("type_id").agg(F.count("*").alias("n")), "SELECT type_id, count(*) AS n FROM detected GROUP BY 1")
add("j12_j13_held_pairs", lambda m: P.held_pairs(P.held_references(m.edges, m.types)), "SELECT x.a AS first, x.b AS second, x.held AS forward, y.held AS back, NOT (starts_with(x.a, x.b || '.') OR starts_with(x.b, x.a || '.')) AS siblings FROM held x JOIN held y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
add("j16_unmeasured_projects", lambda m: P.unmeasured(m.projects, m.types.where("keyword = 'interface' and is_abstract")), "SELECT project FROM projects ANTI JOIN (SELECT project FROM types WHERE keyword = 'interface' AND is_abstract) t USING (project)")
add("a01_edges", lambda m: m.all_edges.select("from_type", "to_type", "weight", F.array_join("kinds", ";").alias("kinds"), F.col("site.file").alias("file"), F.col("site.line").alias("line")), "SELECT from_type, to_type, weight, array_to_string(kinds, ';') AS kinds, file, line FROM all_edges")
add("a02_a03_fan", lambda m: m.classified.select("type_id", "fan_in", "fan_out", "inbound_references"), "SELECT type_id, fan_in, fan_out, inbound_references::BIGINT AS inbound_references FROM fan")
add("a05_member_sums", lambda m: m.classified.select("type_id", "cyclomatic", "max_cc", "dsm", "transform", "static_mutations"), "SELECT type_id, cyclomatic::BIGINT AS cyclomatic, max_cc, dsm::BIGINT AS dsm, transform::BIGINT AS transform, static_mutations::BIGINT AS static_mutations FROM metrics")
add("a06_most_complex_member", lambda m: m.classified.select("type_id", "most_complex_member"), "SELECT type_id, most_complex_member FROM metrics")
add("a07_member_counts", lambda m: m.classified.select("type_id", "member_count", "public_member_count", "executable_member_count", "parameter_count", "data_shape", "lines_of_code"), "SELECT type_id, member_count, public_member_count, executable_member_count, parameter_count::BIGINT AS parameter_count, data_shape, lines_of_code::BIGINT AS lines_of_code FROM metrics")
add("a08_candidate_counts", lambda m: H.candidate_counts(H.candidates(m.classified)), "SELECT key, listed FROM listed")
add("a09_cohort_medians", lambda m: D.medians(m.full, ["cohort"], "max_cc").select("cohort", "median"), "SELECT cohort, median(max_cc) AS median FROM peers GROUP BY 1")
add("a10_couplings", lambda m: m.couplings.select("project", "ca", "ce", "abstract_types", "total_types", "abstractness", "instability", "distance", "zone"), """SELECT project, ca, ce, abstract_types, total_types, abstractness, instability, abs(abstractness + instability - 1) AS distance,
  CASE WHEN instability IS NULL THEN 'None' WHEN instability <= 0.3 AND abstractness <= 0.3 THEN 'Pain' WHEN instability >= 0.7 AND abstractness >= 0.7 THEN 'Uselessness' WHEN abs(abstractness + instability - 1) <= 0.3 THEN 'NearMainSequence' ELSE 'None' END AS zone FROM coupled""")
add("a11_external_dependencies", lambda m: m.dependencies, "SELECT namespace, types_touching FROM dependencies")
add("a12_integrations", lambda m: P.integrations(m.dependencies), "SELECT namespace, types_touching FROM plumbed WHERE NOT plumbing")
add("a12_plumbing", lambda m: P.plumbing_references(m.dependencies), "SELECT coalesce(sum(types_touching), 0)::BIGINT AS plumbing_references FROM plumbed WHERE plumbing")
add("a13_contact_points", lambda m: P.contact_points(m.classified), "SELECT type_id, CASE kind WHEN 'ApiBoundary' THEN 'inbound' ELSE 'outbound' END AS direction FROM kinds WHERE kind IN ('ApiBoundary', 'ExternalCall')")
add("a14_namespace_types", lambda m: m.types.groupBy(S.namespace_or_global(F.col("namespace")).alias("namespace")).agg(F.count("*").alias("n_types")), "SELECT namespace, count(*) AS n_types FROM types GROUP BY 1")
add("a15_held_references", lambda m: P.held_references(m.edges, m.types), "SELECT a, b, held::BIGINT AS held FROM held")
add("a19_dead_code_disclosure", lambda m: N.exclusions(m.considered), "SELECT count(*) FILTER (runtime) AS runtime_invoked, count(*) FILTER (implements_interface) AS implements_interface, count(*) FILTER (is_override) AS overrides, count(*) FILTER (is_externally_visible) AS externally_visible, count(*) FILTER (sole) AS sole_constructors, count(*) AS considered, count(excluded) AS excluded FROM considered")
add("a20_unread_data", lambda m: m.considered.where(F.col("excluded").isNull() & M.is_data()).groupBy("type_id").agg(F.count("*").alias("unread")), "SELECT type_id, count(*) AS unread FROM nominated WHERE is_data GROUP BY 1")
add("a21_keyword_census", lambda m: m.types.groupBy("keyword").agg(F.count("*").alias("n")), "SELECT keyword, count(*) AS n FROM types GROUP BY 1")
add("a22_findings_per_kind", lambda m: m.findings.groupBy("kind").agg(F.count("*").alias("n")), "SELECT kind, count(*) AS n FROM findings GROUP BY 1")

# distributions
add("w01_w04_fan_in_readings", lambda m: m.full.select("type_id", "fan_in_percentile", "fan_in_rank", S.finite(F.col("fan_in_times_median")).alias("fan_in_times_median"), S.top_rank_limit(0.05, F.col("cohort_size")).alias("top_rank_limit")), "SELECT type_id, fan_in_pct AS fan_in_percentile, fan_in_rank, CASE WHEN fan_in_med <= 0 AND fan_in > 0 THEN NULL WHEN fan_in_med <= 0 THEN 1 ELSE fan_in / fan_in_med END AS fan_in_times_median, greatest(1.0::DOUBLE, 0.05::DOUBLE * cohort_size + 0.5::DOUBLE) AS top_rank_limit FROM windows")
add("w05_reading_or_null", lambda m: m.full.select("type_id", F.when(F.col("cohort_size") >= 2, F.col("max_cc_percentile")).alias("percentile")), "SELECT type_id, CASE WHEN cohort_size >= 2 THEN max_cc_pct END AS percentile FROM windows")
add("w06_read_outside", lambda m: D.read_outside(m.full.select("cohort", (F.col("fan_in") + 0.5).alias("x")).distinct(), m.full, ["cohort"], "fan_in", "x"), "SELECT a.cohort, a.x, count(*) AS n, 100.0 * (count(*) FILTER (p.fan_in < a.x) + 0.5 * count(*) FILTER (p.fan_in = a.x)) / count(*) AS percentile, count(*) FILTER (p.fan_in > a.x) + 0.5::DOUBLE * count(*) FILTER (p.fan_in = a.x) + 0.5::DOUBLE AS rank FROM (SELECT DISTINCT cohort, fan_in + 0.5::DOUBLE AS x FROM peers) a JOIN peers p USING (cohort) GROUP BY 1, 2")
add("w07_rank_identity", lambda m: m.full.select("type_id", (F.abs(F.col("fan_in_rank") - (F.col("fan_in_n") * (100 - F.col("fan_in_percentile")) / 100 + 0.5)) < 1e-9).alias("holds")), "SELECT type_id, true AS holds FROM types")
STATS = ("fan_in", "fan_out", "cyclomatic", "max_cc", "dsm", "data_shape")
add("w08_cohort_statistics", lambda m: m.full.select("type_id", *[f"stat_{x}_percentile" for x in STATS], *[f"stat_{x}_times_median" for x in STATS[:-1]], "all_fan_in_percentile", "all_max_cc_percentile"), "SELECT type_id, " + ", ".join([f"CASE WHEN cohort_size >= 5 THEN {x}_pct END AS stat_{x}_percentile" for x in STATS] + [f"CASE WHEN cohort_size >= 5 AND isfinite({x}_times) THEN {x}_times END AS stat_{x}_times_median" for x in STATS[:-1]]) + ", all_fan_in_pct AS all_fan_in_percentile, all_max_cc_pct AS all_max_cc_percentile FROM read")
add("w09_top_by_kind", lambda m: V.top_by_kind(m.findings, 15).select("kind", "subject", "shown", "total"), "SELECT kind, subject, shown::INTEGER AS shown, total FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o1, o2, o3, subject) AS shown, count(*) OVER (PARTITION BY kind) AS total FROM findings) WHERE shown <= 15")

# cohorts
add("h01_h02_candidates", lambda m: H.candidates(m.classified).select("type_id", "key", "basis", "precedence"), "SELECT type_id, key, basis, precedence FROM candidates")
add("h03_assign", lambda m: H.assign(H.candidates(m.classified), 5), "SELECT type_id, key, basis FROM assigned0")
add("h04_reconcile", lambda m: m.assigned.select("type_id", "cohort", "cohort_basis"), "SELECT type_id, cohort, cohort_basis FROM cohorts")
add("h05_sizes", lambda m: m.assigned.groupBy("cohort").agg(F.count("*").alias("size")), "SELECT cohort, count(*) AS size FROM cohorts GROUP BY 1")
add("h06_without_candidates", lambda m: H.without_candidates(m.types, H.candidates(m.classified)), "SELECT type_id FROM types ANTI JOIN candidates USING (type_id)")

# graphs; type-level components and paths have no SQL and are tested against brute force
add("g01_type_components", lambda m: G.strongly_connected(m.type_edges, 2))
add("g02_cycle_paths", lambda m: m.namespace_cycles.select("id", joined("path").alias("path")))
add("g03_namespace_cycles", lambda m: m.namespace_cycles.select(F.get("members", F.lit(0)).alias("first"), "size", joined("members").alias("members")), "SELECT component AS first, count(*)::INTEGER AS size, string_agg(node, ';' ORDER BY node) AS members FROM namespace_scc GROUP BY 1")
add("g04_project_cycles", lambda m: m.project_cycles.select(F.get("members", F.lit(0)).alias("first"), "size", joined("members").alias("members")), "SELECT component AS first, count(*)::INTEGER AS size, string_agg(node, ';' ORDER BY node) AS members FROM project_scc GROUP BY 1 HAVING count(*) > 1")
add("g05_tangles", lambda m: m.tangles.select("id", "size", "path_covers_every_member"))
add("g06_g07_cycle_order", lambda m: m.namespace_cycles.select("id", "size", F.size("path").alias("steps"), "path_covers_every_member").orderBy(F.desc("size"), "id"))
add("g08_cycle_shapes", lambda m: m.namespace_cycles.select(F.get("members", F.lit(0)).alias("first"), "shape", "mutual", "siblings"), """SELECT component AS first, CASE WHEN s.siblings > 0 THEN 'Coupling' WHEN (SELECT c.n FROM cycle_projects c WHERE c.component = s.component) = 1 AND s.component IN (SELECT component FROM anchored) THEN 'FolderLayout' WHEN s.mutual = 0 THEN 'SharedTypes' ELSE 'Coupling' END AS shape, s.mutual, s.siblings
FROM (SELECT n.component, count(x.a) AS mutual, count(*) FILTER (x.a IS NOT NULL AND NOT (starts_with(x.a, x.b || '.') OR starts_with(x.b, x.a || '.'))) AS siblings FROM namespace_scc n
  LEFT JOIN (SELECT h.a, h.b FROM held h JOIN held k ON h.a = k.b AND h.b = k.a WHERE h.a < h.b) x ON x.a = n.node AND x.b IN (SELECT node FROM namespace_scc o WHERE o.component = n.component) GROUP BY 1) s""")
add("g09_tangle_shapes", lambda m: m.tangle_shapes.select("id", "size", "shape"))
add("g10_project_layers", lambda m: m.project_layers, "SELECT node, component, layer FROM layers")
add("g11_project_groups", lambda m: m.project_groups.select(joined("projects").alias("projects"), joined("depends_on").alias("depends_on"), "layer", "is_cycle"), "SELECT array_to_string(projects, ';') AS projects, array_to_string(list_sort(list_filter(all_outs, lambda x: NOT list_contains(projects, x))), ';') AS depends_on, layer, cycle IS NOT NULL AS is_cycle FROM boxed")
add("g12_depth", lambda m: V.depth_and_width(m.project_groups), "SELECT max(layer) + 1 AS depth, max(layer) AS top_layer, max(boxes) AS widest_layer FROM (SELECT layer, count(*) AS boxes FROM boxed GROUP BY 1)")
add("g13_dependents", lambda m: m.project_edges.groupBy(F.col("b").alias("project")).agg(joined(F.array_sort(F.collect_set("a"))).alias("dependents")), "SELECT b AS project, string_agg(a, ';' ORDER BY a) AS dependents FROM project_edges GROUP BY 1")
add("a16_tangle_kinds", lambda m: P.with_id(P.tangle_kinds(P.tangle_edges(m.tangles, m.edges)), m.tangles))
add("a16_heaviest_pairs", lambda m: P.with_id(P.heaviest_pairs(P.tangle_edges(m.tangles, m.edges)), m.tangles))
add("a17_project_links", lambda m: P.project_links(m.project_cycles.select(F.explode("members").alias("node"), F.col("id").alias("component")), m.types, m.edges).drop("component"), "SELECT s.fp AS a, s.tp AS b, sum(s.weight)::BIGINT AS weight, first(s.from_type ORDER BY s.weight DESC, s.from_type, s.to_type) AS example_from, first(s.to_type ORDER BY s.weight DESC, s.from_type, s.to_type) AS example_to FROM sides s JOIN project_scc x ON s.fp = x.node JOIN project_scc y ON s.tp = y.node AND x.component = y.component WHERE s.fp <> s.tp GROUP BY 1, 2")

# detectors: subject, receipts and qualifiers
DETECTORS = {
    "d01_spans_layers": "SpansArchitecturalLayers", "d02_concealed_method": "ConcealedDecisionMethod", "d03_concealed_type": "ConcealedDecisionType", "d04_blast_radius": "BugBlastRadius", "d05_change_cost": "ChangeCost",
    "d06_relied_on": "ReliedOnAndIntricate", "d07_breaks_alone": "BreaksAlone", "d08_hub": "HubOrGodObject", "d09_shared_state": "SharedMutableState", "d10_boundary_logic": "BoundaryCarriesLogic",
    "d11_widest_surface": "WidestContractSurface", "d12_no_references": "NoStaticReferences", "d13_no_peer_group": "Coverage",
}


def nominated(kind: str) -> Callable[[Model], DataFrame]:
    def of(m: Model) -> DataFrame:
        n = m.nomination(kind)
        return n.frame.select("subject", "type_id", *[S.finite(F.col(r)).alias(r) for r, _ in n.receipts], *[q for q, _ in n.qualifiers])

    return of


def _detector_sql(table: str) -> str:
    """Receipts as doubles, infinite ones null; then the qualifiers."""
    text = dict(oracle.TABLES)[table]
    receipts = re.findall(r" AS ([A-Z][a-z]\w+)", text)
    qualifiers = [q for q in re.findall(r" AS ([a-z]\w+)", text) if q not in ("subject", "times")]
    if table == "d01":
        qualifiers = ["PatternGroupSize > 5 AS part_of_a_layering_pattern"]
    numbers = [f"nullif(CAST({r} AS DOUBLE), CAST('Infinity' AS DOUBLE)) AS {r}" for r in receipts]
    return f"SELECT {', '.join(['subject', 'type_id', *numbers, *qualifiers])} FROM {table}"


for _name, _kind in DETECTORS.items():
    add(_name, nominated(_kind), _detector_sql(_name[:3]))

# suppression and finding sets
for _rule in range(3):
    add(f"p0{_rule + 1}_silenced", lambda m, k=_rule: m.judged.where(F.col("silenced_by") == X.RULES[k]).select("subject"), f"SELECT subject FROM judged WHERE silenced_by = '{X.RULES[_rule]}'")
add("p04_silenced", lambda m: m.judged.where(F.col("silenced_by") == X.RULES[3]).select("subject"), f"SELECT subject FROM judged WHERE silenced_by = '{X.RULES[3]}'")
add("p05_judged", lambda m: m.judged.select("kind", "subject", "silenced_by"), "SELECT kind, subject, silenced_by FROM judged")
add("p06_detected", lambda m: m.detected.select("finding_key", "kind", "place", "subject", "type_id", F.size("receipts").alias("n_receipts")).drop("n_receipts"), "SELECT kind || '|' || subject AS finding_key, kind, place, subject, type_id FROM detected")
add("p07_about", lambda m: X.about(m.findings, m.full.where("kind = 'ApiBoundary'")).select("kind", "subject"), "SELECT f.kind, f.subject FROM findings f SEMI JOIN (SELECT type_id FROM kinds WHERE kind = 'ApiBoundary') k USING (type_id)")
add("p08_participants", lambda m: m.participants.groupBy("kind").agg(F.count("*").alias("participants")), """SELECT kind, count(*) AS participants FROM (SELECT d.kind FROM detected d JOIN edges e ON e.to_type = d.subject WHERE d.kind IN ('BugBlastRadius', 'ChangeCost')
UNION ALL SELECT d.kind FROM detected d JOIN read r ON r.type_id = d.subject WHERE d.kind IN ('ConcealedDecisionType', 'ReliedOnAndIntricate', 'BreaksAlone', 'HubOrGodObject', 'BoundaryCarriesLogic', 'Coverage') AND r.most_complex_member IS NOT NULL
UNION ALL SELECT d.kind FROM detected d JOIN members m ON m.type_id = d.subject WHERE d.kind = 'SharedMutableState' AND m.static_mutations > 0
UNION ALL SELECT d.kind FROM detected d JOIN d01_reached x ON x.from_type = d.subject WHERE d.kind = 'SpansArchitecturalLayers') GROUP BY 1""")

# selection and presentation
add("v01_exemplars", lambda m: V.exemplars(m.findings), "SELECT kind, subject, total, row_number() OVER (ORDER BY total, kind)::INTEGER AS place FROM (SELECT kind, count(*) AS total, first(subject ORDER BY o1, o2, o3, subject) AS subject FROM findings GROUP BY 1)")
add("v02_named_types", lambda m: V.named_types(m.findings), "SELECT type_id FROM named")
add("v03_widest_reach", lambda m: V.widest_reach(m.full), "SELECT type_id, fan_in FROM read WHERE fan_in > 0 ORDER BY fan_in DESC, type_id LIMIT 1")
add("v04_clean_share", lambda m: V.clean_share(m.types, V.named_types(m.findings)), "SELECT round_even(100.0 * count(*) FILTER (n.type_id IS NULL) / count(*), 0)::BIGINT AS clean_percent FROM types t LEFT JOIN named n USING (type_id)")
add("v05_concentration", lambda m: V.concentration(m.by_project), "SELECT project, named / expected AS times_share FROM (SELECT project, named, sum(named) OVER () * (types / (sum(types) OVER ())::DOUBLE) AS expected FROM by_project) ORDER BY named - expected DESC, project LIMIT 1")
add("v06_most_intricate", lambda m: V.most_intricate(m.full), "SELECT type_id, max_cc FROM read WHERE max_cc > 0 ORDER BY max_cc DESC, type_id LIMIT 1")
add("v07_foundation", lambda m: V.foundation(m.couplings, m.by_project), "SELECT project, ca, types, named, round_even(100.0 * named / types, 0)::BIGINT AS flagged_percent FROM couplings JOIN by_project USING (project) WHERE ca > 0 ORDER BY ca DESC, project LIMIT 1")
add("v08_plot_points", lambda m: V.plot_points(m.by_project, m.couplings), "SELECT project, types, named, ca AS dependents, CASE WHEN sum(types) OVER () > types THEN 100.0 * ca / (sum(types) OVER () - types)::DOUBLE ELSE 0 END AS reach, 100.0 * named / types::DOUBLE AS density FROM by_project JOIN couplings USING (project)")
add("v09_plot_bounds", lambda m: V.plot_points(m.by_project, m.couplings).agg(V.plot_bound(F.max("reach")).alias("bound")).select("bound", V.plot_step(F.col("bound")).alias("step")), "SELECT bound, greatest(5.0, bound / 5.0)::DOUBLE AS step FROM (SELECT greatest(10.0, ceil(max(reach) / 10.0) * 10.0)::DOUBLE AS bound FROM (SELECT CASE WHEN sum(types) OVER () > types THEN 100.0 * ca / (sum(types) OVER () - types)::DOUBLE ELSE 0 END AS reach FROM by_project JOIN couplings USING (project)))")
add("v11_mosaic_shares", lambda m: m.full.groupBy("project").agg(F.sum("lines_of_code").alias("lines")), "SELECT project, sum(lines_of_code)::BIGINT AS lines FROM read GROUP BY 1")
add("v11_line_shares", lambda m: V.line_shares(m.full), "SELECT type_id, project, 100.0 * lines_of_code / nullif(sum(lines_of_code) OVER (PARTITION BY project), 0)::DOUBLE AS percent FROM read")
add("v11_named_ink", lambda m: V.named_ink(m.full, V.named_types(m.findings)), "SELECT count(*) AS types, count(n.type_id) AS named, 100.0 * coalesce(sum(lines_of_code) FILTER (n.type_id IS NOT NULL), 0) / nullif(sum(lines_of_code), 0)::DOUBLE AS ink_percent FROM read LEFT JOIN named n USING (type_id)")
add("v12_diagram_rows", lambda m: V.diagram_rows(m.project_groups).select(joined("projects").alias("projects"), "layer", "row", "place"), "SELECT array_to_string(projects, ';') AS projects, layer, ((turn - 1) // 5)::BIGINT AS \"row\", ((turn - 1) % 5)::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY projects) AS turn FROM boxed)")
add("v13_unread_carriers", lambda m: V.carriers(m.nomination("NoStaticReferences").frame, m.types), "SELECT c.type_id, t.name, c.unread, c.total FROM (SELECT type_id, count(*) AS unread, max(DeclaringTypeDataMembers)::BIGINT AS total FROM d12 WHERE part_of_an_unread_group GROUP BY 1) c JOIN types t USING (type_id) WHERE c.total > 0")
add("v14_layer_span_groups", lambda m: m.nomination("SpansArchitecturalLayers").frame.groupBy("PatternGroupSize").agg(F.count("*").alias("n")), "SELECT PatternGroupSize::DOUBLE AS PatternGroupSize, count(*) AS n FROM d01 GROUP BY 1")
add("v14_layering_patterns", lambda m: V.layering_patterns(m.findings, m.participants, m.full), "SELECT signature, count(*) AS types, array_to_string(list_sort(list(name))[1:4], ', ') AS names FROM (SELECT coalesce(array_to_string(list_sort(s.ks), '+'), '') AS signature, r.name FROM d01 d JOIN read r ON r.type_id = d.type_id LEFT JOIN d01_sets s ON s.from_type = d.type_id WHERE d.PatternGroupSize > 5) GROUP BY 1")
add("v17_fixed_gate_shares", lambda m: V.fixed_gate_shares(m.findings, m.types), "SELECT kind, count(*) AS found, (SELECT count(*) FROM types) AS types, 100.0 * count(*) / (SELECT count(*) FROM types) AS percent FROM findings WHERE kind IN ('HubOrGodObject', 'BreaksAlone') GROUP BY 1")
add("v18_below_floor", lambda m: m.full.where(F.col("cohort_size") < 5).select("type_id", "fan_in", "max_cc"), "SELECT type_id, fan_in, max_cc FROM read WHERE cohort_size < 5")
add("v18_without_peers", lambda m: V.without_peers(m.findings), "SELECT count(*) AS types, count(*) FILTER (globally_extreme_fan_in OR globally_extreme_complexity) AS extreme, count(*) FILTER (subject IN (SELECT subject FROM findings WHERE kind <> 'Coverage')) AS also_named FROM d13")
add("v19_lead", lambda m: V.lead(m.findings), "SELECT kind, subject, total, row_number() OVER (ORDER BY total, kind)::INTEGER AS place FROM (SELECT kind, count(*) AS total, first(subject ORDER BY o1, o2, o3, subject) AS subject FROM findings WHERE kind <> 'Coverage' GROUP BY 1)")
add("v22_drill_down", lambda m: V.drill_down(m.findings, m.full.select("type_id", "name"), 15), "SELECT type_id, name FROM read SEMI JOIN (SELECT type_id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o1, o2, o3, subject) AS shown FROM findings) WHERE shown <= 15) s USING (type_id)")

# sinks
add("k01_types_table", lambda m: sinks.types_table(m.full).select("Id", "Kind", "KindEvidence", "Cohort", "CohortBasis", "FanIn", "FanInPctl", "FanInXMedian", "Instability", "MostComplexMember", "ExternalNamespaces", "File", "Line"), "SELECT type_id AS Id, kind AS Kind, evidence AS KindEvidence, cohort AS Cohort, cohort_basis AS CohortBasis, fan_in AS FanIn, CASE WHEN cohort_size >= 5 THEN fan_in_pct END AS FanInPctl, CASE WHEN cohort_size >= 5 AND isfinite(fan_in_times) THEN fan_in_times END AS FanInXMedian, instability AS Instability, most_complex_member AS MostComplexMember, array_to_string(list_sort(string_split(external, ';')), ';') AS ExternalNamespaces, CASE WHEN line > 0 THEN file END AS File, CASE WHEN line > 0 THEN line END AS Line FROM read")
add("k02_members_table", lambda m: sinks.members_table(m.members), "SELECT member_id AS Id, name AS Name, name AS Signature, kind AS Kind, accessibility AS Accessibility, type_id AS DeclaringType, project AS Project, cyclomatic AS Cyclomatic, dsm AS Dsm, transform AS Transform, static_mutations AS StaticMutations, max_nesting AS MaxNestingDepth, parameter_count AS ParameterCount, lines_of_code AS LinesOfCode, CASE WHEN file <> '' AND line > 0 THEN file END AS File, CASE WHEN file <> '' AND line > 0 THEN line END AS Line FROM members")
add("k03_edges_table", lambda m: sinks.edges_table(m.all_edges), "SELECT from_type AS \"From\", to_type AS \"To\", weight AS Weight, array_to_string(list_transform(kinds, lambda k: ['Other', 'Inheritance', 'InterfaceImplementation', 'Field', 'Parameter', 'ReturnType', 'Construction', 'Invocation', 'GenericArgument', 'Attribute'][k + 1]), ';') AS Kinds, file AS File, line AS Line FROM all_edges")
add("k05_json_lines", sinks.document)
add("policy_values", lambda m: m.types.sparkSession.createDataFrame([(n, float(v)) for n, v in Policy().values()], "name string, value double"), "SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES ('min_cohort', 5), ('cohort_basis_floor', 5), ('outlier_factor', 3), ('min_fan_in', 5), ('top', 15), ('high_cc', 10), ('min_decision_cc', 5), ('concealed_top_rank', 3), ('boundary_top_fraction', 0.05), ('hub_min', 5), ('god_object_members', 20), ('min_kind_span', 3), ('stable_threshold', 0.2), ('isolated_threshold', 0.8), ('breaks_alone_min_fan_in', 1), ('concealed_fan_in_ceiling', 2), ('concealed_fan_out_ceiling', 2), ('blast_fan_in_multiple', 2), ('blast_top_fraction', 0.05), ('blast_complexity_percentile', 70), ('change_cost_top_fraction', 0.05), ('roll_call_divisor', 3), ('surface_outlier_multiple', 1.5), ('surface_outlier_floor', 1), ('max_named_surfaces', 5), ('global_fan_in_percentile', 90), ('global_complexity_percentile', 90), ('global_complexity_floor', 1), ('min_tangle', 4)) x(name, value)")
