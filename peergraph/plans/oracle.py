"""The same analysis as DuckDB SQL: named tables that each query's text is put on top of.

Written apart from the DataFrame code, at the default policy. ``sql(select)`` gives a whole statement.
"""

from __future__ import annotations

import re

from ..sources.star import duckdb_facts

_INF = "CAST('Infinity' AS DOUBLE)"


def _times(value: str, median: str) -> str:
    return f"CASE WHEN {median} <= 0 THEN CASE WHEN {value} > 0 THEN {_INF} ELSE 1.0 END ELSE {value} / {median} END"


def _peers(metric: str, part: str, name: str) -> str:
    """Window columns of a metric within a partition: pct, rank from the top, times the median, n."""
    over = f"PARTITION BY {part}" if part else ""
    same = f"PARTITION BY {part}, {metric}" if part else f"PARTITION BY {metric}"
    return f"""100.0 * (rank() OVER ({over} ORDER BY {metric}) - 1 + 0.5 * count(*) OVER ({same})) / count(*) OVER ({over}) AS {name}_pct,
  CAST(rank() OVER ({over} ORDER BY {metric} DESC) - 1 + 0.5 * count(*) OVER ({same}) + 0.5 AS DOUBLE) AS {name}_rank, median({metric}) OVER ({over}) AS {name}_med, count(*) OVER ({over}) AS {name}_n"""


def _covered(prefixes: str) -> str:
    tests = " OR ".join(f"x = '{p}' OR starts_with(x, '{p}.')" for p in prefixes.split())
    return f"list_sort(list_filter(string_split(external, ';'), lambda x: {tests}))[1]"


_NS = "CASE WHEN namespace = '' THEN '<global>' ELSE namespace END"


def _reconcile(k: int) -> list[tuple[str, str]]:
    now = f"assigned{k}"
    return [
        (f"size{k}", f"SELECT key, count(*) AS size FROM {now} GROUP BY key"),
        (f"stranded{k}", f"SELECT a.type_id, a.key AS current FROM {now} a JOIN size{k} s USING (key) WHERE s.size < 5"),
        (f"others{k}", f"SELECT c.*, s.current FROM candidates c JOIN stranded{k} s USING (type_id) WHERE c.key <> s.current"),
        (f"potential{k}", f"SELECT key, sum(n) AS potential FROM (SELECT key, size AS n FROM size{k} UNION ALL SELECT key, count(*) FROM others{k} GROUP BY key) GROUP BY key"),
        (f"moves{k}", f"SELECT type_id, key, basis FROM (SELECT o.*, row_number() OVER (PARTITION BY o.type_id ORDER BY o.precedence, o.place) AS r FROM others{k} o JOIN potential{k} p USING (key) WHERE p.potential >= 5) WHERE r = 1"),
        (f"assigned{k + 1}", f"SELECT a.type_id, coalesce(m.key, a.key) AS key, coalesce(m.basis, a.basis) AS basis FROM {now} a LEFT JOIN moves{k} m USING (type_id)"),
    ]


_UNINFORMATIVE = "'IAsyncDisposable', 'ICloneable', 'IComparable', 'IDisposable', 'IEnumerable', 'IEnumerator', 'IEquatable', 'IFormattable', 'INotifyPropertyChanged', 'ISerializable'"
_PLUMBING = " OR ".join(
    f"starts_with(namespace, '{p}')"
    for p in "Microsoft.CSharp Microsoft.Extensions System.Collections System.ComponentModel System.Diagnostics System.Globalization System.Linq System.Numerics System.Reflection System.Runtime System.Text System.Threading".split()
)

TABLES: list[tuple[str, str]] = [
    *duckdb_facts(),
    ("all_edges", """SELECT from_type, to_type, count(*) AS weight, list_sort(list(DISTINCT kind)) AS kinds, count(*) FILTER (kind = 3) AS fields,
  first(file ORDER BY file, line) FILTER (file <> '' AND line > 0) AS file, first(line ORDER BY file, line) FILTER (file <> '' AND line > 0) AS line
FROM type_refs GROUP BY ALL"""),
    ("edges", "SELECT e.* FROM all_edges e SEMI JOIN types f ON e.from_type = f.type_id SEMI JOIN types t ON e.to_type = t.type_id"),
    ("fan", """SELECT t.type_id, coalesce(i.fan_in, 0) AS fan_in, coalesce(i.refs, 0) AS inbound_references, coalesce(o.fan_out, 0) AS fan_out FROM types t
LEFT JOIN (SELECT to_type, count(*) AS fan_in, sum(weight) AS refs FROM edges GROUP BY 1) i ON i.to_type = t.type_id
LEFT JOIN (SELECT from_type, count(*) AS fan_out FROM all_edges GROUP BY 1) o ON o.from_type = t.type_id"""),
    ("member_metrics", """SELECT type_id, sum(cyclomatic) AS cyclomatic, max(cyclomatic) AS max_cc, first(member_id ORDER BY cyclomatic DESC, file, line, member_id) AS most_complex_member,
  sum(dsm) AS dsm, sum(transform) AS transform, sum(static_mutations) AS static_mutations, sum(lines_of_code) AS lines_of_code, sum(parameter_count) AS parameter_count, count(*) AS member_count,
  count(*) FILTER (accessibility = 'Public') AS public_member_count, count(*) FILTER (kind IN ('Method', 'Constructor')) AS executable_member_count, count(*) FILTER (kind = 'Method') AS ordinary_methods,
  least(100, count(*) FILTER (accessibility = 'Public' AND kind IN ('Property', 'Field'))) AS data_shape FROM members GROUP BY 1"""),
    ("metrics", """SELECT t.*, coalesce(cyclomatic, 0) AS cyclomatic, coalesce(max_cc, 0) AS max_cc, most_complex_member, coalesce(dsm, 0) AS dsm, coalesce(transform, 0) AS transform, coalesce(static_mutations, 0) AS static_mutations,
  coalesce(lines_of_code, 0) AS lines_of_code, coalesce(parameter_count, 0) AS parameter_count, coalesce(member_count, 0) AS member_count, coalesce(public_member_count, 0) AS public_member_count,
  coalesce(executable_member_count, 0) AS executable_member_count, coalesce(ordinary_methods, 0) AS ordinary_methods, coalesce(data_shape, 0) AS data_shape, fan_in, inbound_references, fan_out
FROM types t LEFT JOIN member_metrics m USING (type_id) JOIN fan USING (type_id)"""),
    ("evidences", f"""SELECT *, list_filter(string_split(attributes, ';'), lambda x: x IN ('ApiControllerAttribute', 'RouteAttribute'))[1] AS e1, list_filter(string_split(bases, ';'), lambda x: x IN ('ControllerBase', 'Controller', 'ApiController'))[1] AS e2,
  {_covered('Microsoft.AspNetCore')} AS e4, {_covered('Microsoft.EntityFrameworkCore System.Data Dapper NHibernate LinqToDB FluentMigrator')} AS e6,
  {_covered('System.Net.Http Azure Amazon RabbitMQ Confluent.Kafka MassTransit Stripe Twilio SendGrid Polly')} AS e7,
  member_count > 0 AND public_member_count > 0 AND executable_member_count = 0 AND ordinary_methods = 0 AS e8 FROM metrics"""),
    ("kinds", """SELECT * EXCLUDE (e1, e2, e4, e6, e7, e8),
  CASE WHEN e1 IS NOT NULL OR e2 IS NOT NULL OR name LIKE '%Controller' OR e4 IS NOT NULL THEN 'ApiBoundary' WHEN list_contains(string_split(bases, ';'), 'DbContext') OR e6 IS NOT NULL THEN 'DataAccess'
    WHEN e7 IS NOT NULL THEN 'ExternalCall' WHEN e8 THEN 'Contract' ELSE 'Internal' END AS kind,
  CASE WHEN e1 IS NOT NULL THEN 'attribute:' || e1 WHEN e2 IS NOT NULL THEN 'base:' || e2 WHEN name LIKE '%Controller' THEN 'name-suffix:Controller' WHEN e4 IS NOT NULL THEN 'external-ns:' || e4
    WHEN list_contains(string_split(bases, ';'), 'DbContext') THEN 'base:DbContext' WHEN e6 IS NOT NULL THEN 'external-ns:' || e6 WHEN e7 IS NOT NULL THEN 'external-ns:' || e7
    WHEN e8 THEN 'shape:no executable members' ELSE 'no classifying evidence' END AS evidence FROM evidences"""),
    ("insulating", "SELECT type_id FROM kinds WHERE is_abstract OR keyword = 'interface' OR kind = 'Contract'"),
    ("classified", """SELECT k.*, coalesce(n, 0) AS effective_fan_out, CASE WHEN fan_in + coalesce(n, 0) > 0 THEN coalesce(n, 0) / CAST(fan_in + coalesce(n, 0) AS DOUBLE) END AS instability,
  CASE WHEN fan_in + fan_out > 0 THEN fan_out / CAST(fan_in + fan_out AS DOUBLE) END AS instability_raw
FROM kinds k LEFT JOIN (SELECT from_type, count(*) AS n FROM all_edges e ANTI JOIN insulating i ON e.to_type = i.type_id GROUP BY 1) x ON x.from_type = k.type_id"""),
    ("bare", "SELECT type_id, string_split(x, '<')[1] AS iface, place FROM (SELECT type_id, unnest(string_split(interfaces, ';')) AS x, unnest(range(len(string_split(interfaces, ';')))) AS place FROM classified WHERE interfaces <> '')"),
    ("words", r"SELECT type_id, regexp_extract(CASE WHEN keyword = 'interface' AND regexp_matches(name, '^I\p{Lu}') THEN substring(name, 2) ELSE name END, '.*[^\p{Lu}](\p{Lu}.*)$', 1) AS word FROM classified"),
    ("candidates", f"""SELECT type_id, place, 'impl:' || iface AS key, 'interface' AS basis, 0 AS precedence FROM bare WHERE string_split(iface, '.')[-1] NOT IN ({_UNINFORMATIVE})
UNION ALL SELECT type_id, 1000, 'base:' || solution_base, 'base type', 1 FROM classified WHERE solution_base <> ''
UNION ALL SELECT type_id, 1001, 'suffix:' || word, 'name suffix', 2 FROM words WHERE length(word) >= 3
UNION ALL SELECT type_id, 1002, 'ns:' || {_NS}, 'namespace', 4 FROM classified
UNION ALL SELECT type_id, 1003, 'kind:' || kind, 'kind', 3 FROM classified WHERE kind <> 'Internal'"""),
    ("listed", "SELECT key, count(*) AS listed FROM candidates GROUP BY key"),
    ("assigned0", """SELECT type_id, key, basis FROM (SELECT *, row_number() OVER (PARTITION BY type_id ORDER BY listed >= 5 DESC, CASE WHEN listed >= 5 THEN precedence ELSE -listed END, CASE WHEN listed >= 5 THEN place ELSE precedence END, place) AS r
FROM candidates JOIN listed USING (key)) WHERE r = 1"""),
    *_reconcile(0), *_reconcile(1), *_reconcile(2),
    ("cohorts", "SELECT type_id, key AS cohort, basis AS cohort_basis, count(*) OVER (PARTITION BY key) AS cohort_size FROM assigned3"),
    ("peers", "SELECT * FROM classified JOIN cohorts USING (type_id)"),
    ("windows", "SELECT *, " + ",\n  ".join([_peers(m, "cohort", m) for m in ("fan_in", "fan_out", "cyclomatic", "max_cc", "dsm", "data_shape")] + [_peers(m, "", f"all_{m}") for m in ("fan_in", "max_cc")]) + " FROM peers"),
    ("read", "SELECT *, " + ", ".join(f"{_times(m, m + '_med')} AS {m}_times" for m in ("fan_in", "fan_out", "cyclomatic", "max_cc", "dsm", "data_shape")) + " FROM windows"),
    ("d01_reached", "SELECT DISTINCT e.from_type, c.kind, c.type_id FROM all_edges e JOIN classified c ON e.to_type = c.type_id WHERE c.kind IN ('ApiBoundary', 'DataAccess', 'ExternalCall')"),
    ("d01_sets", "SELECT from_type, count(DISTINCT kind) AS through, list(DISTINCT kind) AS ks, string_agg(kind || ':' || type_id, '|' ORDER BY kind, type_id) AS pattern FROM d01_reached GROUP BY 1"),
    ("d01_own", "SELECT r.type_id, r.fan_in, coalesce(s.through, 0) AS through, CASE WHEN kind IN ('ApiBoundary', 'DataAccess', 'ExternalCall') THEN kind END AS own, coalesce(s.ks, []) AS ks, coalesce(s.pattern, '') AS pattern FROM read r LEFT JOIN d01_sets s ON s.from_type = r.type_id"),
    ("d01_span", "SELECT *, through + CASE WHEN own IS NOT NULL AND NOT list_contains(ks, own) THEN 1 ELSE 0 END AS span FROM d01_own"),
    ("d01", "SELECT type_id AS subject, type_id, span AS KindSpan, through AS KindsThroughDependencies, count(*) OVER (PARTITION BY coalesce(own, '-'), pattern) AS PatternGroupSize, fan_in AS FanIn FROM d01_span WHERE span >= 3"),
    ("methods", f"SELECT m.member_id, m.type_id, r.cohort, m.cyclomatic, m.dsm, m.max_nesting, m.lines_of_code, {_peers('m.cyclomatic', 'r.cohort', 'cc')} FROM members m JOIN read r USING (type_id) WHERE m.kind IN ('Method', 'Constructor')"),
    ("d02", f"""SELECT member_id AS subject, type_id, cc_n AS CohortSize, cyclomatic AS Cyclomatic, times AS CyclomaticXMedian, cc_rank AS CyclomaticRank, cc_med AS MedianCohortCyclomatic, cc_pct AS CyclomaticPctl, dsm AS Dsm, max_nesting AS MaxNestingDepth, lines_of_code AS LinesOfCode
FROM (SELECT *, {_times('cyclomatic', 'cc_med')} AS times FROM methods) WHERE cc_n >= 5 AND cyclomatic >= 5 AND times >= 3 AND cc_rank <= 3"""),
    ("d03", """SELECT type_id AS subject, type_id, cohort_size AS CohortSize, max_cc AS MaxMemberCyclomatic, max_cc_times AS MaxMemberCyclomaticXMedian, fan_in_times AS FanInXMedian, fan_out_times AS FanOutXMedian, max_cc_pct AS MaxMemberCyclomaticPctl,
  fan_in AS FanIn, fan_out AS FanOut, dsm AS Dsm, fan_in < 5 AS low_absolute_connectivity FROM read WHERE cohort_size >= 5 AND max_cc >= 5 AND max_cc_times >= 3 AND fan_in_times <= 2 AND fan_out_times <= 2"""),
    ("d04", """SELECT type_id AS subject, type_id, cohort_size AS CohortSize, fan_in AS FanIn, fan_in_times AS FanInXMedian, fan_in_rank AS FanInRank, cyclomatic_pct AS CyclomaticPctl, greatest(1.0, 0.05 * cohort_size + 0.5) AS FanInTopRankLimit,
  fan_in_pct AS FanInPctl, cyclomatic AS Cyclomatic, fan_out AS FanOut, inbound_references AS InboundReferenceCount FROM read
WHERE cohort_size >= 5 AND fan_in >= 5 AND fan_in_times >= 2 AND fan_in_rank <= greatest(1.0, 0.05 * cohort_size + 0.5) AND cyclomatic_pct >= 70"""),
    ("d05", """SELECT type_id AS subject, type_id, fan_in AS FanIn, all_fan_in_rank AS FanInSolutionRank, greatest(1.0, 0.05 * all_fan_in_n + 0.5) AS FanInSolutionRankLimit, all_fan_in_pct AS FanInSolutionPctl, all_fan_in_n AS SolutionTypeCount,
  data_shape AS DataShape, inbound_references AS InboundReferenceCount FROM read WHERE kind IN ('Contract', 'ApiBoundary') AND fan_in >= 5 AND all_fan_in_n >= 2 AND all_fan_in_rank <= greatest(1.0, 0.05 * all_fan_in_n + 0.5)"""),
    ("d06", """SELECT type_id AS subject, type_id, instability AS Instability, fan_in AS FanIn, max_cc AS MaxMemberCyclomatic, effective_fan_out AS EffectiveFanOut, fan_out AS FanOut, instability_raw AS InstabilityRaw, cyclomatic AS Cyclomatic
FROM read WHERE instability <= 0.2 AND fan_in >= 5 AND max_cc >= 10"""),
    ("d07", "SELECT type_id AS subject, type_id, instability AS Instability, max_cc AS MaxMemberCyclomatic, fan_in AS FanIn, fan_out AS FanOut, effective_fan_out AS EffectiveFanOut FROM read WHERE instability >= 0.8 AND max_cc >= 10"),
    ("d08", """SELECT type_id AS subject, type_id, fan_in AS FanIn, fan_out AS FanOut, least(fan_in, fan_out) AS Coupling, member_count AS MemberCount, max_cc AS MaxMemberCyclomatic, dsm AS Dsm, instability AS Instability,
  max_cc >= 10 AS carries_real_logic, member_count >= 20 AS too_large_to_hold FROM read WHERE least(fan_in, fan_out) >= 5"""),
    ("d09", "SELECT type_id AS subject, type_id, static_mutations AS StaticMutations, fan_in AS FanIn FROM read WHERE static_mutations > 0"),
    ("boundaries", f"SELECT type_id, max_cc, data_shape, fan_in, fan_out, public_member_count, {_peers('max_cc', '', 'b')}, median(data_shape) OVER () AS surface_med FROM read WHERE kind IN ('ApiBoundary', 'ExternalCall')"),
    ("d10", """SELECT type_id AS subject, type_id, max_cc AS MaxMemberCyclomatic, b_rank AS MaxMemberCyclomaticRank, greatest(1.0, 0.05 * b_n + 0.5) AS BoundaryTopRankLimit, b_n AS BoundaryCount, b_med AS MedianBoundaryCyclomatic,
  data_shape AS DataShape, fan_in AS FanIn, fan_out AS FanOut FROM boundaries WHERE max_cc >= 10 AND b_rank <= greatest(1.0, 0.05 * b_n + 0.5)"""),
    ("d11", """SELECT type_id AS subject, type_id, data_shape AS DataShape, greatest(surface_med * 1.5, 1.0) AS SurfaceThreshold, surface_med AS MedianBoundarySurface, b_n AS BoundaryCount, public_member_count AS PublicMemberCount
FROM boundaries WHERE data_shape >= greatest(surface_med * 1.5, 1.0)"""),
    ("constructible", """SELECT *, kind = 'Constructor' AND NOT is_static AND accessibility <> 'Private' AS makes, kind IN ('Property', 'Field') AS is_data FROM members"""),
    ("considered", """SELECT *, is_entry_point OR (kind = 'Constructor' AND is_static) AS runtime, makes AND makers = 1 AS sole,
  CASE WHEN is_entry_point OR (kind = 'Constructor' AND is_static) THEN 'invoked by the runtime' WHEN implements_interface THEN 'implements an interface' WHEN is_override THEN 'overrides a base member'
    WHEN is_externally_visible THEN 'externally visible' WHEN makes AND makers = 1 THEN 'the type''s only accessible constructor' END AS excluded
FROM (SELECT *, count(*) FILTER (makes) OVER t AS makers, count(*) OVER t AS type_members, count(*) FILTER (is_data) OVER t AS type_data FROM constructible WINDOW t AS (PARTITION BY type_id)) m
ANTI JOIN member_refs r ON m.member_id = r.to_member"""),
    ("nominated", "SELECT *, count(*) FILTER (is_data) OVER (PARTITION BY type_id) AS unread FROM considered WHERE excluded IS NULL"),
    ("d12", """SELECT n.member_id AS subject, n.type_id, n.lines_of_code, 0 AS InboundReferences, r.inbound_references AS DeclaringTypeInboundReferences, type_members AS DeclaringTypeMembers, type_data AS DeclaringTypeDataMembers, unread AS UnreadDataMembersInType,
  false AS test_usage_unobservable, is_data AND unread > 1 AS part_of_an_unread_group, has_attributes AS an_attribute_may_direct_it FROM nominated n JOIN read r USING (type_id)"""),
    ("d13", """SELECT type_id AS subject, type_id, cohort_size AS CohortSize, all_fan_in_pct AS GlobalFanInPctl, all_max_cc_pct AS GlobalMaxCcPctl, fan_in AS FanIn, max_cc AS MaxMemberCyclomatic, 1.0 AS GlobalComplexityFloor, all_fan_in_n AS SolutionTypeCount,
  all_fan_in_pct >= 90 AS globally_extreme_fan_in, all_max_cc_pct >= 90 AND max_cc > 1 AS globally_extreme_complexity FROM read WHERE cohort_size < 5"""),
    ("detected", " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, {place} AS place, subject, type_id, {o1}::DOUBLE AS o1, {o2}::DOUBLE AS o2, {o3}::DOUBLE AS o3 FROM d{place + 1:02d}"
        for place, (kind, o1, o2, o3) in enumerate([
            ("SpansArchitecturalLayers", "PatternGroupSize", "-FanIn", "0"),
            ("ConcealedDecisionMethod", f"(CyclomaticXMedian = {_INF})::INT", f"CASE WHEN CyclomaticXMedian = {_INF} THEN 0 ELSE -CyclomaticXMedian END", "-Cyclomatic"),
            ("ConcealedDecisionType", f"(MaxMemberCyclomaticXMedian = {_INF})::INT", f"CASE WHEN MaxMemberCyclomaticXMedian = {_INF} THEN 0 ELSE -MaxMemberCyclomaticXMedian END", "-MaxMemberCyclomatic"),
            ("BugBlastRadius", "-FanIn", "0", "0"), ("ChangeCost", "-FanIn", "0", "0"), ("ReliedOnAndIntricate", "Instability", "-FanIn", "0"), ("BreaksAlone", "-MaxMemberCyclomatic", "0", "0"),
            ("HubOrGodObject", "-Coupling", "0", "0"), ("SharedMutableState", "-StaticMutations", "0", "0"), ("BoundaryCarriesLogic", "-MaxMemberCyclomatic", "0", "0"), ("WidestContractSurface", "-DataShape", "0", "0"),
            ("NoStaticReferences", "-lines_of_code", "0", "0"), ("Coverage", "CASE WHEN globally_extreme_fan_in OR globally_extreme_complexity THEN 0 ELSE 1 END", "-FanIn", "0"),
        ])
    )),
    ("judged", """SELECT d.*, CASE WHEN d.kind = 'BreaksAlone' AND r.kind IN ('ApiBoundary', 'ExternalCall', 'Contract') THEN 'breaks-alone-at-a-boundary'
  WHEN d.kind = 'BreaksAlone' AND d.type_id IN (SELECT type_id FROM detected WHERE kind LIKE 'ConcealedDecision%') THEN 'breaks-alone-decides-something'
  WHEN d.kind = 'BreaksAlone' AND r.fan_in < 1 THEN 'breaks-alone-is-unreferenced'
  WHEN d.kind = 'WidestContractSurface' AND (SELECT count(*) FROM d11) > 5 THEN 'widest-surface-is-not-discriminating' END AS silenced_by FROM detected d LEFT JOIN read r USING (type_id)"""),
    ("findings", "SELECT * EXCLUDE (silenced_by) FROM judged WHERE silenced_by IS NULL"),
    ("named", "SELECT DISTINCT type_id FROM findings WHERE kind <> 'Coverage'"),
    ("sides", f"SELECT e.*, f.project AS fp, t.project AS tp, CASE WHEN f.namespace = '' THEN '<global>' ELSE f.namespace END AS fn, CASE WHEN t.namespace = '' THEN '<global>' ELSE t.namespace END AS tn, t.is_abstract OR t.keyword = 'interface' AS to_abstract FROM edges e JOIN types f ON e.from_type = f.type_id JOIN types t ON e.to_type = t.type_id"),
    ("couplings", """SELECT p.project, coalesce(i.ca, 0) AS ca, coalesce(o.ce, 0) AS ce, abstract_types, total_types FROM (SELECT project, count(*) FILTER (is_abstract OR keyword = 'interface') AS abstract_types, count(*) AS total_types FROM types GROUP BY 1) p
LEFT JOIN (SELECT tp AS project, count(DISTINCT from_type) AS ca FROM sides WHERE fp <> tp GROUP BY 1) i USING (project) LEFT JOIN (SELECT fp AS project, count(DISTINCT from_type) AS ce FROM sides WHERE fp <> tp GROUP BY 1) o USING (project)"""),
    ("coupled", "SELECT *, abstract_types / CAST(total_types AS DOUBLE) AS abstractness, CASE WHEN ca + ce > 0 THEN ce / CAST(ca + ce AS DOUBLE) END AS instability FROM couplings"),
    ("labels_of", """SELECT DISTINCT type_id, CASE WHEN string_split(x, '.')[1] IN ('System', 'Microsoft') THEN array_to_string(string_split(x, '.')[1:3], '.') ELSE array_to_string(string_split(x, '.')[1:2], '.') END AS namespace
FROM (SELECT type_id, unnest(string_split(external, ';')) AS x FROM types) WHERE x <> ''"""),
    ("dependencies", "SELECT namespace, count(*) AS types_touching FROM labels_of GROUP BY 1"),
    ("plumbed", f"SELECT *, namespace = 'System' OR {_PLUMBING} AS plumbing FROM dependencies"),
    ("held", "SELECT fn AS a, tn AS b, sum(fields)::BIGINT AS held FROM sides WHERE fields > 0 AND to_abstract AND fn <> tn GROUP BY 1, 2"),
    ("by_project", "SELECT project, count(*) AS types, count(n.type_id) AS named FROM types t LEFT JOIN named n USING (type_id) GROUP BY 1"),
    ("project_edges", "SELECT DISTINCT fp AS a, tp AS b FROM sides WHERE fp <> tp"),
    ("namespace_edges", "SELECT DISTINCT fn AS a, tn AS b FROM sides WHERE fn <> tn"),
    ("project_reach", "SELECT a, b FROM project_edges UNION SELECT r.a, e.b FROM project_reach r JOIN project_edges e ON r.b = e.a"),
    ("namespace_reach", "SELECT a, b FROM namespace_edges UNION SELECT r.a, e.b FROM namespace_reach r JOIN namespace_edges e ON r.b = e.a"),
    ("project_scc", "SELECT p.project AS node, least(p.project, coalesce(min(x.b), p.project)) AS component FROM (SELECT DISTINCT project FROM types) p LEFT JOIN (SELECT r.a, r.b FROM project_reach r JOIN project_reach s ON r.a = s.b AND r.b = s.a) x ON x.a = p.project GROUP BY p.project"),
    ("namespace_scc", "SELECT r.a AS node, least(r.a, min(r.b)) AS component FROM namespace_reach r JOIN namespace_reach s ON r.a = s.b AND r.b = s.a WHERE r.a <> r.b GROUP BY r.a"),
    ("above", "SELECT DISTINCT x.component AS ca, y.component AS cb FROM project_edges e JOIN project_scc x ON e.a = x.node JOIN project_scc y ON e.b = y.node WHERE x.component <> y.component"),
    ("depths", "SELECT component, 0 AS depth FROM project_scc UNION SELECT a.ca, d.depth + 1 FROM depths d JOIN above a ON a.cb = d.component"),
    ("layers", "SELECT s.node, s.component, d.layer FROM project_scc s JOIN (SELECT component, max(depth) AS layer FROM depths GROUP BY 1) d USING (component)"),
    ("outs_of", "SELECT a AS node, list_sort(list(b)) AS outs FROM project_edges GROUP BY 1"),
    ("ins_of", "SELECT b AS node, list_sort(list(a)) AS ins FROM project_edges GROUP BY 1"),
    ("sized_layers", "SELECT l.*, s.n FROM layers l JOIN (SELECT component, count(*) AS n FROM layers GROUP BY 1) s USING (component)"),
    ("boxed", """SELECT list_sort(list(l.node)) AS projects, list_distinct(flatten(list(coalesce(o.outs, [])))) AS all_outs, l.layer, CASE WHEN l.n > 1 THEN l.component END AS cycle
FROM sized_layers l LEFT JOIN outs_of o USING (node) LEFT JOIN ins_of i USING (node)
GROUP BY l.layer, CASE WHEN l.n > 1 THEN l.component END, CASE WHEN l.n = 1 THEN coalesce(o.outs, []) END, CASE WHEN l.n = 1 THEN coalesce(i.ins, []) END"""),
    ("cycle_projects", f"SELECT n.component, count(DISTINCT t.project) AS n FROM namespace_scc n JOIN types t ON n.node = {_NS.replace('namespace', 't.namespace')} GROUP BY 1"),
    ("anchored", "SELECT c.component FROM namespace_scc c JOIN namespace_scc m ON m.component = c.component GROUP BY c.component, c.node HAVING count(*) FILTER (m.node <> c.node AND NOT starts_with(m.node, c.node || '.')) = 0"),
]

_BODY = dict(TABLES)


def _needed(text: str, found: set[str]) -> None:
    for name in set(re.findall(r"\b(?:FROM|JOIN)\s+\(?\s*([a-z]\w*)", text)) | set(re.findall(r",\s*([a-z]\w*)\s+(?:AS\s+)?\w*", text)):
        if name in _BODY and name not in found:
            found.add(name)
            _needed(_BODY[name], found)


def sql(select: str) -> str:
    """The statement: those of the tables that the select needs, then the select."""
    found: set[str] = set()
    _needed(select, found)
    # what is read more than once is computed once, whatever the optimizer thinks; a table that reads itself can't be asked to
    kept = {name: "" if re.search(rf"\b(FROM|JOIN) {name}\b", text) else "MATERIALIZED " for name, text in TABLES}
    named = ",\n".join(f"{name} AS {kept[name]}({text})" for name, text in TABLES if name in found)
    return f"WITH RECURSIVE {named}\n{select}" if named else select
