"""Projects: coupling, what nothing refers to, selection; and what lies outside the solution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def abstract_or_interface():
    return F.col("is_abstract") | (F.col("keyword") == "interface")


def ends_by(edges: DataFrame, types: DataFrame, column: str) -> DataFrame:
    """Declared edges with ``a`` and ``b``, the column's values at both ends."""
    side = types.select("type_id", column)
    return edges.join(side.select(F.col("type_id").alias("from_type"), F.col(column).alias("a")), "from_type").join(side.select(F.col("type_id").alias("to_type"), F.col(column).alias("b")), "to_type")


def couplings(types: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, ca, ce, abstract_types, total_types, abstractness, instability, distance, zone): ce counts the types here that reach out."""
    across = ends_by(edges, types, "project").where("a <> b")
    out = across.groupBy(F.col("a").alias("project")).agg(F.count_distinct("from_type").alias("ce"))
    into = across.groupBy(F.col("b").alias("project")).agg(F.count_distinct("from_type").alias("ca"))
    totals = types.groupBy("project").agg(F.count_if(abstract_or_interface()).alias("abstract_types"), F.count("*").alias("total_types"))
    found = totals.join(into, "project", "left").join(out, "project", "left").na.fill(0, ["ca", "ce"])
    found = found.withColumns({"abstractness": F.try_divide(F.col("abstract_types").cast("double"), F.col("total_types").cast("double")), "instability": S.instability(F.col("ca"), F.col("ce"))})
    return found.withColumns({"distance": S.distance(F.col("abstractness"), F.col("instability")), "zone": S.zone(F.col("abstractness"), F.col("instability"))})


def unreferenced(projects: DataFrame, coupled: DataFrame, classified: DataFrame) -> DataFrame:
    """Libraries that nothing refers to, that have no entry point and host no API boundary."""
    alone = coupled.where("ca = 0").select("project")
    hosts = classified.where("kind = 'ApiBoundary'").select("project")
    return projects.where("is_library and not has_entry_point").join(alone, "project", "left_semi").join(hosts, "project", "left_anti").select("project")


def unmeasured(projects: DataFrame, types: DataFrame) -> DataFrame:
    """Projects of which no type is analysed."""
    return projects.join(types, "project", "left_anti").select("project")


def selected(projects: DataFrame, include_tests: bool = False) -> DataFrame:
    """projects with ``skipped``: test projects, unless they are asked for."""
    return projects.withColumn("skipped", S.is_test_project(F.col("project")) & F.lit(not include_tests))


def external_dependencies(types: DataFrame) -> DataFrame:
    """(namespace, types_touching) by label: a type counts once for each label."""
    rows = types.select("type_id", F.explode(F.array_distinct(F.transform("external", S.external_label))).alias("namespace"))
    return rows.where("namespace is not null").groupBy("namespace").agg(F.count("*").alias("types_touching"))


def integrations(dependencies: DataFrame) -> DataFrame:
    return dependencies.where(~S.is_plumbing(F.col("namespace")))


def plumbing_references(dependencies: DataFrame) -> DataFrame:
    return dependencies.where(S.is_plumbing(F.col("namespace"))).agg(F.coalesce(F.sum("types_touching"), F.lit(0)).alias("plumbing_references"))


def contact_points(classified: DataFrame) -> DataFrame:
    """(type_id, direction): boundaries that calls come in at, and that calls go out at."""
    return classified.where(F.col("kind").isin("ApiBoundary", "ExternalCall")).select("type_id", F.when(F.col("kind") == "ApiBoundary", "inbound").otherwise("outbound").alias("direction"))


def held_references(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(a, b, held): fields of a namespace's types that hold an abstraction of another namespace."""
    named = types.withColumn("ns", S.namespace_or_global(F.col("namespace")))
    targets = named.where(abstract_or_interface()).select(F.col("type_id").alias("to_type"))
    rows = ends_by(edges.where("fields > 0").join(targets, "to_type", "left_semi"), named, "ns").where("a <> b")
    return rows.groupBy("a", "b").agg(F.sum("fields").alias("held"))


def held_pairs(held: DataFrame) -> DataFrame:
    """(first, second, forward, back, siblings): namespaces that hold each other."""
    there, back = held.alias("x"), held.alias("y")
    found = there.join(back, (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).where("x.a < x.b")
    below = F.startswith(F.col("x.a"), F.concat(F.col("x.b"), F.lit("."))) | F.startswith(F.col("x.b"), F.concat(F.col("x.a"), F.lit(".")))
    return found.select(F.col("x.a").alias("first"), F.col("x.b").alias("second"), F.col("x.held").alias("forward"), F.col("y.held").alias("back"), (~below).alias("siblings"))


def first_member(found: DataFrame) -> DataFrame:
    """(first, members) of cycles. No two cycles share a member, so the first stands for one on the way; an id names all members, and on each row of a cycle it would grow with the square of the cycle."""
    return found.select(F.get("members", F.lit(0)).alias("first"), "members")


def pairs_within(found: DataFrame, held: DataFrame) -> DataFrame:
    """Held pairs of which both ends are members of one cycle, with ``cycle``, its first member."""
    each = first_member(found).select(F.col("first").alias("cycle"), F.explode("members").alias("ns"))
    ends = held_pairs(held).join(each.select("cycle", F.col("ns").alias("first")), "first").join(each.select(F.col("cycle").alias("same"), F.col("ns").alias("second")), "second")
    return ends.where("cycle = same").drop("same")


def cycle_shapes(found: DataFrame, types: DataFrame, held: DataFrame) -> DataFrame:
    """Namespace cycles with their projects, anchor, held pairs and shape."""
    each = first_member(found).select(F.col("first").alias("cycle"), F.explode("members").alias("ns"))
    of_ns = types.select(S.namespace_or_global(F.col("namespace")).alias("ns"), "project").distinct()
    spans = each.join(of_ns, "ns").groupBy("cycle").agg(F.array_sort(F.collect_set("project")).alias("projects"))
    counts = pairs_within(found, held).groupBy("cycle").agg(F.count("*").alias("mutual"), F.count_if("siblings").alias("siblings"))
    # a namespace that holds all others comes before them
    anchor = F.when(F.forall("members", lambda m: (m == F.col("cycle")) | F.startswith(m, F.concat("cycle", F.lit(".")))), F.col("cycle"))
    joined = found.withColumn("cycle", F.get("members", F.lit(0))).join(spans, "cycle", "left").join(counts, "cycle", "left").na.fill(0, ["mutual", "siblings"]).withColumn("anchor", anchor).drop("cycle")
    shape = F.when(F.col("siblings") > 0, "Coupling").when((F.size("projects") == 1) & F.col("anchor").isNotNull(), "FolderLayout").when(F.col("mutual") == 0, "SharedTypes").otherwise("Coupling")
    return joined.withColumn("shape", shape)


def tangle_edges(tangles: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges within a tangle, with ``tangle``, its first member."""
    each = first_member(tangles).select(F.col("first").alias("tangle"), F.explode("members").alias("type_id"))
    ends = edges.join(each.select(F.col("type_id").alias("from_type"), "tangle"), "from_type").join(each.select(F.col("type_id").alias("to_type"), F.col("tangle").alias("same")), "to_type")
    return ends.where("tangle = same").drop("same")


def with_id(rows: DataFrame, tangles: DataFrame) -> DataFrame:
    """rows with the tangle's ``id`` for ``tangle``: of results, of which a tangle has few."""
    ids = tangles.select(F.get("members", F.lit(0)).alias("tangle"), "id")
    return rows.join(ids, "tangle").select("id", *[c for c in rows.columns if c != "tangle"])


def tangle_kinds(inner: DataFrame, type_refs: DataFrame | None = None) -> DataFrame:
    """(tangle, kind, references) of the references within each tangle, as its edges count them; of type_refs, if these are given."""
    if type_refs is None:
        return inner.select("tangle", F.inline("counts")).groupBy("tangle", "kind").agg(F.sum("n").alias("references"))
    return type_refs.join(inner.select("tangle", "from_type", "to_type"), ["from_type", "to_type"]).groupBy("tangle", "kind").agg(F.count("*").alias("references"))


def heaviest_pairs(inner: DataFrame) -> DataFrame:
    """(tangle, first, second, weight): of each tangle the two types that refer to each other most (ties: names)."""
    pairs = inner.groupBy("tangle", F.least("from_type", "to_type").alias("first"), F.greatest("from_type", "to_type").alias("second")).agg(F.sum("weight").alias("weight"))
    best = pairs.groupBy("tangle").agg(F.min(F.struct((-F.col("weight")).alias("w"), "first", "second")).alias("p"))
    return best.select("tangle", "p.first", "p.second", (-F.col("p.w")).alias("weight"))


def project_links(members: DataFrame, types: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, a, b, weight, example_from, example_to): links between the projects of each cycle (columns node, component), with the heaviest edge of each."""
    across = ends_by(edges, types, "project").where("a <> b")
    within = across.join(members.select(F.col("node").alias("a"), "component"), "a").join(members.select(F.col("node").alias("b"), F.col("component").alias("same")), "b").where("component = same")
    grouped = within.groupBy("component", "a", "b").agg(F.sum("weight").alias("weight"), F.min(F.struct((-F.col("weight")).alias("w"), "from_type", "to_type")).alias("e"))
    return grouped.select("component", "a", "b", "weight", F.col("e.from_type").alias("example_from"), F.col("e.to_type").alias("example_to"))
