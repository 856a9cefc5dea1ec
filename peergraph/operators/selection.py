"""What a reader is shown first: exemplars, leading facts, points of the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("o1", "o2", "o3", "subject")
SPANS = "SpansArchitecturalLayers"
# Kinds that a fixed count selects.
FIXED_GATES = ("HubOrGodObject", "BreaksAlone")


def top_by_kind(found: DataFrame, n: int) -> DataFrame:
    """The first n findings of each kind with ``shown`` (place) and ``total``: how many the kind has."""
    w = W.partitionBy("kind").orderBy(*ORDER)
    totals = found.groupBy("kind").agg(F.count("*").alias("total"))
    return found.withColumn("shown", F.row_number().over(w)).where(F.col("shown") <= n).join(totals, "kind")


def exemplars(found: DataFrame) -> DataFrame:
    """(kind, subject, total): the first finding of each kind, rarest kind first (``place``)."""
    first = found.groupBy("kind").agg(F.count("*").alias("total"), F.min(F.struct(*ORDER)).alias("f"))
    return first.select("kind", F.col("f.subject").alias("subject"), "total", F.row_number().over(W.orderBy("total", "kind")).alias("place"))


def lead(found: DataFrame) -> DataFrame:
    """Exemplars of the kinds that are risks."""
    return exemplars(found.where("kind <> 'Coverage'"))


def named_types(found: DataFrame) -> DataFrame:
    """Types that any risk is about, directly or through a member."""
    return found.where("kind <> 'Coverage'").select("type_id").distinct()


def _argmax(types: DataFrame, value: str) -> DataFrame:
    best = types.where(F.col(value) > 0).agg(F.min(F.struct((-F.col(value)).alias("v"), "type_id")).alias("b"))
    return best.where("b is not null").select(F.col("b.type_id").alias("type_id"), (-F.col("b.v")).alias(value))


def widest_reach(types: DataFrame) -> DataFrame:
    return _argmax(types, "fan_in")


def most_intricate(types: DataFrame) -> DataFrame:
    return _argmax(types, "max_cc")


def clean_share(types: DataFrame, named: DataFrame) -> DataFrame:
    """Percent of types that no risk names, rounded half to even."""
    flagged = types.select("type_id").join(named.withColumn("named", F.lit(1)), "type_id", "left")
    return flagged.agg(F.bround(F.try_divide(100.0 * F.count_if(F.col("named").isNull()), F.count("*").cast("double"))).cast("bigint").alias("clean_percent"))


def flagged_projects(types: DataFrame, named: DataFrame) -> DataFrame:
    """(project, types, named)."""
    marked = types.select("type_id", "project").join(named.withColumn("hit", F.lit(1)), "type_id", "left")
    return marked.groupBy("project").agg(F.count("*").alias("types"), F.count("hit").alias("named"))


def _with_totals(by_project: DataFrame) -> DataFrame:
    totals = by_project.agg(F.sum("types").alias("all_types"), F.sum("named").alias("all_named"))
    one = F.lit(1).alias("one")
    return by_project.select("*", one).join(F.broadcast(totals.select("*", one)), "one").drop("one")  # an aggregate: one row


def concentration(by_project: DataFrame) -> DataFrame:
    """The project with most findings above its share of the types, and how many times its share that is."""
    expected = F.col("all_named") * F.try_divide(F.col("types").cast("double"), F.col("all_types").cast("double"))
    rows = _with_totals(by_project).withColumn("expected", expected)
    best = rows.orderBy(F.desc(F.col("named") - F.col("expected")), "project").limit(1)
    return best.where("named > 0 and expected > 0").select("project", (F.col("named") / F.col("expected")).alias("times_share"))


def plot_points(by_project: DataFrame, coupled: DataFrame) -> DataFrame:
    """(project, types, named, dependents, reach, density)."""
    rows = _with_totals(by_project).join(coupled.select("project", F.col("ca").alias("dependents")), "project")
    outside = F.col("all_types") - F.col("types")
    reach = F.when(outside > 0, F.try_divide(100.0 * F.col("dependents"), outside.cast("double"))).otherwise(0.0)
    return rows.select("project", "types", "named", "dependents", reach.alias("reach"), F.try_divide(100.0 * F.col("named"), F.col("types").cast("double")).alias("density"))


def plot_bound(value: Column) -> Column:
    """The axis end: the next ten, at least ten."""
    return F.greatest(F.lit(10.0), F.ceil(value / 10.0) * 10.0)


def plot_step(bound: Column) -> Column:
    return F.greatest(F.lit(5.0), bound / 5.0)


def foundation(coupled: DataFrame, by_project: DataFrame) -> DataFrame:
    """The project that most types elsewhere depend on, and what share of its own is flagged."""
    top = coupled.where("ca > 0").orderBy(F.desc("ca"), "project").limit(1)
    share = F.bround(100.0 * F.col("named") / F.col("types")).cast("bigint")
    return top.join(by_project, "project").select("project", "ca", "types", "named", share.alias("flagged_percent"))


def carriers(unread: DataFrame, types: DataFrame) -> DataFrame:
    """(type_id, name, unread, total): types by the share of their data members that nothing reads."""
    rows = unread.where("part_of_an_unread_group").groupBy("type_id").agg(F.count("*").alias("unread"), F.max("DeclaringTypeDataMembers").cast("bigint").alias("total"))
    return rows.where("total > 0").join(types.select("type_id", "name"), "type_id")


def diagram_rows(layered: DataFrame, most: int = 5) -> DataFrame:
    """Boxes in rows of at most ``most``: (projects, layer, row, place)."""
    w = W.partitionBy("layer").orderBy("projects")
    at = F.row_number().over(w) - 1
    return layered.select("projects", "layer", F.floor(at / most).alias("row"), (at % most).alias("place"))


def drill_down(found: DataFrame, types: DataFrame, n: int) -> DataFrame:
    """Types that a shown finding is about."""
    return types.join(top_by_kind(found, n).select("type_id"), "type_id", "left_semi")


def fixed_gate_shares(found: DataFrame, types: DataFrame) -> DataFrame:
    """(kind, found, types, percent) of the kinds whose gate is a fixed count and no share: the percentage is of this code alone."""
    one = F.lit(1).alias("one")
    counts = found.where(F.col("kind").isin(*FIXED_GATES)).groupBy("kind").agg(F.count("*").alias("found")).select("*", one)
    joined = counts.join(F.broadcast(types.agg(F.count("*").alias("types")).select("*", one)), "one").drop("one")  # an aggregate: one row
    return joined.withColumn("percent", 100.0 * F.col("found") / F.col("types"))


def layering_patterns(found: DataFrame, participants: DataFrame, types: DataFrame, named: int = 4) -> DataFrame:
    """(signature, types, names) of the types that span layers as many others do: by the kinds that they reach, with the first names."""
    common = F.exists("qualifiers", lambda q: (q.name == "part_of_a_layering_pattern") & q.holds)
    spanning = found.where((F.col("kind") == SPANS) & common).select("subject", "type_id")
    kinds = participants.where(F.col("kind") == SPANS).select("subject", F.col("participant").alias("type_id")).join(types.select("type_id", F.col("kind").alias("reached")), "type_id")
    signatures = kinds.join(spanning.select("subject"), "subject", "left_semi").groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("reached")), "+").alias("signature"))
    rows = spanning.join(signatures, "subject", "left").na.fill("", ["signature"]).join(types.select("type_id", "name"), "type_id")
    first = rows.withColumn("at", F.row_number().over(W.partitionBy("signature").orderBy("name", "type_id"))).where(F.col("at") <= named)
    names = first.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    return rows.groupBy("signature").agg(F.count("*").alias("types")).join(names, "signature")


def without_peers(found: DataFrame) -> DataFrame:
    """One row: types without a usable peer group, those extreme in the whole, and those that another finding is about all the same."""
    lone = found.where("kind = 'Coverage'").select("subject", F.exists("qualifiers", lambda q: q.holds).alias("extreme"))
    others = found.where("kind <> 'Coverage'").select("subject").distinct().withColumn("named", F.lit(True))
    return lone.join(others, "subject", "left").agg(F.count("*").alias("types"), F.count_if("extreme").alias("extreme"), F.count("named").alias("also_named"))


def named_ink(types: DataFrame, named: DataFrame) -> DataFrame:
    """One row: types, how many of them a risk names, and the percent of all lines that these hold (which the mosaic's tint covers)."""
    marked = types.select("type_id", "lines_of_code").join(named.withColumn("hit", F.lit(1)), "type_id", "left")
    inked = F.sum(F.when(F.col("hit").isNotNull(), F.col("lines_of_code")).otherwise(0))
    return marked.agg(F.count("*").alias("types"), F.count("hit").alias("named"), F.try_divide(100.0 * inked, F.sum("lines_of_code").cast("double")).alias("ink_percent"))


def line_shares(types: DataFrame) -> DataFrame:
    """(type_id, project, percent): each type's share of its project's lines, null where the project has none."""
    whole = types.groupBy("project").agg(F.sum("lines_of_code").alias("project_lines"))
    share = F.try_divide(100.0 * F.col("lines_of_code"), F.col("project_lines").cast("double"))
    return types.select("type_id", "project", "lines_of_code").join(whole, "project").select("type_id", "project", share.alias("percent"))


def depth_and_width(groups: DataFrame) -> DataFrame:
    """One row: how many layers, the highest layer, and the boxes of the widest one."""
    boxes = groups.groupBy("layer").agg(F.count("*").alias("boxes"))
    return boxes.agg((F.max("layer") + 1).alias("depth"), F.max("layer").alias("top_layer"), F.max("boxes").alias("widest_layer"))
