"""The detectors. Each nominates subjects with receipts (the numbers that decided) and qualifiers (what may be said).

A nomination is a wide frame: subject, type_id, the order keys o1 to o3 (ascending, then the subject), and a column for
each receipt and qualifier. ``findings`` turns nominations into one long frame. Participants are a frame of their own,
so a hub's callers are rows and not one value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..policy import Policy
from . import distribution as D
from . import metrics as M

# Kinds in the order in which they run.
KINDS = (
    "SpansArchitecturalLayers", "ConcealedDecisionMethod", "ConcealedDecisionType", "BugBlastRadius", "ChangeCost", "ReliedOnAndIntricate", "BreaksAlone",
    "HubOrGodObject", "SharedMutableState", "BoundaryCarriesLogic", "WidestContractSurface", "NoStaticReferences", "Coverage",
)
SIGNIFICANT = ("ApiBoundary", "DataAccess", "ExternalCall")
BOUNDARIES = ("ApiBoundary", "ExternalCall")
INF = float("inf")


@dataclass
class Nomination:
    kind: str
    frame: DataFrame
    receipts: tuple[tuple[str, str | None], ...]
    qualifiers: tuple[tuple[str, str | None], ...] = ()


def _nominate(kind: str, rows: DataFrame, subject: str, order: list[Column], receipts: dict[str, tuple[Column, str | None]], qualifiers: dict[str, tuple[Column, str | None]] | None = None) -> Nomination:
    qualifiers = qualifiers or {}
    keys = [o.cast("double") for o in order] + [F.lit(0.0)] * (3 - len(order))
    frame = rows.select(
        F.col(subject).alias("subject"),
        "type_id",
        *[k.alias(f"o{i + 1}") for i, k in enumerate(keys)],
        *[c.cast("double").alias(n) for n, (c, _) in receipts.items()],
        *[c.alias(n) for n, (c, _) in qualifiers.items()],
    )
    return Nomination(kind, frame, tuple((n, g) for n, (_, g) in receipts.items()), tuple((n, g) for n, (_, g) in qualifiers.items()))


def spans_layers(types: DataFrame, edges: DataFrame, p: Policy) -> Nomination:
    significant = types.where(F.col("kind").isin(*SIGNIFICANT)).select("type_id", "kind")
    reached = edges.join(significant.select(F.col("type_id").alias("to_type"), F.col("kind").alias("reached")), "to_type")
    # the pattern's key: own kind and the reached types as a set, summed as hashes so that no list is gathered
    h = F.xxhash64("reached", "to_type")
    outs = reached.groupBy(F.col("from_type").alias("type_id")).agg(
        F.collect_set("reached").alias("kinds"), F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(h, F.lit(7)).cast("decimal(38,0)")).alias("h2")
    )
    own = F.when(F.col("kind").isin(*SIGNIFICANT), F.col("kind"))
    joined = types.join(outs, "type_id", "left").withColumns({"own": own, "kinds": F.coalesce("kinds", F.array().cast("array<string>"))})
    span = F.size(F.array_distinct(F.array_compact(F.concat("kinds", F.array("own")))))
    spanning = joined.withColumns({"span": span, "through": F.size("kinds")}).where(F.col("span") >= p.min_kind_span)
    key = [F.coalesce("own", F.lit("-")).alias("k"), F.coalesce("n", F.lit(0)).alias("kn"), F.coalesce("h1", F.lit(0)).alias("k1"), F.coalesce("h2", F.lit(0)).alias("k2")]
    keyed = spanning.select("*", *key)
    found = keyed.join(keyed.groupBy("k", "kn", "k1", "k2").agg(F.count("*").alias("group_size")), ["k", "kn", "k1", "k2"])
    return _nominate(
        KINDS[0], found, "type_id", [F.col("group_size"), -F.col("fan_in")],
        {"KindSpan": (F.col("span"), "min_kind_span"), "KindsThroughDependencies": (F.col("through"), None), "PatternGroupSize": (F.col("group_size"), None), "FanIn": (F.col("fan_in"), None)},
        {"part_of_a_layering_pattern": (F.col("group_size") > p.roll_call_threshold, "roll_call_divisor")},
    )


def _extreme_order(times: str, absolute: str) -> list[Column]:
    """Measured ratios first, largest first; ratios against a median of 0 last, by the absolute value."""
    undefined = F.col(times) == INF
    return [undefined.cast("int"), F.when(undefined, 0.0).otherwise(-F.col(times)), -F.col(absolute)]


def concealed_method(types: DataFrame, members: DataFrame, p: Policy) -> Nomination:
    rows = members.where(M.is_method_like()).join(types.select("type_id", "cohort"), "type_id").select("member_id", "type_id", "cohort", "cyclomatic", F.col("dsm").alias("m_dsm"), "max_nesting", F.col("lines_of_code").alias("m_loc"))
    read = rows.join(D.readings(rows, ["cohort"], "cyclomatic"), ["cohort", "cyclomatic"])
    found = read.where((F.col("n") >= p.min_cohort) & (F.col("cyclomatic") >= p.min_decision_cc) & (F.col("times_median") >= p.outlier_factor) & (F.col("rank") <= p.concealed_top_rank))
    return _nominate(
        KINDS[1], found, "member_id", _extreme_order("times_median", "cyclomatic"),
        {
            "CohortSize": (F.col("n"), "min_cohort"), "Cyclomatic": (F.col("cyclomatic"), "min_decision_cc"), "CyclomaticXMedian": (F.col("times_median"), "outlier_factor"),
            "CyclomaticRank": (F.col("rank"), "concealed_top_rank"), "MedianCohortCyclomatic": (F.col("median"), None), "CyclomaticPctl": (F.col("percentile"), None),
            "Dsm": (F.col("m_dsm"), None), "MaxNestingDepth": (F.col("max_nesting"), None), "LinesOfCode": (F.col("m_loc"), None),
        },
    )


def concealed_type(types: DataFrame, p: Policy) -> Nomination:
    found = types.where(
        (F.col("cohort_size") >= p.min_cohort) & (F.col("max_cc") >= p.min_decision_cc) & (F.col("max_cc_times_median") >= p.outlier_factor)
        & (F.col("fan_in_times_median") <= p.concealed_fan_in_ceiling) & (F.col("fan_out_times_median") <= p.concealed_fan_out_ceiling)
    )
    return _nominate(
        KINDS[2], found, "type_id", _extreme_order("max_cc_times_median", "max_cc"),
        {
            "CohortSize": (F.col("cohort_size"), "min_cohort"), "MaxMemberCyclomatic": (F.col("max_cc"), "min_decision_cc"), "MaxMemberCyclomaticXMedian": (F.col("max_cc_times_median"), "outlier_factor"),
            "FanInXMedian": (F.col("fan_in_times_median"), "concealed_fan_in_ceiling"), "FanOutXMedian": (F.col("fan_out_times_median"), "concealed_fan_out_ceiling"),
            "MaxMemberCyclomaticPctl": (F.col("max_cc_percentile"), None), "FanIn": (F.col("fan_in"), None), "FanOut": (F.col("fan_out"), None), "Dsm": (F.col("dsm"), None),
        },
        {"low_absolute_connectivity": (F.col("fan_in") < p.min_fan_in, "min_fan_in")},
    )


def blast_radius(types: DataFrame, p: Policy) -> Nomination:
    limit = S.top_rank_limit(p.blast_top_fraction, F.col("cohort_size"))
    found = types.where(
        (F.col("cohort_size") >= p.min_cohort) & (F.col("fan_in") >= p.min_fan_in) & (F.col("fan_in_times_median") >= p.blast_fan_in_multiple)
        & (F.col("fan_in_rank") <= limit) & (F.col("cyclomatic_percentile") >= p.blast_complexity_percentile)
    )
    return _nominate(
        KINDS[3], found, "type_id", [-F.col("fan_in")],
        {
            "CohortSize": (F.col("cohort_size"), "min_cohort"), "FanIn": (F.col("fan_in"), "min_fan_in"), "FanInXMedian": (F.col("fan_in_times_median"), "blast_fan_in_multiple"),
            "FanInRank": (F.col("fan_in_rank"), "blast_top_fraction"), "CyclomaticPctl": (F.col("cyclomatic_percentile"), "blast_complexity_percentile"), "FanInTopRankLimit": (limit, None),
            "FanInPctl": (F.col("fan_in_percentile"), None), "Cyclomatic": (F.col("cyclomatic"), None), "FanOut": (F.col("fan_out"), None), "InboundReferenceCount": (F.col("inbound_references"), None),
        },
    )


def change_cost(types: DataFrame, p: Policy) -> Nomination:
    limit = S.top_rank_limit(p.change_cost_top_fraction, F.col("all_fan_in_n"))
    found = types.where(F.col("kind").isin("Contract", "ApiBoundary") & (F.col("fan_in") >= p.min_fan_in) & (F.col("all_fan_in_n") >= 2) & (F.col("all_fan_in_rank") <= limit))
    return _nominate(
        KINDS[4], found, "type_id", [-F.col("fan_in")],
        {
            "FanIn": (F.col("fan_in"), "min_fan_in"), "FanInSolutionRank": (F.col("all_fan_in_rank"), "change_cost_top_fraction"), "FanInSolutionRankLimit": (limit, None),
            "FanInSolutionPctl": (F.col("all_fan_in_percentile"), None), "SolutionTypeCount": (F.col("all_fan_in_n"), None), "DataShape": (F.col("data_shape"), None), "InboundReferenceCount": (F.col("inbound_references"), None),
        },
    )


def relied_on(types: DataFrame, p: Policy) -> Nomination:
    found = types.where((F.col("instability") <= p.stable_threshold) & (F.col("fan_in") >= p.min_fan_in) & (F.col("max_cc") >= p.high_cc))
    return _nominate(
        KINDS[5], found, "type_id", [F.col("instability"), -F.col("fan_in")],
        {
            "Instability": (F.col("instability"), "stable_threshold"), "FanIn": (F.col("fan_in"), "min_fan_in"), "MaxMemberCyclomatic": (F.col("max_cc"), "high_cc"),
            "EffectiveFanOut": (F.col("effective_fan_out"), None), "FanOut": (F.col("fan_out"), None), "InstabilityRaw": (F.col("instability_raw"), None), "Cyclomatic": (F.col("cyclomatic"), None),
        },
    )


def breaks_alone(types: DataFrame, p: Policy) -> Nomination:
    found = types.where((F.col("instability") >= p.isolated_threshold) & (F.col("max_cc") >= p.high_cc))
    return _nominate(
        KINDS[6], found, "type_id", [-F.col("max_cc")],
        {
            "Instability": (F.col("instability"), "isolated_threshold"), "MaxMemberCyclomatic": (F.col("max_cc"), "high_cc"), "FanIn": (F.col("fan_in"), None),
            "FanOut": (F.col("fan_out"), None), "EffectiveFanOut": (F.col("effective_fan_out"), None),
        },
    )


def hub(types: DataFrame, p: Policy) -> Nomination:
    coupling = F.least("fan_in", "fan_out")
    return _nominate(
        KINDS[7], types.where(coupling >= p.hub_min), "type_id", [-coupling],
        {
            "FanIn": (F.col("fan_in"), "hub_min"), "FanOut": (F.col("fan_out"), "hub_min"), "Coupling": (coupling, None), "MemberCount": (F.col("member_count"), None),
            "MaxMemberCyclomatic": (F.col("max_cc"), None), "Dsm": (F.col("dsm"), None), "Instability": (F.col("instability"), None),
        },
        {"carries_real_logic": (F.col("max_cc") >= p.high_cc, "high_cc"), "too_large_to_hold": (F.col("member_count") >= p.god_object_members, "god_object_members")},
    )


def shared_state(types: DataFrame, p: Policy) -> Nomination:
    found = types.where("static_mutations > 0")
    return _nominate(KINDS[8], found, "type_id", [-F.col("static_mutations")], {"StaticMutations": (F.col("static_mutations"), None), "FanIn": (F.col("fan_in"), None)})


def _boundaries(types: DataFrame, value: str) -> DataFrame:
    rows = types.where(F.col("kind").isin(*BOUNDARIES)).withColumn("whole", F.lit(1))
    return rows.join(D.readings(rows, ["whole"], value), ["whole", value])


def boundary_logic(types: DataFrame, p: Policy) -> Nomination:
    limit = S.top_rank_limit(p.boundary_top_fraction, F.col("n"))
    found = _boundaries(types, "max_cc").where((F.col("max_cc") >= p.high_cc) & (F.col("rank") <= limit))
    return _nominate(
        KINDS[9], found, "type_id", [-F.col("max_cc")],
        {
            "MaxMemberCyclomatic": (F.col("max_cc"), "high_cc"), "MaxMemberCyclomaticRank": (F.col("rank"), "boundary_top_fraction"), "BoundaryTopRankLimit": (limit, None), "BoundaryCount": (F.col("n"), None),
            "MedianBoundaryCyclomatic": (F.col("median"), None), "DataShape": (F.col("data_shape"), None), "FanIn": (F.col("fan_in"), None), "FanOut": (F.col("fan_out"), None),
        },
    )


def widest_surface(types: DataFrame, p: Policy) -> Nomination:
    threshold = F.greatest(F.col("median") * p.surface_outlier_multiple, F.lit(p.surface_outlier_floor))
    found = _boundaries(types, "data_shape").where(F.col("data_shape") >= threshold)
    return _nominate(
        KINDS[10], found, "type_id", [-F.col("data_shape")],
        {
            "DataShape": (F.col("data_shape"), "surface_outlier_multiple"), "SurfaceThreshold": (threshold, None), "MedianBoundarySurface": (F.col("median"), None),
            "BoundaryCount": (F.col("n"), None), "PublicMemberCount": (F.col("public_member_count"), None),
        },
    )


def considered(members: DataFrame, member_refs: DataFrame) -> DataFrame:
    """Members that nothing refers to, with why each is left out, if it is."""
    constructible = (F.col("kind") == "Constructor") & ~F.col("is_static") & (F.col("accessibility") != "Private")
    counts = members.groupBy("type_id").agg(F.count_if(constructible).alias("constructors"), F.count("*").alias("type_members"), F.count_if(M.is_data()).alias("type_data"))
    rows = members.join(member_refs.select(F.col("to_member").alias("member_id")), "member_id", "left_anti").join(counts, "type_id")
    runtime = F.col("is_entry_point") | ((F.col("kind") == "Constructor") & F.col("is_static"))
    sole = constructible & (F.col("constructors") == 1)
    why = (
        F.when(runtime, "invoked by the runtime")
        .when(F.col("implements_interface"), "implements an interface")
        .when(F.col("is_override"), "overrides a base member")
        .when(F.col("is_externally_visible"), "externally visible")
        .when(sole, "the type's only accessible constructor")
    )
    return rows.withColumns({"runtime": runtime, "sole": sole, "excluded": why})


def exclusions(rows: DataFrame) -> DataFrame:
    """How many of the considered members each reason applies to (reasons overlap), and how many are excluded."""
    flags = {"runtime_invoked": "runtime", "implements_interface": "implements_interface", "overrides": "is_override", "externally_visible": "is_externally_visible", "sole_constructors": "sole"}
    counts = [F.count_if(F.col(c)).alias(n) for n, c in flags.items()]
    return rows.agg(*counts, F.count("*").alias("considered"), F.count("excluded").alias("excluded"))


def no_references(rows: DataFrame, types: DataFrame, p: Policy, tests_unseen: bool = False) -> Nomination:
    kept = rows.where(F.col("excluded").isNull()).drop("static_mutations")
    unread = kept.where(M.is_data()).groupBy("type_id").agg(F.count("*").alias("unread"))
    joined = kept.join(unread, "type_id", "left").na.fill(0, ["unread"]).join(types.select("type_id", "inbound_references"), "type_id")
    return _nominate(
        KINDS[11], joined, "member_id", [-F.col("lines_of_code")],
        {
            "InboundReferences": (F.lit(0), None), "DeclaringTypeInboundReferences": (F.col("inbound_references"), None), "DeclaringTypeMembers": (F.col("type_members"), None),
            "DeclaringTypeDataMembers": (F.col("type_data"), None), "UnreadDataMembersInType": (F.col("unread"), None),
        },
        {"test_usage_unobservable": (F.lit(tests_unseen), None), "part_of_an_unread_group": (M.is_data() & (F.col("unread") > 1), None), "an_attribute_may_direct_it": (F.col("has_attributes"), None)},
    )


def no_peer_group(types: DataFrame, p: Policy) -> Nomination:
    some = F.col("all_fan_in_n") >= 2
    fan_in, worst = F.when(some, F.col("all_fan_in_percentile")), F.when(some, F.col("all_max_cc_percentile"))
    extreme_in = F.coalesce(fan_in >= p.global_fan_in_percentile, F.lit(False))
    extreme_cc = F.coalesce(worst >= p.global_complexity_percentile, F.lit(False)) & (F.col("max_cc") > p.global_complexity_floor)
    return _nominate(
        KINDS[12], types.where(F.col("cohort_size") < p.min_cohort), "type_id", [F.when(extreme_in | extreme_cc, 0).otherwise(1), -F.col("fan_in")],
        {
            "CohortSize": (F.col("cohort_size"), "min_cohort"), "GlobalFanInPctl": (fan_in, None), "GlobalMaxCcPctl": (worst, None), "FanIn": (F.col("fan_in"), None),
            "MaxMemberCyclomatic": (F.col("max_cc"), None), "GlobalComplexityFloor": (F.lit(p.global_complexity_floor), None), "SolutionTypeCount": (F.col("all_fan_in_n"), None),
        },
        {"globally_extreme_fan_in": (extreme_in, "global_fan_in_percentile"), "globally_extreme_complexity": (extreme_cc, "global_complexity_percentile")},
    )


def findings(nominations: list[Nomination]) -> DataFrame:
    """All nominations, long: key, kind, place of the kind, subject, type, order keys, receipts and qualifiers with their gates."""
    frames = []
    for n in nominations:
        receipts = [F.struct(F.lit(name).alias("name"), S.finite(F.col(name)).alias("value"), F.lit(gate).cast("string").alias("gate")) for name, gate in n.receipts]
        qualifiers = [F.struct(F.lit(name).alias("name"), F.col(name).alias("holds"), F.lit(gate).cast("string").alias("gate")) for name, gate in n.qualifiers]
        empty = F.array().cast("array<struct<name:string,holds:boolean,gate:string>>")
        frames.append(
            n.frame.select(
                F.concat(F.lit(f"{n.kind}|"), "subject").alias("finding_key"), F.lit(n.kind).alias("kind"), F.lit(KINDS.index(n.kind)).alias("place"), "subject", "type_id", "o1", "o2", "o3",
                F.array(*receipts).alias("receipts"), (F.array(*qualifiers) if qualifiers else empty).alias("qualifiers"),
            )
        )
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repeated_keys(found: DataFrame) -> DataFrame:
    """Keys that occur more than once: an error to the caller."""
    return found.groupBy("finding_key").agg(F.count("*").alias("n")).where("n > 1")
