"""The whole analysis as lazy DataFrames over one set of facts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import classify as C
from ..operators import cohorts as H
from ..operators import detectors as N
from ..operators import distribution as D
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import projects as P
from ..operators import selection as V
from ..operators import suppression as X
from ..policy import Policy
from ..session import cut

COHORT_METRICS = ("fan_in", "fan_out", "cyclomatic", "max_cc", "dsm", "data_shape")
GLOBAL_METRICS = ("fan_in", "max_cc")


class Model:
    """Facts in (projects, types, members, type_refs, member_refs, and where known left_out), every later table as an attribute.

    Tables that several others read are cut (checkpointed), so each is computed once and survives lost executors.
    """

    def __init__(self, facts: dict[str, DataFrame], policy: Policy | None = None) -> None:
        self.policy = policy or Policy()
        self.projects, self.types, self.members = (facts[k] for k in ("projects", "types", "members"))
        self.type_refs, self.member_refs = facts["type_refs"], facts["member_refs"]
        self.left_out = facts.get("left_out")

    @cached_property
    def all_edges(self) -> DataFrame:
        return cut(M.edges(self.type_refs))

    @cached_property
    def edges(self) -> DataFrame:
        return M.declared(self.all_edges, self.types)

    @cached_property
    def classified(self) -> DataFrame:
        return cut(M.with_instability(C.classify(M.with_metrics(self.types, self.members, self.all_edges)), self.all_edges))

    @cached_property
    def assigned(self) -> DataFrame:
        return H.cohorts(self.classified, self.policy.cohort_basis_floor)

    @cached_property
    def full(self) -> DataFrame:
        """Types with metrics, cohort, readings in the cohort and in the whole, and the exported statistics."""
        peers = self.classified.join(self.assigned, "type_id")
        own = D.read_all(peers, "type_id", "cohort", COHORT_METRICS)
        rows = D.stacked(peers.withColumn("whole", F.lit("all")), "type_id", "whole", GLOBAL_METRICS)
        found = rows.join(D.readings(rows, ["metric"], "value"), ["metric", "value"])
        world = found.groupBy("type_id").agg(*[F.max(F.when(F.col("metric") == m, F.col(w))).alias(f"all_{m}_{w}") for m in GLOBAL_METRICS for w in ("percentile", "rank", "n")])
        joined = peers.join(own, "type_id").join(world, "type_id")
        comparable = F.col("cohort_size") >= self.policy.min_cohort
        stats = {f"stat_{m}_percentile": F.when(comparable, F.col(f"{m}_percentile")) for m in COHORT_METRICS}
        stats |= {f"stat_{m}_times_median": F.when(comparable, S.finite(F.col(f"{m}_times_median"))) for m in COHORT_METRICS if m != "data_shape"}
        return cut(joined.withColumns(stats))

    @cached_property
    def considered(self) -> DataFrame:
        return cut(N.considered(self.members, self.member_refs))

    def nomination(self, kind: str) -> N.Nomination:
        """One detector's nominations; nothing that only others need is computed."""
        t, p = self.full, self.policy
        makers = {
            "SpansArchitecturalLayers": lambda: N.spans_layers(t, self.all_edges, p),
            "ConcealedDecisionMethod": lambda: N.concealed_method(t, self.members, p),
            "NoStaticReferences": lambda: N.no_references(self.considered, t, p),
        }
        by_type = (N.concealed_type, N.blast_radius, N.change_cost, N.relied_on, N.breaks_alone, N.hub, N.shared_state, N.boundary_logic, N.widest_surface, N.no_peer_group)
        rest = [k for k in N.KINDS if k not in makers]
        return makers[kind]() if kind in makers else by_type[rest.index(kind)](t, p)

    @cached_property
    def nominations(self) -> dict[str, N.Nomination]:
        return {kind: self.nomination(kind) for kind in N.KINDS}

    @cached_property
    def detected(self) -> DataFrame:
        return cut(N.findings(list(self.nominations.values())))

    @cached_property
    def judged(self) -> DataFrame:
        return cut(X.judged(self.detected, self.full, self.policy))

    @cached_property
    def findings(self) -> DataFrame:
        return X.kept(self.judged)

    @cached_property
    def participants(self) -> DataFrame:
        """(kind, subject, participant): who a finding is about besides its subject."""
        pairs = self.edges.select(F.col("to_type").alias("subject"), F.col("from_type").alias("participant"))
        callers = self.detected.where(F.col("kind").isin("BugBlastRadius", "ChangeCost")).select("kind", "subject").join(pairs, "subject")
        worst_of = ("ConcealedDecisionType", "ReliedOnAndIntricate", "BreaksAlone", "HubOrGodObject", "BoundaryCarriesLogic", "Coverage")
        worst = self.detected.where(F.col("kind").isin(*worst_of)).select("kind", "subject").join(self.full.select(F.col("type_id").alias("subject"), F.col("most_complex_member").alias("participant")), "subject").where("participant is not null")
        writers = self.members.where("static_mutations > 0").select(F.col("type_id").alias("subject"), F.col("member_id").alias("participant"))
        state = self.detected.where("kind = 'SharedMutableState'").select("kind", "subject").join(writers, "subject")
        significant = self.full.where(F.col("kind").isin(*N.SIGNIFICANT)).select(F.col("type_id").alias("participant"))
        reached = self.all_edges.select(F.col("from_type").alias("subject"), F.col("to_type").alias("participant")).join(significant, "participant", "left_semi")
        spans = self.detected.where("kind = 'SpansArchitecturalLayers'").select("kind", "subject").join(reached, "subject")
        columns = ("kind", "subject", "participant")
        return callers.select(*columns).unionByName(worst.select(*columns)).unionByName(state.select(*columns)).unionByName(spans.select(*columns))

    @cached_property
    def couplings(self) -> DataFrame:
        return cut(P.couplings(self.types, self.edges))

    @cached_property
    def project_edges(self) -> DataFrame:
        return P.ends_by(self.edges, self.types, "project").where("a <> b").select("a", "b").distinct()

    @cached_property
    def namespace_edges(self) -> DataFrame:
        named = self.types.withColumn("ns", S.namespace_or_global(F.col("namespace")))
        return P.ends_by(self.edges, named, "ns").where("a <> b").select("a", "b").distinct()

    @cached_property
    def type_edges(self) -> DataFrame:
        return self.edges.select(F.col("from_type").alias("a"), F.col("to_type").alias("b"))

    @cached_property
    def namespace_cycles(self) -> DataFrame:
        found = G.cycles(self.namespace_edges, "namespace")
        return cut(P.cycle_shapes(found, self.types, P.held_references(self.edges, self.types)))

    @cached_property
    def project_cycles(self) -> DataFrame:
        return cut(G.cycles(self.project_edges, "project"))

    @cached_property
    def tangles(self) -> DataFrame:
        return cut(G.cycles(self.type_edges, "", self.policy.min_tangle))

    @cached_property
    def tangle_shapes(self) -> DataFrame:
        """Tangles with ``shape``: does a cycle remain without the edges that inheritance explains?"""
        inner = cut(P.tangle_edges(self.tangles, self.edges))
        chosen = inner.where(~F.arrays_overlap("kinds", F.array(F.lit(1), F.lit(2))))
        loops = G.strongly_connected(chosen.select(F.col("from_type").alias("a"), F.col("to_type").alias("b")), 2)
        of = P.first_member(self.tangles).select("first", F.explode("members").alias("node"))
        tangled = of.join(loops, "node").select("first").distinct().withColumn("left", F.lit(True))
        first = self.tangles.withColumn("first", F.get("members", F.lit(0)))
        return first.join(tangled, "first", "left").withColumn("shape", F.when(F.col("left"), "Entangled").otherwise("Hierarchy")).drop("first", "left")

    @cached_property
    def project_layers(self) -> DataFrame:
        return cut(G.layers(self.project_edges, self.types.select(F.col("project").alias("node"))))

    @cached_property
    def project_groups(self) -> DataFrame:
        return G.fold(self.project_layers, self.project_edges)

    @cached_property
    def dependencies(self) -> DataFrame:
        return P.external_dependencies(self.types)

    @cached_property
    def by_project(self) -> DataFrame:
        return V.flagged_projects(self.types, V.named_types(self.findings))

    @cached_property
    def not_analysed(self) -> DataFrame:
        """(what, name, count): what the facts leave out, then what they refer to without declaring it."""
        columns = ("what", "name", F.col("count").cast("long").alias("count"))
        nameless = F.lit(None).cast("string").alias("name")
        edges = M.dangling(self.all_edges, self.types).agg(F.count("*").alias("count")).select(F.lit("edge to an undeclared type").alias("what"), nameless, "count")
        refs = M.dangling_member_refs(self.member_refs, self.members).select(F.lit("reference to an undeclared member").alias("what"), nameless, F.col("dangling_references").alias("count"))
        empty = P.unmeasured(self.projects, self.types).select(F.lit("project without an analysed type").alias("what"), F.col("project").alias("name"), F.lit(1).alias("count"))
        found = edges.select(*columns).unionByName(refs.select(*columns)).unionByName(empty.select(*columns))
        return found if self.left_out is None else self.left_out.select(*columns).unionByName(found)
