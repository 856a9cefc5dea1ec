"""A text report and drawings of an analysis. Only what is shown is collected: capped findings and one row a project."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from html import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import EDGE_KINDS
from ..operators import projects as P
from ..operators import selection as V
from ..operators.detectors import KINDS
from . import drawing
from .model import Model

# How many of each are listed in a line or section.
NAMESPACES, PAIRS, LINKS, KINDS_SHOWN, TYPES, PROJECTS, LISTED = 6, 6, 6, 3, 8, 4, 10
ZONES = {"Pain": "; zone of pain: much rests on it and little of it is abstract", "Uselessness": "; zone of uselessness: abstract and unused", "NearMainSequence": "; near the main sequence"}


def number(x: float | None) -> str:
    """At most two decimals; a missing value has no number."""
    return "undefined" if x is None else f"{round(x, 2):g}"


def plural(n: float, one: str, many: str | None = None) -> str:
    return f"{int(n):,} {one if n == 1 else many or one + 's'}"


#: What each kind's row says, from its receipts and the qualifiers that hold.
CLAIMS: dict[str, Callable[[dict, set], str]] = {
    "SpansArchitecturalLayers": lambda r, q: f"reaches {number(r['KindSpan'])} kinds of layer" + (f", as {plural(r['PatternGroupSize'] - 1, 'other')} of the same pattern do" if "part_of_a_layering_pattern" in q else ""),
    "ConcealedDecisionMethod": lambda r, q: f"complexity {number(r['Cyclomatic'])} where the median of {plural(r['CohortSize'], 'peer method')} is {number(r['MedianCohortCyclomatic'])}",
    "ConcealedDecisionType": lambda r, q: ("looks unimportant, yet is " if "low_absolute_connectivity" in q else "is as connected as its peers, yet ") + (f"{number(r['MaxMemberCyclomaticXMedian'])} times as complex as their median" if r["MaxMemberCyclomaticXMedian"] is not None else "the only complex one among them"),
    "BugBlastRadius": lambda r, q: f"{plural(r['FanIn'], 'caller')}, complexity {number(r['Cyclomatic'])}: a bug here reaches far",
    "ChangeCost": lambda r, q: f"{plural(r['FanIn'], 'caller')} of a contract of {plural(r['DataShape'], 'field')}: a change here is a change there; callers outside aren't seen",
    "ReliedOnAndIntricate": lambda r, q: f"{plural(r['FanIn'], 'type')} rest on it, it rests on {plural(r['EffectiveFanOut'], 'concrete type')}, and a member has complexity {number(r['MaxMemberCyclomatic'])}",
    "BreaksAlone": lambda r, q: f"complexity {number(r['MaxMemberCyclomatic'])}, but only {plural(r['FanIn'], 'type')} would notice if it broke",
    "HubOrGodObject": lambda r, q: f"{number(r['FanIn'])} in, {number(r['FanOut'])} out" + (", and carries logic" if "carries_real_logic" in q else ", mostly wiring") + (", too large to hold in mind" if "too_large_to_hold" in q else ""),
    "SharedMutableState": lambda r, q: f"{plural(r['StaticMutations'], 'write')} to static state, {plural(r['FanIn'], 'type')} can reach it",
    "BoundaryCarriesLogic": lambda r, q: f"complexity {number(r['MaxMemberCyclomatic'])} at the edge, where the median is {number(r['MedianBoundaryCyclomatic'])}",
    "WidestContractSurface": lambda r, q: f"{plural(r['DataShape'], 'field')}, from {number(r['SurfaceThreshold'])} up is wide here",
    "NoStaticReferences": lambda r, q: "nothing refers to it" + (", as to others of its type's data" if "part_of_an_unread_group" in q else "") + (", but an attribute may direct it" if "an_attribute_may_direct_it" in q else "") + "; verify before deleting",
    "Coverage": lambda r, q: f"{plural(r['CohortSize'], 'peer')}: too few to compare" + (", yet extreme in the whole" if q else ""),
}


class Profile:
    """Seconds by stage; what no stage measured is a row of its own."""

    def __init__(self) -> None:
        self.began, self.stages = time.perf_counter(), {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        at = time.perf_counter()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - at

    def rows(self) -> list[tuple[str, float]]:
        total = time.perf_counter() - self.began
        return [*self.stages.items(), ("unmeasured", max(0.0, total - sum(self.stages.values()))), ("total", total)]


def sections(model: Model, top: int | None = None) -> dict[str, tuple[int, list[str]]]:
    """For each kind that has findings, how many and the lines of the first ``top``."""
    shown = V.top_by_kind(model.findings, top or model.policy.top).orderBy("place", "shown").collect()
    out: dict[str, tuple[int, list[str]]] = {}
    for f in shown:
        receipts, holds = {r.name: r.value for r in f.receipts}, {q.name for q in f.qualifiers if q.holds}
        out.setdefault(f.kind, (f.total, []))[1].append(f"{f.subject.split('|', 2)[-1]}: {CLAIMS[f.kind](receipts, holds)}")
    return out


def some(names: list[str], most: int, between: str = ", ") -> str:
    """The first names, and of how many they are where some are left out."""
    shown = between.join(names[:most])
    return shown if len(names) <= most else f"{shown} ({most} of {len(names)} shown)"


def short(subject: str) -> str:
    """A subject without its kind and assembly."""
    return subject.split("|", 2)[-1]


def capped(frame: DataFrame, most: int, noun: str, *order: Column | str) -> tuple[list, list[str]]:
    """The first rows in order, and a line that says how many there are beyond them."""
    rows = frame.orderBy(*order).limit(most).collect()
    total = frame.count() if len(rows) == most else len(rows)
    return rows, [f"{total - len(rows):,} not shown of {plural(total, noun)}"] if total > len(rows) else []


def coverage(model: Model) -> list[str]:
    """What was not analysed: what the facts leave out, and what they refer to without declaring it."""
    counts = model.not_analysed.groupBy("what").agg(F.sum("count").alias("n")).orderBy("what").collect()
    w = W.partitionBy("what").orderBy("name")
    named = model.not_analysed.where("name is not null").withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= LISTED).orderBy("what", "name").collect()
    names: dict[str, list[str]] = {}
    for r in named:
        names.setdefault(r.what, []).append(r.name)
    return [f"{r.what}: " + (f"{r.n:,}" if r.n else "none") + (f" ({', '.join(names[r.what])}{', ...' if r.n > len(names[r.what]) else ''})" if r.what in names else "") for r in counts]


def peerless(model: Model) -> list[str]:
    """What can be said of types with too few peers."""
    r = V.without_peers(model.findings).first()
    if not r.types:
        return ["every type has peers to be compared with"]
    out = [f"{plural(r.types, 'type')} with fewer than {model.policy.min_cohort} in the peer group: readings against peers are blank, not zero", f"{plural(r.also_named, 'type')} of these named above all the same, by findings that need no peers"]
    lone = model.findings.where("kind = 'Coverage'").select("subject", F.exists("qualifiers", lambda q: q.holds).alias("extreme"))
    types = model.full.select(F.col("type_id").alias("subject"), "name", "fan_in", "max_cc", "cohort_size").join(lone, "subject")
    for note, rows in ((" (extreme in the whole, a weaker claim: it compares unlike things)", types.where("extreme")), ("", types)):
        shown, more = capped(rows, model.policy.top, "type", F.desc("fan_in"), "subject")
        out += [f"{t.name}: {plural(t.fan_in, 'caller')}, complexity {t.max_cc}, {plural(t.cohort_size - 1, 'peer')}{note}" for t in shown] + more
    return out


def loop(r: Row, name: Callable[[str], str] = str) -> str:
    steps = [name(x) for x in r["path"]]
    return "  loop: " + " -> ".join([*steps, steps[0]]) + ("" if r["path_covers_every_member"] else f" ({len(steps)} of {r['size']}; all reach each other)")


def cycle_lines(model: Model) -> dict[str, list[str]]:
    """Namespace cycles, those set aside with the reason, project cycles with their links, tangles with what holds them."""
    top, by_size = model.policy.top, (F.desc("size"), "id")
    shaped = model.namespace_cycles
    rows, more = capped(shaped.where("shape = 'Coupling'"), top, "cycle", *by_size)
    held = P.pairs_within(shaped.where(F.get("members", F.lit(0)).isin([r.members[0] for r in rows])), P.held_references(model.edges, model.types)).withColumn("weight", F.col("forward") + F.col("back"))
    turn = F.row_number().over(W.partitionBy("cycle").orderBy(F.desc("weight"), "first", "second"))
    pairs: dict[str, list[str]] = {}
    for p in held.withColumn("turn", turn).where(F.col("turn") <= PAIRS).orderBy("cycle", "turn").collect() if rows else []:
        pairs.setdefault(p.cycle, []).append(f"  {p.first} <-> {p.second}: {plural(p.weight, 'held reference')}")
    namespaces = []
    for r in rows:
        shown = pairs.get(r.members[0], [])
        namespaces += [f"{plural(r['size'], 'namespace')}: {some(r.members, NAMESPACES, ' <-> ')}", loop(r), *shown]
        if r.mutual > len(shown):
            namespaces.append(f"  {r.mutual - len(shown)} more pairs that hold each other")
    aside, left = capped(shaped.where("shape <> 'Coupling'"), top, "cycle", *by_size)
    reasons = {"FolderLayout": lambda r: f"folders of one project, {r.projects[0]}", "SharedTypes": lambda r: "they name each other's types and hold none"}
    set_aside = [f"{r.anchor or r.members[0]}: {plural(r['size'], 'namespace')}; {reasons[r['shape']](r)}" for r in aside] + left

    rings, rest = capped(model.project_cycles, top, "cycle", *by_size)
    nodes = model.project_cycles.where(F.col("id").isin([r.id for r in rings])).select(F.explode("members").alias("node"), F.col("id").alias("component"))
    closing = P.project_links(nodes, model.types, model.edges).withColumn("turn", F.row_number().over(W.partitionBy("component").orderBy(F.desc("weight"), "a", "b"))).where(F.col("turn") <= LINKS)
    links: dict[str, list[str]] = {}
    for x in closing.orderBy("component", "turn").collect() if rings else []:
        links.setdefault(x.component, []).append(f"  {x.a} -> {x.b}: {plural(x.weight, 'reference')}, the heaviest from {short(x.example_from)} to {short(x.example_to)}")
    projects = [line for r in rings for line in (f"{plural(r['size'], 'project')}: {some(r.members, PROJECTS, ' <-> ')}", loop(r), *links.get(r.id, []))] + rest

    knots, others = capped(model.tangle_shapes, top, "tangle", *by_size)
    inner = P.tangle_edges(model.tangles.where(F.get("members", F.lit(0)).isin([r.members[0] for r in knots])), model.edges)
    kinds: dict[str, list[str]] = {}
    heaviest: dict[str, str] = {}
    if knots:
        for x in P.tangle_kinds(inner).orderBy("tangle", F.desc("references"), "kind").collect():
            kinds.setdefault(x.tangle, []).append(f"{x['references']:,} {EDGE_KINDS[x.kind]}")
        heaviest = {x.tangle: f"most between {short(x.first)} and {short(x.second)} ({x.weight:,})" for x in P.heaviest_pairs(inner).collect()}
    tangles = []
    for r in knots:
        why = "inheritance explains it" if r["shape"] == "Hierarchy" else "a cycle stays without inheritance"
        tangles += [f"{plural(r['size'], 'type')}: {some([short(m) for m in r.members], TYPES)}", loop(r, short), f"  {', '.join(kinds[r.members[0]][:KINDS_SHOWN])}; {heaviest[r.members[0]]}; {why}"]
    return {
        "Namespaces that hold each other": namespaces or ["none"],
        "Cycles of namespaces that are no layering problem": set_aside or ["none"],
        "Cycles of projects": projects or ["none"],
        f"Tangles of {model.policy.min_tangle} types or more": tangles + others or ["none"],
    }


def stability(model: Model) -> list[str]:
    """Projects by how many types rest on them, and those that can't be placed."""
    rows, more = capped(model.couplings, model.policy.top, "project", F.desc("ca"), "project")
    out = []
    for r in rows:
        if r.instability is None:
            out.append(f"{r.project}: no coupling with other projects, abstractness {number(r.abstractness)}")
        else:
            out.append(f"{r.project}: {r.ca} in, {r.ce} out, {r.abstract_types} of {r.total_types} abstract, instability {number(r.instability)}, distance {number(r.distance)}" + ZONES.get(r.zone, ""))
    lost, unlisted = capped(P.unmeasured(model.projects, model.types), LISTED, "project", "project")
    return out + more + [f"{r.project}: no analysed type, can't be placed" for r in lost] + unlisted


def shape(model: Model) -> list[str]:
    """Depth and width of the project layers, and what lies outside."""
    r = V.depth_and_width(model.project_groups).first()
    out = [f"{plural(r.depth, 'layer')}, {plural(r.widest_layer, 'box', 'boxes')} in the widest"] if r.depth else []
    rows, more = capped(P.integrations(model.dependencies), LISTED, "dependency", F.desc("types_touching"), "namespace")
    return out + [f"{x.namespace}: {plural(x.types_touching, 'type')} touch it" for x in rows] + more


def text(model: Model, top: int | None = None, profile: Profile | None = None) -> str:
    profile = profile or Profile()
    with profile.stage("facts"):
        n_types, n_projects = model.types.count(), model.couplings.count()
    with profile.stage("findings"):
        found = sections(model, top)
        lead = V.lead(model.findings).orderBy("place").collect()
    lines = [f"{plural(n_types, 'type')} in {plural(n_projects, 'project')}. Every line carries the numbers behind it; an order is no severity.", "", "First of each kind, rarest kind first"]
    lines += [f"  {r.kind} (1 of {r.total}): {found[r.kind][1][0]}" for r in lead]
    shares = {r.kind: r for r in V.fixed_gate_shares(model.findings, model.types).collect()}
    patterns = [f"{plural(r.types, 'type')} that reach {r.signature}, a pattern and no exception: {r.names}" for r in V.layering_patterns(model.findings, model.participants, model.full).orderBy("types", "signature").limit(LISTED).collect()]
    for kind in KINDS:
        total, rows = found.get(kind, (0, []))
        if rows:
            lines += ["", f"{kind}: {total:,}", *[f"  {row}" for row in rows]]
            if total > len(rows):
                lines.append(f"  {total - len(rows):,} not shown of {total:,}")
        if kind in shares:
            lines.append(f"  {number(shares[kind].percent)} % of {plural(shares[kind].types, 'type')}; the gate is a fixed count, so compare names and not percentages between code bases")
        if kind == V.SPANS:
            lines += [f"  {x}" for x in patterns]
    with profile.stage("structure"):
        parts = cycle_lines(model) | {"Stability and abstractness of projects": stability(model), "Layers and outside": shape(model)}
    with profile.stage("coverage"):
        parts |= {"Types without peers": peerless(model), "What was not analysed": coverage(model)}
    for title, rows in parts.items():
        lines += ["", title, *[f"  {x}" for x in rows]]
    return "\n".join(lines) + "\n"


def ink(model: Model) -> str:
    """The mosaic's caption: the share of types that are tinted, and of the drawn area."""
    r = V.named_ink(model.full, V.named_types(model.findings)).first()
    return f"{r.named:,} of {plural(r.types, 'type')} tinted, {number(r.ink_percent or 0)} % of the lines"


def drawings(model: Model, most_types: int = 20_000) -> dict[str, str]:
    """Map, mosaic and plot as SVG. The mosaic shows the ``most_types`` longest types and says so in its file name if there are more."""
    boxes = V.diagram_rows(model.project_groups).join(model.project_groups.select("projects", "is_cycle"), "projects").orderBy("layer", "row", "place").collect()
    out = {"map": drawing.layer_map([(r.projects, r.layer, r["row"], r.place, r.is_cycle) for r in boxes])}
    named = V.named_types(model.findings).withColumn("named", F.lit(True))
    types = model.full.join(named, "type_id", "left").select("project", "name", "lines_of_code", "named").orderBy(F.desc("lines_of_code"), "name").limit(most_types + 1).collect()
    by_project: dict[str, list[tuple[str, float, bool]]] = {}
    for r in types[:most_types]:
        by_project.setdefault(r.project, []).append((r.name, float(r.lines_of_code), bool(r.named)))
    out["mosaic" if len(types) <= most_types else f"mosaic-longest-{most_types}"] = drawing.mosaic(by_project)
    points = V.plot_points(model.by_project, model.couplings).orderBy(F.desc("dependents"), "project").collect()
    bound = [max(10.0, -(-max((p[k] for p in points), default=0) // 10) * 10) for k in ("reach", "density")]
    out["plot"] = drawing.reach_plot([(p.project, p.types, p.dependents, p.reach, p.density) for p in points], *bound)
    return out


def html(model: Model, top: int | None = None, full: bool = True) -> str:
    """The drawings and the report as one page, a folding block for each section; without ``full`` only the lead and the counts are open."""
    pictures = "".join(f"<h2>{escape(n)}</h2>{svg}" + (f"<p>{escape(ink(model))}</p>" if n.startswith("mosaic") else "") for n, svg in drawings(model).items())
    first, *rest = text(model, top).strip("\n").split("\n\n")
    blocks = []
    for k, part in enumerate(rest):
        title, _, body = part.partition("\n")
        blocks.append(f"<details{' open' if full or k == 0 else ''}><summary>{escape(title)}</summary><pre>{escape(body)}</pre></details>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Analysis</title></head><body><p>{escape(first)}</p>{pictures}{"".join(blocks)}</body></html>'
