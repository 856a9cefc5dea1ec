import json

import pytest
from pyspark.sql import functions as F

from peergraph.__main__ import main
from peergraph.plans import drawing, report, sinks
from peergraph.plans.drawing import Rect
from peergraph.plans.model import Model
from peergraph.sources import files, star

DATA = "/root/testdata/sf0.001"


def test_squarify_fills_the_area_in_proportion():
    weights = [6, 6, 4, 3, 2, 2, 1]
    cells = drawing.squarify(weights, Rect(0, 0, 6, 4))
    assert [c.w * c.h for c in cells] == pytest.approx(weights)
    assert not any(a.meets(Rect(b.x + 1e-6, b.y + 1e-6, b.w - 2e-6, b.h - 2e-6)) for i, a in enumerate(cells) for b in cells[:i])
    assert drawing.squarify([0, 0], Rect(1, 2, 5, 5)) == [Rect(1, 2, 1, 1)] * 2


def test_labels_take_the_first_free_corner():
    found = drawing.place_labels([("aa", 50, 50, 2), ("bb", 50, 50, 2), ("far", 99, 50, 2)], Rect(0, 0, 100, 100))
    assert found["aa"].x > 50 and found["bb"].x < 50
    assert found["far"].x < 99


def test_the_document_has_all_blocks(spark):
    model = Model(star.facts(spark, DATA))
    found = sinks.document(model).collect()
    assert len({(r.block, r.id) for r in found}) == len(found)
    blocks = {}
    for r in found:
        blocks.setdefault(r.block, []).append(json.loads(r.json))
    assert set(blocks) == {"tool", "policy", "coverage", "projects", "types", "edges", "namespaceCycles", "projectCycles", "typeTangles", "externalDependencies", "boundary", "findings"}
    assert blocks["policy"][0]["minFanIn"] == 5 and len(blocks["policy"][0]) == 29
    assert {p["coupling"]["zone"] for p in blocks["projects"] if p["coupling"]} <= {"None", "Pain", "Uselessness", "NearMainSequence"}
    assert len(blocks["findings"]) == model.findings.count() and len(blocks["types"]) == model.types.count()
    assert sum(len(t.get("members", [])) for t in blocks["types"]) == model.members.count()


def test_the_document_is_not_planned_at_once(spark):
    """The driver's memory goes by what it plans and compiles at once: here types with their members, and what was cut before."""
    found = sinks.document(Model(star.facts(spark, DATA)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange ") <= 12 and "HashAggregate" in final
    assert found.select("block").distinct().count() == 12


def test_what_is_left_out(spark):
    facts = star.facts(spark, DATA)
    name = facts["projects"].orderBy("project").first().project
    renamed = {k: v.withColumn("project", F.when(F.col("project") == name, f"{name}.Tests").otherwise(F.col("project"))) if k in ("projects", "types", "members") else v for k, v in facts.items()}
    some = files.narrow(renamed, False, ("SRC/1.CS",))
    gone = {r.what: (r.name, r["count"]) for r in some["left_out"].collect()}
    lost = facts["types"].where(F.col("project") != name).where("lower(file) like '%src/1.cs%'").count()
    assert gone == {"skipped test project": (f"{name}.Tests", 1), "type excluded by 1 path patterns": (None, lost)}
    assert some["types"].count() == facts["types"].where(F.col("project") != name).count() - lost
    assert some["members"].join(some["types"], "type_id", "left_anti").count() == 0
    assert files.narrow(renamed)["types"].count() == facts["types"].count()
    assert any("skipped test project: 1" in x for x in report.coverage(Model(some)))


def test_the_command_line(spark, tmp_path, capsys):
    pictures = [x for n in ("diagram", "mosaic", "plot") for x in (f"--{n}", str(tmp_path / f"{n}.svg"))]
    assert main([DATA, "--star", "--csv", str(tmp_path / "csv"), "--json", str(tmp_path / "json"), "--html", str(tmp_path / "a.html"), "--profile", "--exclude-path", "/1.cs", *pictures]) == 0
    out = capsys.readouterr()
    for part in ("types in", "HubOrGodObject", "What was not analysed", "Types without peers", "Tangles of 4", "Cycles of projects", "loop: ", "fixed count", "excluded by 17 path patterns"):
        assert part in out.out, part
    assert "unmeasured" in out.err
    page = (tmp_path / "a.html").read_text(encoding="utf-8")
    assert page.count("<svg") == 3 and page.count("<details open>") == 1 and "% of the lines" in page
    assert all((tmp_path / f"{n}.svg").read_text(encoding="utf-8").startswith("<svg") for n in ("diagram", "mosaic", "plot"))
    assert {p.name for p in (tmp_path / "csv").iterdir()} == {"types", "members", "edges"}
    assert main(["/nowhere"]) == 1
    with pytest.raises(SystemExit) as e:
        main([DATA, "--min-cohort", "1"])
    assert e.value.code == 2
