"""Command line: python -m peergraph FACTS [options] and a flag for each policy value.

Test projects and files of the default path patterns are left out unless --include-tests and --no-default-excludes say
otherwise; --exclude-path adds a pattern. FACTS is a folder of Parquet facts, or with --star a folder of star-schema tables. Exit codes: 0 done, 1 facts can't be
read, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from . import __version__
from .functions.scalars import EXCLUDED_PATHS
from .plans import report, sinks
from .plans.model import Model
from .policy import Policy
from .sources import files, star


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="peergraph", description=__doc__)
    parser.add_argument("facts")
    parser.add_argument("--star", action="store_true")
    for name in ("--csv", "--json", "--html", "--diagram", "--mosaic", "--plot"):
        parser.add_argument(name)
    for name in ("--profile", "--full", "--include-tests", "--no-default-excludes"):
        parser.add_argument(name, action="store_true")
    parser.add_argument("--exclude-path", action="append", default=[])
    parser.add_argument("--version", action="version", version=f"peergraph {__version__}")
    for f in fields(Policy):
        parser.add_argument(Policy.flag_for(f.name), dest=f.name, type=type(f.default), default=f.default)
    given = parser.parse_args(arguments)
    try:
        policy = Policy(**{f.name: getattr(given, f.name) for f in fields(Policy)})
    except ValueError as e:
        parser.error(str(e))
    spark = SparkSession.builder.appName("peergraph").getOrCreate()
    profile = report.Profile()
    try:
        facts = star.facts(spark, given.facts) if given.star else files.read_parquet(spark, given.facts)
    except (files.FactsError, AnalysisException) as e:
        print(f"the facts can't be read: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    patterns = (() if given.no_default_excludes else EXCLUDED_PATHS) + tuple(given.exclude_path)
    model = Model(files.narrow(facts, given.include_tests, patterns), policy)
    print(report.text(model, profile=profile))
    with profile.stage("exports"):
        if given.csv:
            sinks.write_csv(sinks.types_table(model.full), f"{given.csv}/types", "Id")
            sinks.write_csv(sinks.members_table(model.members), f"{given.csv}/members", "DeclaringType", "Id")
            sinks.write_csv(sinks.edges_table(model.all_edges), f"{given.csv}/edges", "From", "To")
        if given.json:
            sinks.document(model).orderBy("block", "id").select("json").write.mode("overwrite").text(given.json)
        if given.html:
            Path(given.html).write_text(report.html(model, full=given.full), encoding="utf-8")
        wanted = {"map": given.diagram, "mosaic": given.mosaic, "plot": given.plot}
        for name, svg in (report.drawings(model) if any(wanted.values()) else {}).items():
            path = wanted[name.partition("-")[0]]
            if path:
                Path(path).write_text(svg, encoding="utf-8")
    if given.profile:
        print("\n".join(f"{s:8.2f} s  {n}" for n, s in profile.rows()), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
