"""Fact tables from a star schema, so that every operator has data and SQL to be held against.

Parts are types, brands are projects, lines are members. A line refers to the next line of its order if its quantity is
small against that part's size, so small parts are referred to most; across brands only downwards, or within brands of
one leading digit. The same text runs in Spark and in DuckDB. Parts above size 45 are outside what is analysed:
references to them dangle. Parts of size 41 have a namespace of their own and no peers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import few_threads

#: Parts above this size are not declared.
DECLARED = 45

PARTS = f"""
SELECT p_partkey AS part, p_brand AS project, p_brand AS assembly, p_size AS size,
  p_brand || '.' || p_type || CASE WHEN p_size = 41 THEN '.Own' || CAST(p_partkey AS VARCHAR(20)) ELSE '' END AS namespace,
  p_size <= {DECLARED} AS declared,
  CASE p_size % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'struct' ELSE 'class' END AS keyword, p_size % 10 = 0 AS is_abstract,
  CASE WHEN p_size = 41 THEN 'Only' || CAST(p_partkey AS VARCHAR(20)) ELSE (CASE p_size % 5 WHEN 0 THEN 'I' ELSE '' END) || 'P' || CAST(p_partkey AS VARCHAR(20)) || upper(substring(p_name, 1, 1)) || substring(p_name, 2, instr(p_name, ' ') - 2)
    || upper(substring(p_name, instr(p_name, ' ') + 1, 1)) || substring(p_name, instr(p_name, ' ') + 2, 40)
    || CASE WHEN p_type = 'PROMO' AND p_size % 7 = 0 THEN 'Controller' ELSE '' END END AS name,
  CASE WHEN p_type = 'PROMO' AND p_size % 3 = 0 THEN 'ApiControllerAttribute' WHEN p_type = 'LARGE' AND p_size % 11 = 0 THEN 'RouteAttribute' ELSE '' END AS attributes,
  CASE WHEN p_type = 'ECONOMY' AND p_size % 4 = 0 THEN 'DbContext' WHEN p_type = 'STANDARD' AND p_size % 9 = 0 THEN 'Entity;ControllerBase' WHEN p_size % 2 = 0 THEN 'Entity' ELSE '' END AS bases,
  CASE WHEN p_size % 6 = 0 THEN 'Shop.IOrder;Shop.IDisposable' WHEN p_size % 6 = 1 THEN 'Shop.IHandler<A>;Shop.IHandler<B>' WHEN p_size % 6 = 2 THEN 'Shop.' || 'I' || p_type ELSE '' END AS interfaces,
  CASE WHEN p_size % 8 = 3 THEN 'Shop.Base' || p_type ELSE '' END AS solution_base,
  'System.Collections.Generic' || CASE WHEN p_type = 'MEDIUM' AND p_size % 3 = 0 THEN ';System.Net.Http.Json' ELSE '' END || CASE WHEN p_type = 'SMALL' AND p_size % 2 = 0 THEN ';System.Data.Common' ELSE '' END
    || CASE WHEN p_type = 'PROMO' AND p_size % 3 = 1 THEN ';Microsoft.AspNetCore.Mvc.Core' ELSE '' END || CASE WHEN p_size % 13 = 0 THEN ';Stripe.Checkout.Api' ELSE '' END AS external
FROM {{part}}"""

#: Lines with the number each has in its part, and the line after it in its order.
LINES = """
SELECT l_orderkey AS ord, l_partkey AS part, l_linenumber AS line, l_suppkey AS supplier, l_returnflag AS flag, l_linestatus AS status,
  CAST(l_quantity AS INT) AS quantity, CAST(round(l_discount * 100) AS INT) AS discount, CAST(round(l_tax * 100) AS INT) AS tax,
  CAST(floor(l_extendedprice / 1000) AS INT) AS price, CAST(month(l_shipdate) AS INT) AS shipped,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) AS n
FROM {lineitem}"""

FOLLOWED = """
SELECT ord, part, n, line, supplier, flag, status, quantity,
  lead(part) OVER (PARTITION BY ord ORDER BY line, part, n) AS next_part, lead(n) OVER (PARTITION BY ord ORDER BY line, part, n) AS next_n
FROM {lines}"""

TYPES = """
SELECT 'type|' || assembly || '|' || namespace || '.' || name AS type_id, part, project, assembly, namespace, namespace || '.' || name AS fqn, name, keyword, is_abstract,
  attributes, bases, interfaces, solution_base, external, 'src/' || project || '/' || name || '.cs' AS file, size AS line
FROM {parts} WHERE declared"""

MEMBERS = """
SELECT 'member|' || t.assembly || '|' || t.fqn || '|M' || CAST(l.n AS VARCHAR(20)) AS member_id, t.type_id, t.project, l.part, l.n, 'M' || CAST(l.n AS VARCHAR(20)) AS name,
  CASE l.line % 6 WHEN 0 THEN 'Constructor' WHEN 1 THEN 'Property' WHEN 2 THEN 'Field' WHEN 3 THEN 'Event' ELSE 'Method' END AS kind,
  CASE l.supplier % 4 WHEN 0 THEN 'Private' WHEN 1 THEN 'Internal' WHEN 2 THEN 'Protected' ELSE 'Public' END AS accessibility,
  CAST(floor(l.quantity * l.quantity * (CASE t.line % 7 WHEN 0 THEN 22 WHEN 1 THEN 9 WHEN 2 THEN 4 ELSE 1 END) / 2500.0) AS INT) + 1 AS cyclomatic, l.discount AS dsm, l.tax AS transform,
  CASE WHEN l.flag = 'R' AND l.tax >= 7 THEN l.tax - 6 ELSE 0 END AS static_mutations, l.line AS max_nesting, l.supplier % 5 AS parameter_count, l.price AS lines_of_code,
  CASE WHEN l.supplier % 10 = 0 THEN '' ELSE 'src/' || CAST(l.supplier AS VARCHAR(20)) || '.cs' END AS file, CASE WHEN l.supplier % 10 = 0 THEN 0 ELSE CAST(l.ord % 1000 AS INT) + 1 END AS line,
  l.supplier % 4 = 3 AND l.shipped <= 6 AS is_externally_visible, l.shipped = 7 AS is_override, l.shipped = 8 AS implements_interface,
  l.shipped = 9 AND l.line = 4 AS is_entry_point, l.discount = 5 AS has_attributes, l.tax = 1 AS is_static
FROM {lines} l JOIN {types} t ON l.part = t.part"""

#: From a type to a type that may not be declared; never to itself.
TYPE_REFS = """
SELECT f.type_id AS from_type, 'type|' || p.assembly || '|' || p.namespace || '.' || p.name AS to_type, p.declared AS to_declared,
  CASE WHEN x.flag = 'A' AND x.status = 'F' THEN 3 WHEN x.flag = 'A' THEN 4 WHEN x.flag = 'N' AND x.status = 'F' THEN 7 WHEN x.flag = 'N' THEN 6 WHEN x.status = 'F' AND x.line = 1 THEN 1 WHEN x.status = 'F' THEN 5 ELSE 8 END AS kind,
  CASE WHEN x.supplier % 10 = 0 THEN '' ELSE 'src/' || CAST(x.supplier AS VARCHAR(20)) || '.cs' END AS file, CASE WHEN x.supplier % 10 = 0 THEN 0 ELSE x.line END AS line
FROM {followed} x JOIN {types} f ON x.part = f.part JOIN {parts} p ON x.next_part = p.part
WHERE x.part <> x.next_part AND x.quantity * (p.size * p.size + 50) <= 2500 AND (p.project <= f.project OR substring(p.project, 7, 1) = substring(f.project, 7, 1))"""

#: From a member to a member, which may be of the same type or not declared.
MEMBER_REFS = """
SELECT f.member_id AS from_member, 'member|' || p.assembly || '|' || p.namespace || '.' || p.name || '|M' || CAST(x.next_n AS VARCHAR(20)) AS to_member, p.declared AS to_declared
FROM {followed} x JOIN {members} f ON x.part = f.part AND x.n = f.n JOIN {parts} p ON x.next_part = p.part
WHERE x.quantity * (p.size * p.size + 50) <= 2500"""

PROJECTS = """
SELECT s.project, s.n_types, s.low = 1 AS has_entry_point, s.n_types % 3 <> 0 AS is_library
FROM (SELECT project, count(*) AS n_types, min(size) AS low FROM {parts} GROUP BY project) s"""

FACTS = {"parts": PARTS, "lines": LINES, "followed": FOLLOWED, "types": TYPES, "members": MEMBERS, "type_refs": TYPE_REFS, "member_refs": MEMBER_REFS, "projects": PROJECTS}
LISTS = ("attributes", "bases", "interfaces", "external")


def files(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, length and time of each file that the facts are made of: what has changed is read again."""
    jvm, found = spark.sparkContext._jvm, []
    for table in ("part", "lineitem"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
        for f in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path):
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(found)


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The fact tables of a star schema in sf_dir; lists are arrays."""
    few_threads(spark)
    found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem")}
    for name, text in FACTS.items():
        used = {t: df for t, df in found.items() if "{" + t + "}" in text}
        found[name] = spark.sql(text, **used)
    as_list = {c: F.filter(F.split(c, ";"), lambda x: x != "") for c in LISTS}
    found["types"] = found["types"].withColumns(as_list)
    return found


def duckdb_facts() -> list[tuple[str, str]]:
    """(name, text) of the same tables for DuckDB; lists are text, separated by semicolons."""
    names = {t: t for t in ("part", "lineitem", *FACTS)}
    return [(name, text.format(**names)) for name, text in FACTS.items()]
