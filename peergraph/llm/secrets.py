r"""Secret scans with multipart credential linking, in Spark expressions only.

Three base kinds are found in every text, leftmost and not overlapping within a kind: assignments, access
identifiers, long hexadecimal runs. Spark has no function that gives the places of all matches, so a text is split
by the pattern and the lengths of the pieces and of the matches are added up.

Weak candidates (a run of 40 or more base64 characters with a digit, a small and a large letter, outside of URLs; a URL) are
too common to report alone. A credential has a secret and what it opens: complementary are a secret and an access
identifier, and a secret and an endpoint. Secrets, identifiers and endpoints are dealt to scope-wide buckets of their
document and an interval join on (document, bucket) links each secret to the identifiers and endpoints within ``scope``
code points. A weak candidate is reported if it has a link. A bucket holds no more parts than its width in characters
allows, so no group grows with the corpus. Only texts with both kinds of parts are joined, and of these ids and spans alone.

Spans are [start, end) in code points. Defined cases: null and empty texts have no spans; repeated rows each get
the same result; rows without an id are scanned like others; texts of the same id are kept apart; any other columns
don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Patterns of the base kinds in listed order; Java's (?i:) takes ASCII letters in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Weak candidates; a secret must match each of MIXED.
WEAK_SECRET, MIXED = r"[A-Za-z0-9+/]{40,}", ("[0-9]", "[a-z]", "[A-Z]")
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]{4,}"""
#: All kinds, in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint")
SPAN = "struct<start:bigint,kind:int,end:bigint>"
NONE = f"cast(array() as array<{SPAN}>)"


def spans(text: Column, kind: int, pattern: str, measured: int = 0, least: int = 1, may: Column | None = None, has: tuple[str, ...] = ()) -> Column:
    """Spans of the pattern's matches whose group ``measured`` has so many characters at least and matches all of ``has``; ``may``: a cheaper test of whether there can be any."""
    pieces = F.split(text, pattern, -1)

    def each(found: Column) -> Column:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), measured), F.length) if measured else F.transform(found, F.length)
        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(found)), F.length)
        good = F.transform(found, lambda m: reduce(Column.__and__, [F.rlike(m, F.lit(p)) for p in has], F.lit(True)))
        return F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"), sizes.alias("measured"), good.alias("good"))

    def add(acc: Column, m: Column) -> Column:
        begin = acc.at + m["gap"]
        end = begin + m["size"]
        span = F.struct(begin.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when((m["measured"] >= least) & m["good"], F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    def moved(s: Column, at: Column) -> Column:
        return F.struct((s.start + at).alias("start"), s.kind.alias("kind"), (s.end + at).alias("end"))

    test = F.rlike(text, F.lit(pattern)) if may is None else may
    return F.when(test, common.running(common.let(F.regexp_extract_all(text, F.lit(pattern), 0), each), NONE, add, moved)).otherwise(F.expr(NONE))


def base(text: Column) -> dict[str, Column]:
    """Spans of the base kinds."""
    return {
        "assign": spans(text, 0, ASSIGN, 1, LEAST["assign"], F.rlike(text, F.lit(r"(?i:passw|secret|token|api_?key)"))),
        "access": spans(text, 1, ACCESS, 0, LEAST["access"], F.contains(text, F.lit("AKIA"))),
        # runs of 32 and more, taken whole, are the runs that shorter ones are dropped from
        "hex": spans(text, 2, HEX.replace("+", f"{{{LEAST['hex']},}}")),
    }


def _may_link(text: Column) -> Column:
    """Whether text can have a weak secret and something that it opens."""
    return (F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("http"))) & F.rlike(text, F.lit(WEAK_SECRET))


def links(documents: DataFrame, id_column: str = "doc_id", column: str = "text", scope: int = 200) -> DataFrame:
    """(id, text_hash, links): for each different document that has any, its links of a secret with an identifier or an endpoint."""
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    some = documents.where(_may_link(text)).select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = some.select("id", "text_hash", spans(F.col("text"), 3, WEAK_SECRET, has=MIXED).alias("secrets"), F.concat(base(F.col("text"))["access"], spans(F.col("text"), 4, ENDPOINT)).alias("parts"))
    both = common.cut(found.where((F.size("secrets") > 0) & (F.size("parts") > 0)).dropDuplicates(["id", "text_hash"]))

    def dealt(spans_of: str, name: str, spread: int) -> DataFrame:
        buckets = F.sequence(F.floor((F.col("p.start") - spread) / scope), F.floor((F.col("p.end") + spread) / scope))
        return both.select("id", "text_hash", F.explode(spans_of).alias("p")).select("id", "text_hash", F.col("p").alias(name), F.explode(buckets).alias("bucket")).alias(name)

    near = (
        F.col("secret.id").eqNullSafe(F.col("part.id"))
        & (F.col("secret.text_hash") == F.col("part.text_hash"))
        & (F.col("secret.bucket") == F.col("part.bucket"))
        & (F.col("secret.secret.start") <= F.col("part.part.end") + scope)
        & (F.col("secret.secret.end") >= F.col("part.part.start") - scope)
    )
    inside = (F.col("part.part.kind") == 4) & (F.col("secret.secret.start") < F.col("part.part.end")) & (F.col("secret.secret.end") > F.col("part.part.start"))
    met = dealt("secrets", "secret", 0).join(dealt("parts", "part", scope), near)
    # a run within a URL is a part of it, not a secret
    met = met.groupBy("secret.id", "secret.text_hash", F.col("secret.secret").alias("secret")).agg(F.collect_set("part.part").alias("parts"), F.max(inside).alias("inside")).where("not inside")
    link = F.transform("parts", lambda p: F.struct(F.col("secret").alias("secret"), p.alias("part")))
    return met.groupBy("id", "text_hash").agg(F.array_sort(F.flatten(F.collect_list(link))).alias("links"))


def _linked(found: Column) -> Column:
    """The weak candidates of links."""
    return F.coalesce(F.array_distinct(F.concat(F.transform(found, lambda x: x.secret), F.transform(F.filter(found, lambda x: x.part.kind == 4), lambda x: x.part))), F.expr(NONE))


def _with_links(documents: DataFrame, id_column: str, column: str, scope: int, made) -> DataFrame:
    """documents' rows as made(text, links) says; only rows that may have links are joined."""
    text = F.coalesce(F.col(f"d.`{column}`"), F.lit(""))
    d, found = documents.alias("d"), links(documents, id_column, column, scope).alias("l")
    same = F.col(f"d.`{id_column}`").eqNullSafe(F.col("l.id")) & (F.xxhash64(text) == F.col("l.text_hash"))
    alone = d.where(~_may_link(text)).select(*made(text, F.lit(None).cast(found.schema["links"].dataType)))
    return alone.unionByName(d.where(_may_link(text)).join(found, same, "left").select(*made(text, F.col("l.links"))))


def scan(documents: DataFrame, id_column: str = "doc_id", column: str = "text", scope: int = 200) -> DataFrame:
    """(id, text_hash, assign, access, hex, linked, links): arrays of spans and of links, one row for each row of documents."""

    def made(text: Column, found: Column) -> list[Column]:
        own = [c.alias(k) for k, c in base(text).items()]
        return [F.col(f"d.`{id_column}`").alias("id"), F.xxhash64(text).alias("text_hash"), *own, _linked(found).alias("linked"), found.alias("links")]

    return _with_links(documents, id_column, column, scope, made)


def listed(found: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat(F.get(names, s.kind), F.lit(":"), s.start, F.lit(":"), s.end)), ",")


def listed_links(found: Column) -> Column:
    """start:end of the secret = kind:start:end of what it is linked to, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat(x.secret.start, F.lit(":"), x.secret.end, F.lit("="), F.get(names, x.part.kind), F.lit(":"), x.part.start, F.lit(":"), x.part.end)), ",")


def _without(text: Column, found: Column, mark: str) -> Column:
    """text with each stretch that spans cover replaced by mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        parts = F.when(s.start >= acc.at, F.concat(acc.parts, F.array(gap, F.lit(mark)))).otherwise(acc.parts)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc.parts, ""), F.substring(text, (acc.at + 1).cast("int"), F.length(text)))

    return F.aggregate(F.array_sort(found), start, add, finish)


def redact(documents: DataFrame, id_column: str = "doc_id", column: str = "text", scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """documents, with every found span of a text replaced by mark (overlapping spans by one). All rows and columns stay."""

    def made(text: Column, found: Column) -> list[Column]:
        clean = common.let(F.concat(*base(text).values(), _linked(found)), lambda s: F.when(F.size(s) == 0, F.col(f"d.`{column}`")).otherwise(_without(text, s, mark)))
        return [(clean if c == column else F.col(f"d.`{c}`")).alias(c) for c in documents.columns]

    return _with_links(documents, id_column, column, scope, made)
