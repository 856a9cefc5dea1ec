"""Scalar functions as column builders: names, keys, thresholds, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists.
UNINFORMATIVE_INTERFACES = ("IAsyncDisposable", "ICloneable", "IComparable", "IDisposable", "IEnumerable", "IEnumerator", "IEquatable", "IFormattable", "INotifyPropertyChanged", "ISerializable")
PLUMBING_PREFIXES = ("Microsoft.CSharp", "Microsoft.Extensions", "System.Collections", "System.ComponentModel", "System.Diagnostics", "System.Globalization", "System.Linq", "System.Numerics", "System.Reflection", "System.Runtime", "System.Text", "System.Threading")
API_NAMESPACES = ("Microsoft.AspNetCore",)
DATA_NAMESPACES = ("Microsoft.EntityFrameworkCore", "System.Data", "Dapper", "NHibernate", "LinqToDB", "FluentMigrator")
CALL_NAMESPACES = ("System.Net.Http", "Azure", "Amazon", "RabbitMQ", "Confluent.Kafka", "MassTransit", "Stripe", "Twilio", "SendGrid", "Polly")
TEST_PROJECT = r"(?i)(^|\.)(tests?|specs?|unittests?|integrationtests?)($|\.)|tests?$"
EXCLUDED_PATHS = (".designer.cs", ".g.cs", ".g.i.cs", ".generated.cs", "/.nuget/", "/bin/", "/connected services/", "/helppage/", "/migrations/", "/obj/", "/packages/", "/service references/", "/web references/", "assemblyinfo.cs", "globalusings.cs", "reference.cs")
#: Edge kinds in their order.
EDGE_KINDS = ("Other", "Inheritance", "InterfaceImplementation", "Field", "Parameter", "ReturnType", "Construction", "Invocation", "GenericArgument", "Attribute")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def escape(part: Column) -> Column:
    """A key's component: a backslash before each backslash and bar."""
    return F.replace(F.replace(col(part), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def canonical(prefix: str, *parts: Column | str) -> Column:
    return F.concat_ws("|", F.lit(prefix), *[escape(col(p)) for p in parts])


def set_key(members: Column) -> Column:
    """The key of a set: its distinct members' keys in order, each escaped again."""
    return F.concat_ws("|", F.lit("set"), F.transform(F.array_sort(F.array_distinct(members)), escape))


def trailing_word(name: Column, is_interface: Column) -> Column:
    """The last capitalised word of a name, null if shorter than 3 or if the name has none."""
    bare = F.when(is_interface & F.rlike(name, F.lit(r"^I\p{Lu}")), F.substring(name, F.lit(2), F.length(name))).otherwise(name)
    word = F.regexp_extract(bare, r".*[^\p{Lu}](\p{Lu}.*)$", 1)
    return F.when(F.length(word) >= 3, word)


def simple_name(fqn: Column) -> Column:
    """What follows the last dot, without type arguments."""
    return F.substring_index(F.substring_index(fqn, "<", 1), ".", -1)


def external_label(ns: Column) -> Column:
    """The first three segments under System and Microsoft, else the first two; null for no namespace."""
    parts = F.split(ns, r"\.")
    kept = F.when(F.get(parts, F.lit(0)).isin("System", "Microsoft"), F.slice(parts, 1, 3)).otherwise(F.slice(parts, 1, 2))
    return F.when(F.length(ns) > 0, F.array_join(kept, "."))


def covers(prefix: str, ns: Column) -> Column:
    """The namespace is the prefix or lies below it."""
    return (ns == prefix) | F.startswith(ns, F.lit(prefix + "."))


def first_match(namespaces: Column, prefixes: tuple[str, ...]) -> Column:
    """The first namespace, in order, that any prefix covers; null if none is."""

    def any_covers(ns: Column) -> Column:
        found = F.lit(False)
        for p in prefixes:
            found = found | covers(p, ns)
        return found

    return F.get(F.filter(F.array_sort(namespaces), any_covers), F.lit(0))


def is_plumbing(ns: Column) -> Column:
    found = ns == "System"
    for p in PLUMBING_PREFIXES:
        found = found | F.startswith(ns, F.lit(p))
    return found


def is_test_project(name: Column) -> Column:
    return F.rlike(name, F.lit(TEST_PROJECT))


def namespace_or_global(ns: Column) -> Column:
    return F.coalesce(F.nullif(ns, F.lit("")), F.lit("<global>"))


def top_rank_limit(fraction: float, n: Column) -> Column:
    return F.greatest(F.lit(1.0), F.lit(fraction) * n + 0.5)


def times_median(value: Column, median: Column) -> Column:
    """Infinite above a median of 0, and 1 at it."""
    infinite = F.lit(float("inf"))
    return F.when(median <= 0, F.when(value > 0, infinite).otherwise(F.lit(1.0))).otherwise(F.try_divide(value.cast("double"), median.cast("double")))


def finite(value: Column) -> Column:
    return F.when((value != float("inf")) & ~F.isnan(value), value)


def instability(ca: Column, ce: Column) -> Column:
    """Null where nothing depends on it and it depends on nothing."""
    return F.try_divide(ce.cast("double"), (ca + ce).cast("double"))


def distance(abstractness: Column, unstable: Column) -> Column:
    return F.abs(abstractness + unstable - 1)


def zone(abstractness: Column, unstable: Column) -> Column:
    return (
        F.when(unstable.isNull(), "None")
        .when((unstable <= 0.3) & (abstractness <= 0.3), "Pain")
        .when((unstable >= 0.7) & (abstractness >= 0.7), "Uselessness")
        .when(distance(abstractness, unstable) <= 0.3, "NearMainSequence")
        .otherwise("None")
    )


def number(value: Column) -> Column:
    """At most two decimals, halves to even, without trailing zeros; an infinite value is undefined."""
    text = F.format_string("%.2f", F.bround(value, 2))
    return F.when(value == float("inf"), "undefined").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def whole(value: Column) -> Column:
    return F.bround(value).cast("bigint").cast("string")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def top_percent(percentile: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(100 - percentile).cast("bigint"))


def cut_label(name: Column, tail_is_unique: Column, most: int = 20) -> Column:
    """Short names stay; else a unique last segment that is short; else the beginning and an ellipsis."""
    tail = F.substring_index(name, ".", -1)
    return F.when(F.length(name) <= most, name).when(tail_is_unique & (F.length(tail) <= most), tail).otherwise(F.concat(F.substring(name, 1, most - 1), F.lit("…")))


def html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def grouped_count(n: Column) -> Column:
    return F.format_number(n, 0)


def flag_for(name: Column) -> Column:
    """PascalCase as a command-line flag."""
    return F.concat(F.lit("--"), F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", "-")))


def without_revision(version: Column) -> Column:
    return F.substring_index(version, "+", 1)


def signature_in(key: Column) -> Column:
    return F.substring_index(key, "|", -1)


def shape_breadth(public_data: Column, is_primitive: Column, in_solution: Column) -> Column:
    """1 for primitives and for what lies outside; else the number of public data members, from 1 to 100."""
    return F.when(is_primitive | ~in_solution, F.lit(1)).otherwise(F.least(F.lit(100), F.greatest(F.lit(1), public_data)))


def externally_visible(chain: Column) -> Column:
    return F.forall(chain, lambda a: a.isin("Public", "Protected", "ProtectedOrInternal"))


def excluded_path(path: Column, fragments: tuple[str, ...]) -> Column:
    """The path, with forward slashes, contains any fragment, in either case."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    found = F.lit(False)
    for f in fragments:
        found = found | F.contains(low, F.lit(f.lower()))
    return found


def origin_of(path: Column) -> Column:
    """2 for a package, 1 for the framework, 0 for neither: the largest wins."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when(F.contains(low, F.lit("/.nuget/packages/")), 2).when(F.contains(low, F.lit("/packs/")) | F.contains(low, F.lit("/shared/microsoft.")), 1).otherwise(0)
