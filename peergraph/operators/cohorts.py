"""Peer groups: candidates, assignment to the most specific viable one, and re-homing of the stranded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut

# Precedence of each basis.
IMPL, BASE, SUFFIX, KIND, NAMESPACE = 0, 1, 2, 3, 4
PASSES = 3


def _candidate(key: Column, basis: str, precedence: int) -> Column:
    return F.struct(key.alias("key"), F.lit(basis).alias("basis"), F.lit(precedence).alias("precedence"))


def candidates(classified: DataFrame) -> DataFrame:
    """(type_id, place, key, basis, precedence), in the order in which a type lists them.

    Interfaces are listed as declared, without type arguments and with repeats; the kind comes last.
    """
    bare = F.transform("interfaces", lambda i: F.substring_index(i, "<", 1))
    informative = F.filter(bare, lambda i: ~S.simple_name(i).isin(*S.UNINFORMATIVE_INTERFACES))
    word = S.trailing_word(F.col("name"), F.col("keyword") == "interface")
    listed = F.concat(
        F.transform(informative, lambda i: _candidate(F.concat(F.lit("impl:"), i), "interface", IMPL)),
        F.array(F.when(F.col("solution_base") != "", _candidate(F.concat(F.lit("base:"), "solution_base"), "base type", BASE))),
        F.array(F.when(word.isNotNull(), _candidate(F.concat(F.lit("suffix:"), word), "name suffix", SUFFIX))),
        F.array(_candidate(F.concat(F.lit("ns:"), S.namespace_or_global(F.col("namespace"))), "namespace", NAMESPACE)),
        F.array(F.when(F.col("kind") != "Internal", _candidate(F.concat(F.lit("kind:"), "kind"), "kind", KIND))),
    )
    rows = classified.select("type_id", F.posexplode(F.filter(listed, lambda c: c.isNotNull())).alias("place", "c"))
    return rows.select("type_id", "place", "c.*")


def candidate_counts(listed: DataFrame) -> DataFrame:
    """How often each key is listed: every occurrence counts."""
    return listed.groupBy("key").agg(F.count("*").alias("listed"))


def without_candidates(subjects: DataFrame, listed: DataFrame) -> DataFrame:
    """Subjects that can't be assigned: an error to the caller."""
    return subjects.select("type_id").join(listed, "type_id", "left_anti")


def _best(rows: DataFrame, *order: Column) -> DataFrame:
    """The row of each type that comes first; combined before the shuffle."""
    return rows.groupBy("type_id").agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "key", "basis")).alias("b")).select("type_id", "b.key", "b.basis")


def assign(listed: DataFrame, floor: int) -> DataFrame:
    """(type_id, key, basis): of the candidates listed often enough the lowest precedence, else the most listed."""
    counted = listed.join(candidate_counts(listed), "key")
    viable = F.col("listed") >= floor
    first = F.when(viable, F.col("precedence").cast("long")).otherwise(-F.col("listed"))
    second = F.when(viable, F.col("place")).otherwise(F.col("precedence"))
    return _best(counted, F.when(viable, 0).otherwise(1), first, second, F.col("place"))


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("key").agg(F.count("*").alias("size"))


def reconcile(assigned: DataFrame, listed: DataFrame, floor: int) -> DataFrame:
    """Moves members of groups below the floor to the most specific other group that could reach it, in at most three passes.

    Each pass judges by what sizes could become before it moves anyone, so the order of subjects doesn't matter.
    """
    now = cut(assigned)
    for _ in range(PASSES):
        actual = sizes(now)
        stranded = now.join(actual.where(F.col("size") < floor), "key").select("type_id", F.col("key").alias("current"))
        others = listed.join(stranded, "type_id").where(F.col("key") != F.col("current"))
        more = others.groupBy("key").agg(F.count("*").alias("more"))
        potential = actual.join(more, "key", "full").select("key", (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("potential"))
        moves = _best(others.join(potential.where(F.col("potential") >= floor), "key"), F.col("precedence"), F.col("place"))
        moves = cut(moves)
        if not moves.limit(1).count():
            break
        now = cut(now.join(moves.select("type_id", F.col("key").alias("k"), F.col("basis").alias("b")), "type_id", "left").select("type_id", F.coalesce("k", "key").alias("key"), F.coalesce("b", "basis").alias("basis")))
    return now


def cohorts(classified: DataFrame, floor: int) -> DataFrame:
    """(type_id, cohort, cohort_basis, cohort_size)."""
    listed = cut(candidates(classified))
    final = reconcile(assign(listed, floor), listed, floor)
    return final.join(sizes(final), "key").select("type_id", F.col("key").alias("cohort"), F.col("basis").alias("cohort_basis"), F.col("size").alias("cohort_size"))
