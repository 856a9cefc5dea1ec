"""Distribution readings without a window over rows: a histogram of values is ranked and joined back.

For a value among its population of n: ``below``, ``equal`` and ``above`` count the others; the percentile and the rank
from the top give ties their middle. Counts are combined before the shuffle, so a population may hold any share of the
rows; what is sorted in one task is a population's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import times_median


def histogram(values: DataFrame, population: list[str], value: str) -> DataFrame:
    return values.groupBy(*population, value).agg(F.count("*").alias("equal"))


def _counted(bars: DataFrame, population: list[str], value: str) -> DataFrame:
    by = W.partitionBy(*population)
    upto = by.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    through = bars.withColumns({"n": F.sum("equal").over(by), "through": F.sum("equal").over(upto)})
    return through.withColumns({"below": F.col("through") - F.col("equal"), "above": F.col("n") - F.col("through")})


def percentile(below: Column, equal: Column, n: Column) -> Column:
    """Midrank percentile, 0 for an empty population."""
    return F.coalesce(F.try_divide(100.0 * (below + 0.5 * equal), n.cast("double")), F.lit(0.0))


def rank(above: Column, equal: Column) -> Column:
    """Midrank position from the top."""
    return above + 0.5 * equal + 0.5


def readings(values: DataFrame, population: list[str], value: str) -> DataFrame:
    """For each population and value that occurs: n, below, equal, above, median, percentile, rank, times_median.

    Readings of a population of one are given too; whether they count is the caller's rule. Null values are no values.
    """
    counted = _counted(histogram(values.where(F.col(value).isNotNull()), population, value), population, value)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") < place) & (F.col("through") >= place), F.col(value))).over(W.partitionBy(*population))

    middle = counted.withColumn("median", (at(low) + at(high)) / 2.0)
    return middle.select(
        *population,
        value,
        "n",
        "below",
        "equal",
        "above",
        "median",
        percentile(F.col("below"), F.col("equal"), F.col("n")).alias("percentile"),
        rank(F.col("above"), F.col("equal")).alias("rank"),
        times_median(F.col(value), F.col("median")).alias("times_median"),
    )


def medians(values: DataFrame, population: list[str], value: str) -> DataFrame:
    return readings(values, population, value).select(*population, "n", "median").distinct()


def read_outside(asked: DataFrame, values: DataFrame, population: list[str], value: str, x: str) -> DataFrame:
    """asked (population, x) with the percentile and rank that x would have among values, of which it need not be one.

    Asked values are points of the histogram without rows of their own, so one running sum answers them all. Nulls and
    populations without values get no row.
    """
    bars = histogram(values, population, value).select(*population, F.col(value).cast("double").alias(x), "equal", F.lit(False).alias("asked"))
    points = bars.unionByName(asked.select(*population, F.col(x).cast("double").alias(x), F.lit(0).cast("long").alias("equal"), F.lit(True).alias("asked")))
    merged = points.where(F.col(x).isNotNull()).groupBy(*population, x).agg(F.sum("equal").alias("equal"), F.max("asked").alias("asked"))
    whole = W.partitionBy(*population)
    before = whole.orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    counted = merged.withColumns({"n": F.sum("equal").over(whole), "below": F.coalesce(F.sum("equal").over(before), F.lit(0))}).where("asked and n > 0")
    above = F.col("n") - F.col("below") - F.col("equal")
    return counted.select(*population, x, "n", percentile(F.col("below"), F.col("equal"), F.col("n")).alias("percentile"), rank(above, F.col("equal")).alias("rank"))


def stacked(types: DataFrame, key: str, population: str, metrics: tuple[str, ...]) -> DataFrame:
    """(key, population, metric, value), one row for each metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return types.select(key, population, F.explode(pairs).alias("m")).select(key, population, "m.metric", "m.value")


def read_all(types: DataFrame, key: str, population: str, metrics: tuple[str, ...]) -> DataFrame:
    """(key, and for each metric its percentile, rank, times_median, median and the population's n), with one join for all."""
    rows = stacked(types, key, population, metrics)
    found = rows.join(readings(rows, [population, "metric"], "value"), [population, "metric", "value"])
    wanted = ("percentile", "rank", "times_median", "median", "n")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("metric") == m, F.col(w))).alias(f"{m}_{w}") for m in metrics for w in wanted])
