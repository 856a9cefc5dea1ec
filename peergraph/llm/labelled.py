"""A bounded sample of labelled rows, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, of: int) -> Column:
    """crc32 of the id as text, modulo of; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % of


def sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_column: str = "doc_id", column: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, label, text) of at most per_class usable labelled documents of each class, and how many usable labels each class has.

    The sample is taken in the order of a hash of the id, so it is the same on every run. Null labels count for nothing;
    of an id's several labels the largest counts.
    """
    known = labels.where(usable & F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64(id_column), id_column).limit(per_class) for k in sorted(counts)]
    if not parts:
        return documents.select(id_column, F.lit(0).alias("label"), column).limit(0), counts
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # at most per_class ids of each class: small enough to be sent to all
    return documents.select(id_column, column).join(F.broadcast(chosen), id_column).select(id_column, "label", column), counts


def isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to the labels (pool adjacent violators): scores and values to interpolate between."""
    points, where = np.unique(score, return_inverse=True)
    w = np.bincount(where, weight)
    y = np.bincount(where, weight * label) / w
    pools: list[list[float]] = []
    for i in range(len(points)):
        pools.append([y[i], w[i], i, i])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    x, v = [], []
    for value, _, first, last in pools:
        x += [points[int(first)], points[int(last)]]
        v += [value, value]
    return np.array(x), np.array(v)
