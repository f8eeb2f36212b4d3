"""Ranks of all rows of large groups, without a task that holds a group, and the best rows of many queries in one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: tuple[str, ...], coarse: Column, *order: str | Column, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 in each group, by ``coarse`` (ascending) and then ``order``.

    Only rows that agree in ``coarse`` are sorted together; what comes before them is a running sum over their numbers, a
    table of one row for each value."""
    rows = df.withColumn("_coarse", coarse)
    sizes = rows.groupBy(*keys, "_coarse").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "_coarse").orderBy(*order))
    return rows.withColumn("_place", place).join(sizes.withColumn("_before", before).drop("_n"), [*keys, "_coarse"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_coarse", "_place", "_before")


def keep_best(scores: np.ndarray, ties: list[np.ndarray], row: np.ndarray, score: np.ndarray, found: list[np.ndarray]) -> None:
    """Take candidates (each for a row, with a score over -inf) into the best k of each row: ``scores`` is rows x k, -inf where there
    is none yet, descending; ``ties`` are arrays of that shape that order equal scores, ascending, the first one first."""
    touched, k = np.unique(row), scores.shape[1]
    if not len(touched):
        return
    row = np.concatenate([row, np.repeat(touched, k)])
    score = np.concatenate([score, scores[touched].ravel()])
    found = [np.concatenate([f, t[touched].ravel()]) for f, t in zip(found, ties, strict=True)]
    order = np.lexsort((*found[::-1], -score, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept, row, place = order[place < k], row[place < k], place[place < k]
    scores[row, place] = score[kept]
    for t, f in zip(ties, found, strict=True):
        t[row, place] = f[kept]
