"""The best rows of each query: in a task's Arrow table, and over all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, query: str, tie: list[str], k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query, with `result_rank` from 1: by score, then by `tie`."""
    order = Window.partitionBy(query).orderBy(F.desc(score), *tie)
    return scored.withColumn("result_rank", F.row_number().over(order)).where(F.col("result_rank") <= k)


def best_of(hits: pa.Table, query: str, k: int) -> pa.Table:
    """The k best rows of each query: by the column `score`, then by the columns that follow it."""
    q = np.asarray(hits.column(query).combine_chunks().dictionary_encode().indices)
    at = hits.column_names.index("score")
    ties = [np.asarray(hits.column(j)) for j in range(hits.num_columns - 1, at, -1)]
    order = np.lexsort((*ties, -hits.column("score").to_numpy(), q))
    first = np.searchsorted(q[order], q[order], side="left")
    return hits.take(pa.array(order[np.arange(len(q)) - first < k]))
