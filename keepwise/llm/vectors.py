"""Shared parts of the vector operators: usable rows, packed blocks, top-k merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_EVERY = 50


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector) with an id and only finite components, one row per distinct pair."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(F.col(key).isNotNull() & (F.size(v) > 0) & finite)
    return rows.select(F.col(key).cast("long").alias("id"), v.alias("v")).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from the few that every task found."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return distinct.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
