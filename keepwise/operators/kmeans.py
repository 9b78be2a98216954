"""K-means for several numbers of clusters and several starts at once.

Rows are packed once, in blocks, and stay cached. Every pass over them serves all runs: a task measures a block against the
centres of all runs with one matrix product, adds its rows up per cluster with another and returns sums per run, which Spark adds up per run; only centres, whose number the
caller chooses, pass the driver.

Seeds are drawn by k-means++. A draw in proportion to a row's squared distance is an exponential race: the smallest
-ln(u) / distance wins, with u from a hash of (row key, start, step). So a draw is one minimum over all rows, does
not depend on partitions, and the first k seeds of a start serve every k. Runs end when their centres stay within
``TOLERANCE`` of the mean variance, or after ``ITERATIONS`` steps; finished runs take no part in further passes.

A cluster that loses all its rows keeps its centre. Of equal costs the earlier start wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITERATIONS = 300
TOLERANCE = 1e-4
PARTITION_ROWS = 40_000
BLOCK = 4096  # rows packed and measured at once

_RUN = "run int, sums binary, counts binary, squares binary, cost double"


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
    return np.maximum(d, 0.0)


def _uniform(keys: np.ndarray, seed: int, start: int, step: int) -> np.ndarray:
    """A number in (0, 1) per row, start and step."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + start * 8_191 + step * 131 + 7) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _blocks(batches, size: int):
    for b in batches:
        for keys, x in zip(b.column(0), b.column(1), strict=True):
            yield np.frombuffer(keys.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.float64).reshape(-1, size)


def _nearest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column of ``d`` the row of its least value, the first of several, and that value."""
    least, own = d[0].copy(), np.zeros(d.shape[1], np.int32)
    for j in range(1, len(d)):
        np.copyto(own, j, where=d[j] < least)
        np.minimum(least, d[j], out=least)
    return own, least


@dataclass(frozen=True)
class Clusters:
    """Centres of one run, the squared distances to them in all, and per cluster its rows, sums and sums of squares."""

    centres: np.ndarray
    cost: float
    counts: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    def label(self, df: DataFrame, column: str = "segment", features: str = "features") -> DataFrame:
        """The rows with the number of the nearest centre, the first of several."""
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="int32")
            return pd.Series(_distances(np.stack(x.to_numpy()), shared.value).argmin(axis=1).astype("int32"))

        return df.withColumn(column, nearest(vector_to_array(F.col(features))))


class Rows:
    """Vectors packed for passes; use as a context, which frees the cached rows."""

    def __init__(self, vectors: DataFrame, key: str, features: str):
        vectors = vectors.select(F.xxhash64(key).alias("key"), features)
        found = vectors.agg(F.count("*").alias("n"), Summarizer.variance(F.col(features)).alias("v")).first()
        self.n = found.n
        variance = np.array(found.v.toArray()) if found.n else np.zeros(0)
        self.size = len(variance)
        self.tolerance = TOLERANCE * float(variance.mean()) if self.size else 0.0
        packed = vectors.select("key", vector_to_array(F.col(features)).alias("x"))
        packed = packed.repartition(max(1, -(-self.n // PARTITION_ROWS)), "key").sortWithinPartitions("key", "x")

        def pack(batches):
            for b in batches:
                keys, x = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
                starts = range(0, b.num_rows, BLOCK)
                columns = [pa.array([part[lo : lo + BLOCK].tobytes() for lo in starts], pa.binary()) for part in (keys, x)]
                yield pa.RecordBatch.from_arrays(columns, names=["keys", "x"])

        self.df = packed.mapInArrow(pack, "keys binary, x binary").persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_) -> None:
        self.df.unpersist()

    def draw(self, chosen: list[np.ndarray], seed: int) -> list[np.ndarray]:
        """The next seed of every start, given its seeds so far."""
        size, step = self.size, len(chosen[0])

        def race(batches):
            best: dict[int, tuple] = {}
            for keys, x in _blocks(batches, size):
                for start, centres in enumerate(chosen):
                    d = _distances(x, centres).min(axis=1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        score = -np.log(_uniform(keys, seed, start, step)) / d
                    at = np.flatnonzero(score == score.min())
                    i = int(at[keys[at].argmin()])
                    found = (float(score[i]), int(keys[i]), x[i].tobytes())
                    best[start] = min(best.get(start, found), found)
            rows = [(start, *b) for start, b in best.items()]
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.int32(), pa.float64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["start", "score", "key", "x"])

        raced = self.df.mapInArrow(race, "start int, score double, key long, x binary")
        won = {r.start: r.best.x for r in raced.groupBy("start").agg(F.min(F.struct("score", "key", "x")).alias("best")).collect()}
        return [np.vstack([c, np.frombuffer(won[start], np.float64)]) for start, c in enumerate(chosen)]

    def sums(self, runs: dict[int, np.ndarray]) -> dict[int, Clusters]:
        """Per run: what its rows, assigned to the nearest centres, add up to."""
        size, numbers = self.size, list(runs)
        ends = np.cumsum([0, *[len(runs[r]) for r in numbers]])
        centres = np.vstack([runs[r] for r in numbers])

        def measure(batches):
            # Columns: sums, rows and sums of squares.
            found, cost = np.zeros((len(centres), size + 2)), np.zeros(len(numbers))
            twice, own_squares = -2 * centres, (centres**2).sum(axis=1)[:, None]
            for _, x in _blocks(batches, size):
                norms = (x**2).sum(axis=1)
                d = twice @ x.T  # the squared distance less the row's own square
                d += own_squares
                member = np.empty_like(d)
                for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    own, least = _nearest(d[lo:hi])
                    np.equal(own, np.arange(hi - lo)[:, None], out=member[lo:hi])
                    cost[i] += np.maximum(least + norms, 0.0).sum()
                found += member @ np.column_stack([x, np.ones(len(x)), norms])
            sums, squares = np.ascontiguousarray(found[:, :size]), found[:, size + 1]
            counts = np.rint(found[:, size]).astype(np.int64)
            for i, r in enumerate(numbers):
                part = slice(ends[i], ends[i + 1])
                columns = [[r], [sums[part].tobytes()], [counts[part].tobytes()], [squares[part].tobytes()], [cost[i]]]
                kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["run", "sums", "counts", "squares", "cost"])

        def add_up(parts: pa.Table) -> pa.Table:
            # In one order, so that the last bits do not depend on which task came first.
            parts = parts.sort_by([("cost", "ascending"), ("counts", "ascending")])
            total = [[parts["run"][0].as_py()]]
            for name, kind in (("sums", np.float64), ("counts", np.int64), ("squares", np.float64)):
                total.append([sum(np.frombuffer(b.as_py(), kind) for b in parts[name]).tobytes()])
            return pa.table([*total, [float(np.sum(parts["cost"].to_numpy()))]], schema=parts.schema)

        out = {}
        for r in self.df.mapInArrow(measure, _RUN).groupBy("run").applyInArrow(add_up, _RUN).collect():
            counts, squares = np.frombuffer(r.counts, np.int64), np.frombuffer(r.squares, np.float64)
            out[r.run] = Clusters(runs[r.run], r.cost, counts, np.frombuffer(r.sums, np.float64).reshape(-1, size), squares)
        return out

    def silhouettes(self, found: dict[int, Clusters]) -> dict[int, float | None]:
        """Mean silhouette of all rows by squared distance, for several runs in one pass; None with a single cluster."""
        several = {r: c for r, c in found.items() if (c.counts > 0).sum() > 1}
        size = self.size

        def measure(batches):
            total = dict.fromkeys(several, 0.0)
            for _, x in _blocks(batches, size):
                norms = (x**2).sum(axis=1)
                for r, c in several.items():
                    own = _distances(x, c.centres).argmin(axis=1)
                    n = np.maximum(c.counts, 1)
                    mean = norms[:, None] - 2 * x @ (c.sums / n[:, None]).T + c.squares / n
                    at = np.arange(len(x))
                    inside = np.maximum(mean[at, own], 0.0) * n[own] / np.maximum(n[own] - 1, 1)
                    mean[at, own] = np.inf
                    mean[:, c.counts == 0] = np.inf
                    other = np.maximum(mean.min(axis=1), 0.0)
                    value = (other - inside) / np.maximum(np.maximum(other, inside), 1e-300)
                    total[r] += float(np.where(n[own] > 1, value, 0.0).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["run", "s"])

        sums = self.df.mapInArrow(measure, "run int, s double").groupBy("run").agg(F.sum("s").alias("s")).collect()
        return {r: None for r in found} | {r.run: r.s / self.n for r in sums}

    def cluster(self, ks: list[int], seed: int, starts: int) -> dict[int, Clusters]:
        """Per k the cheapest of its starts."""
        seeds = [np.zeros((0, self.size)) for _ in range(starts)]
        for _ in range(max(ks)):
            seeds = self.draw(seeds, seed)
        runs = {i: (k, start) for i, (k, start) in enumerate((k, s) for k in ks for s in range(starts))}
        centres = {i: seeds[start][:k] for i, (k, start) in runs.items()}
        moving = dict(centres)
        for _ in range(ITERATIONS):
            for i, c in self.sums(moving).items():
                mean = c.sums / np.maximum(c.counts, 1)[:, None]
                centres[i] = np.where((c.counts > 0)[:, None], mean, c.centres)
                if ((centres[i] - c.centres) ** 2).sum() <= self.tolerance:
                    del moving[i]
                else:
                    moving[i] = centres[i]
            if not moving:
                break
        done = self.sums(centres)
        return {k: min((done[i] for i, (size, _) in runs.items() if size == k), key=lambda c: round(c.cost, 6)) for k in ks}
