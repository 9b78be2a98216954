"""Approximate nearest neighbours by cosine over shifted Hilbert curves.

Vectors are scaled to length one. Each of ``CURVES`` curves projects them to ``DIMS`` dimensions along its
own random directions, shifts them, and numbers the cells of a grid by their place on a Hilbert curve.
Spark range-partitions the keys of all curves at once; a row's rank among them is its position in its
partition plus the size of the partitions before. A query looks at everything within ``window`` ranks on
every curve: the ranks are cut into blocks of ``BLOCK``, queries go to each block their window touches,
and a block reranks by exact cosine. The best of all blocks are merged.

The window is chosen for the data: for at most ``PROBES`` queries the true neighbours are found by brute
force (one pass over the vectors), and the window is the smallest that brings ``RECALL`` of them into
reach. So the same recall holds at every size, whatever the dimension of the data; where vectors have
little structure the windows become wide. Directions are centred and scaled on at most ``FIT`` rows. Every
row is indexed.

Equal vectors are indexed once, with their k + 1 smallest ids, which is all a query can ask for; equal
queries are searched once.

Defined results: vectors without id, null, empty, zero, or with null or non-finite components take no
part; shorter vectors end in zeros; a repeated row counts once; rows sharing an id are candidates of
their own but never of a query with that id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import stored
from keepwise.llm.vectors import QUERY_EVERY, best, matrix, usable, widen

CURVES = 8
DIMS = 6
BITS = 8
BLOCK = 2048
ASKERS = 2048  # queries that meet a block at once
PROBES = 256
FIT = 4096
RECALL = 0.96
TOP = 5
SALTS = 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (rows of ``cells``), by Skilling's transform."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """Directions, centres, scales and shifts of all curves."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.directions = [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(CURVES)]
        shown = [sample @ d for d in self.directions]
        self.low = [s.mean(0) - 3 * s.std(0) - 1e-9 for s in shown]
        self.span = [6 * s.std(0) + 2e-9 for s in shown]
        # Half of the grid is room for the shift.
        self.shifts = [rng.random(dims) for _ in range(CURVES)]

    def keys(self, unit: np.ndarray, curve: int) -> np.ndarray:
        at = (widen(unit, len(self.directions[curve]))[:, : len(self.directions[curve])] @ self.directions[curve] - self.low[curve]) / self.span[curve]
        cells = np.floor((np.clip(at, 0, 1) + self.shifts[curve]) * (1 << (BITS - 1)))
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def _positions(curves):
    def run(batches):
        for batch in batches:
            unit = _unit(matrix(batch.column(1)))
            n = batch.num_rows
            for c in range(CURVES):
                key = pa.array(curves.value.keys(unit, c))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), key, *batch.columns], names=["curve", "key", *batch.schema.names])

    return run


def distinct_vectors(vectors: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(gid, v, ids, asks): distinct vectors with their k + 1 smallest ids; ``asks`` marks queries' vectors."""
    keyed = vectors.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = keyed
    for keys in (["h1", "h2", "salt"], ["h1", "h2"]):
        order = Window.partitionBy(*keys).orderBy("id")
        few = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    lists = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
    marked = lists.join(asking.select("h1", "h2").distinct().withColumn("asks", F.lit(True)), ["h1", "h2"], "left")
    return marked.select(F.monotonically_increasing_id().alias("gid"), "h1", "h2", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


def _scored(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (q @ m.T) / np.outer(np.sqrt((q * q).sum(1)), np.sqrt((m * m).sum(1)))


def _nearest(gids, q, m, lists, k):
    """The k best ids for each query vector among the vectors ``m`` with their id lists."""
    owner = np.repeat(np.arange(len(lists)), [len(i) for i in lists])
    ids = np.concatenate([np.asarray(i, np.int64) for i in lists])
    width = max(q.shape[1], m.shape[1])
    q, m = widen(q, width), widen(m, width)
    out = []
    for lo in range(0, len(q), 256):
        for g, s in zip(gids[lo : lo + 256], _scored(q[lo : lo + 256], m), strict=True):
            full = s[owner]
            at = best(full, ids, k)
            out.append((np.full(len(at), g, np.int64), ids[at], full[at], owner[at]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


NEAR = "asker long, vec_id long, score double"


def _probe(shared, k: int):
    """Brute force for a few queries: the best of each batch, with the vector they belong to."""

    def run(batches):
        gids, q = shared.value
        for batch in batches:
            if batch.num_rows:
                a, i, s, owner = _nearest(gids, q, matrix(batch.column(1)), batch.column(2).to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(i), pa.array(s), batch.column(0).take(pa.array(owner))], names=["asker", "vec_id", "score", "gid"]
                )

    return run


def _block(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table([np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], names=["asker", "vec_id", "score"])
        # A block that spans two curves holds some vectors twice.
        rows = rows.take(pa.array(np.unique(rows["gid"].to_numpy(), return_index=True)[1]))
        q, m = matrix(queries["q"].combine_chunks()), matrix(rows["v"].combine_chunks())
        found = _nearest(queries["asker"].to_numpy(), q, m, rows["ids"].to_pylist(), k)
        return pa.table(found[:3], names=["asker", "vec_id", "score"])

    return run


def _merged(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The k best distinct ids of each asker."""
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("asker", "vec_id", *more).agg(F.max("score").alias("score"))
    return once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def ranks(reps: DataFrame, curves) -> DataFrame:
    """(curve, rank, gid, v, ids, asks) of every vector on every curve, ranks counted over all curves."""
    schema = "curve int, key long, gid long, v array<double>, ids array<long>, asks boolean"
    keyed = reps.select("gid", "v", "ids", "asks").mapInArrow(_positions(curves), schema)
    dealt = keyed.repartitionByRange("curve", "key", "gid").sortWithinPartitions("curve", "key", "gid")
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "curves")
    # One row per partition: its number and size.
    sizes = placed.groupBy(F.shiftright("place", 33).cast("int").alias("part")).agg(F.count("*").alias("n")).collect()
    start, rows = 0, []
    for r in sorted(sizes, key=lambda r: r.part):
        rows.append((r.part, start))
        start += r.n
    starts = reps.sparkSession.createDataFrame(rows, "part int, start long")
    known = placed.withColumn("part", F.shiftright("place", 33).cast("int")).join(F.broadcast(starts), "part")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)
    return known.select("curve", rank.alias("rank"), "gid", "v", "ids", "asks")


def window_for(reps: DataFrame, ranked: DataFrame, k: int, recall: float = RECALL) -> int:
    """The smallest distance in ranks that reaches ``recall`` of the true neighbours of some queries."""
    spark = reps.sparkSession
    probes = reps.filter("asks").orderBy(F.xxhash64("gid"), "gid").limit(PROBES).select("gid", "v").toArrow()
    q = matrix(probes["v"].combine_chunks())
    shared = spark.sparkContext.broadcast((probes["gid"].to_numpy(), q))  # PROBES vectors at most
    schema = "asker long, vec_id long, score double, gid long"
    best_of = _merged(reps.select("gid", "v", "ids").mapInArrow(_probe(shared, k), schema), k, "gid")
    # PROBES * k pairs and their ranks on every curve.
    true = [(r.asker, r.gid) for r in best_of.select("asker", "gid").collect()]
    wanted = spark.createDataFrame([(g,) for g in {g for pair in true for g in pair}], "gid long")
    at = {}
    for r in ranked.select("curve", "gid", "rank").join(F.broadcast(wanted), "gid").collect():
        at.setdefault(r.gid, {})[r.curve] = r.rank
    gaps = sorted(min(abs(at[a][c] - at[g][c]) for c in at[a]) for a, g in true)
    return gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))] if gaps else 0


def _dealt(asks: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: about ASKERS askers of a block share one, each with all rows of the block."""
    counts = asks.groupBy("block").agg(F.ceil(F.count("*") / ASKERS).cast("int").alias("salts"))
    asking = asks.join(counts, "block").withColumn("salt", F.pmod(F.xxhash64("asker"), "salts").cast("int")).drop("salts")
    copies = rows.join(counts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return asking, copies


def nearest(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found; inputs (id, v)."""
    spark = vectors.sparkSession

    def keyed(df: DataFrame) -> DataFrame:
        return df.filter(F.exists("v", lambda x: x != 0)).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))

    asking = keyed(queries)
    reps = stored(distinct_vectors(keyed(vectors), asking, k), "distinct")
    sample = reps.orderBy(F.xxhash64("gid"), "gid").limit(FIT).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = spark.sparkContext.broadcast(Curves(_unit(matrix(sample["v"].combine_chunks()))))
    ranked = ranks(reps, curves)
    window = window_for(reps, ranked, k)
    size = F.lit(BLOCK)
    touched = F.sequence(F.floor((F.greatest(F.col("rank") - window, F.lit(0))) / size), F.floor((F.col("rank") + window) / size))
    asks = ranked.filter("asks").select(F.col("gid").alias("asker"), F.col("v").alias("q"), F.explode(touched).alias("block"))
    asks = asks.dropDuplicates(["asker", "block"])
    rows = ranked.select("gid", "v", "ids", F.floor(F.col("rank") / size).alias("block"))
    asking_rows, copies = _dealt(asks, rows)
    found = asking_rows.groupBy("block", "salt").cogroup(copies.groupBy("block", "salt")).applyInArrow(_block(k + 1), NEAR)
    merged = _merged(found, k + 1).select(F.col("asker").alias("gid"), "vec_id", "score")
    named = asking.join(reps.select("gid", "h1", "h2"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "gid")
    answered = named.join(merged, "gid").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = answered.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order).cast("int"))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(embeddings: DataFrame) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    vectors = stored(usable(embeddings), "vectors")
    return nearest(vectors, vectors.filter(F.col("id") % QUERY_EVERY == 0))
