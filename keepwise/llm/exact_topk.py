"""Exact top-k inner products by block-at-a-time pruning.

A vector is a document whose terms are its dimensions; term weights are its integer components. Documents
are reordered by their strongest terms and cut into ranges of ``BLOCK`` documents. A block keeps its
forward index (the component matrix) and the largest and smallest weight of each term. For a query
the summed term maxima, weight by weight with the sign that counts, bound every score in the block.

1. Each query scores the few blocks with the highest bounds first; the k-th score found is a threshold
   that no true result falls below. The block summaries for this pass are grouped, a few per cent of
   the data, and meet the queries in blocks.
2. The queries with their thresholds meet groups of blocks. In a group each query takes the blocks by
   falling bound and stops when the bound falls below its k-th score; equal bounds are still scored,
   since ties go to the smaller id.
3. The k best of every group are merged per query.

A query set against all rows is the job here; queries are packed in blocks of ``QUERIES`` and dealt by hash to
batches of about ``BATCH`` such blocks. Each batch is copied once per group of blocks and each group once
per batch, so a task holds one group and one batch, and no pair of vectors becomes a row.

Defined results: vectors without id, null, empty, or with null or non-finite components take no part;
shorter vectors end in zeros; a repeated row counts once, and rows that share an id are candidates of
their own but never of a query with the same id; scores are 64-bit integers (components beyond
2**26 wrap around as such).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import stored
from keepwise.llm.vectors import QUERY_EVERY, best, matrix, ranked, usable, widen

BLOCK = 256
GROUP = 16  # blocks in a group
QUERIES = 256  # queries in a query block
BATCH = 16  # query blocks that meet a group of blocks at once
FIRST = 4  # blocks a query scores before its threshold is fixed
TOP = 5
SCALE = 256


def terms(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, v): integer components floor(scale * x)."""
    return df.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))


def _strongest(v):
    """Order key: the two dimensions of largest weight, with sign, and then the id."""
    ordered = F.sort_array(F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("w"), (i * 2 + (x < 0).cast("int")).alias("t"))))
    return F.struct(F.get(ordered, F.lit(0))["t"].alias("a"), F.get(ordered, F.lit(1))["t"].alias("b"))


def _pack(batches):
    """Blocks of at most BLOCK documents from rows in order: ids, components, term maxima and minima."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            m = matrix(part.column(1))
            ids = part.column(0).to_numpy()
            columns = [[ids.min()], [ids.tobytes()], [m.astype(np.float64).tobytes()], [m.max(0).tobytes()], [m.min(0).tobytes()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                names=["head", "ids", "m", "top", "low"],
            )


BLOCKS = "head long, ids binary, m binary, top binary, low binary"


def index(vectors: DataFrame) -> DataFrame:
    """Blocks of the reordered documents, with a number and a group, in the shared folder."""
    ordered = vectors.withColumn("key", _strongest(F.col("v"))).repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    packed = stored(ordered.select("id", "v").mapInArrow(_pack, BLOCKS), "blocks")
    numbered = packed.withColumn("block", F.monotonically_increasing_id())
    return stored(numbered, "index")


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


def _products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact while every partial sum stays below 2**53."""
    if np.abs(m).max(initial=0) * np.abs(q).max(initial=0) * m.shape[1] < 2.0**53:
        return (m @ q).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        return m.astype(np.int64) @ q.astype(np.int64)


def _bounds(top: np.ndarray, low: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed term maxima of each block; term weights of a query with a minus sign meet the minima."""
    return top @ np.maximum(q, 0) + low @ np.minimum(q, 0)


class Blocks:
    """Blocks of one group, opened."""

    def __init__(self, rows: pa.Table, width: int):
        self.ids = [np.frombuffer(b, np.int64) for b in rows["ids"].to_pylist()]
        self.m = [widen(_matrix(b, len(i)), width) for b, i in zip(rows["m"].to_pylist(), self.ids, strict=True)]
        self.top = np.stack([m.max(0) for m in self.m])
        self.low = np.stack([m.min(0) for m in self.m])
        self.mass = max((np.abs(m).max(initial=0) for m in self.m), default=0)

    def search(self, query: int, q: np.ndarray, k: int, threshold: float):
        """Best (scores, ids) of one query, block by block while a bound may still reach the k-th score."""
        bounds = _bounds(self.top, self.low, q)
        # Beyond exact doubles a bound may be off: then every block is scored.
        exact = self.mass * np.abs(q).max(initial=0) * len(q) < 2.0**53
        scores, ids, kth = np.empty(0, np.int64), np.empty(0, np.int64), threshold
        for b in np.argsort(-bounds, kind="stable"):
            if exact and bounds[b] < kth:
                break
            other = self.ids[b] != query
            s, i = np.concatenate([scores, _products(self.m[b], q)[other]]), np.concatenate([ids, self.ids[b][other]])
            at = best(s, i, k)
            scores, ids = s[at], i[at]
            if len(scores) == k:
                kth = max(kth, scores[-1])
        return scores, ids


def _rows(found) -> pa.Table:
    query, ids, scores = [], [], []
    for q, s, i in found:
        query.append(np.full(len(s), q, np.int64))
        ids.append(i)
        scores.append(s)
    join = [np.concatenate([np.empty(0, np.int64), *c]) for c in (query, ids, scores)]
    return pa.table(join, names=["query_id", "vec_id", "score"])


def _search(k: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not queries.num_rows or not blocks.num_rows:
            return _rows([])
        packed = []
        for ids, m, thresholds in zip(*(queries[c].to_pylist() for c in ("ids", "m", "thresholds")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            packed.append((ids, _matrix(m, len(ids)), np.frombuffer(thresholds, np.float64)))
        width = max([m.shape[1] for _, m, _ in packed] + [len(t) // 8 for t in blocks["top"].to_pylist()])
        opened, found = Blocks(blocks, width), []
        for ids, m, thresholds in packed:
            for query, q, threshold in zip(ids, widen(m, width), thresholds, strict=True):
                found.append((query, *opened.search(query, q, k, threshold)))
        return _rows(found)

    return run


FOUND = "query_id long, vec_id long, score long"


def _pack_queries(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, QUERIES):
            part = batch.slice(lo, QUERIES)
            thresholds = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            row = [part.column(0).to_numpy().tobytes(), matrix(part.column(1)).tobytes(), thresholds.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], names=["ids", "m", "thresholds"])


def _packed(queries: DataFrame) -> DataFrame:
    return queries.select("id", "v", "threshold").mapInArrow(_pack_queries, "ids binary, m binary, thresholds binary")


def _meet(queries: DataFrame, blocks: DataFrame, groups: int, run, schema: str) -> DataFrame:
    """``run`` on each batch of query blocks with each of the numbered groups of ``blocks``."""
    packed = stored(_packed(queries), "queries")
    batches = max(-(-packed.count() // BATCH), 1)
    # Rows may share an id, but not its vector as well.
    dealt = packed.withColumn("batch", F.pmod(F.xxhash64("ids", "m"), F.lit(batches)).cast("int"))
    asked = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    copies = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    return asked.groupBy("group", "batch").cogroup(copies.groupBy("group", "batch")).applyInArrow(run, schema)


def _bounded(queries: pa.Table, blocks: pa.Table) -> pa.Table:
    """The FIRST blocks of a summary group with the highest bounds, for each query."""
    top, low = (
        [np.frombuffer(b, np.float64) for b in blocks[c].to_pylist()] for c in ("top", "low")
    )
    numbers, out = blocks["block"].to_numpy(), []
    for ids, m in zip(queries["ids"].to_pylist(), queries["m"].to_pylist(), strict=True):
        ids = np.frombuffer(ids, np.int64)
        q = _matrix(m, len(ids))
        width = max([q.shape[1], *map(len, top)])
        q, t, w = widen(q, width), *(np.stack([np.pad(x, (0, width - len(x))) for x in side]) for side in (top, low))
        bounds = np.maximum(q, 0) @ t.T + np.minimum(q, 0) @ w.T
        at = np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST]
        rows = np.repeat(np.arange(len(ids)), at.shape[1])
        out.append((ids[rows], numbers[at.ravel()], bounds[rows, at.ravel()]))
    join = [np.concatenate(c) for c in zip(*out, strict=True)] if out and len(numbers) else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
    return pa.table(join, names=["id", "block", "bound"])


def thresholds(queries: DataFrame, blocks: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """The queries with the k-th best score of their most promising blocks, or minus infinity."""
    groups = -(-n_blocks // (GROUP * BLOCK))
    summaries = blocks.select("block", "top", "low", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
    asked = queries.withColumn("threshold", F.lit(float("-inf")))
    bounds = _meet(asked, summaries, groups, _bounded, "id long, block long, bound double")
    order = Window.partitionBy("id").orderBy(F.desc("bound"), "block")
    chosen = bounds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= FIRST).select("id", "block").distinct()
    # A block that many queries choose is searched by several tasks, each with a copy of it.
    counts = chosen.groupBy("block").agg(F.ceil(F.count("*") / (8 * QUERIES)).cast("int").alias("salts"))
    asking = chosen.join(counts, "block").withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int"))
    asking = asking.join(queries, "id").select("block", "salt", "id", "v")
    copies = blocks.join(counts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    found = asking.groupBy("block", "salt").cogroup(copies.groupBy("block", "salt")).applyInArrow(_search_one(k), FOUND)
    kth = ranked(found, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    kth = kth.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("kth").cast("double")).alias("kth"))
    return queries.join(kth, "id", "left").select("id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("threshold"))


def _search_one(k: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return _rows([])
        q = matrix(queries["v"].combine_chunks())
        packed = {"ids": [queries["id"].to_numpy().tobytes()], "m": [q.tobytes()], "thresholds": [np.full(len(q), -np.inf).tobytes()]}
        return _search(k)(pa.table(packed), blocks)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of integer vectors (id, v)."""
    blocks = index(vectors)
    n_blocks = blocks.count()
    if not n_blocks:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ready = stored(thresholds(queries, blocks, n_blocks, k), "thresholds")
    groups = -(-n_blocks // GROUP)
    grouped = blocks.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    return ranked(_meet(ready, grouped, groups, _search(k), FOUND), k)


def op4(embeddings: DataFrame) -> DataFrame:
    """The five largest products of every fiftieth vector with all others."""
    vectors = stored(terms(usable(embeddings)), "terms")
    return top_k(vectors, vectors.filter(F.col("id") % QUERY_EVERY == 0))


ORACLE = f"""
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as t from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % {QUERY_EVERY} = 0 and q.vec_id <> c.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= {TOP}
"""
