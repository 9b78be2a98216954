"""Removal of repeated passages by fixed-block anchors.

A passage of ``WINDOW`` words that occurs twice holds, at either place, a whole reference block: the
blocks are non-overlapping runs of ``WINDOW // 2`` words from the start of every document. So

1. reference blocks are indexed, and every rolling window of a block's length of every document is
   looked up; a window that meets a block at another place is an anchor;
2. anchors are extended to the passages around them: every run of ``WINDOW`` words holding an anchor is a
   candidate, and adjoining candidates make a maximal repeat. Candidates are checked exactly by their
   64-bit hashes: the earliest place of each is looked up over all documents;
3. words covered by a candidate whose words also start earlier are removed.

The order is by doc_id, then input row, then position. Look-ups go by chunk (see ``chunks``): each chunk
sends the distinct hashes of its windows, packed by hash, and gets its answers back in that order. So
a passage that stands in a third of all documents is asked for once per chunk, texts are never
shuffled, and no task holds more than its share of the hashes. The look-up of anchors uses 32 bits and
the partition, which can only add candidates; candidates use 64 bits and the partition.

Defined results: null and empty texts have no words; texts below ``WINDOW`` words are kept; rows
without an id come last; rows with the same id are ordered by input row and are separate documents;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.llm.chunks import chunked
from keepwise.llm.common import WordHashes, mix64, stored

WINDOW = 20
CHUNK_ROWS = 1000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
LAST = (1 << 63) - 1  # stands for a missing id
ASK = "part int, chunk long, kind int, data binary"
ASK_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by prefix sums of a polynomial modulo 2**64."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(BASE, len(words)), _powers(INVERSE, len(words))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
        runs = (sums[size:] - sums[:-size]) * down[: len(words) - size + 1]
        return mix64(runs + np.uint64(size))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes; sorted unsigned ones as differences, all by byte planes, which compress well."""
    import zstandard

    out = []
    for a in arrays:
        kind = a.dtype.str.encode().ljust(4)
        out.append(kind + len(a).to_bytes(8, "little") + np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())
    return zstandard.compress(b"".join(out), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _split(hashes: np.ndarray, partitions: int) -> list[np.ndarray]:
    """Places of sorted distinct hashes by partition; the low bits choose it, the high bits are sent."""
    part = (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(partitions)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.cumsum(np.bincount(part.astype(np.int64), minlength=partitions))[:-1])


class Chunk:
    """The documents of one chunk in order, as hashed words, with what was asked and answered for them."""

    def __init__(self, docs: pa.Table, window: int, partitions: int):
        ids = docs["doc_id"].fill_null(LAST).to_numpy()
        rows = docs["row"].to_numpy()
        self.order = np.lexsort((rows, ids))
        self.ids, self.rows = ids[self.order], rows[self.order]
        self.texts = docs["text"].combine_chunks().take(pa.array(self.order))
        words = WordHashes()
        self.words = [words.of((t.as_py() or b"").split()) for t in self.texts]
        self.window, self.block, self.partitions = window, window // 2, partitions
        self.long = [i for i, w in enumerate(self.words) if len(w) >= window]
        anchors = [rolling(self.words[i], self.block) for i in self.long]
        self.lengths = [len(a) for a in anchors]
        flat = np.concatenate([np.empty(0, np.uint64), *anchors])
        starts = [np.arange(n) % self.block == 0 for n in self.lengths]
        self.aligned = np.concatenate([np.empty(0, bool), *starts])
        self.hashes, self.place = np.unique(flat, return_inverse=True)

    def ask_anchors(self):
        """Per partition: distinct window hashes (kind 1) and how often each is a block (kind 0)."""
        blocks = np.bincount(self.place[self.aligned], minlength=len(self.hashes))
        for part, at in enumerate(_split(self.hashes, self.partitions)):
            if len(at):
                short = (self.hashes[at] >> np.uint64(32)).astype(np.uint32)
                yield part, _pack(_steps(short), np.minimum(blocks[at], 2).astype(np.uint8))

    def candidates(self, answers: dict[int, bytes]):
        """Mark the windows that hold an anchor and hash them."""
        met = np.zeros(len(self.hashes), np.uint8)
        for part, at in enumerate(_split(self.hashes, self.partitions)):
            if len(at):
                met[at] = _unpack(answers[part])[0]
        # A block meets itself, so it takes two; another window takes one.
        hit = met[self.place] > self.aligned
        self.marks, parts, owner, lo = [], [], [], 0
        for i, n in zip(self.long, self.lengths, strict=True):
            total = np.concatenate([[0], np.cumsum(hit[lo : lo + n])])
            lo += n
            count = len(self.words[i]) - self.window + 1
            inside = self.window - self.block + 1
            at = np.flatnonzero(total[inside : inside + count] - total[:count])
            self.marks.append(at)
            if len(at):
                parts.append(rolling(self.words[i], self.window)[at])
                owner.append(np.full(len(at), i, np.uint32))
        flat = np.concatenate([np.empty(0, np.uint64), *parts])
        owner = np.concatenate([np.empty(0, np.uint32), *owner])
        self.runs, self.first, self.run_place = np.unique(flat, return_index=True, return_inverse=True)
        self.first_doc = owner[self.first]
        return self

    def ask_runs(self):
        """Per partition: distinct run hashes, and the first document of the chunk with each."""
        for part, at in enumerate(_split(self.runs, self.partitions)):
            if len(at):
                docs, local = np.unique(self.first_doc[at], return_inverse=True)
                yield part, _pack(_steps(self.runs[at]), self.ids[docs], self.rows[docs], local.astype(np.uint32))

    def removed(self, answers: dict[int, bytes]) -> list[np.ndarray | None]:
        """Per document, which words go."""
        here = np.zeros(len(self.runs), bool)
        for part, at in enumerate(_split(self.runs, self.partitions)):
            if len(at):
                here[at] = _unpack(answers[part])[0]
        keep = here[self.run_place]
        keep &= self.first[self.run_place] == np.arange(len(self.run_place))
        out, lo = [None] * len(self.words), 0
        for i, at in zip(self.long, self.marks, strict=True):
            gone = at[~keep[lo : lo + len(at)]]
            lo += len(at)
            if len(gone):
                edge = np.zeros(len(self.words[i]) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + self.window, -1)
                out[i] = np.cumsum(edge[:-1]) > 0
        return out


def _table(chunk: int, kind: int, found) -> pa.Table:
    rows = list(found)
    return pa.table([[p for p, _ in rows], [chunk] * len(rows), [kind] * len(rows), [d for _, d in rows]], schema=ASK_SCHEMA)


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(*(table[c].to_pylist() for c in ("kind", "part", "data")), strict=True)
    return {p: d for k, p, d in rows if k == kind}


def _meet(asked: pa.Table) -> pa.Table:
    """One partition of the block index: for each window hash the number of its blocks, 2 at most."""
    index = []
    for data in asked["data"]:
        steps, blocks = _unpack(data.as_py())
        at = np.flatnonzero(blocks)
        index.append(np.repeat(np.cumsum(steps, dtype=np.uint32)[at], blocks[at]))
    blocks, counts = np.unique(np.concatenate(index), return_counts=True)
    out = []
    for data in asked["data"]:
        probe = np.cumsum(_unpack(data.as_py())[0], dtype=np.uint32)
        at = np.minimum(np.searchsorted(blocks, probe), max(len(blocks) - 1, 0))
        met = np.where(blocks[at] == probe, np.minimum(counts[at], 2), 0) if len(blocks) else np.zeros(len(probe))
        out.append(_pack(met.astype(np.uint8)))
    return asked.set_column(3, "data", pa.array(out, pa.binary()))


def _own(asked: pa.Table) -> pa.Table:
    """One partition of the runs: for each asking chunk, whether the earliest place of a run is its own."""
    parts = [_unpack(d.as_py()) for d in asked["data"]]
    hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    sizes = [len(h) for h in hashes]
    flat = np.concatenate(hashes)
    ids, rows = (np.concatenate([p[k][p[3]] for p in parts]) for k in (1, 2))
    order = np.lexsort((rows, ids, flat))
    first = np.ones(len(flat), bool)
    first[1:] = flat[order][1:] != flat[order][:-1]
    own = np.zeros(len(flat), np.uint8)
    own[order[first]] = 1
    out = [_pack(o) for o in np.split(own, np.cumsum(sizes)[:-1])]
    return asked.set_column(3, "data", pa.array(out, pa.binary()))


def deduplicate(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, their text without repeated passages (words joined by one space).

    ``n_words`` and ``n_removed`` are added, or replaced. A text that loses nothing is left as it was.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Other columns travel as one, so that none of their names can clash.
    others = [c for c in docs.columns if c not in ("doc_id", text, "n_words", "n_removed")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("__none"))
    raw = F.col(f"`{text}`").cast("binary")
    table = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"), rest.alias("rest")), CHUNK_ROWS)
    words = table.select("chunk", "row", "doc_id", "text")

    def ask(rows: pa.Table) -> pa.Table:
        return _table(rows["chunk"][0].as_py(), 0, Chunk(rows, window, partitions).ask_anchors())

    def extend(rows: pa.Table, answers: pa.Table) -> pa.Table:
        got = _answers(answers, 0)
        chunk = Chunk(rows, window, partitions)
        return _table(rows["chunk"][0].as_py(), 1, chunk.candidates(got).ask_runs())

    def remove(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(rows, window, partitions).candidates(_answers(answers, 0))
        gone = chunk.removed(_answers(answers, 1))
        texts, lost = [], []
        for t, g in zip(chunk.texts, gone, strict=True):
            raw = t.as_py()
            if g is not None:
                raw = b" ".join(w for w, out in zip(raw.split(), g.tolist(), strict=True) if not out)
            texts.append(raw)
            lost.append(0 if g is None else int(g.sum()))
        kept = rows.take(pa.array(chunk.order))
        left = pa.array([None if x is None else x.decode() for x in texts], pa.string())
        counts = [pa.array([len(w) for w in chunk.words], pa.int64()), pa.array(lost, pa.int64())]
        return pa.table([kept["doc_id"], left, kept["rest"], *counts], names=["doc_id", "text", "rest", "n_words", "n_removed"])

    by_chunk = words.groupBy("chunk")
    met = stored(by_chunk.applyInArrow(ask, ASK).groupBy("part").applyInArrow(_meet, ASK), "anchors")
    asked = by_chunk.cogroup(met.groupBy("chunk")).applyInArrow(extend, ASK)
    owned = stored(asked.groupBy("part").applyInArrow(_own, ASK), "runs")
    longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")]
    schema = T.StructType([table.schema["doc_id"], T.StructField("text", T.StringType()), table.schema["rest"], *longs])
    done = table.groupBy("chunk").cogroup(met.unionByName(owned).groupBy("chunk")).applyInArrow(remove, schema)
    own = {"doc_id": F.col("doc_id"), text: F.col("text").alias(text)}
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    return done.select(*[own[c] if c in own else F.col(f"rest.`{c}`") for c in names], "n_words", "n_removed")


def op6(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    done = deduplicate(docs.select("doc_id", "text"))
    # Texts that lost nothing still have their own white space.
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    kept = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.array_join(words, " "))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))
