"""Near-duplicates by MinHash with tensored banding, candidates verified on whole shingle sets.

Two collections of ``m`` partial keys are computed per document, each key from ``HALF`` minhashes. The
key of table (i, j) combines key i of the first collection with key j of the second, so ``m * m`` tables
need ``2 * m * HALF`` minhashes instead of ``2 * HALF * m * m``. ``m`` follows from the threshold: a
pair at the threshold meets in no table with probability ``MISS`` at most.

1. Documents with equal shingle sets become one class (pre-aggregated by a digest of the set), so
   thousands of exact copies are one row from here on.
2. Partial keys that no other class has cannot meet; only classes that share a key of both collections
   go into the tables.
3. In each table group every class is paired with the group's smallest class: as many pairs as rows,
   however large the group. The pairs are verified on full sets, links grow into components.
4. Where a group still holds several components, members of different components may be linked
   without being linked to the smallest. Classes without a link get a home, the largest open group they
   are in; components are homes of their own. Members of open groups are compared by sketch, one
   byte per minhash, in blocks; a group of k members has sqrt(k / ``SKETCH_BLOCK``) of them, so a member is copied
   seldom and a block stays small. A class that cannot be ruled out for a member of a
   home (within ``SLACK`` standard deviations of the threshold, and by set size) leaves the task as
   one row (class, home), however many members it resembles, and is then compared with all
   members of that home on full sets, again in blocks. Only links leave those tasks.

Verification sends each class's text to the centres it is compared with; a centre with many
members is dealt to several tasks, each with a copy of the centre. A pair at the threshold is missed
with probability ``MISS`` at most, more similar ones far more rarely; nothing else is left out.

Defined results: null texts and texts without words have an empty set and link with nothing; with fewer
words than a shingle the whole sequence is one; rows sharing an id are documents of their own, and a
component is named by the smallest id of its rows; rows without an id are kept, link with nothing and
have no component; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.chunks import chunked, of_rows
from keepwise.llm.common import WordHashes, mix64, stored
from keepwise.llm.components import components

HALF = 4
MISS = 3e-4
MEMBERS_PER_TASK = 2000
BLOCK_MEMBERS = 512
SKETCH_BLOCK = 2048  # members of a group whose sketches are compared in one task
SLACK = 5.0
BLOCK = 1 << 15


def tables_per_side(similarity: float, miss: float = MISS, half: int = HALF) -> int:
    """Partial keys per collection so that a pair at the threshold is missed with ``miss`` at most."""
    return math.ceil(math.log(miss / 2) / math.log(1 - similarity**half))


def shingle_set(text: bytes | None, words: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; letters A-Z count as a-z."""
    h = words.of((text or b"").lower().split())
    if not len(h):
        return h
    n = min(size, len(h))
    runs = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            runs = (runs + h[i : i + len(runs)]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
        return np.unique(mix64(runs + np.uint64(n)))


def signatures(sets: list[np.ndarray], m: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, 2 * m) partial keys, and a byte of every minhash; sets must not be empty."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, 2 * m * HALF, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, 2 * m * HALF, np.uint64)
    out = np.empty((len(sets), 2 * m), np.uint64)
    sketch = np.empty((len(sets), len(odd)), np.uint8)
    with np.errstate(over="ignore"):
        for lo, hi in _blocks(sets):
            flat = np.concatenate(sets[lo:hi])
            starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
            for key in range(2 * m):
                part = np.full(hi - lo, key, np.uint64)
                for i in range(key * HALF, key * HALF + HALF):
                    x = flat * odd[i] + add[i]
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xD6E8FEB86659FD93)
                    least = mix64(np.minimum.reduceat(x, starts))
                    sketch[lo:hi, i] = least >> np.uint64(56)
                    part = mix64(part * np.uint64(0x9E3779B97F4A7C15) + least)
                out[lo:hi, key] = part
    return out, sketch


def _blocks(sets: list[np.ndarray]):
    """Ranges of documents with about BLOCK shingles together."""
    lo = total = 0
    for i, s in enumerate(sets):
        total += len(s)
        if total >= BLOCK:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sets):
        yield lo, len(sets)


def _sign(size: int, m: int):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, size) for t in batch.column(2)]
            full = [s for s in sets if len(s)]
            keys, sketches = signatures(full, m) if full else ([], [])
            rows = iter(zip(keys.view(np.int64), sketches, strict=True) if full else [])
            lists = [next(rows) if len(s) else (None, None) for s in sets]
            sizes, digests = pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_digest, sets), pa.binary())
            keys = pa.array([k for k, _ in lists], pa.list_(pa.int64()))
            sketches = pa.array([k if k is None else k.tobytes() for _, k in lists], pa.binary())
            columns = [batch.column(0), batch.column(1), sizes, digests, keys, sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "n_shingles", "digest", "keys", "sketch"])

    return run


def _digest(s: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _verify(size: int, percent: int):
    """Compare members with their centre; rows of a group come together, the centre first."""

    def run(batches):
        words, at, centre = WordHashes(), None, None
        for batch in batches:
            us, vs = [], []
            for u, salt, v, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text, words, size)
                if u == v:
                    at, centre = (u, salt), own
                elif at != (u, salt):
                    raise ValueError(f"the text of class {u} is missing")
                elif percent * max(len(centre), len(own)) <= 100 * min(len(centre), len(own)):
                    both = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(own) - both):
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _routed(routes: DataFrame, texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Texts of classes sent where ``routes`` (id, to) says, ``to.copies`` times each; ``copy`` counts these.

    ``texts`` (chunk, row, text) are found by row number where they were written, so a doc_id or a text that many rows
    share is no group here, and only texts with a route are moved. Copies are made after the join: a route is one entry,
    however many it stands for. ``known`` has more columns by id.
    """
    gathered = routes.groupBy("id").agg(F.collect_list("to").alias("to"))
    more = [c for c in known.columns if c != "id"] if known is not None else []
    gathered = gathered.join(known, "id") if more else gathered
    sent = of_rows(texts, gathered.withColumnRenamed("id", "row"))
    sent = sent.select(F.explode("to").alias("to"), F.col("row").alias("id"), *more, "text")
    return sent.select("to.*", F.explode(F.sequence(F.lit(0), F.col("to.copies") - 1)).alias("copy"), "id", *more, "text")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough.

    Every text goes once to each centre u it is compared with; a centre with many members is dealt
    to several tasks.
    """
    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("salts"))
    salt, one = F.pmod(F.xxhash64("v"), "salts").cast("int"), F.lit(1)
    members = pairs.join(counts, "u").select(F.col("v").alias("id"), F.struct("u", salt.alias("salt"), one.alias("member"), one.alias("copies")).alias("to"))
    first = F.lit(0)
    centres = counts.select(F.col("u").alias("id"), F.struct("u", first.alias("salt"), first.alias("member"), F.col("salts").alias("copies")).alias("to"))
    dealt = _routed(members.unionByName(centres), texts).withColumn("salt", F.col("salt") + F.col("copy"))
    ordered = dealt.repartition("u", "salt").sortWithinPartitions("u", "salt", "member", "id")
    return ordered.select("u", "salt", "id", "text").mapInArrow(_verify(size, percent), "u long, v long")


def _verify_parts(size: int, percent: int, least: int):
    """Compare classes with the members of a home; the rows of a block pair come together."""

    def compare(rows: list[tuple], joined: bool) -> list[tuple[int, int]]:
        members = [r for r in rows if r[0]]
        if not members or len(members) == len(rows):
            return []
        sketch = np.frombuffer(b"".join(r[2] for r in members), np.uint8).reshape(len(members), -1)
        sizes, out, root = np.array([len(r[3]) for r in members]), [], {}

        def head(i: int) -> int:
            while root.get(i, i) != i:
                i = root[i]
            return i

        for _, x, own_sketch, own in (r for r in rows if not r[0]):
            fits = percent * np.maximum(sizes, len(own)) <= 100 * np.minimum(sizes, len(own))
            alike = (sketch == np.frombuffer(own_sketch, np.uint8)).sum(1)
            fits &= alike >= least
            for i in sorted(np.flatnonzero(fits), key=lambda i: -alike[i]):
                y = members[i][1]
                if head(x) == head(y):
                    continue
                both = len(np.intersect1d(members[i][3], own, assume_unique=True))
                if 100 * both >= percent * (len(own) + sizes[i] - both):
                    out.append((x, y))
                    root[head(x)] = head(y)
                    if joined:  # the members are linked already, so one link is enough
                        break
        return out

    def run(batches):
        words, at, rows = WordHashes(), None, []
        for batch in batches:
            found = []
            for part, x, y, member, i, sketch, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text, words, size)
                if (part, x, y) != at:
                    found += compare(rows, at is not None and at[0] >= 0)
                    at, rows = (part, x, y), []
                rows.append((member, i, sketch, own))
            yield _links(found)
        yield _links(compare(rows, at is not None and at[0] >= 0))

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def verified_parts(near: DataFrame, parts: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, least: int) -> DataFrame:
    """Links between classes x and members of the homes ``part`` in ``near`` (x, part).

    ``parts`` has (id, part) of all homes. A home is cut into blocks of members and the classes that
    ask for it into blocks too; every pair of blocks is one small group.
    """
    asked = near.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("xs"))
    inside = parts.join(asked, "part")
    shape = inside.groupBy("part").agg(F.first("xs").alias("xs"), F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("ys"))

    def block(of: str, n: str):
        return F.pmod(F.xxhash64(of), n).cast("int")

    def routes(df: DataFrame, member: int, x, y, copies: str) -> DataFrame:
        to = F.struct("part", x.alias("x"), y.alias("y"), F.lit(member).alias("member"), F.col(copies).alias("copies"))
        return df.select("id", to.alias("to"))

    # A member meets every block of askers and an asker every block of members: ``copy`` is that block.
    members = routes(inside.select("id", "part").join(shape, "part"), 1, F.lit(0), block("id", "ys"), "xs")
    asking = routes(near.withColumnRenamed("x", "id").join(shape, "part"), 0, block("id", "xs"), F.lit(0), "ys")
    x = F.when(F.col("member") == 1, F.col("copy")).otherwise(F.col("x"))
    y = F.when(F.col("member") == 1, F.col("y")).otherwise(F.col("copy"))
    sent = _routed(members.unionByName(asking), texts, classes.select("id", "sketch"))
    dealt = sent.select("part", x.alias("x"), y.alias("y"), "member", "id", "sketch", "text").repartition("part", "x", "y")
    ordered = dealt.sortWithinPartitions("part", "x", "y", "id")
    return ordered.mapInArrow(_verify_parts(size, percent, least), "u long, v long")


def table_groups(classes: DataFrame, m: int) -> DataFrame:
    """(table, first, id): the classes in the m * m tables, without those that share no partial key.

    ``first`` is the partial key of the first collection, which m tables of a class have in common.
    """
    keys = classes.select("id", F.posexplode("keys").alias("pos", "key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key")
    first = F.col("pos") < m
    live = keys.join(shared, "key", "left_semi").groupBy("id").agg(
        F.collect_list(F.when(first, F.col("key"))).alias("a"), F.collect_list(F.when(~first, F.col("key"))).alias("b")
    )
    # Groups here are the 2 * m keys of one class. Combine every pair of them.
    tensor = live.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y"))
    return tensor.select(F.xxhash64("x", "y").alias("table"), F.col("x").alias("first"), "id")


def open_groups(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(table, first, id, component, k): groups that still hold several components, with their size."""
    placed = groups.join(found, "id", "left")
    part = F.coalesce("component", "id")
    several = placed.groupBy("table").agg(F.min(part).alias("lo"), F.max(part).alias("hi"), F.count("*").alias("k"))
    return placed.join(several.filter("lo < hi").select("table", "k"), "table")


def homes(rest: DataFrame, found: DataFrame) -> DataFrame:
    """(id, part): components, and for unlinked classes their largest open group as a negative number."""
    alone = rest.filter("component is null").groupBy("id").agg(F.max(F.struct("k", "table")).alias("m"))
    group = F.bitwise_not(F.shiftrightunsigned("m.table", 1))
    return found.select("id", F.col("component").alias("part")).unionByName(alone.select("id", group.alias("part")))


def least_alike(m: int, percent: int) -> int:
    """Bytes of a sketch that agree at least when two sets reach the threshold."""
    bits, chance = 2 * m * HALF, percent / 100
    chance += (1 - chance) / 256
    return math.floor(bits * chance - SLACK * math.sqrt(bits * chance * (1 - chance)))


def _plausible(least: int, percent: int):
    """(x, part) of one block pair: classes that may be linked with a member of a home, smaller home to larger."""

    def compare(rows: list[tuple]) -> np.ndarray:
        ids, parts, homes, weight, sizes = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        own = np.array([r[6] for r in rows])
        sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        out = []
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            fits = parts[rest] != parts[i]
            fits &= percent * np.maximum(sizes[rest], sizes[i]) <= 100 * np.minimum(sizes[rest], sizes[i])
            if rows[i][7]:  # two blocks: only across
                fits &= own[rest] != own[i]
            at = np.flatnonzero(fits) + i + 1
            at = at[(sketch[at] == sketch[i]).sum(1) >= least]
            small = (weight[at] < weight[i]) | ((weight[at] == weight[i]) & (homes[at] <= homes[i]))
            out.append(np.stack([np.where(small, ids[at], ids[i]), np.where(small, homes[i], homes[at])], 1))
        return np.unique(np.concatenate(out), axis=0)

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["x", "part"])

    def run(batches):
        at, rows, out = None, [], []
        for batch in batches:
            done = []
            for *key, x, y, i, part, home, weight, n, sketch, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (*key, x, y) != at:
                    if len(rows) > 1:
                        out.append(compare(rows))
                    if at and key[0] != at[0]:
                        done += out
                        out = []
                    at, rows = (*key, x, y), []
                rows.append((i, part, home, weight, n, sketch, own, x != y))
            yield pairs(done)
        if len(rows) > 1:
            out.append(compare(rows))
        yield pairs(out)

    return run


def sketch_blocks(k: Column) -> Column:
    """Blocks of a group of k members: each member is copied so often, and a block has sqrt(k * SKETCH_BLOCK) members."""
    return F.ceil(F.sqrt(k / SKETCH_BLOCK)).cast("int")


def open_pairs(rest: DataFrame, classes: DataFrame, parts: DataFrame, m: int, percent: int) -> DataFrame:
    """Distinct (x, part): classes and homes that a sketch cannot rule out."""
    blocks = sketch_blocks(F.col("k"))
    rows = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    weights = parts.groupBy("part").agg(F.count("*").alias("weight"))
    known = classes.select("id", F.col("n_shingles").alias("n"), "sketch").join(parts, "id").join(weights, "part")
    rows = rows.join(known, "id").withColumn("component", F.coalesce("component", "id"))
    # Tables with a partial key in common come to one task, which names each (x, part) of them once.
    x, y = F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    dealt = rows.select("first", "table", x, y, "id", "component", "part", "weight", "n", "sketch", "own").repartition("first", "x", "y")
    ordered = dealt.sortWithinPartitions("first", "table", "x", "y")
    return ordered.mapInArrow(_plausible(least_alike(m, percent), percent), "x long, part long").distinct()


def near_duplicates(numbered: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """uid, doc_id, n_shingles, component_id, kept and first for every row of the chunked table ``numbered`` (doc_id, text).

    ``uid`` is the row of the table. ``kept`` marks rows with the smallest doc_id of their component, ``first`` one row of
    each component.
    """
    percent, m = round(100 * similarity), tables_per_side(similarity)
    texts = numbered.select("chunk", "row", F.col("text").cast("binary").alias("text"))
    rows = numbered.select(F.col("row").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "uid long, doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary"
    signed = stored(rows.mapInArrow(_sign(size, m), schema), "signed")
    known = signed.filter("digest is not null and doc_id is not null")
    firsts = stored(known.groupBy("digest").agg(F.min("uid").alias("id")), "firsts")
    classes = known.join(firsts, "digest").filter("uid = id").drop("uid")
    groups = stored(table_groups(classes, m), "groups")
    classes = classes.drop("keys")

    # Every class against the smallest of its group: no more pairs than rows.
    centres = groups.groupBy("table").agg(F.min("id").alias("u"), F.max("id").alias("hi")).filter("u < hi").drop("hi")
    pairs = stored(groups.join(centres, "table").filter("id <> u").select("u", F.col("id").alias("v")).distinct(), "pairs")
    links = stored(verified(pairs, texts, size, percent), "verified")
    found = stored(components(links), "components")

    rest = stored(open_groups(groups, found), "open")
    parts = stored(homes(rest, found), "homes")
    near = stored(open_pairs(rest, classes, parts, m, percent), "near")
    more = verified_parts(near, parts, classes, texts, size, percent, least_alike(m, percent))
    found = components(links.unionByName(more))

    # From classes to rows; the smallest doc_id names a component.
    row_class = known.select("uid", "doc_id", "digest").join(firsts, "digest").select("uid", "doc_id", "id")
    placed = row_class.join(found, "id", "left").select("uid", "doc_id", F.coalesce("component", "id").alias("c"))
    names = placed.groupBy("c").agg(F.min(F.struct("doc_id", "uid")).alias("head"))
    named = placed.join(names, "c").select("uid", F.col("head.doc_id").alias("component_id"), F.col("head.uid").alias("head"))
    out = signed.select("uid", "doc_id", "n_shingles").join(named, "uid", "left")
    component = F.coalesce("component_id", "doc_id")
    kept, first = component.eqNullSafe(F.col("doc_id")), F.coalesce("head", "uid") == F.col("uid")
    return out.select("uid", "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), first.alias("first"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component, the one with the smallest id, with the columns it had."""
    # The columns travel as one, so that none of their names can clash.
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    numbered = chunked(docs.select("doc_id", "text", others))
    found = near_duplicates(numbered, size, similarity).filter("first").select(F.col("uid").alias("row"))
    kept = of_rows(numbered, found, "left_semi")
    return kept.select(*["text" if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def op1(docs: DataFrame) -> DataFrame:
    """Three-word shingles, similarity 0.85."""
    return near_duplicates(chunked(docs.select("doc_id", "text")), 3, 0.85).drop("uid", "first")
