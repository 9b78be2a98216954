"""Mixing sources to target weights by balanced sampling (the cube method).

Every document of a source has the same expected number of copies, target / size of the source,
between 0 and 2. The whole part is taken for certain. The fractional part is an inclusion
probability, and the cube method turns all of these into zeros and ones while it keeps two totals of
each source in place: tokens and documents. The flight moves three undecided documents at a time
along the null vector of the two constraints until one of them is decided. It runs in blocks of at
most a few thousand documents; what a block leaves undecided (two documents, and ``LANDING`` of all
sizes that are held back) flies again in the next level, until a source has a single block.

Three documents alone hardly move one that is far larger than the other two. In the last block, documents
with more than a ``LARGE``-th of its words therefore move first, each against all others together, along
the null vector closest to an even move. The documents held back are landed last: the document
total is given up, and of all their subsets the one nearest to the words still to be taken is chosen, the
nearest number of documents next. A source with several blocks whose words lie mostly in a few documents can still
miss its target by about half of such a document.

Defined results: null text has size 0; a null source is a source of its own, the last in order;
repeated rows are documents of their own, numbered among themselves so that no block gathers them; documents of size 0 are taken like any other but count no
words; an empty table gives no rows. Seeds come from source and block, so reruns agree however the
rows are partitioned. One row per source passes the driver, nothing else does.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.llm.chunks import chunked, of_rows
from keepwise.llm.common import stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
BLOCK_ROWS = 4096
LANDING = 12  # documents held back for the landing, which looks at all subsets of two more
LARGE = 64  # a document above this share of the words of a last block moves against all others
EPS = 1e-9


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> dict:
    """Target words per source: weights repeat over the sources in code point order, null last.

    A target stops at ``most`` times the source's size; what lies above is shared again by weight.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size = dict(order)
    left, fixed, free = share * sum(size.values()), {}, list(size)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > most * size[s]]
        if not above:
            return fixed | {s: unit * weight[s] for s in free}
        for s in above:
            fixed[s] = most * size[s]
            left -= fixed[s]
        free = [s for s in free if s not in fixed]
    return fixed


def _step(chance: list[float], trio: list[int], null: list[float], draw: float) -> None:
    """Move the chances of ``trio`` along ``null`` or against it until one of them is 0 or 1."""
    up = down = math.inf
    for i, u in zip(trio, null, strict=True):
        if u > 0:
            up, down = min(up, (1 - chance[i]) / u), min(down, chance[i] / u)
        elif u < 0:
            up, down = min(up, chance[i] / -u), min(down, (1 - chance[i]) / -u)
    move = up if draw * (up + down) < down else -down
    for i, u in zip(trio, null, strict=True):
        x = chance[i] + move * u
        chance[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x


def fly(chance: list[float], size: list[float], rng: random.Random) -> None:
    """Decide all but two of the chances, keeping their sum and their sum weighted by size."""
    active: list[int] = []
    for i in range(len(chance)):
        if not EPS < chance[i] < 1 - EPS:
            chance[i] = float(round(chance[i]))
            continue
        active.append(i)
        if len(active) == 3:
            a, b, c = (size[j] for j in active)
            null = [b - c, c - a, a - b] if a != b or b != c else [1.0, -1.0, 0.0]
            most = max(abs(u) for u in null)
            _step(chance, active, [u / most for u in null], rng.random())
            active = [j for j in active if 0 < chance[j] < 1]


def settle_large(chance: list[float], size: list[float], rng: random.Random) -> None:
    """Decide documents with more than a LARGE-th of the undecided words while more than the landing's are left."""
    p, s = np.array(chance), np.array(size)
    while True:
        free = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        big = free[np.argmax(s[free])] if len(free) else -1
        if len(free) <= LANDING + 2 or s[big] * LARGE <= s[free].sum():
            break
        rest = free[free != big]
        room = np.minimum(p[rest], 1 - p[rest])
        mean = np.average(s[rest], weights=room)
        spread = (room * (s[rest] - mean) ** 2).sum()
        null = np.zeros(len(p))
        if spread > EPS * max(mean, 1.0):
            null[rest] = room * ((mean - s[big]) / spread * (s[rest] - mean) - 1 / room.sum())
        else:  # equal sizes: no move keeps both totals, the words come first
            null[rest] = -room * s[big] / max((room * s[rest]).sum(), EPS)
        null[big] = 1.0
        null /= np.abs(null).max()
        with np.errstate(divide="ignore", invalid="ignore"):
            rise, fall = (1 - p) / np.abs(null), p / np.abs(null)
        up = np.where(null > 0, rise, np.where(null < 0, fall, np.inf))
        down = np.where(null > 0, fall, np.where(null < 0, rise, np.inf))
        first_up, first_down = int(np.argmin(up)), int(np.argmin(down))
        rises = rng.random() * (up[first_up] + down[first_down]) < down[first_down]
        at, move = (first_up, up[first_up]) if rises else (first_down, -down[first_down])
        p = np.clip(p + move * null, 0.0, 1.0)
        p[at] = round(p[at])  # the one that ends the move is decided, whatever the rounding
    chance[:] = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p)).tolist()


def held_back(chance: list[float], size: list[float]) -> list[int]:
    """LANDING undecided documents of all sizes, evenly spaced in their order by size."""
    free = sorted((i for i in range(len(chance)) if 0 < chance[i] < 1 and size[i] > 0), key=lambda i: size[i])
    if len(free) <= LANDING:
        return free
    return [free[k * (len(free) - 1) // (LANDING - 1)] for k in range(LANDING)]


def land(chance: list[float], size: list[float]) -> None:
    """Decide the last ones: the subset with the nearest words, then the nearest number, then the first."""
    left = [i for i in range(len(chance)) if 0 < chance[i] < 1]
    if not left:
        return
    p, s = np.array([chance[i] for i in left]), np.array([size[i] for i in left])
    members = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, number = np.abs(members @ s - p @ s).round(6), np.abs(members.sum(1) - p.sum()).round(6)
    best = members[np.lexsort((number, words))[0]]
    for i, taken in zip(left, best, strict=True):
        chance[i] = float(taken)


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: flight without the documents held back, and the landing if the source has no other block."""
    # Halving size classes: a document moves only against others whose sizes differ from each other.
    pdf = pdf.assign(klass=[int(s).bit_length() for s in pdf["size"]])
    pdf = pdf.sort_values(["klass", "unit", "size"], ascending=[False, True, True], kind="stable", ignore_index=True)
    pdf = pdf.drop(columns="klass")
    first = pdf.iloc[0]
    rng = random.Random(f"{first['number']}:{first['level']}:{first['block']}")
    chance, size = pdf["chance"].tolist(), pdf["size"].astype(float).tolist()
    if first["blocks"] == 1:
        settle_large(chance, size, rng)
    waiting = set(held_back(chance, size))
    flying = [i for i in range(len(chance)) if i not in waiting]
    flown = [chance[i] for i in flying]
    fly(flown, [size[i] for i in flying], rng)
    for i, c in zip(flying, flown, strict=True):
        chance[i] = c
    if first["blocks"] == 1:
        land(chance, size)
    return pdf.assign(chance=chance)


def _numbered(units: DataFrame) -> DataFrame:
    """``same``: 0, 1, ... among rows equal in unit, source and size.

    Rows are numbered within the partition they were written from and partitions follow each other, so equal rows never
    gather in one task.
    """
    key = ["unit", "source", "size"]
    placed = stored(units.withColumn("part", F.spark_partition_id()), "rows")
    counts = placed.groupBy(*key, "part").agg(F.count("*").alias("n"))
    every = Window.partitionBy(*key)
    before = F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*key, "part", before.alias("before"), F.sum("n").over(every).alias("all"))
    repeated = counts.filter("all > 1").select(*[F.col(c).alias(f"of_{c}") for c in (*key, "part")], "before")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key]
    joined = placed.join(repeated, [*same, F.col("part") == F.col("of_part")], "left")
    # Rows without an equal are not ranked: each is a group of its own by its row number.
    alone = F.when(F.col("before").isNull(), F.monotonically_increasing_id())
    within = F.row_number().over(Window.partitionBy(*key, "part", "alone").orderBy("part")) - 1
    ranked = joined.withColumn("alone", alone).withColumn("same", F.coalesce(F.col("before") + within, F.lit(0)))
    return ranked.select(*units.columns, F.col("same").cast("long").alias("same"))


def copies(units: DataFrame, block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = (), **rule) -> DataFrame:
    """(unit, source, size, *keep) with source_size, target and the copies taken of each row.

    ``unit`` is a long that deals and orders the rows of the blocks; equal units are separate rows.
    """
    spark = units.sparkSession
    given = [F.col("unit").cast("long").alias("unit"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size")]
    units = stored(_numbered(units.select(*given, *keep)), "units")
    totals = units.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    goal = targets([(r.source, r.s) for r in totals], **rule)
    rows = []
    for number, r in enumerate(sorted(totals, key=lambda r: (r.source is None, r.source or ""))):
        per = min(goal[r.source] / r.s, rule.get("most", MOST_COPIES)) if r.s else 0.0
        rows.append((number, r.source, r.s, float(goal[r.source]), math.floor(per), per - math.floor(per), r.n))
    plan = "number int, source string, source_size long, target double, whole int, chance double, n long"
    # One row per source, as collected above.
    goals = spark.createDataFrame(rows, plan)
    state = units.alias("u").join(F.broadcast(goals.alias("g")), F.col("u.source").eqNullSafe(F.col("g.source")))
    state = state.select("u.unit", "u.source", "u.size", "u.same", *[f"u.{c}" for c in keep], "number", "source_size", "target", "whole", "chance", F.col("n").alias("left"))
    done, level = None, 0
    while True:
        blocks = F.greatest(F.ceil(F.col("left") / block_rows), F.lit(1)).cast("long")
        state = state.withColumn("level", F.lit(level)).withColumn("blocks", blocks)
        state = state.withColumn("block", F.pmod(F.xxhash64("unit", "size", "same", F.lit(level)), "blocks"))
        most = state.agg(F.max("blocks")).first()[0]
        flown = stored(state.groupBy("number", "block").applyInPandas(_decide, state.schema), "flight")
        if most is None or most == 1:
            return (done.unionByName(flown) if done is not None else flown).select(
                "unit", "source", "size", *keep, "source_size", "target", (F.col("whole") + F.col("chance")).cast("int").alias("copies")
            )
        open_rows = (F.col("chance") > 0) & (F.col("chance") < 1)
        # Few rows of a block stay open, so the next level counts them anew.
        settled, state = flown.filter(~open_rows), flown.filter(open_rows)
        done = settled if done is None else done.unionByName(settled)
        counts = {r.number: r.n for r in state.groupBy("number").agg(F.count("*").alias("n")).collect()}
        again = spark.createDataFrame([(k, v) for k, v in counts.items()], "number int, left long")
        state = state.drop("left").join(F.broadcast(again), "number")
        level += 1


def mix(docs: DataFrame, text: str = "text", source: str = "source", **rule) -> DataFrame:
    """The documents, each repeated as often as the mix takes it; the columns stay as they were."""
    # The mixture depends on ids and texts, not on how the rows are numbered.
    unit, own = F.xxhash64("doc_id", text).alias("unit"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    numbered = chunked(docs.select(unit, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), own))
    units = numbered.select("unit", "source", "size", F.col("row").alias("at"))
    taken = copies(units, keep=("at",), **rule).filter("copies > 0").select(F.col("at").alias("row"), "copies")
    repeated = of_rows(numbered, taken).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, for every document."""
    units = docs.select(F.col("doc_id").alias("unit"), "source", word_count(F.col("text")).alias("size"))
    return copies(units).select(
        F.col("unit").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast(T.LongType()).alias("taken")
    )
