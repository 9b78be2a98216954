"""Deterministic stratified splits and folds along a hash of the customer id.

Every class is laid out on the axis md5(id:seed) and cut where the wanted number of rows has
passed. Only the cut positions are computed, from grouped counts; assigning a row to its part
is then a comparison of its own hash with a few constants, so no row moves. Copies of an id
share a hash and therefore a part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.schema import ID, LABEL

# Seed, shares of test and of validation within the rest, fold count.
SEED = 42
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.25
FOLDS = 5

PREFIX_DIGITS = 3
HASH_DIGITS = 32
BUCKET_ROWS = 1_000_000


def id_hash(seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.col(ID).cast("string"), F.lit(str(seed))))


def proportional(total: int, sizes: dict) -> dict:
    """Share ``total`` out over classes by size, largest remainders first, then lowest class."""
    everything = sum(sizes.values())
    exact = {c: total * n / everything for c, n in sizes.items()}
    share = {c: math.floor(v) for c, v in exact.items()}
    order = sorted(sizes, key=lambda c: (-(exact[c] - share[c]), c))
    for c in order[: total - sum(share.values())]:
        share[c] += 1
    return share


def part_sizes(sizes: dict) -> dict:
    """Rows per class and part: test = ceil(20 %), validation = ceil(25 % of the rest)."""
    n = sum(sizes.values())
    n_test = math.ceil(TEST_SHARE * n)
    test = proportional(n_test, sizes)
    rest = {c: sizes[c] - test[c] for c in sizes}
    validation = proportional(math.ceil(VALIDATION_SHARE * (n - n_test)), rest)
    return {
        c: [("test", test[c]), ("validation", validation[c]), ("train", rest[c] - validation[c])]
        for c in sizes
    }


def fold_sizes(folds: int) -> Callable[[dict], dict]:
    """Equal consecutive ranges: fold f holds ranks with floor(rank * folds / n) = f."""

    def sizes_of(sizes: dict) -> dict:
        ends = {c: [math.ceil(n * (f + 1) / folds) for f in range(folds)] for c, n in sizes.items()}
        return {
            c: [(f, end - (e[f - 1] if f else 0)) for f, end in enumerate(e)] for c, e in ends.items()
        }

    return sizes_of


def assign(
    df: DataFrame,
    name: str,
    sizes_of: Callable[[dict], dict],
    stratum: str | None = LABEL,
    seed: int = SEED,
    digits: int = PREFIX_DIGITS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add column ``name`` with the part each row falls into.

    ``sizes_of`` maps class sizes to an ordered list of (part, rows) per class. Counts per
    class and hash prefix (at most classes x 16^digits rows come to the driver) show which
    prefixes hold a cut; these alone are counted by ever longer prefixes until few rows are
    left, and those are ordered.
    """
    cls = F.col(stratum) if stratum else F.lit(0)
    keyed = df.select(cls.alias("cls"), id_hash(seed).alias("h")).filter(F.col("cls").isNotNull())
    histogram = _histogram(keyed, digits)
    if not histogram:
        raise ValueError("no rows to split")
    parts = sizes_of({c: sum(h.values()) for c, h in histogram.items()})

    cuts = []
    for c, counts in histogram.items():
        end = 0
        for part, size in parts[c][:-1]:
            end += size
            if end < sum(counts.values()):
                cuts.append(_Cut(c, part, "", end, 0).descend(counts))
    length = digits
    while any(cut.rows > bucket_rows and len(cut.prefix) == length < HASH_DIGITS for cut in cuts):
        large = [cut for cut in cuts if cut.rows > bucket_rows and len(cut.prefix) == length]
        length = min(HASH_DIGITS, length + digits)
        finer = _histogram(keyed.filter(_near(large)), length)
        cuts = [cut.descend(finer[cut.cls]) if cut in large else cut for cut in cuts]
    starts = _starts(keyed, cuts)

    out = F.lit(None)
    for c, sizes in parts.items():
        inside = F.lit(sizes[-1][0])
        for part, _ in reversed(sizes[:-1]):
            inside = (
                F.when(id_hash(seed) < starts[(c, part)], F.lit(part)).otherwise(inside)
                if (c, part) in starts
                else F.lit(part)
            )
        out = F.when(cls == c, inside).otherwise(out)
    return df.withColumn(name, out)


@dataclass(frozen=True)
class _Cut:
    """A part ends ``offset`` rows into the hashes of ``cls`` that begin with ``prefix``."""

    cls: float
    part: object
    prefix: str
    offset: int
    rows: int

    def descend(self, counts: dict[str, int]) -> _Cut:
        before = 0
        for prefix in sorted(p for p in counts if p.startswith(self.prefix)):
            if before + counts[prefix] > self.offset:
                return replace(self, prefix=prefix, offset=self.offset - before, rows=counts[prefix])
            before += counts[prefix]
        raise ArithmeticError("the rows changed while they were counted")


def _histogram(keyed: DataFrame, digits: int) -> dict:
    prefix = F.substring("h", 1, digits).alias("prefix")
    found = defaultdict(dict)
    for row in keyed.groupBy("cls", prefix).agg(F.count("*").alias("n")).collect():
        found[row["cls"]][row["prefix"]] = row["n"]
    return found


def _near(cuts: list[_Cut]) -> Column:
    tests = [(F.col("cls") == cut.cls) & F.col("h").startswith(cut.prefix) for cut in cuts]
    return reduce(or_, tests, F.lit(False))


def _starts(keyed: DataFrame, cuts: list[_Cut]) -> dict:
    """Hash at which the part after each cut begins: the first id that starts past the cut."""
    if not cuts:
        return {}
    ids = keyed.filter(_near(cuts)).groupBy("cls", "h").agg(F.count("*").alias("n"))
    bucket = F.concat_ws("|", "cls", *[F.when(_near([c]), F.lit(c.prefix)) for c in _distinct(cuts)])
    before = Window.partitionBy(bucket).orderBy("h")
    placed = ids.withColumn("start", F.sum("n").over(before) - F.col("n"))
    firsts = [
        F.min(F.when(_near([cut]) & (F.col("start") >= cut.offset), F.col("h"))).alias(f"c{i}")
        for i, cut in enumerate(cuts)
    ]
    row = placed.agg(*firsts).first()
    # No such id in the bucket: the part begins with the next bucket, and 'g' follows every digit.
    return {(c.cls, c.part): row[f"c{i}"] or c.prefix + "g" for i, c in enumerate(cuts)}


def _distinct(cuts: list[_Cut]) -> list[_Cut]:
    return list({(c.cls, c.prefix): c for c in cuts}.values())


def split_data(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Column part: train / validation / test = 60 / 20 / 20 % within each class."""
    return assign(df, "part", part_sizes, seed=seed)


def with_folds(df: DataFrame, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Column fold: 0..folds-1, equal shares within each class."""
    return assign(df, "fold", fold_sizes(folds), seed=seed)


def holdout_sizes(sizes: dict) -> dict:
    """Test = ceil(20 %) of all rows, the rest is train."""
    return {
        c: [("test", n := math.ceil(TEST_SHARE * size)), ("train", size - n)] for c, size in sizes.items()
    }


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """(label, n, weight) with balanced weights n_all / (classes * n)."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    counted = counts.withColumn("_t", totals)
    return counted.select(label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight"))
