"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import stored


def _digest(links: DataFrame):
    """Number and order-free checksum of the links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest one: the larger neighbours (large) or the smaller ones and itself."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # The join on a may meet one node with most links; adaptive execution splits that partition.
    hung = pairs.join(least, "a")
    if large:
        return hung.filter("b > a").select(F.col("m").alias("u"), F.col("b").alias("v"))
    return hung.select(F.col("m").alias("u"), F.col("b").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("a").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node with a link; component is the smallest reachable id.

    ``links`` has columns u and v. Every round is written to the shared folder; the number of rounds
    is logarithmic in the length of chains.
    """
    smaller, larger = F.least("u", "v"), F.greatest("u", "v")
    links = stored(links.filter("u <> v").select(smaller.alias("u"), larger.alias("v")).distinct(), "links")
    before = _digest(links)
    while before[0]:
        both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
        big = _star(both, True).filter("u <> v").distinct()
        # From the larger to the smaller end.
        down = big.select(F.col("v").alias("a"), F.col("u").alias("b"))
        small = _star(down, False).filter("u <> v").distinct()
        links = stored(small, "links")
        after = _digest(links)
        if after == before:
            break
        before = after
    heads = links.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return heads.distinct().unionByName(links.select(F.col("v").alias("id"), F.col("u").alias("component")))
