"""Documents in a bucketed table of numbered chunks.

Operators that ask a question about every word and put the answers back by position need the same
documents twice, in the same order. They are written once, numbered by where the writing task stood, as
a table bucketed by chunk. Answers keyed by chunk then join the table without shuffling a text again.
A chunk is at most ``CHUNK_ROWS`` consecutive rows of one input partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import scratch_path

CHUNK_ROWS = 2000
PARTITION_BITS = 22  # chunk numbers per input partition


def chunk_of(row: Column, rows: int = CHUNK_ROWS) -> Column:
    """The chunk that holds a row of this number."""
    # The upper bits are the partition, the lower 33 the position in it.
    position = row.bitwiseAND((1 << 33) - 1)
    return F.shiftright(row, 33) * (1 << PARTITION_BITS) + F.floor(position / rows).cast("long")


def chunked(docs: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """The documents with ``chunk`` and ``row`` (their order), bucketed by chunk in the shared folder."""
    spark = docs.sparkSession
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("chunk", chunk_of(F.col("row"), rows))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    name = f"keepwise_chunks_{uuid.uuid4().hex}"
    # Each task writes its own few chunks, so there are few files and no shuffle.
    out = numbered.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", scratch_path(spark, name)).option("compression", "zstd")
    out = out.option("parquet.compression.codec.zstd.level", "9")
    out.format("parquet").saveAsTable(name)
    return spark.table(name)


def of_rows(table: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of a chunked ``table`` joined to ``more`` by row; ``more`` has (row, ...), each row at most once.

    The chunk alone is the key, so the table is read by bucket and not shuffled; inside a chunk, which has few rows,
    the row decides. Two bounds say so, since an equality would become a key that the buckets do not have.
    """
    asked = more.withColumn("chunk", chunk_of(F.col("row"))).alias("m")
    same = (F.col("t.row") >= F.col("m.row")) & (F.col("t.row") <= F.col("m.row"))
    joined = table.alias("t").join(asked, (F.col("t.chunk") == F.col("m.chunk")) & same, how)
    if how == "left_semi":
        return joined
    return joined.select("t.*", *[F.col(f"m.`{c}`") for c in more.columns if c != "row"])
