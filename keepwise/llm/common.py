"""Helpers the operators share: word patterns, written intermediate tables, seeds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.session import table_path, write_table

# Words are runs of anything but ASCII white space; bytes.split() cuts at the same bytes.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASK = (1 << 64) - 1


def word_count(text: Column) -> Column:
    """Number of white-space separated words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` would also map letters such as the Kelvin sign."""
    return F.translate(text, UPPER, UPPER.lower())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return table_path(spark, name, "llm", uuid.uuid4().hex)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder: lineage ends here and lost executors cost nothing."""
    return write_table(df, scratch_path(df.sparkSession, name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x):
    """Finaliser of a 64-bit hash, on a numpy array of unsigned words (changed in place)."""
    import numpy as np

    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered; forgets everything when it has grown large."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
