"""Session settings, the shared folder for written intermediate tables."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows that parallel fits may hold in memory together, each fit keeping a copy of its own.
ROWS_IN_FLIGHT = 12_000_000


def local_session(cpus: int | str = "*", app: str = "keepwise", **conf) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Wide generated code is faster split up than too large for the JIT compiler.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="keepwise-"))
    return sc.getCheckpointDir().rstrip("/")


def table_path(spark: SparkSession, name: str, *key: str) -> str:
    """Path in the shared folder for a table of this application."""
    digest = hashlib.md5("|".join(key).encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/keepwise/{spark.sparkContext.applicationId}/{digest}/{name}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table and return a scan of it, so that later plans prune and push down again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_at_once(rows: int, most: int) -> int:
    """How many fits over ``rows`` rows to run side by side: many when small, one when large.

    Only the scheduling depends on it; every fit sees the same rows either way.
    """
    return max(1, min(most, ROWS_IN_FLIGHT // max(rows, 1)))
