"""Session set-up."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it; on a cluster ship it with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/pagewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so it is computed once."""
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(spark: SparkSession, df: DataFrame, name: str, by: str, most: int = 128) -> DataFrame:
    """``written`` in buckets by a column, so that joins and windows by it move no rows. Every task writes a file a bucket, hence the limit."""
    table, n = f"pagewright_{name}_{uuid.uuid4().hex[:12]}", min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("compression", "zstd").option("path", work_path(spark, name)).bucketBy(n, by).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out.schema  # resolved, so the catalog needs the name no longer; the files stay
    spark.sql(f"DROP TABLE {table}")
    return out


def positions(spark: SparkSession, df: DataFrame, *order) -> DataFrame:
    """``df`` with ``position``, its place from 0 in the given order, which must be total.

    Rows are sorted by ranges; each range numbers its own rows, and one count for each range reaches the driver.
    """
    df = written(spark, df, "unsorted")  # a sort by ranges reads its input twice
    rows = written(spark, df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    before, ahead = 0, []
    for p, n in sorted(tuple(r) for r in rows.groupBy(part.alias("p")).count().collect()):
        ahead.append((p, before))
        before += n
    ahead = F.broadcast(spark.createDataFrame(ahead, "_part long, _before long"))
    rows = rows.join(ahead, part == F.col("_part"))
    return rows.withColumn("position", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
