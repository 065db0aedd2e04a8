"""Session plumbing shared by the operators: shared work tables, worker paths, label folds."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, one machine).
DEFAULT_WORK_DIR = "/tmp/checkpoints"
#: Shares of a group that are ranked apart before the group is.
SALTS = 32
#: Longest text, in bytes, that a model learns from. Every text is scored whole.
MOST_BYTES = 1 << 15


def with_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package travels with ``--py-files``; there the extra
    search path points nowhere and is harmless.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; a cluster must name one in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = DEFAULT_WORK_DIR
    return f"{base.rstrip('/')}/pagewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the work table that ``df`` reads, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/pagewright/" in f:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: lost executors cost a re-read, not a recomputation.
    """
    path = work_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def fold_of(ids: pa.Array, n: int) -> np.ndarray:
    """The same for a batch of ids; a null id counts as fold 0."""
    return np.array([zlib.crc32(str(i).encode()) % n if i is not None else 0 for i in ids.to_pylist()], np.int64)


def bounded_sample(df: DataFrame, by: list[str], key: str, per_group: int) -> DataFrame:
    """At most ``per_group`` different rows of each group, the same ones on every run.

    Only the columns of ``df`` travel, so pass ids, not texts. Repeated rows count once.
    Each group is first cut down in ``SALTS`` shares, each to twice its part of
    ``per_group`` and some, so no task ranks more than about that, however large the group is.
    """
    from pyspark.sql import Window

    order = [F.xxhash64(key, F.lit(1)), F.col(key)]
    df = df.distinct()
    for parts, most in (([*by, F.pmod(F.xxhash64(key), F.lit(SALTS))], 2 * per_group // SALTS + 64), (by, per_group)):
        w = Window.partitionBy(*parts).orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")
    return df


def texts_of(rows: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """One text for each of the ``picked`` keys (a bounded number, broadcast), of those that repeat the one with the least hash.

    Texts of over ``MOST_BYTES`` teach nothing, so what reaches the driver is bounded too.
    """
    found = rows.filter(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(picked), keys)
    return found.groupBy(*picked.columns).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select(*picked.columns, F.col("m.text").alias("text"))


def first_by_hash(df: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """The ``most`` rows of ``df`` whose hash of ``key`` is least; ``n`` is the number of its rows.

    Rows whose hash cannot be among them go before the sort. Without that, every
    partition would send its own ``most`` rows to the one task that merges them.
    """
    share = (2 * most + 100) / max(1, n)  # so many pass that fewer than ``most`` is out of the question
    if share < 0.5:
        df = df.filter(F.xxhash64(key) < F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(F.xxhash64(key)).limit(most)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind, column = np.int32, column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets.

    Memory of the vectorised operators follows ``limit`` or the longest single text.
    """
    data, offsets = texts(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
