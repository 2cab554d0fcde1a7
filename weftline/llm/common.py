"""Shared folders, staged tables and group attachment used by the operators of this folder."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of bytes that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    Where both are unset, a local session, which has one machine only, gets a temporary folder; a cluster gets an error,
    as its executors don't share the driver's folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables and files of one operator call, in a new folder under the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: cuts lineage, and survives the loss of executors."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def small(self, df: DataFrame, name: str) -> DataFrame:
        """As table, in few files, for rows without texts that come out of a shuffle."""
        return self.table(df.coalesce(few_files(self.spark)), name)

    def folder(self, name: str) -> str:
        path = self._path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Have the driver's JVM drop plans that nothing refers to any more, whereupon Spark deletes their shuffle files; one collection alone was seen to leave them."""
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.3)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")


def few_files(spark: SparkSession, rows: int | None = None) -> int:
    """Tasks to coalesce to where each writes a file: an eighth of the shuffle's partitions, or one per 100,000 rows if their number is known, and four waves of tasks at least.

    Hadoop's local file system starts a chmod for each file (and one for its checksum) from the executor's JVM. Until
    that child has replaced its image it shares the JVM's memory, and counts as a second JVM of that size.
    """
    least = 4 * spark.sparkContext.defaultParallelism
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8 if rows is None else rows // 100_000)


def shrink_executors(spark: SparkSession) -> None:
    """Have each executor collect its garbage, whereupon its JVM returns the heap that it doesn't need to the system.

    An executor's heap grows with every stage and stays so, beside Python workers that hold memory of their own. There is
    a task for each executor, which an idle cluster deals to one each; where one is missed it keeps its heap, and results
    are the same. Twice, as one collection alone was seen to return a part only.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # without the driver
    for _ in range(2):
        spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def give_back() -> None:
    """Return what was freed to the system: Python workers outlive their tasks, and C's allocator keeps it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def open_shared(path: str):
    """(filesystem, path within it) of a shared path, for use in Python workers."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_shared(path: str, parts) -> int:
    """Write the byte strings of parts to path by way of a name of this attempt's own; returns the bytes written."""
    system, path = open_shared(path)
    own, size = f"{path}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    system.move(own, path)
    return size


def attach_groups(rows: DataFrame, groups: DataFrame, keys: list[str], row_key: str, total: int, most_heavy: int = 256) -> DataFrame:
    """Left-join groups (unique by keys, with its row count in column n) to rows.

    A group with more than total / most_heavy rows is heavy; there are fewer than most_heavy of those, so they are
    broadcast. Their rows, and those with a null key, go through the other, shuffled join under row_key instead of the
    group's key, so that no task gets a large group.
    """
    values = [c for c in groups.columns if c not in keys]
    limit = max(total // most_heavy, 1)
    heavy = groups.filter(F.col("n") > limit).select(*keys, *[F.col(c).alias(f"_h_{c}") for c in values])
    light = groups.filter(F.col("n") <= limit).select(F.xxhash64(*keys).alias("_l_spread"), *[F.col(k).alias(f"_l_{k}") for k in keys], *[F.col(c).alias(f"_l_{c}") for c in values])
    rows = rows.join(F.broadcast(heavy), keys, "left")
    alone = F.col("_h_n").isNotNull()
    for k in keys:
        alone = alone | F.col(k).isNull()
    rows = rows.withColumn("_spread", F.when(alone, F.xxhash64(F.col(row_key), F.lit(1))).otherwise(F.xxhash64(*keys)))
    on = [F.col("_spread") == F.col("_l_spread"), *[F.col(k) == F.col(f"_l_{k}") for k in keys]]
    rows = rows.join(light, on, "left")
    return rows.drop("_spread", "_l_spread", *[f"_l_{k}" for k in keys]).withColumns({c: F.coalesce(f"_h_{c}", f"_l_{c}") for c in values}).drop(*[f"_{x}_{c}" for x in "hl" for c in values])


def words_in(text: Column) -> Column:
    """How many words text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def crc_mod(name: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "utf-8")) % modulus
