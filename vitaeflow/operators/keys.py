"""Dense surrogate keys in the order of a column, without a single task for all rows; lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, in local sessions, a temporary one is taken."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='extractions-')}")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame, folder: str) -> DataFrame:
    """Like :func:`cut`, in columns, which takes less of the disk, in a folder that whoever named it removes."""
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever the engine can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def meanwhile(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A :func:`keep` whose rows go at the end."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    try:
        yield lambda df: keep(df, folder)
    finally:
        remove(spark, folder)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is computed at once in here leaves no shuffle files: they go with the job that wrote them instead of
    when the driver happens to collect its garbage. DataFrames that are made in here and used later shuffle anew."""
    conf, name = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def many(spark: SparkSession) -> int:
    """How many tasks much work on rows is dealt to: small tables would be dealt to a few only, by their bytes."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def told(held: list[list], kinds: dict[str, pa.DataType], least: int = 1) -> Iterator[pa.RecordBatch]:
    """The columns that a task has gathered as one batch, once they hold ``least`` rows; then they are empty."""
    if len(held[0]) >= least:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, kinds.values(), strict=True)], names=list(kinds))
        for c in held:
            c.clear()


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to all cores. For much work on narrow rows: a small file of many rows is read by
    one task or a few, whatever the number of cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def numbered(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """Adds ``name``: after + 1, after + 2, ... in the given order.

    Rows are put into ranges, which are kept in the shared folder; a range's first number follows from the counts of those before it, of
    which there are as many as partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_k", within).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_k") + F.lit(after)).drop("_part", "_k", "_first")
