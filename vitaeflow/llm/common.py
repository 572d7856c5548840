"""Shared pieces of the corpus operators: lineage cuts, word rules, column access."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that separates words, as a regex class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"
#: Rows of a batch that is handed to Python, at most.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (local tests) a temporary folder is taken instead.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpus-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever the engine can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_in_batches(df: DataFrame, rows: int) -> DataFrame:
    """:func:`cut`, with batches of at most ``rows`` rows handed to Python while it runs."""
    conf, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(size)
    conf.set(size, str(rows))
    try:
        return cut(df)
    finally:
        conf.set(size, before)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, computed once, with ``name``: 0, 1, ... in the given order, which tells all rows apart.

    Rows are sorted by ranges; a range's first number follows from the sizes of those before it, of
    which there are as many as partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = (1 << 33) - 1  # the engine's own numbers hold the partition above 33 bits
    ranged = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_k", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("_k", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return ranged.join(F.broadcast(first), F.shiftright("_k", 33) == F.col("_part")).withColumn(name, F.col("_first") + F.col("_k").bitwiseAND(within)).drop("_k", "_part", "_first")


def arrow_map(df: DataFrame, function, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with batches of at most ``BATCH_ROWS`` rows from here on in the session: the
    engine's 10,000 long texts at once, in and out, take more memory than the work itself."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(size)) <= BATCH_ROWS:
        df.sparkSession.conf.set(size, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def trimmed(text: Column) -> Column:
    """Text without separating white space at its ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, in order; no words: empty array."""
    body = trimmed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.size(word_array(text)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""

    def hashable(field) -> Column:
        kind, column = field.dataType.simpleString(), F.col(f"`{field.name}`")
        return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column

    return F.xxhash64(*map(hashable, docs.schema))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["arrow_map", "cut", "cut_in_batches", "id_remainder", "let", "numbered", "read", "remove", "row_hash", "shared_dir", "text_or_empty", "trimmed", "word_array", "word_count"]
