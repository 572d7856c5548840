"""Watches a folder of extraction files and post-processes what arrives.

Every micro-batch runs the batch pipeline, written under its number, so that a batch which is run
again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitaeflow.config import PipelineConfig
from vitaeflow.functions.filename import stem
from vitaeflow.operators.keys import remove
from vitaeflow.plans import pipeline
from vitaeflow.schema import EXTRACTION
from vitaeflow.sources.extractions import items


def watch(spark: SparkSession, extractions: str, documents: DataFrame, out: str, checkpoint: str, config: PipelineConfig | None = None, once: bool = False) -> StreamingQuery:
    """Start the stream; with ``once`` it takes what is there and ends."""
    files = spark.readStream.format("text").option("wholetext", True).load(extractions)
    rows = files.select(stem(F.col("_metadata.file_path")).alias("doc_key"), F.posexplode(items(F.col("value"))).alias("ord", "x")).select("doc_key", "ord", "x.*")

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.select(*EXTRACTION.fieldNames()).persist()
        result = pipeline.run(documents, rows, config)
        result.extractions.write.mode("overwrite").parquet(f"{out}/extractions/batch={number}")
        result.relations.write.mode("overwrite").parquet(f"{out}/relations/batch={number}")
        remove(batch.sparkSession, result.folder)
        rows.unpersist()

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
