"""Knowledge-graph nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.functions.scoring import rounded
from vitaeflow.functions.text import filled, squeeze

NODE_TYPES = ("entity", "rule", "constraint", "event", "state")
THRESHOLD = 0.3


def _sure(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def nodes(extractions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, ord, name, entityType, observations) of the general types."""
    summary, text = filled(F.col("summary_cn")), filled(F.col("text"))
    line = F.col("source_location.line")
    notes = F.array(
        summary,
        F.when(line > 0, F.concat(F.lit("Source: "), F.coalesce("source_file", F.lit("unknown")), F.lit(":"), line.cast("string"))),
        F.when(F.col("confidence").isNotNull(), F.format_string("Confidence: %.2f", rounded(F.col("confidence"), 2))),
        *(F.concat(F.lit(f"{k}: "), filled(F.col(k))) for k in ("trigger_context", "consequence", "reason")),
        F.when(summary.isNull(), F.concat(F.lit("Text: "), F.substring(text, 1, 100))),
    )
    name = F.coalesce(F.substring(summary, 1, 50), F.substring(squeeze(text), 1, 50), F.concat_ws("_", F.lit("Entity"), "doc_key", F.col("ord").cast("string")))
    return _sure(extractions, threshold).filter(F.col("type").isin(*NODE_TYPES)).select("doc_key", "ord", name.alias("name"), F.col("type").alias("entityType"), F.array_compact(notes).alias("observations"))


def edges(extractions: DataFrame, inferred: DataFrame, threshold: float = THRESHOLD, keep_types: bool = False) -> DataFrame:
    """(doc_key, from, to, relationType); inferred ones are relates_to unless ``keep_types``."""
    told = _sure(extractions, threshold).filter(F.col("type") == "relation").select("doc_key", "from", "to", F.coalesce("relation_type", F.lit("relates_to")).alias("relationType"))
    kind = F.col("type") if keep_types else F.lit("relates_to")
    return told.unionByName(_sure(inferred, threshold).select("doc_key", "from", "to", kind.alias("relationType")))
