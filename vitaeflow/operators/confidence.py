"""Confidence of extractions, a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.functions import scoring


def score(extractions: DataFrame) -> DataFrame:
    """Sets confidence from match quality, attributes, length of the text and type."""
    texts = [F.col(c) for c in ("summary_cn", "trigger_context", "consequence", "reason")]
    value = scoring.confidence(
        scoring.match_quality(F.col("source_location.match_type")),
        scoring.attribute_completeness(texts, F.col("related_entities")),
        scoring.text_specificity(F.col("text")),
        scoring.type_consistency(F.col("type")),
    )
    return extractions.withColumn("confidence", value)
