"""Counts over a batch of extractions: one aggregation for the numbers, one for each breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by(df: DataFrame, column, name: str) -> DataFrame:
    return df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def totals(extractions: DataFrame) -> DataFrame:
    """total_extractions, avg_confidence, and how many are high, medium and low."""
    c = F.coalesce("confidence", F.lit(0.0))
    return extractions.agg(
        F.count("*").alias("total_extractions"),
        F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)).alias("avg_confidence"),
        F.count_if(c >= 0.7).alias("high"),
        F.count_if((c >= 0.3) & (c < 0.7)).alias("medium"),
        F.count_if(c < 0.3).alias("low"),
    )


def summarize(extractions: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: the totals, by_type and match_quality as maps, and the number of relations."""

    def as_map(column, name: str) -> DataFrame:
        return by(extractions, column, "k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    kinds = as_map(F.coalesce("type", F.lit("unknown")), "by_type")
    quality = as_map(F.coalesce("source_location.match_type", F.lit("none")), "match_quality")
    return totals(extractions).join(kinds).join(quality).join(relations.agg(F.count("*").alias("inferred_relations")))
