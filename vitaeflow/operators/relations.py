"""Relations from a document's candidates to what its extractions name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.functions.scoring import rounded
from vitaeflow.functions.text import filled

#: Relation and naming attribute by type.
RULES = {"experience": ("worked_at", "company"), "education": ("studied_at", "school"), "skill": ("has_skill", "name"), "certification": ("certified_by", "name")}


def infer(extractions: DataFrame) -> DataFrame:
    """(doc_key, from, to, type, target_name, scope, confidence, inferred), by an equi-join on doc_key."""
    kind, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (relation, attribute) in RULES.items():
        kind = F.when(F.col("type") == name, relation).otherwise(kind)
        target = F.when(F.col("type") == name, filled(F.col(f"attributes.{attribute}"))).otherwise(target)
    ends = extractions.filter(F.col("type").isin(*RULES)).select(
        "doc_key", F.col("ord").alias("to_ord"), F.col("text").alias("to"), kind.alias("type"),
        F.coalesce(target, filled(F.col("summary_cn")), F.col("text")).alias("target_name"),
        F.coalesce(rounded(F.col("confidence") * 0.85), F.lit(0.7)).alias("confidence"),
    )
    people = extractions.filter(F.col("type") == "candidate").select("doc_key", F.col("ord").alias("from_ord"), F.coalesce(filled(F.col("attributes.name")), F.col("text")).alias("from"))
    return people.join(ends, "doc_key").select("doc_key", "from_ord", "to_ord", "from", "to", "type", "target_name", F.lit("resume").alias("scope"), "confidence", F.lit(True).alias("inferred"))
