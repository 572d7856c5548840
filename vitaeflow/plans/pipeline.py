"""Post-processing of extractions: seven stages, each of which can be left out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaeflow.config import PipelineConfig
from vitaeflow.functions.dates import normalize_period
from vitaeflow.operators import confidence, graph, grounding, overlap, relations, resolution, summary
from vitaeflow.operators.keys import keep, meanwhile, shared_folder, tidy

DATE_ATTRIBUTES = ("period_start", "period_end", "date", "expiry")
_LOCATION = "struct<char_start:int,char_end:int,line:int,match_type:string,confidence:double>"
_EDGES = "doc_key string, from_ord int, to_ord int, from string, to string, type string, target_name string, scope string, confidence double, inferred boolean"


@dataclass(frozen=True)
class PipelineResult:
    extractions: DataFrame
    relations: DataFrame
    stats: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    folder: str | None = None  # what all of them read; ``keys.remove`` frees it when none is needed any more


def _facts(documents: DataFrame, extractions: DataFrame, config: PipelineConfig, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_key, ord, text_id, source_file, source_location) of the extractions that stay, each once: what is told of
    them by joins, without their texts and attributes."""
    said = [c for c in overlap.attributes_of(extractions) if c != "source_file"]
    own = ["doc_key", "ord", "text_id"]
    once = lambda facts: kept(facts.select(*own, "source_file", "source_location").dropDuplicates(own))
    with meanwhile(extractions.sparkSession) as first:
        facts = first(extractions.select(
            "doc_key", "ord", grounding.text_id(), "source_file", "type", F.col("attributes.name").alias("name"), overlap.n_given(extractions, *said).alias("n_attrs"),
            F.length(F.coalesce("text", F.lit(""))).alias("text_length"), "confidence",
        ))
        places = grounding.locations(extractions, documents, rows=facts) if config.source_grounding else None
        files = documents.groupBy("doc_key").agg(F.min("source_file").alias("_file"))
        facts = facts.join(files, "doc_key", "left").withColumn("source_file", F.coalesce("source_file", "_file")).drop("_file")
        facts = facts.join(places, ["doc_key", "text_id"], "left") if config.source_grounding else facts.withColumn("source_location", F.lit(None).cast(_LOCATION))
        if not config.overlap_dedup:
            return once(facts)
        facts = first(facts)
        place = (F.col(f"source_location.char_{c}").alias(c) for c in ("start", "end"))
        spans = facts.select("doc_key", "ord", "type", "name", *place, (F.col("n_attrs") + overlap.n_given(facts, "source_file")).alias("n_attrs"), "text_length", "confidence")
        stay = overlap.survivors(spans, config.overlap_threshold).withColumn("ord", F.col("ord").cast("int"))
        return once(facts.join(stay, ["doc_key", "ord"], "left_semi"))


def _processed(documents: DataFrame, extractions: DataFrame, config: PipelineConfig, folder: str) -> DataFrame:
    """The extractions after all stages that change them, in a folder."""
    columns = [c for c in extractions.columns if c != "source_location"]
    attributes = F.col("attributes")
    if config.time_normalization:
        for name in DATE_ATTRIBUTES:
            attributes = attributes.withField(name, normalize_period(F.col(f"attributes.{name}")))
    own = extractions.select(*columns).withColumns({"attributes": attributes, "_id": grounding.text_id()})
    same = (F.col("doc_key") == F.col("_key")) & F.col("ord").eqNullSafe(F.col("_ord")) & (F.col("_id") == F.col("_text"))
    with meanwhile(own.sparkSession) as kept:
        facts = _facts(documents, extractions, config, kept).withColumnsRenamed({"doc_key": "_key", "ord": "_ord", "text_id": "_text", "source_file": "_file"})
        joined = own.join(facts, same, "inner" if config.overlap_dedup else "left").withColumn("source_file", F.coalesce("source_file", "_file"))
        out = joined.select(*columns, grounding.told_location() if config.source_grounding else "source_location")
        out = keep(confidence.score(out) if config.confidence_scoring else out, folder)
    if not config.entity_resolution:
        return out
    resolved = F.coalesce(F.col("type").isin("entity", "relation"), F.lit(False))
    return out.filter(~resolved).unionByName(keep(resolution.resolve(out.filter(resolved), config.entity_similarity_threshold), folder))


def run(documents: DataFrame, extractions: DataFrame, config: PipelineConfig | None = None) -> PipelineResult:
    """documents: (doc_key, source_file, text), a row for each doc_key; extractions: schema.EXTRACTION. They are read
    anew for each stage rather than kept. What is told of extractions is computed and kept without their texts, which
    move twice: to their sources, and to what was told of them. The processed extractions are kept in ``folder`` of the
    result, in the shared folder; relations, statistics and graph run when they are used."""
    config = config or PipelineConfig()
    spark = documents.sparkSession
    with tidy(spark):
        folder = f"{shared_folder(spark)}/extractions-{uuid.uuid4().hex}"
        out = _processed(documents, extractions, config, folder)
    edges = relations.infer(out) if config.relation_inference else spark.createDataFrame([], _EDGES)
    stats = summary.summarize(out, edges)
    if not config.kg_injection:
        return PipelineResult(out, edges, stats, folder=folder)
    return PipelineResult(out, edges, stats, graph.nodes(out, config.confidence_threshold), graph.edges(out, edges, config.confidence_threshold), folder)
