"""Extractions and texts from files, results to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.functions.filename import stem
from vitaeflow.schema import EXTRACTION, ITEM


def document_keys(files: DataFrame) -> DataFrame:
    """(path, doc_key) of files: the name without its ending. Where several files have the same, the
    first path gets it; the others are known by their whole path, so that no two share a key."""
    named = files.select("path", stem(F.col("path")).alias("stem"))
    first = named.groupBy("stem").agg(F.min("path").alias("first"))
    return named.join(first, "stem").select("path", F.when(F.col("path") == F.col("first"), F.col("stem")).otherwise(F.col("path")).alias("doc_key"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, value) of the texts of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("_file"), "value")


def items(value: Column, kind: str = ITEM.simpleString()) -> Column:
    """The items of a JSON array, or of an object's ``extractions``; null if it is neither."""
    wrapped = F.from_json(value, f"struct<extractions:array<{kind}>>")["extractions"]
    return F.when(value.rlike(r"^\s*\["), F.from_json(value, f"array<{kind}>")).otherwise(wrapped)


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(extractions, status) of JSON files: a file that can't be read has a status other than ok."""
    found = _files(spark, path)
    files = found.join(document_keys(found), "path").select("doc_key", "_file", items(F.col("value")).alias("items"))
    status = files.select("doc_key", F.when(F.col("items").isNull(), "not a list of extractions").when(F.size("items") == 0, "no extractions").otherwise("ok").alias("status"))
    rows = files.select("doc_key", F.posexplode("items").alias("ord", "x")).select("doc_key", "ord", "x.*")
    return rows.select(*EXTRACTION.fieldNames()), status


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_key, source_file, text), one row a file."""
    found = _files(spark, path)
    return found.join(document_keys(found), "path").select("doc_key", F.col("_file").alias("source_file"), F.col("value").alias("text"))


def write_result(result, path: str) -> None:
    """Results as JSON lines: extractions, inferred_relations, stats and, if made, the graph."""
    tables = {"extractions": result.extractions, "inferred_relations": result.relations, "stats": result.stats, "kg_entities": result.nodes, "kg_relations": result.edges}
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")


def document_results(result) -> DataFrame:
    """(doc_key, json): one JSON document a source with its extractions in order, the relations
    inferred and, if made, the graph. A document's items are gathered in one row."""
    located = F.col("source_location")
    interval = F.when(located["char_start"].isNotNull(), F.array(located["char_start"], located["char_end"]))
    extractions = result.extractions.withColumn("source_location", F.when(located.isNotNull(), located.withField("char_interval", interval)))

    def gathered(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        columns = [c for c in df.columns if c != "doc_key"]
        items = df.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct(*(F.coalesce(c, F.lit(-1)).alias(f"_{c}") for c in order), F.to_json(F.struct(*columns)).alias("_item")))).alias("_items"))
        return items.select("doc_key", F.concat(F.lit(f'"{name}":['), F.array_join(F.transform("_items", lambda x: x["_item"]), ","), F.lit("]")).alias(name))

    parts = [gathered(extractions, "extractions", ["ord"]), gathered(result.relations, "inferred_relations", ["from_ord", "to_ord"])]
    out = parts[0].join(parts[1], "doc_key", "left").withColumn("inferred_relations", F.coalesce("inferred_relations", F.lit('"inferred_relations":[]')))
    names = ["extractions", "inferred_relations"]
    if result.nodes is not None:
        graph = gathered(result.nodes, "entities", ["ord"]).join(gathered(result.edges, "relations", []), "doc_key", "full")
        graph = graph.select("doc_key", F.concat(F.lit('"kg_format":{'), F.concat_ws(",", F.coalesce("entities", F.lit('"entities":[]')), F.coalesce("relations", F.lit('"relations":[]'))), F.lit("}")).alias("kg_format"))
        out = out.join(graph, "doc_key", "left").withColumn("kg_format", F.coalesce("kg_format", F.lit('"kg_format":{"entities":[],"relations":[]}')))
        names.append("kg_format")
    return out.select("doc_key", F.concat(F.lit("{"), F.concat_ws(",", *names), F.lit("}")).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns as CSV; nested ones as JSON."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
