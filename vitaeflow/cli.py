"""Command line: parse | pipeline | import | search | detail | list | stats | match | delete."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.config import PipelineConfig
from vitaeflow.functions.jd import parse_jd
from vitaeflow.functions.text import cell
from vitaeflow.operators import matching, search
from vitaeflow.operators.store import document_status
from vitaeflow.operators.store_folder import StoreFolder
from vitaeflow.plans import pipeline
from vitaeflow.sources.documents import read_documents
from vitaeflow.sources.extractions import read_extractions, read_texts, write_result


def _table(df: DataFrame, widths: dict[str, int] | None = None) -> None:
    widths = widths or {}
    df.select(*(cell(F.col(c), widths.get(c, 0)).alias(c) for c in df.columns)).show(1000, truncate=False)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="vitaeflow", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple) -> None:
        own = sub.add_parser(name)
        for names, options in flags:
            own.add_argument(*names.split(), **options)

    db = ("--db", {"default": "talent-store"})
    add("parse", ("input", {}), ("--output", {"required": True}))
    add("pipeline", ("--input", {"required": True}), ("--source", {"required": True}), ("--output", {"required": True}), ("--config", {}), ("--kg", {"action": "store_true"}))
    add("import", ("--input", {"required": True}), ("--refuse-known", {"action": "store_true"}), db)
    add("search", ("query", {"nargs": "?"}), ("--skill", {}), ("--city", {}), ("--min-years", {"type": float}), ("--education", {}), db)
    add("detail", ("id", {"type": int}), db)
    add("list", ("--limit", {"type": int, "default": 50}), ("--offset", {"type": int, "default": 0}), db)
    add("stats", ("--by", {"choices": ["skill", "education", "city"]}), ("--json", {"action": "store_true"}), db)
    add("match", ("--jd", {"required": True}), ("--top", {"type": int, "default": 10}), db)
    add("delete", ("id", {"type": int}), db)
    return out


def jd_frame(spark: SparkSession, path: str) -> DataFrame:
    """One job description: a JSON object of requirements, or a text."""
    content = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        r = json.loads(content)
        row = (1, r.get("skills"), r.get("min_years"), r.get("education"), r.get("city"), r.get("salary_range"))
        return spark.createDataFrame([row], "jd_id int, skills array<string>, min_years int, education string, city string, salary_range array<bigint>")
    return spark.createDataFrame([(1, content)], "jd_id int, text string").select("jd_id", parse_jd(F.col("text")).alias("r")).select("jd_id", "r.*")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("vitaeflow").getOrCreate()
    if given.command == "parse":
        documents = read_documents(spark, given.input).persist()
        documents.filter("status = 'ok'").select("doc_key", "source_file", "text").write.mode("overwrite").parquet(given.output)
        _table(documents.select("source_file", "status"))
        return int(not documents.filter("status <> 'ok'").isEmpty())
    if given.command == "pipeline":
        extractions, status = read_extractions(spark, given.input)
        config = PipelineConfig.of(given.config, **({"kg_injection": True} if given.kg else {}))
        write_result(pipeline.run(read_texts(spark, given.source), extractions, config), given.output)
        return int(not status.filter("status <> 'ok'").isEmpty())
    folder = StoreFolder(spark, given.db)
    store = folder.read()
    if given.command == "import":
        extractions, files = read_extractions(spark, given.input)
        status = files.filter("status <> 'ok'").unionByName(document_status(files.filter("status = 'ok'"), extractions)).persist()
        folder.add(extractions, refuse_known=given.refuse_known)
        _table(status.orderBy("doc_key"))
        return int(not status.filter("status <> 'ok'").isEmpty())
    if given.command == "search":
        if not any((given.query, given.skill, given.city, given.min_years, given.education)):
            parser().error("search takes at least one criterion")
        _table(search.search(store, given.query, given.skill, given.city, given.min_years, given.education), {"name": 20})
    elif given.command == "detail":
        for row in search.candidate_detail(store, given.id).toJSON().toLocalIterator():
            print(json.dumps(json.loads(row), ensure_ascii=False, indent=2))
    elif given.command == "list":
        _table(search.list_candidates(store, given.limit, given.offset), {"name": 20, "city": 12})
    elif given.command == "stats":
        rows = search.statistics(store, given.by)
        print("\n".join(rows.toJSON().toLocalIterator())) if given.json else _table(rows)
    elif given.command == "match":
        wanted = jd_frame(spark, given.jd)
        _table(matching.best_in_store(store, wanted, given.top).orderBy("rank").drop("rank"))
    elif given.command == "delete":
        return int(not folder.delete(spark.createDataFrame([(given.id,)], "id long")))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
