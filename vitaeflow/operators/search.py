"""Search, detail, lists and counts over the store."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.functions.text import contains_like, keyword_list
from vitaeflow.operators.store import TalentStore

#: Rows of a page up to which its ids are shipped to the tables that are counted.
MAX_PAGE = 10_000
SUMMARY = ["id", "name", "gender", "age", "phone", "city", "education_level", "source_file"]


def months_by_candidate(experiences: DataFrame) -> DataFrame:
    return experiences.groupBy("candidate_id").agg(F.sum("duration_months").cast("long").alias("total_months"))


def with_skill(store: TalentStore, part: str) -> DataFrame:
    """(id) of candidates with a skill whose name holds ``part``."""
    skills = store.skills.filter(contains_like(F.col("name"), part)).select(F.col("id").alias("skill_id"))
    return store.candidate_skills.join(skills, "skill_id", "left_semi").select(F.col("candidate_id").alias("id"))


def search(
    store: TalentStore, query: str | None = None, skill: str | None = None, city: str | None = None, min_years: float | None = None, education: str | None = None
) -> DataFrame:
    """Candidates that meet all criteria given, newest first. Only tables that a criterion needs are read."""
    found = store.candidates
    if city:
        found = found.filter(contains_like(F.col("city"), city))
    if education:
        found = found.filter(contains_like(F.col("education_level"), education))
    if skill:
        found = found.join(with_skill(store, skill), "id", "left_semi")
    if min_years is not None:
        months = months_by_candidate(store.experiences).withColumnRenamed("candidate_id", "id")
        found = found.join(months, "id", "left").filter(F.coalesce("total_months", F.lit(0)) >= 12 * min_years).drop("total_months")
    words = keyword_list(query) if query else []
    if words:
        # One pass over the skills that hold a word tells for each candidate which words its skills hold.
        marks = [F.max(contains_like(F.col("name"), w)).alias(f"_k{i}") for i, w in enumerate(words)]
        held = reduce(or_, (contains_like(F.col("name"), w) for w in words))
        named = store.candidate_skills.join(store.skills.filter(held).select(F.col("id").alias("skill_id"), "name"), "skill_id")
        found = found.join(named.groupBy(F.col("candidate_id").alias("id")).agg(*marks), "id", "left")
        for i, w in enumerate(words):
            own = reduce(or_, (F.coalesce(contains_like(F.col(c), w), F.lit(False)) for c in ("name", "city", "education_level")))
            found = found.filter(own | F.coalesce(F.col(f"_k{i}"), F.lit(False)))
    return found.select(*(c for c in SUMMARY if c in found.columns)).orderBy(F.desc("id"))


def _children(df: DataFrame, order: list, name: str) -> DataFrame:
    """(id, name): a candidate's rows as an array in the given order."""
    columns = [c for c in df.columns if c != "candidate_id"]
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy(*order))
    items = df.withColumn("_k", place).groupBy(F.col("candidate_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("_k", *columns))).alias("_all"))
    return items.select("id", F.transform("_all", lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias(name))


def details(store: TalentStore, ids: DataFrame | None = None) -> DataFrame:
    """Candidates with their rows of the other tables as arrays; for the ids given, or all."""
    keep = (lambda df, key: df) if ids is None else (lambda df, key: df.join(ids.select(F.col("id").alias(key)), key, "left_semi"))
    out = keep(store.candidates, "id")
    skills = keep(store.candidate_skills, "candidate_id").join(store.skills.select(F.col("id").alias("skill_id"), "name", "category"), "skill_id").drop("skill_id")
    parts = {
        "experiences": (store.experiences, [F.desc("start_date"), "id"]),
        "educations": (store.educations, [F.desc("start_date"), "id"]),
        "skills": (skills, ["name", "category"]),
        "job_intentions": (store.job_intentions, ["id"]),
        "self_evaluations": (store.self_evaluations, ["id"]),
        "certifications": (store.certifications, ["id"]),
    }
    for name, (df, order) in parts.items():
        out = out.join(_children(keep(df, "candidate_id"), order, name), "id", "left")
    return out


def candidate_detail(store: TalentStore, candidate_id: int) -> DataFrame:
    spark: SparkSession = store.candidates.sparkSession
    return details(store, spark.createDataFrame([(candidate_id,)], "id long"))


def list_candidates(store: TalentStore, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Candidates, newest first, with the numbers of their experiences, skills and certifications."""
    out = store.candidates
    counts = (("experience_count", store.experiences), ("skill_count", store.candidate_skills), ("certification_count", store.certifications))
    out = out.select("id", "name", "city", "education_level", "source_file").orderBy(F.desc("id")).offset(offset)
    out = out.limit(limit) if limit is not None else out  # the page first, then what belongs to it
    page = out.select(F.col("id").alias("candidate_id"))
    for name, df in counts:
        if limit is not None and limit <= MAX_PAGE:
            df = df.join(F.broadcast(page), "candidate_id", "left_semi")
        own = df.groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias(name))
        out = out.join(own, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out.orderBy(F.desc("id"))


def stats_skill(store: TalentStore) -> DataFrame:
    counts = store.candidate_skills.groupBy("skill_id").agg(F.count("*").alias("n"))
    return store.skills.join(counts, F.col("id") == F.col("skill_id")).select("name", "category", "n").orderBy(F.desc("n"), "name", "category")


def stats_column(store: TalentStore, column: str) -> DataFrame:
    return store.candidates.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def stats_overview(store: TalentStore) -> DataFrame:
    """One row of totals; the mean counts candidates with at least one experience."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    per = store.experiences.groupBy("candidate_id").agg(F.count("*").alias("n"))
    rows = [count(getattr(store, t), f"total_{t}") for t in ("candidates", "experiences", "educations", "skills", "certifications")]
    rows.append(per.agg(F.coalesce(F.round(F.avg("n"), 1), F.lit(0.0)).alias("avg_experiences")))
    return reduce(lambda a, b: a.join(b), rows)  # six rows of one


def statistics(store: TalentStore, group_by: str | None = None) -> DataFrame:
    if group_by == "skill":
        return stats_skill(store)
    return stats_column(store, {"education": "education_level"}.get(group_by, group_by)) if group_by in ("education", "city") else stats_overview(store)
