"""The relational store: eight tables, import of extractions, deletion with cascade."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.functions.coerce import safe_int, truthy
from vitaeflow.functions.text import filled
from vitaeflow.operators.keys import numbered
from vitaeflow.schema import CHILDREN, TABLES


#: Candidates whose rows are numbered together.
RUN = 4096


@dataclass(frozen=True)
class TalentStore:
    candidates: DataFrame
    experiences: DataFrame
    educations: DataFrame
    skills: DataFrame
    candidate_skills: DataFrame
    job_intentions: DataFrame
    self_evaluations: DataFrame
    certifications: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> TalentStore:
        return cls(**{t: spark.createDataFrame([], schema) for t, schema in TABLES.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TalentStore:
        return cls(**{t: spark.read.schema(schema).parquet(f"{path}/{t}") for t, schema in TABLES.items()})

    def write(self, path: str) -> None:
        """Write all tables to a folder other than the one they were read from."""
        for t in TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def _named(attribute: str = "name") -> Column:
    """An attribute if it is there, even empty, or else the text."""
    return F.coalesce(F.col(f"attributes.{attribute}"), F.col("text"))


def first_candidates(extractions: DataFrame) -> DataFrame:
    """The first candidate of each document."""
    return first_of(extractions.filter(F.col("type") == "candidate"), ["doc_key"], ["ord"])


def document_status(documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """(doc_key, status): ok for the documents that an import adds, or why it leaves them out."""
    kinds = extractions.groupBy("doc_key").agg(F.count("*").alias("items"), F.count_if(F.col("type") == "candidate").alias("people"))
    told = documents.select("doc_key").join(kinds, "doc_key", "left")
    return told.select("doc_key", F.when(F.coalesce("items", F.lit(0)) == 0, "no extractions").when(F.col("people") == 0, "no candidate").otherwise("ok").alias("status"))


def type_tally(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("doc_key", "type").agg(F.count("*").alias("n"))


def last_ids(store: TalentStore) -> dict[str, int]:
    """The largest id of each table that has ids, in one pass."""
    tables = [t for t in TABLES if t != "candidate_skills"]
    every = None
    for t in tables:
        own = getattr(store, t).agg(F.lit(t).alias("name"), F.max("id").alias("id"))
        every = own if every is None else every.unionByName(own)
    return {r["name"]: r["id"] or 0 for r in every.collect()}


def new_skills(mentions: DataFrame, skills: DataFrame, after: int) -> DataFrame:
    """(id, name, category) of the pairs of ``mentions`` that aren't in ``skills``."""
    pairs = mentions.select("name", "category").filter(truthy(F.col("name"))).distinct()
    same = (F.col("n.name") == F.col("s.name")) & F.col("n.category").eqNullSafe(F.col("s.category"))
    return numbered(pairs.alias("n").join(skills.alias("s"), same, "left_anti"), ["name", "category"], "id", after).select("id", "name", "category")


def skill_dimension(mentions: DataFrame, skills: DataFrame) -> DataFrame:
    """``skills`` with the new (name, category) pairs of ``mentions`` added."""
    return skills.unionByName(new_skills(mentions, skills, skills.agg(F.max("id")).first()[0] or 0))


def skill_bridge(mentions: DataFrame, skills: DataFrame, order: list[str]) -> DataFrame:
    """(candidate_id, skill_id, level, years): a candidate's first mention of each skill."""
    same = (F.col("m.name") == F.col("s.name")) & F.col("m.category").eqNullSafe(F.col("s.category"))
    rows = mentions.alias("m").join(skills.select(F.col("id").alias("skill_id"), "name", "category").alias("s"), same).select("m.*", "skill_id")
    return first_of(rows, ["candidate_id", "skill_id"], order).select("candidate_id", "skill_id", "level", "years")


def numbered_children(rows: DataFrame, after: int) -> DataFrame:
    """``rows`` with ids after ``after``, in the order of (candidate_id, ord), instead of ``ord``. Candidates are
    numbered without gaps, so runs of ``RUN`` of them are counted and numbered on their own."""
    dealt = rows.withColumn("_run", F.floor(F.col("candidate_id") / RUN))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    first = dealt.groupBy("_run").agg(F.count("*").alias("_n")).select("_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_run").orderBy("candidate_id", "ord"))
    return dealt.withColumn("_k", within).join(first, "_run").withColumn("id", F.col("_first") + F.col("_k") + F.lit(after)).drop("_run", "_k", "_first", "ord")


def additions(extractions: DataFrame, store: TalentStore, source_file: str = "doc_key") -> dict[str, DataFrame]:
    """The rows that an import adds to each table: all documents with a candidate, of whom the first counts.

    Documents get ids in the order of their keys. New candidates and skills are numbered at once; nothing is
    written.
    """
    a = lambda k: F.col(f"attributes.{k}")
    last = last_ids(store)
    people = numbered(first_candidates(extractions), ["doc_key"], "id", last["candidates"])
    candidates = people.select(
        "id", F.coalesce(_named(), F.lit("")).alias("name"), a("gender").alias("gender"), safe_int(a("age")).alias("age"), a("phone").alias("phone"), a("email").alias("email"), a("city").alias("city"),
        a("education_level").alias("education_level"), F.col(source_file).alias("source_file"), F.to_json(F.struct(*extractions.columns)).alias("raw_json"), F.current_timestamp().alias("created_at"),
    )
    owned = extractions.join(people.select("doc_key", F.col("id").alias("candidate_id")), "doc_key")

    def children(table: str, kind: str, **columns) -> DataFrame:
        rows = owned.filter(F.col("type") == kind).select("candidate_id", "ord", *(c.alias(k) for k, c in columns.items()))
        return numbered_children(rows, last[table])

    start, end = (F.coalesce(filled(a(f"period_{k}")), a(f"{k}_date")) for k in ("start", "end"))
    as_json = lambda k: F.when(F.size(a(k)) > 0, F.to_json(a(k)))
    mentions = owned.filter(F.col("type") == "skill").select(
        "candidate_id", "ord", _named().alias("name"), a("category").alias("category"), a("level").alias("level"), safe_int(a("years")).alias("years")
    )
    skills = new_skills(mentions, store.skills, last["skills"])
    added = {
        "candidates": candidates,
        "experiences": children("experiences", "experience", company=a("company"), title=a("title"), start_date=start, end_date=end, duration_months=safe_int(a("duration_months")), description=a("description"), projects=as_json("projects")),
        "educations": children("educations", "education", school=a("school"), major=a("major"), degree=a("degree"), start_date=start, end_date=end, gpa=a("gpa")),
        "skills": skills,
        "candidate_skills": skill_bridge(mentions, store.skills.unionByName(skills), ["ord"]),
        "job_intentions": children("job_intentions", "job_intention", position=a("position"), industry=a("industry"), city=a("city"), salary_min=safe_int(a("salary_min")), salary_max=safe_int(a("salary_max")), entry_date=a("entry_date")),
        "self_evaluations": children("self_evaluations", "self_evaluation", text=F.coalesce(_named("text"), F.lit("")), traits=as_json("traits")),
        "certifications": children("certifications", "certification", name=F.coalesce(_named(), F.lit("")), issuer=a("issuer"), date=a("date"), expiry=a("expiry")),
    }
    return {t: rows.select(*TABLES_COLUMNS[t]) for t, rows in added.items()}


def import_extractions(extractions: DataFrame, store: TalentStore, source_file: str = "doc_key") -> TalentStore:
    """The store with the rows of :func:`additions`."""
    return replace(store, **{t: getattr(store, t).unionByName(rows) for t, rows in additions(extractions, store, source_file).items()})


def delete_candidates(store: TalentStore, ids: DataFrame) -> TalentStore:
    """The store without the candidates of (id) and their rows; skills stay."""
    left = {t: getattr(store, t).join(ids.select(F.col("id").alias("candidate_id")), "candidate_id", "left_anti") for t in CHILDREN}
    return replace(store, candidates=store.candidates.join(ids.select("id"), "id", "left_anti"), **{t: df.select(*TABLES_COLUMNS[t]) for t, df in left.items()})


TABLES_COLUMNS = {t: [c.split()[0] for c in schema.split(", ")] for t, schema in TABLES.items()}
