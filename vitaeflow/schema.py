"""Explicit schemas of extractions and of the store's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_text = T.StringType()


def _struct(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _text) for n in names.split()])


PROJECTS = T.ArrayType(_struct("name role period description"))
ATTRIBUTES = T.StructType(
    [
        *_struct(
            "name gender age phone email city education_level company title period_start period_end start_date end_date duration_months "
            "description school major degree gpa category level years text position industry salary_min salary_max salary_unit entry_date "
            "issuer date expiry cert_id"
        ),
        T.StructField("projects", PROJECTS),
        T.StructField("traits", T.ArrayType(_text)),
        T.StructField("honors", T.ArrayType(_text)),
    ]
)
ITEM = T.StructType(
    [
        *_struct("id type text summary_cn source_file trigger_context consequence reason from to relation_type"),
        T.StructField("related_entities", T.ArrayType(_text)),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("attributes", ATTRIBUTES),
    ]
)
EXTRACTION = T.StructType([T.StructField("doc_key", _text), T.StructField("ord", T.IntegerType()), *ITEM])

#: Columns of the store's tables.
TABLES = {
    "candidates": "id long, name string, gender string, age long, phone string, email string, city string, education_level string, source_file string, raw_json string, created_at timestamp",
    "experiences": "id long, candidate_id long, company string, title string, start_date string, end_date string, duration_months long, description string, projects string",
    "educations": "id long, candidate_id long, school string, major string, degree string, start_date string, end_date string, gpa string",
    "skills": "id long, name string, category string",
    "candidate_skills": "candidate_id long, skill_id long, level string, years long",
    "job_intentions": "id long, candidate_id long, position string, industry string, city string, salary_min long, salary_max long, entry_date string",
    "self_evaluations": "id long, candidate_id long, text string, traits string",
    "certifications": "id long, candidate_id long, name string, issuer string, date string, expiry string",
}
CHILDREN = tuple(t for t in TABLES if t not in ("candidates", "skills"))
