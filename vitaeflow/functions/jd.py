"""Requirements in the text of a job description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.functions.text import filled

#: Skills by group, degrees and their words (first match counts), cities in order.
SKILL_GROUPS = (
    ("Python", "Java", "JavaScript", "TypeScript", "Go", "Golang", "Rust", r"C\+\+", "C#", "Ruby", "PHP", "Swift", "Kotlin"),
    ("React", "Vue", "Angular", "Django", "Flask", "FastAPI", "Spring", r"Node\.js", "Express"),
    ("MySQL", "PostgreSQL", "MongoDB", "Redis", "Elasticsearch", "Kafka"),
    ("Docker", "Kubernetes", "K8s", "AWS", "Azure", "GCP", "Linux"),
    ("Git", "CI/CD", "Jenkins", "GitHub Actions", "TensorFlow", "PyTorch"),
    ("SQL", "NoSQL", "GraphQL", "REST", "gRPC", "Microservices"),
)
DEGREE_WORDS = (
    ("PhD", ("phd", "doctor", "doctorate")),
    ("Master", ("master", "mba")),
    ("Bachelor", ("bachelor", "undergraduate", "bs", "ba")),
    ("Associate", ("associate", "college", "diploma")),
)
CITIES = ("Beijing", "Shanghai", "Shenzhen", "Guangzhou", "Hangzhou", "Chengdu", "Nanjing", "Wuhan", "Xi'an", "Suzhou", "Remote")
#: Patterns of years and of salary ranges, tried in this order.
YEARS = (
    r"(\d+)\s*(?:years?|yr)",
    r"(\d+)\s*[\+]?\s*(?:years?|yr)",
)
SALARIES = (
    r"(\d+)[kK]\s*[-~]\s*(\d+)[kK]",
    r"(\d{4,})\s*[-~]\s*(\d{4,})",
)


def skills(text: Column) -> Column:
    """Distinct spellings of known skills, sorted; null if there are none."""
    found = [F.regexp_extract_all(text, F.lit(rf"(?iU)\b({'|'.join(own)})\b"), F.lit(1)) for own in SKILL_GROUPS]
    own = F.array_sort(F.array_distinct(F.flatten(F.array(*found))))
    return F.when(F.size(own) > 0, own)


def min_years(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*(filled(F.regexp_extract(lower, p, 1)).try_cast("int") for p in YEARS))


def education(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*(F.when(lower.rlike(rf"(?U)\b(?:{'|'.join(words)})\b"), level) for level, words in DEGREE_WORDS))


def city(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*(F.when(lower.contains(c.lower()), c) for c in CITIES))


def salary_range(text: Column) -> Column:
    """[low, high]; numbers below 100 are thousands."""

    def bounds(pattern: str) -> Column:
        low, high = (filled(F.regexp_extract(text, pattern, k)).try_cast("bigint") for k in (1, 2))
        factor = F.when(low < 100, 1000).otherwise(1)
        return F.when(low.isNotNull() & high.isNotNull(), F.array(low * factor, high * factor))

    return F.coalesce(*map(bounds, SALARIES))


def parse_jd(text: Column) -> Column:
    return F.struct(
        skills(text).alias("skills"), min_years(text).alias("min_years"), education(text).alias("education"), city(text).alias("city"), salary_range(text).alias("salary_range")
    )
