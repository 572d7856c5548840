"""Scores: confidence of an extraction, fit of a candidate to a job description."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.functions.coerce import truthy

#: Weights and levels.
CONFIDENCE_WEIGHTS = {"match": 0.35, "attributes": 0.25, "text": 0.20, "type": 0.20}
MATCH_QUALITY = {"exact": 1.0, "normalized": 0.85, "fuzzy": 0.6, "none": 0.1}
GENERIC_TYPES = ("entity", "rule", "constraint", "event", "state", "relation")
FIT_WEIGHTS = {"skill": 0.40, "experience": 0.20, "education": 0.15, "city": 0.15, "salary": 0.10}
LEVEL_WORDS = {"high_school": 1, "highschool": 1, "associate": 2, "college": 2, "bachelor": 3, "master": 4, "phd": 5, "doctor": 5, "doctorate": 5}


def rounded(value: Column, digits: int = 3) -> Column:
    """Rounded half up, whatever the last bit of a sum of weights is."""
    return F.round(value + F.lit(1e-9), digits)


def match_quality(match_type: Column) -> Column:
    levels = F.create_map(*(F.lit(x) for pair in MATCH_QUALITY.items() for x in pair))
    return F.coalesce(F.try_element_at(levels, match_type), F.lit(0.1))


def attribute_completeness(texts: list[Column], related: Column | None = None) -> Column:
    given = [truthy(t).cast("int") for t in texts]
    if related is not None:
        given.append((F.coalesce(F.size(related), F.lit(0)) > 0).cast("int"))
    return F.least(F.lit(1.0), reduce(add, [F.coalesce(g, F.lit(0)) for g in given]) / F.lit(3.0))


def text_specificity(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0.0).when(n < 10, n / 10.0).when(n <= 200, 1.0).otherwise(F.greatest(F.lit(0.3), 1.0 - (n - 200) / 800.0))


def type_consistency(kind: Column) -> Column:
    return F.when(~F.coalesce(truthy(kind), F.lit(False)), 0.5).when(kind.isin(*GENERIC_TYPES), 0.9).otherwise(0.7)


def confidence(match: Column, attributes: Column, text: Column, kind: Column) -> Column:
    w = CONFIDENCE_WEIGHTS
    total = match * w["match"] + attributes * w["attributes"] + text * w["text"] + kind * w["type"]
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


def education_level(name: Column) -> Column:
    """1 (high school) to 5 (doctorate); 0 if a name says none of them."""
    key = F.replace(F.trim(F.lower(name)), F.lit(" "), F.lit("_"))
    exact = F.create_map(*(F.lit(x) for pair in LEVEL_WORDS.items() for x in pair))
    inside = [F.when(key.contains(word), level) for word, level in LEVEL_WORDS.items()]
    return F.coalesce(F.try_element_at(exact, key), *inside, F.lit(0))


def skill_fit(wanted: Column, had: Column) -> Column:
    """Share of the wanted skills of which one of the candidate's is a part, or the reverse."""
    low_had = F.transform(F.coalesce(had, F.array().cast("array<string>")), F.lower)
    met = F.filter(wanted, lambda r: F.exists(low_had, lambda c: c.contains(F.lower(r)) | F.lower(r).contains(c)))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, 1.0).otherwise(F.size(met) / F.size(wanted))


def experience_fit(min_years: Column, months: Column) -> Column:
    years = F.coalesce(months, F.lit(0)) / 12.0
    return F.when(F.coalesce(min_years, F.lit(0)) == 0, 1.0).when(years >= min_years, 1.0).when(years == 0, 0.0).otherwise(years / min_years)


def education_fit(wanted: Column, has: Column) -> Column:
    need, own = education_level(wanted), education_level(has)
    part = F.lower(has).contains(F.lower(wanted)) | F.lower(wanted).contains(F.lower(has))
    return (
        F.when(~F.coalesce(truthy(wanted), F.lit(False)), 1.0)
        .when(~F.coalesce(truthy(has), F.lit(False)), 0.0)
        .when((need == 0) | (own == 0), F.when(part, 1.0).otherwise(0.3))
        .when(own >= need, 1.0)
        .when(own == need - 1, 0.6)
        .otherwise(0.2)
    )


def city_fit(wanted: Column, has: Column) -> Column:
    part = F.lower(has).contains(F.lower(wanted)) | F.lower(wanted).contains(F.lower(has))
    return F.when(~F.coalesce(truthy(wanted), F.lit(False)), 1.0).when(~F.coalesce(truthy(has), F.lit(False)), 0.3).when(part, 1.0).otherwise(0.0)


def salary_fit(wanted: Column, low: Column, high: Column) -> Column:
    """Overlap of the wanted range with the range the candidate expects; farther apart is worse."""
    jd_low, jd_high = F.get(wanted, 0).cast("double"), F.get(wanted, 1).cast("double")
    least = F.coalesce(low, F.lit(0)).cast("double")
    most = F.when(F.coalesce(high, F.lit(0)) != 0, high.cast("double")).otherwise(least * 1.5)
    start, end = F.greatest(jd_low, least), F.least(jd_high, most)
    middle = (jd_low + jd_high) / 2
    apart = F.when(middle > 0, F.greatest(F.lit(0.0), 1.0 - (start - end) / middle)).otherwise(0.0)
    unknown = (F.coalesce(low, F.lit(0)) == 0) & (F.coalesce(high, F.lit(0)) == 0)
    return (
        F.when(F.coalesce(F.size(wanted), F.lit(0)) < 2, 1.0)
        .when(unknown, 0.5)
        .when(start >= end, apart)
        .otherwise(F.least(F.lit(1.0), (end - start) / F.greatest(jd_high - jd_low, F.lit(1.0))))
    )
