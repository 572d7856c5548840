"""What file names of exported résumés say: 【position_city 18-25K】name 6年.pdf"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitaeflow.functions.text import filled, let, strip

# What stands in and after the brackets of a name; in them a tag and the rest, then
# position, city and salary, or position and city; after them a person and more.
_OUTER = r"[【\[](.+)[】\]]([^【\[]*)"
_TAG = r"^[【\[]([^】\]]+)[】\]]\s*(.*)"
_FULL = r"^(.+?)_(.+?)\s+(\d+(?:-\d+)?K)"
_SHORT = r"^(.+?)_(.+)"
_PERSON = r"^(\S+)\s*(.*)"


def _part(text: Column, pattern: str, group: int) -> Column:
    return let(strip(F.regexp_extract(text, pattern, group)), filled)


def stem(name: Column) -> Column:
    """A file name without folders and its last extension."""
    return let(F.regexp_extract(name, r"([^/]*)$", 1), lambda base: F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base))


def parse_filename(name: Column) -> Column:
    """A struct of what a name says; fields that it doesn't say are null. Each part is matched once."""
    return let(stem(name), lambda base: let(F.struct(*(strip(F.regexp_extract(base, _OUTER, k)).alias(part) for k, part in ((1, "inside"), (2, "person")))), _parsed))


def _parsed(parts: Column) -> Column:
    inside, person = parts["inside"], parts["person"]
    tagged = let(_part(inside, _TAG, 1), lambda tag: F.struct(tag.alias("tag"), F.when(tag.isNotNull(), strip(F.regexp_extract(inside, _TAG, 2))).otherwise(inside).alias("job")))
    job = let(tagged, lambda x: _job(x["tag"], x["job"]))
    named = F.struct(_part(person, _PERSON, 1).alias("name"), let(_part(person, _PERSON, 2), _years).alias("years"))
    return let(F.struct(job.alias("job"), named.alias("person")), lambda x: _fields(x["job"], x["person"]))


def _job(tag: Column, job: Column) -> Column:
    def told(full: Column) -> Column:
        part = lambda k: F.when(full, _part(job, _FULL, k)).otherwise(_part(job, _SHORT, k))
        return F.struct(part(1).alias("position"), part(2).alias("city"), F.when(full, F.regexp_extract(job, _FULL, 3)).alias("salary"), tag.alias("tag"))

    return let(job.rlike(_FULL), told)


def _years(years: Column) -> Column:
    number = filled(F.regexp_extract(years, r"^(\d+)年", 1)).try_cast("int")
    return F.struct(years.alias("text"), number.alias("number"), years.contains("应届").alias("graduate"))


def _fields(job: Column, person: Column) -> Column:
    salary, years = job["salary"], person["years"]
    number, graduate = years["number"], years["graduate"]
    return F.struct(
        job["position"].alias("position"),
        job["city"].alias("city"),
        salary.alias("salary_text"),
        (F.regexp_extract(salary, r"^(\d+)", 1).try_cast("bigint") * 1000).alias("salary_min"),
        (filled(F.regexp_extract(salary, r"^\d+-(\d+)K", 1)).try_cast("bigint") * 1000).alias("salary_max"),
        person["name"].alias("candidate_name"),
        F.when(number.isNotNull(), years["text"]).alias("years_text"),
        F.when(~graduate, number).alias("years_of_experience"),
        F.when(graduate, F.when(number < 100, number + 2000).otherwise(number)).alias("graduate_year"),
        F.when(job["tag"].isNotNull(), F.array(job["tag"])).alias("tags"),
    )


def context_hints(meta: Column) -> Column:
    """Lines that tell a reader what the name said, in a fixed order."""
    lines = (
        ("Candidate name: ", meta["candidate_name"], ""),
        ("Applied position: ", meta["position"], ""),
        ("Target city: ", meta["city"], ""),
        ("Salary range: ", meta["salary_text"], ""),
        ("Years of experience: ", meta["years_of_experience"], ""),
        ("Graduate year: ", meta["graduate_year"], " (fresh graduate)"),
        ("Tags: ", F.array_join(meta["tags"], ", "), ""),
    )
    return F.concat_ws("\n", *(F.concat(F.lit(a), value.cast("string"), F.lit(b)) for a, value, b in lines))
