"""Fit of candidates to job descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.functions import scoring
from vitaeflow.operators.keys import cut
from vitaeflow.operators.search import months_by_candidate
from vitaeflow.operators.store import TalentStore, first_of

TOP = 10
#: Candidates of each job description whose skills are looked at to learn what the best totals are.
SEEDS = 200
#: Words and ids up to which they are written into a filter; beyond, they are joined.
MAX_WORDS, MAX_IDS = 1000, 4000


def basics(store: TalentStore) -> DataFrame:
    """One row a candidate: all that scoring needs but the skills. Each child table is aggregated before it is
    joined."""
    months = months_by_candidate(store.experiences).withColumnRenamed("candidate_id", "id")
    wishes = first_of(store.job_intentions, ["candidate_id"], ["id"]).select(F.col("candidate_id").alias("id"), "salary_min", "salary_max")
    return store.candidates.select("id", "name", "city", "education_level").join(months, "id", "left").join(wishes, "id", "left")


def asked_skills(store: TalentStore, jds: DataFrame | None = None) -> DataFrame:
    """(skill_id, name) of the skills that a job description asks for, in lower case; of all without any."""
    known = store.skills.select(F.col("id").alias("skill_id"), F.lower("name").alias("name"))
    if jds is None:
        return known
    asked = jds.select(F.explode("skills").alias("word")).select(F.lower("word").alias("word")).distinct()
    words = [r["word"] for r in asked.limit(MAX_WORDS + 1).collect()]
    if len(words) > MAX_WORDS:
        return known.join(asked, F.contains("name", "word") | F.contains("word", "name"), "left_semi")
    found = F.lit(False)
    for w in words:
        if w is not None:
            found = found | F.contains("name", F.lit(w)) | F.contains(F.lit(w), F.col("name"))
    return known.filter(found)


def skills_of(store: TalentStore, known: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(id, skills): the ``known`` skills of candidates, of those in ``held`` (candidate_id, skill_id)."""
    rows = (store.candidate_skills if held is None else held).join(known, "skill_id")
    return rows.groupBy(F.col("candidate_id").alias("id")).agg(F.collect_set("name").alias("skills"))


def profiles(store: TalentStore, jds: DataFrame | None = None) -> DataFrame:
    """One row a candidate: what scoring needs. With job descriptions only skills that one of them asks for are
    gathered; others don't count."""
    return basics(store).join(skills_of(store, asked_skills(store, jds)), "id", "left")


def _parts(skill: Column) -> dict[str, Column]:
    j, p = (lambda c: F.col(f"j.{c}")), (lambda c: F.col(f"p.{c}"))
    return {
        "skill": skill,
        "experience": scoring.experience_fit(j("min_years"), p("total_months")),
        "education": scoring.education_fit(j("education"), p("education_level")),
        "city": scoring.city_fit(j("city"), p("city")),
        "salary": scoring.salary_fit(j("salary_range"), p("salary_min"), p("salary_max")),
    }


def _total(parts: dict[str, Column]) -> Column:
    return scoring.rounded(sum((parts[k] * w for k, w in scoring.FIT_WEIGHTS.items()), F.lit(0.0)))


def _scored(pairs: DataFrame, *more: str) -> DataFrame:
    """The scores of pairs, structs p (with skills) and j, and further columns."""
    parts = _parts(scoring.skill_fit(F.col("j.skills"), F.col("p.skills")))
    plain = pairs.select(
        F.col("j.jd_id").alias("jd_id"), F.col("p.id").alias("candidate_id"), F.col("p.name").alias("name"), F.col("p.city").alias("city"), F.col("p.education_level").alias("education"),
        *(v.alias(f"{k}_score") for k, v in parts.items()), *more,
    )
    raw = {k: F.col(f"{k}_score") for k in parts}
    return plain.withColumn("total_score", _total(raw)).withColumns({f"{k}_score": scoring.rounded(v) for k, v in raw.items()})


def _pairs(people: DataFrame, jds: DataFrame) -> DataFrame:
    """Every job description with every profile, as structs j and p. All pairs are wanted; the engine ships the
    descriptions to the profiles if they are few by its own measure, and pairs their partitions otherwise."""
    return people.select(F.struct(*people.columns).alias("p")).crossJoin(jds.select(F.struct(*jds.columns).alias("j")))


def scored(people: DataFrame, jds: DataFrame) -> DataFrame:
    """Every job description (jd_id, skills, min_years, education, city, salary_range) with every profile."""
    return _scored(_pairs(people, jds))


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The best of each job description, with their rank; equal totals by newest."""
    order = Window.partitionBy("jd_id").orderBy(F.desc("total_score"), F.desc("candidate_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def best(people: DataFrame, jd: DataFrame, top: int | None = TOP) -> DataFrame:
    """The best candidates for one job description; equal totals by newest."""
    rows = scored(people, jd).orderBy(F.desc("total_score"), F.desc("candidate_id"))
    return rows if top is None else rows.limit(top)


def best_for_each(people: DataFrame, jds: DataFrame, top: int = TOP) -> DataFrame:
    """The best candidates of each job description, with their rank."""
    return _ranked(scored(people, jds), top)


def reachable(known: DataFrame, jds: DataFrame) -> DataFrame:
    """``jds`` with ``reach``, the largest share of its skills that any candidate can have: those which some
    skill in the store matches; 1 where no skills are asked for."""
    words = jds.select("jd_id", F.posexplode("skills").alias("k", "word"))
    names = known.select("name").distinct()
    met = words.join(names, F.contains("name", F.lower("word")) | F.contains(F.lower("word"), F.col("name")), "left_semi")
    counts = met.groupBy("jd_id").agg(F.count("*").alias("n"))
    reach = F.when(F.coalesce(F.size("skills"), F.lit(0)) <= 0, 1.0).otherwise(F.coalesce("n", F.lit(0)) / F.size("skills"))
    return jds.join(counts, "jd_id", "left").withColumn("reach", reach).drop("n")


def gathered(store: TalentStore, jds: DataFrame, top: int = TOP) -> DataFrame:
    """The scores of the pairs that can be among the best ``top`` of each job description, and of some more.

    A threshold algorithm: the four parts that need no skills, with all reachable skills, bound a total from
    above. The skills of the ``SEEDS`` highest bounds of each description are gathered. The total that is ``top``-th
    among these can't be missed by the best; if the last of the bounds is lower, no other pair can reach it.
    Else the pairs with such a bound (equal ones too) follow, and no others. Where no skills are asked for, bounds
    are totals, and nothing follows.
    """
    known, seeds = asked_skills(store, jds), max(SEEDS, top)
    pairs = _pairs(basics(store), reachable(known, jds)).withColumn("bound", _total(_parts(F.col("j.reach"))))
    order = Window.partitionBy("j.jd_id").orderBy(F.desc("bound"), F.desc("p.id"))
    first = cut(pairs.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= seeds).drop("_k"))
    scores = cut(_scored(with_skills(store, first, known), "bound"))
    ends = scores.groupBy("jd_id").agg(F.get(F.sort_array(F.collect_list("total_score"), False), F.lit(top - 1)).alias("least"), F.min("bound").alias("last"), F.count("*").alias("n"))
    asking = jds.filter(F.size("skills") > 0).select("jd_id")
    unsure = cut(ends.filter((F.col("n") >= seeds) & (F.col("last") >= F.col("least"))).join(asking, "jd_id", "left_semi").select(F.col("jd_id").alias("unsure_id"), "least"))
    if unsure.isEmpty():
        return scores.drop("bound")
    seen = scores.select(F.col("jd_id").alias("seen_jd"), F.col("candidate_id").alias("seen_id"))
    more = pairs.join(unsure, F.col("j.jd_id") == F.col("unsure_id")).filter(F.col("bound") >= F.col("least"))
    rest = cut(more.join(seen, (F.col("j.jd_id") == F.col("seen_jd")) & (F.col("p.id") == F.col("seen_id")), "left_anti").select("p", "j", "bound"))
    return scores.drop("bound").unionByName(_scored(with_skills(store, rest, known)))


def with_skills(store: TalentStore, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs with the known skills of their candidates; no others are gathered. Few ids go into the filter."""
    ids = pairs.select(F.col("p.id").alias("candidate_id")).distinct()
    few = [str(int(r[0])) for r in ids.limit(MAX_IDS + 1).collect()]
    if not few:
        held = store.candidate_skills.filter(F.lit(False))
    elif len(few) <= MAX_IDS:
        held = store.candidate_skills.filter(f"candidate_id IN ({', '.join(few)})")
    else:
        held = store.candidate_skills.join(ids, "candidate_id", "left_semi")
    own = skills_of(store, known, held)
    return pairs.join(own, F.col("p.id") == F.col("id"), "left").select(F.col("p").withField("skills", F.col("skills")).alias("p"), "j", "bound")


def best_in_store(store: TalentStore, jds: DataFrame, top: int = TOP) -> DataFrame:
    """The best candidates of each job description, with their rank, without gathering all profiles."""
    return _ranked(gathered(store, jds, top), top)
