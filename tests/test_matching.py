"""The best candidates without gathering all profiles are those of scoring all."""

import random

import pytest

from vitaeflow.operators import matching
from vitaeflow.operators.store import TalentStore
from vitaeflow.schema import TABLES

JD = "jd_id int, skills array<string>, min_years int, education string, city string, salary_range array<bigint>"
LEVELS = ["high_school", "Associate", "Bachelor", "Master of Science", "PhD", None, "本科"]
WORDS = ["Python", "python 3", "Java", "JavaScript", "Go", "SQL", "C++", "", "Rust"]


def made(spark, n, seed):
    rng = random.Random(seed)
    tables = {t: [] for t in TABLES}
    for k in range(1, n + 1):
        tables["candidates"].append((k, f"N{k}", None, None, None, None, rng.choice(["Oslo", "Bergen", "Oslo West", None, ""]), rng.choice(LEVELS), "f", None, None))
        tables["experiences"] += [(0, k, "c", "t", None, None, rng.choice([None, 3, 24, 60]), None, None) for _ in range(rng.randrange(3))]
        tables["job_intentions"] += [(k, k, "p", None, None, low := rng.randrange(0, 9000, 500), rng.choice([None, 0, low + 2000]), None)] * rng.randrange(2)
        tables["candidate_skills"] += [(k, s, None, None) for s in rng.sample(range(1, len(WORDS) + 1), rng.randrange(4))]
    tables["skills"] = [(k + 1, w, None) for k, w in enumerate(WORDS)]
    return TalentStore(**{t: spark.createDataFrame(rows, TABLES[t]) for t, rows in tables.items()})


JDS = [
    (1, ["python", "SQL", "Cobol"], 3, "Bachelor", "Oslo", [3000, 6000]), (2, ["Rust"], None, None, None, None), (3, None, None, None, None, None), (4, [], 2, "本科", "Bergen", [8000, 9000]),
    (5, ["Cobol"], 1, "PhD", "Oslo", None), (6, ["GO", "java"], 5, "Master", None, [1, 2]), (7, [None, "SQL"], 0, "", "", [5]),
]


@pytest.mark.parametrize("changed", [{}, {"SEEDS": 2, "MAX_WORDS": 2, "MAX_IDS": 5}])
@pytest.mark.parametrize("n, top", [(3, 10), (300, 3)])
def test_best_in_store(spark, monkeypatch, changed, n, top):
    for name, value in changed.items():
        monkeypatch.setattr(matching, name, value)
    store, jds = made(spark, n, n + top), spark.createDataFrame(JDS, JD)
    want = matching.best_for_each(matching.profiles(store), jds, top)
    got = matching.best_in_store(store, jds, top)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_most_profiles_are_never_gathered(spark):
    store = made(spark, 2000, 7)
    jds = spark.createDataFrame([(1, ["python", "SQL"], 3, "Bachelor", "Oslo", [3000, 6000]), (2, ["Rust", "Cobol"], 8, "PhD", "Bergen", [8000, 9000])], JD)
    assert matching.gathered(store, jds).count() <= 0.1 * 2 * 2000
