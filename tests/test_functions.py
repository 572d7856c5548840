"""Column functions, case by case."""

import pytest
from pyspark.sql import functions as F

from vitaeflow.functions import coerce, dates, filename, jd, scoring, text


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2025 年", "2025.01"), ("2025", "2025.01"), ("2025.9", "2025.09"), ("2020.07", "2020.07"), ("Jul 2020", "2020.07"), ("Sept 2020", "Sept 2020"), ("2019年7月", "2019.07"),
        ("2020/7", "2020.07"), ("2020-07", "2020.07"), ("2020-13", "2020.13"), ("2020.7.1", "2020.7.1"), (" 至今 ", "至今"), ("Present", "Present"), ("", ""), (None, None), ("september 1999", "1999.09"),
    ],
)
def test_periods(spark, value, want):
    assert one(spark, dates.normalize_period, value) == want
    assert one(spark, lambda x: dates.normalize_period(dates.normalize_period(x)), value) == want


@pytest.mark.parametrize(("value", "want"), [(None, None), (" 42 ", 42), ("3.5", None), ("abc", None), ("", None), ("-7", -7), ("99999999999999999999", None)])
def test_safe_int(spark, value, want):
    assert one(spark, coerce.safe_int, value) == want


def test_safe_int_of_number(spark):
    assert one(spark, coerce.safe_int_of_number, 3.9, "double") == 3


FILES = {
    "【高级Web后端开发工程师_成都 18-25K】唐双 6年.pdf": {"position": "高级Web后端开发工程师", "city": "成都", "salary_text": "18-25K", "salary_min": 18000, "salary_max": 25000, "candidate_name": "唐双", "years_text": "6年", "years_of_experience": 6},
    "【【2026秋招】游戏算法工程师_成都 15-16K】姚智强 26年应届生.pdf": {"position": "游戏算法工程师", "city": "成都", "salary_text": "15-16K", "salary_min": 15000, "salary_max": 16000, "candidate_name": "姚智强", "years_text": "26年应届生", "graduate_year": 2026, "tags": ["2026秋招"]},
    "plain name.pdf": {},
    "[dev_X 20K]A": {"position": "dev", "city": "X", "salary_text": "20K", "salary_min": 20000, "candidate_name": "A"},
}


@pytest.mark.parametrize("name", FILES)
def test_filenames(spark, name):
    got = one(spark, filename.parse_filename, name).asDict()
    assert {k: v for k, v in got.items() if v is not None} == FILES[name]


def test_hints(spark):
    assert one(spark, lambda x: filename.context_hints(filename.parse_filename(x)), "[dev_X 20K]A") == "Candidate name: A\nApplied position: dev\nTarget city: X\nSalary range: 20K"
    assert one(spark, lambda x: filename.context_hints(filename.parse_filename(x)), "none") == ""


def test_noise_lines(spark):
    lines = ["keep", "QUJDREVGR0hJSktMTU5PUA==", "A" * 19, "A" * 20, "with space " + "A" * 20, "中" * 25, "-" * 20, ""]
    assert one(spark, text.clean_noise_lines, "\n".join(lines)).split("\n") == ["keep", "A" * 19, "with space " + "A" * 20, "中" * 25, ""]


def test_cleanup_and_cells(spark):
    assert one(spark, text.pdf_cleanup, " a  \n\n\n\nb\t\n") == "a\n\nb"
    assert one(spark, text.docx_cleanup, "**a****b**") == "**ab**"
    assert one(spark, lambda x: text.cell(x, 6), "abcdefgh") == "abcd.."
    assert one(spark, text.cell, None) == "-"


def test_keywords(spark):
    assert one(spark, text.keywords, "Python, 3 years in Beijing") == ["Python", "Beijing"] == text.keyword_list("Python, 3 years in Beijing")
    assert one(spark, text.keywords, "the of 12") == []


def test_jd(spark):
    sample = "Wanted: Python or Java, MySQL, Redis, Docker/K8s, AWS and Go. 3+ years, Bachelor, Beijing, 25K-40K"
    r = one(spark, jd.parse_jd, sample)
    assert r["skills"] == ["AWS", "Docker", "Go", "Java", "K8s", "MySQL", "Python", "Redis"]
    assert (r["min_years"], r["education"], r["city"], r["salary_range"]) == (3, "Bachelor", "Beijing", [25000, 40000])
    assert set(one(spark, jd.parse_jd, "nothing here").asDict().values()) == {None}
    assert one(spark, jd.salary_range, "2019-2023") == [2019, 2023]


@pytest.mark.parametrize(("n", "want"), [(0, 0.0), (5, 0.5), (10, 1.0), (200, 1.0), (201, 0.99875), (600, 0.5), (1000, 0.3)])
def test_specificity(spark, n, want):
    assert one(spark, scoring.text_specificity, "x" * n) == pytest.approx(want)


@pytest.mark.parametrize(("need", "has", "want"), [("Bachelor", "master", 1.0), ("Master", "Bachelor", 0.6), ("PhD", "bachelor", 0.2), ("Bachelor", "Master of Science", 1.0), ("Bachelor", "本科", 0.3), ("本科", "本科", 1.0), ("Bachelor", None, 0.0), (None, None, 1.0)])
def test_education(spark, need, has, want):
    row = spark.createDataFrame([(need, has)], "a string, b string").select(scoring.education_fit(F.col("a"), F.col("b"))).first()
    assert row[0] == pytest.approx(want)


@pytest.mark.parametrize(
    ("wanted", "low", "high", "want"),
    [(None, 1, 2, 1.0), ([10, 20], None, None, 0.5), ([10, 20], 12, 15, 0.3), ([10, 20], 20, 30, 1.0), ([10, 20], 30, 40, 1 - 10 / 15), ([10, 20], 10, None, 0.5), ([10, 20], None, 15, 0.5), ([10, 20], 0, 0, 0.5), ([20, 10], 5, 30, 1 - 10 / 15)],
)
def test_salary(spark, wanted, low, high, want):
    row = spark.createDataFrame([(wanted, low, high)], "w array<bigint>, l bigint, h bigint").select(scoring.salary_fit(F.col("w"), F.col("l"), F.col("h"))).first()
    assert row[0] == pytest.approx(want)


def test_skill_fit(spark):
    rows = [(["Go", "Java"], ["MongoDB", "python"]), (None, []), (["x"], None)]
    got = spark.createDataFrame(rows, "w array<string>, h array<string>").select(scoring.skill_fit(F.col("w"), F.col("h"))).collect()
    assert [r[0] for r in got] == [0.5, 1.0, 0.0]
