"""Files to pipeline to store to search and match; the command line; the stream; documents."""

import io
import json
import zipfile

import pytest

from vitaeflow import cli
from vitaeflow.config import PipelineConfig
from vitaeflow.operators import matching, search
from vitaeflow.operators.store import TalentStore, delete_candidates, import_extractions
from vitaeflow.plans import pipeline
from vitaeflow.sources.documents import read_documents
from vitaeflow.sources.extractions import read_extractions, read_texts

RESUME = """Ann Example, Python engineer, Springfield, ann@example.org
Acme Works, developer, from Jul 2018 until 2021/3: built the billing system
State College, Bachelor of physics
Skills: Python, MySQL
"""


def items(name: str, city: str, degree: str, months: int, skills: list[str]) -> list[dict]:
    return [
        {"type": "candidate", "text": RESUME.split("\n")[0].replace("Ann Example", name), "summary_cn": "short", "attributes": {"name": name, "age": "31", "city": city, "education_level": degree}},
        {"type": "experience", "text": "Acme Works, developer", "attributes": {"company": "Acme Works", "title": "developer", "period_start": "Jul 2018", "period_end": "2021/3", "duration_months": months, "projects": [{"name": "billing"}]}},
        {"type": "education", "text": "State College, Bachelor of physics", "attributes": {"school": "State College", "degree": degree}},
        *({"type": "skill", "text": s, "attributes": {"name": s, "category": "language", "years": "3.5"}} for s in skills),
        {"type": "job_intention", "text": "engineer", "attributes": {"position": "engineer", "salary_min": 20000, "salary_max": 30000}},
        {"type": "self_evaluation", "text": "careful", "attributes": {"traits": ["calm"]}},
    ]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "json").mkdir()
    (root / "text").mkdir()
    people = {"a": ("Ann Example", "Springfield", "Bachelor", 32, ["Python", "MySQL"]), "b": ("Bob Other", "Shelbyville", "Master", 80, ["Java", "Python", "Python"]), "c": ("Cy Third", "Springfield", "PhD", 0, [])}
    for key, person in people.items():
        own = items(*person)
        (root / "json" / f"{key}.json").write_text(json.dumps(own if key != "b" else {"extractions": own}, ensure_ascii=False))
        (root / "text" / f"{key}.md").write_text(RESUME.replace("Ann Example", person[0]))
    (root / "json" / "broken.json").write_text('{"x": 1}')
    (root / "json" / "nobody.json").write_text(json.dumps(items("x", "y", "z", 1, [])[1:]))
    (root / "json" / "zero.json").write_text("[]")
    return root


@pytest.fixture(scope="module")
def read(spark, files):
    extractions, status = read_extractions(spark, str(files / "json"))
    return extractions.persist(), status


@pytest.fixture(scope="module")
def store(spark, read):
    return import_extractions(read[0], TalentStore.empty(spark))


def test_status(read):
    assert {r["doc_key"]: r["status"] for r in read[1].collect()} == {"a": "ok", "b": "ok", "c": "ok", "nobody": "ok", "broken": "not a list of extractions", "zero": "no extractions"}


def test_pipeline(spark, files, read):
    result = pipeline.run(read_texts(spark, str(files / "text")), read[0], PipelineConfig.of({"pipeline_config": {"kg_injection": True}, "unknown": 1}))
    rows = [r for r in result.extractions.collect() if r["doc_key"] == "a"]
    by = {r["type"]: r for r in rows}
    assert len(rows) == 7 and by["candidate"]["source_location"]["match_type"] == "exact" and by["candidate"]["source_location"]["line"] == 1
    assert by["experience"]["attributes"]["period_start"] == "2018.07" and by["experience"]["attributes"]["period_end"] == "2021.03"
    assert by["candidate"]["confidence"] == 0.773 and by["education"]["confidence"] == 0.69 and by["experience"]["source_file"] == "a.md"
    edges = [r for r in result.relations.collect() if r["doc_key"] == "a"]
    assert sorted((r["type"], r["target_name"]) for r in edges) == [("has_skill", "MySQL"), ("has_skill", "Python"), ("studied_at", "State College"), ("worked_at", "Acme Works")]
    stats = result.stats.first()
    assert stats["total_extractions"] == result.extractions.count() and stats["by_type"]["candidate"] == 3
    assert result.nodes.count() == 0 and result.edges.count() == result.relations.filter("confidence >= 0.3").count()


def test_store(store):
    assert [(r["id"], r["name"], r["age"]) for r in store.candidates.orderBy("id").collect()] == [(1, "Ann Example", 31), (2, "Bob Other", 31), (3, "Cy Third", 31)]
    assert store.experiences.count() == 3 and store.skills.count() == 3 and store.candidate_skills.count() == 4
    first = store.experiences.orderBy("id").first()
    assert json.loads(first["projects"])[0]["name"] == "billing" and first["start_date"] == "Jul 2018"
    assert store.candidate_skills.first()["years"] is None


def test_second_import_keeps_ids_apart(store, read):
    again = import_extractions(read[0].filter("doc_key = 'a'"), store)
    assert again.candidates.agg({"id": "max"}).first()[0] == 4 and again.skills.count() == 3


def test_search_and_detail(store):
    names = lambda df: [r["name"] for r in df.collect()]
    assert names(search.search(store, query="python springfield")) == ["Ann Example"]
    assert names(search.search(store, city="SPRING")) == ["Cy Third", "Ann Example"]
    assert names(search.search(store, skill="java", min_years=6)) == ["Bob Other"]
    assert names(search.search(store, min_years=0)) == ["Cy Third", "Bob Other", "Ann Example"]
    assert names(search.search(store, query="the 3 years")) == ["Cy Third", "Bob Other", "Ann Example"]
    detail = search.candidate_detail(store, 1).first()
    assert [s["name"] for s in detail["skills"]] == ["MySQL", "Python"] and detail["job_intentions"][0]["salary_max"] == 30000
    assert search.candidate_detail(store, 99).count() == 0
    assert [(r["id"], r["skill_count"]) for r in search.list_candidates(store, 2).collect()] == [(3, 0), (2, 2)]
    overview = search.statistics(store).first()
    assert (overview["total_candidates"], overview["avg_experiences"]) == (3, 1.0)


def test_match(spark, store):
    jd = spark.createDataFrame([(1, ["Python", "MySQL"], 2, "Bachelor", "Springfield", [25000, 40000])], "jd_id int, skills array<string>, min_years int, education string, city string, salary_range array<bigint>")
    best = matching.best(matching.profiles(store), jd).collect()
    assert best[0]["name"] == "Ann Example" and best[0]["total_score"] == pytest.approx(0.4 + 0.2 + 0.15 + 0.15 + 0.1 / 3, abs=1e-3)


def test_delete_cascades(spark, store):
    left = delete_candidates(store, spark.createDataFrame([(2,)], "id long"))
    assert left.candidates.count() == 2 and left.experiences.count() == 2 and left.candidate_skills.count() == 2 and left.skills.count() == 3


def test_command_line(spark, files, tmp_path, capsys):
    db = str(tmp_path / "db")
    assert cli.main(["import", "--input", str(files / "json"), "--db", db], spark) == 1  # some files were refused
    assert cli.main(["search", "--city", "Shelby", "--db", db], spark) == 0
    assert "Bob Other" in capsys.readouterr().out
    assert cli.main(["delete", "2", "--db", db], spark) == 0 and cli.main(["delete", "2", "--db", db], spark) == 1
    assert cli.main(["detail", "1", "--db", db], spark) == 0 and cli.main(["list", "--db", db], spark) == 0
    assert cli.main(["stats", "--by", "city", "--json", "--db", db], spark) == 0
    (tmp_path / "jd.txt").write_text("Python, 2 years, Bachelor")
    assert cli.main(["match", "--jd", str(tmp_path / "jd.txt"), "--db", db], spark) == 0
    assert cli.main(["pipeline", "--input", str(files / "json" / "a.json"), "--source", str(files / "text"), "--output", str(tmp_path / "out"), "--kg"], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["search", "--db", db], spark)


def test_stream(spark, files, tmp_path):
    from vitaeflow.streaming.ingest import watch

    stream = watch(spark, str(files / "json"), read_texts(spark, str(files / "text")), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    stream.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "extractions")).filter("doc_key = 'a'").count() == 7


def word_file(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    run = lambda t, mark="": f"<w:r><w:rPr>{mark}</w:rPr><w:t>{t}</w:t></w:r>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{run("Head")}</w:p><w:p>{run("bold", "<w:b/>")}{run("more", "<w:b/>")} </w:p><w:p/>'
    body += f'<w:p><w:pPr><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr>{run("item")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("x")}</w:p></w:tc><w:tc><w:p>{run("y")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{run("1")}</w:p></w:tc><w:tc><w:p>{run("2")}</w:p></w:tc></w:tr></w:tbl>'
    (tmp_path / "[dev_X 20K]A.docx").write_bytes(word_file(body))
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "n.xyz").write_bytes(b"?")
    (tmp_path / "t.md").write_text("keep\n" + "A" * 30)
    got = {r["source_file"]: r for r in read_documents(spark, str(tmp_path)).collect()}
    assert got["[dev_X 20K]A.docx"]["text"] == "## Head\n\n**boldmore**\n\n- item\n\n| x | y |\n| --- | --- |\n| 1 | 2 |"
    assert got["[dev_X 20K]A.docx"]["meta"]["city"] == "X" and got["t.md"]["text"] == "keep"
    assert got["bad.docx"]["status"].startswith("BadZipFile") and got["n.xyz"]["status"] == "no parser for .xyz"
