"""A store on disk: changes are whole or not there, untouched rows are not rewritten."""

import os

import pytest

from vitaeflow.operators import store_folder
from vitaeflow.operators.store import TalentStore, import_extractions
from vitaeflow.operators.store_folder import Conflict, StoreFolder
from vitaeflow.schema import EXTRACTION, TABLES

NAMES = EXTRACTION.fieldNames()


def said(spark, keys):
    rows = []
    for key in keys:
        own = [{"type": "candidate", "text": key, "attributes": {"name": f"Name {key}", "age": "30"}}, {"type": "candidate", "text": "second"}]
        own += [{"type": "skill", "text": s, "attributes": {"name": s}} for s in ("Python", f"only {key}", "Python", "")]
        own += [{"type": "experience", "text": "x", "attributes": {"company": f"C{k}"}} for k in range(3)]
        own += [{"type": "education", "text": "e"}, {"type": "job_intention", "text": "wish", "attributes": {"position": None}}, {"type": "self_evaluation", "text": "calm"}, {"type": "certification", "text": "c", "attributes": {"name": ""}}]
        rows += [{"doc_key": key, "ord": k, **x} for k, x in enumerate(own)]
    attributes = EXTRACTION["attributes"].dataType.fieldNames()
    flat = [tuple(tuple((r.get(n) or {}).get(a) for a in attributes) if n == "attributes" else r.get(n) for n in NAMES) for r in rows]
    return spark.createDataFrame(flat, EXTRACTION)


def rows_of(store: TalentStore):
    plain = [c for c in store.candidates.columns if c not in ("created_at", "raw_json")]
    return {t: sorted(map(str, (store.candidates.select(*plain) if t == "candidates" else getattr(store, t)).collect())) for t in TABLES}


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_folder, "BUCKETS", 3)
    return StoreFolder(spark, str(tmp_path / "db"))


def test_changes(spark, folder):
    assert folder.read().candidates.count() == 0 and folder.current()[0] == 0
    first, second = [f"a{k}" for k in range(5)], ["b0", "a3"]
    assert folder.add(said(spark, first)) == 5
    want = import_extractions(said(spark, first), TalentStore.empty(spark))
    assert rows_of(folder.read()) == rows_of(want)
    assert [r["name"] for r in want.certifications.collect()] == [""] * 5 and want.job_intentions.first()["position"] is None and want.skills.count() == 6
    before = files(folder.path)
    assert folder.add(said(spark, second)) == 2  # a3 comes again, unless known sources are refused
    assert rows_of(folder.read()) == rows_of(import_extractions(said(spark, second), want))
    assert all(files(folder.path)[f] == t for f, t in before.items())
    assert folder.add(said(spark, [*second, "c"]), refuse_known=True) == 1
    whole, held = rows_of(folder.read()), files(folder.path)
    assert folder.delete(spark.createDataFrame([(2,), (99,)], "id long")) == 1 and folder.delete(spark.createDataFrame([(2,)], "id long")) == 0
    left = rows_of(folder.read())
    assert len(left["candidates"]) == 7 and len(left["experiences"]) == 21 and left["skills"] == whole["skills"] and len(left["candidate_skills"]) == 14
    listed = {f for own in folder.current()[1]["experiences"].values() for f in own}
    assert sum(any(f"{folder.path}/{x}/" in f for x in listed) for f in held) > 0  # other buckets are as they were
    folder.compact()
    assert rows_of(folder.read()) == left and all(len(f) == 1 for own in folder.current()[1].values() for f in own.values())


def test_a_change_that_breaks_off_leaves_the_store(spark, folder, monkeypatch):
    folder.add(said(spark, ["a", "b"]))
    whole = rows_of(folder.read())
    real = StoreFolder._write

    def breaks(self, change, name, rows):
        if name == "skills":
            raise OSError("the disk is full")
        return real(self, change, name, rows)

    monkeypatch.setattr(StoreFolder, "_write", breaks)
    with pytest.raises(OSError):
        folder.add(said(spark, ["c"]))
    monkeypatch.setattr(StoreFolder, "_write", real)
    assert rows_of(folder.read()) == whole
    folder.add(said(spark, ["d"]))
    assert [r["source_file"] for r in folder.read().candidates.orderBy("id").collect()] == ["a", "b", "d"]


def test_of_two_changes_the_later_one_fails(spark, folder):
    folder.add(said(spark, ["a"]))
    number, tables = folder.current()
    folder.add(said(spark, ["b"]))
    with pytest.raises(Conflict):
        folder._switch(number, tables)
    assert folder.read().candidates.count() == 2 and folder._lists() == [1, 2]
