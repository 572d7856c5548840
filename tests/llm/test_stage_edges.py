"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows, clashing names, nothing."""

import random
from collections import Counter

import pytest

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, draw map<string,int>, row int, component string, shard string, `a b` int"


def rows():
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n)) + "."
    one, two = prose(60), prose(40)
    found = [(1, one, "en", "s1"), (1, one, "en", "s1"), (1, two, "en", "s1"), (7, one + " end", "en", "s2"), (2, None, None, None), (2, None, None, None), (3, "", "de", "s1"), (4, " \n\t", "de", None)]
    found += [(None, one, "en", "s2"), (None, None, None, None), (5, prose(40_000), "en", "s2"), (6, "x" * 100_000, None, "s1"), *((20 + k, prose(30), "en", f"s{k % 3}") for k in range(12))]
    return [(*r, len(r[1] or ""), "clash", "clash", {"k": 1}, 1, "clash", "clash", 4) for r in found]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels = [(20 + k, 1, int(k == 1)) for k in range(12)] + [(None, None, 1), (3, None, None), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (None, "some words that are in no text"), (3, "y")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(r):
    return (r["doc_id"], r["text"], r["source"])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, folder, name, stage):
    docs = spark.createDataFrame(rows(), KIND)
    out = stage(spark, docs, folder)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == ([c for c in docs.columns if c != "shard"] + ["shard", "slot", "grown_shard"] if last else docs.columns)
    got, given = Counter(map(key, out.collect())), Counter(map(key, docs.collect()))
    one = rows()[0][1]
    if name == "near_duplicates":
        want = given - Counter({(1, one, "s1"): 1, (7, one + " end", "s2"): 1})
        assert got == want
    elif name == "mixing":
        assert set(got) <= set(given) and all(got[k] <= 3 * n for k, n in given.items())
        assert all(got[k] == n for k, n in given.items() if not (k[1] or "").split())
    elif name == "toxicity":
        assert not got - given and all(got[k] == n for k, n in given.items() if not (k[1] or "").split())
    else:
        assert got == given
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_run_on_an_empty_table(spark, folder, tmp_path):
    import shutil

    shutil.copytree(folder, tmp_path / "t")
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/t/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/t").count() == 0
