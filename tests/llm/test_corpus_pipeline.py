"""The pipeline's stages, one by one, against brute force on their own inputs."""

import random
from collections import Counter

import corpus_pipeline
from vitaeflow.llm import decontamination, near_duplicates, sharding
from vitaeflow.llm.registry import oracle_sql, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, folder):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ta", "ro", "mi", "ke", "su"]) for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for i in range(240):
        words, bad = [word() for _ in range(50)], i % 5 == 0
        if bad:
            words[7] = "moron"
        if i % 7 == 1:
            words[20:20] = items[i % 6][1].split()
        if i % 11 == 2:
            words = rows[i - 1][1].split()
        labels.append((i, 1, int("moron" in words)))  # a copy is labelled as its text is
        rows.append((i, " ".join(words), "en", f"s{i % 4}", len(" ".join(words))))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    items = make(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    states = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        states[name] = docs.collect()
        assert docs.columns[: len(COLUMNS)] == COLUMNS
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    clean = {i for i, t in texts.items() if "moron" not in t.split()}
    assert {r["doc_id"] for r in states["toxicity"]} == clean
    first = {}
    for i in sorted(clean):
        first.setdefault(texts[i], i)
    sets = {i: near_duplicates.Sketcher().hashes(texts[i].encode().split()) for i in first.values()}
    assert not any(near_duplicates.linked(sets[a], sets[b]) for a in sets for b in sets if a < b)
    assert Counter(r["doc_id"] for r in states["near_duplicates"]) == Counter(first.values())
    leaking = {i for i in first.values() if any(t in texts[i] for _, t in items)}
    assert {r["doc_id"] for r in states["decontamination"]} == set(first.values()) - leaking
    mixed = Counter(r["doc_id"] for r in states["mixing"])
    assert max(mixed.values()) <= 3 and set(mixed) <= {r["doc_id"] for r in states["decontamination"]} and max(mixed.values()) > 1
    assert Counter(r["doc_id"] for r in states["sharding"]) == mixed
    for r in states["sharding"]:
        assert sharding.jump(sharding.mix(__import__("numpy").array([r["doc_id"]])), 40)[0] == r["shard"]


def test_run_is_the_stages_in_a_row(spark, tmp_path):
    make(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*COLUMNS, "shard", "slot", "grown_shard"] and got.count() > 100


def test_every_operator_is_registered():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(oracle_sql()) <= set(names) and decontamination.OVERLAP == 0.8
