"""What must hold for queries to grow with their input and with the cores."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitaeflow.functions import filename
from vitaeflow.operators import grounding, overlap, resolution
from vitaeflow.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def _tasks(spark, name):
    return QUERIES[name](spark, SF).rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism


def test_parts_of_a_file_name_are_matched_once(spark):
    names = spark.createDataFrame([("[dev_X 20K]A 3年.pdf",)], "file string")
    meta = names.select(filename.parse_filename(F.col("file")).alias("m")).select("m.*")
    plan = meta._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 20  # hundreds when each field matches all that it is taken from


@needs_tables
def test_file_names_are_read_by_all_cores(spark):
    tasks, want = _tasks(spark, "filename_metadata")
    assert tasks == want


@needs_tables
def test_hints_are_made_by_all_cores(spark):
    tasks, want = _tasks(spark, "context_hints")
    assert tasks == want


@needs_tables
def test_word_files_are_parsed_by_all_cores(spark):
    tasks, want = _tasks(spark, "parse_word_files")
    assert tasks == want


def test_few_texts_need_no_automaton(monkeypatch):
    """Texts of small documents are looked for as they are; both ways tell the same places."""
    source, texts = "ab  cd　ef\nab cd\n\U0001F600gh ij", ["ab cd", "cdef", "gh  ij", "ij", "zz", "\n", " ", "a", "ij\n"]
    monkeypatch.setattr(grounding, "PLAIN", 0)
    want = grounding.find_all(source, texts)
    monkeypatch.undo()
    monkeypatch.setattr(grounding.ahocorasick, "Automaton", None)
    assert grounding.find_all(source, texts) == want
    assert want[0] == (10, 15, 2, "exact") and want[1] == (4, 10, 1, "normalized") and want[4] == (None,) * 4


def _grounded(spark):
    import random

    draw = random.Random(4)
    said = lambda n, chars: "".join(draw.choice(chars) for _ in range(n))
    docs, rows = [], []
    for k, (size, chars) in enumerate([(0, "a"), (40, "ab \n"), (150, "abcdef\n"), (400, "abcdefghijklmnop\U0001F600é\n "), (900, [chr(c) for c in range(40, 900)])]):
        source = said(size, chars)
        docs.append((k, source))
        at = lambda: draw.randrange(len(source) + 1)
        rows += [(k, f"~{source[a : a + draw.randrange(30)]}{said(draw.randrange(6), chars)}~{source[b : b + 9]}") for a, b in ((at(), at()) for _ in range(25))]
    texts = spark.createDataFrame([(k, o, t) for o, (k, t) in enumerate(rows)], "doc_key long, ord int, text string")
    return sorted(map(str, (tuple(r) for autojunk in (True, False) for r in grounding.ground(texts, spark.createDataFrame(docs, "doc_key long, text string"), autojunk=autojunk).collect())))


def test_small_blocks_are_told_without_joins(spark, monkeypatch):
    """Longest blocks of small texts need no joins, and are those that joins tell."""
    monkeypatch.setattr(grounding, "SMALL", -1)
    want = _grounded(spark)
    monkeypatch.undo()
    monkeypatch.setattr(grounding, "longest_blocks", None)
    assert _grounded(spark) == want and any("fuzzy" in x for x in want)


def test_blocks_of_few_rare_characters_need_no_joins(spark, monkeypatch):
    """What has to be looked for counts, not the length of a text and its source; both ways tell the same blocks."""
    import random

    draw = random.Random(5)
    source = "".join(draw.choice("abcdefgh \n") if k % 150 else chr(0x4E00 + k) for k in range(30_000))
    rows = [(1, f"~{source[a : a + 400]}") for a in (7, 9_000, 29_500)]
    texts = spark.createDataFrame([(k, o, t) for o, (k, t) in enumerate(rows)], "doc_key long, ord int, text string")
    docs = spark.createDataFrame([(1, source)], "doc_key long, text string")
    told = lambda: sorted(map(tuple, grounding.ground(texts, docs).collect()))
    monkeypatch.setattr(grounding, "SMALL", -1)
    want = told()
    monkeypatch.undo()
    monkeypatch.setattr(grounding, "longest_blocks", None)
    assert told() == want and [r[3]["match_type"] for r in want] == ["fuzzy"] * 3 and [r[3]["char_start"] for r in want] == [7, 9_000, 29_500]


def test_documents_share_batches():
    """What is found in many small documents leaves Python in a few batches."""
    keys = [f"d{k}" for k in range(600)]
    rows = [r for k in keys for r in ((k, 0, 0, f"text of {k}"), (k, 0, None, k))]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)]
    found = list(grounding._searching(pa.string(), True)(iter([pa.RecordBatch.from_arrays(columns, names=["doc_key", "part", "at", "body"])])))
    assert len(found) == 1 and found[0].column("text").to_pylist() == keys and set(found[0].column("char_start").to_pylist()) == {8}
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
    named = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, [0] * 600, keys), kinds[:3], strict=True)], names=["doc_key", "place", "name"])
    led = list(resolution._leading(0.7, kinds)(iter([named])))
    assert len(led) == 1 and led[0].column("seed").to_pylist() == keys


def test_attributes_are_counted_without_json(spark):
    kinds = "doc_key string, ord int, type string, text string, summary_cn string, reason string, related_entities array<string>, confidence double, attributes struct<name: string>, source_location struct<char_start: int, char_end: int>"
    rows = [("a", 0, "x", "t", "0", "r", [], 1.0, (None,), (0, 1)), ("a", 1, "x", "t", None, "[]", ["q"], 1.0, ("n",), (0, 1)), ("a", 2, "x", "t", "false", "", None, 1.0, None, None), ("a", 3, "x", "t", "s", "{}", [None], 1.0, ("",), None)]
    spans = overlap.spans_of(spark.createDataFrame(rows, kinds))
    assert [r["n_attrs"] for r in spans.orderBy("ord").collect()] == [1, 2, 0, 3]
    assert "from_json" not in spans._jdf.queryExecution().analyzed().toString()


def test_dates_are_stripped_once(spark):
    from vitaeflow.functions.dates import normalize_period

    values = spark.createDataFrame([(" 2019/5 ",), ("",), (None,), ("Now",), ("May 2020",)], "v string").select(normalize_period(F.col("v")).alias("d"))
    assert [r["d"] for r in values.collect()] == ["2019.05", "", None, "Now", "2020.05"]
    assert values._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_stages_keep_little_on_disk(spark):
    """Texts of extractions are kept once, in columns, and shuffle files go with the job that wrote them."""
    import random

    from vitaeflow.config import PipelineConfig
    from vitaeflow.operators import keys
    from vitaeflow.plans import pipeline
    from vitaeflow.schema import EXTRACTION

    draw = random.Random(6)
    sources = [["".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(300)) for _ in range(20)] for _ in range(60)]
    docs = spark.createDataFrame([(f"d{k}", f"d{k}.md", "\n".join(x)) for k, x in enumerate(sources)], "doc_key string, source_file string, text string")
    rows = [{"doc_key": f"d{k}", "ord": o, "type": ("candidate", "entity", "skill", "relation")[o % 4], "text": t} for k, x in enumerate(sources) for o, t in enumerate(x)]
    said = spark.createDataFrame([tuple(r.get(n) for n in EXTRACTION.fieldNames()) for r in rows], EXTRACTION)
    shared = keys.cut(spark.range(1)) and spark.sparkContext.getCheckpointDir().removeprefix("file:")
    shuffles = lambda: {str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(f)}
    kept, before = _bytes(shared), shuffles()
    result = pipeline.run(docs, said, PipelineConfig(kg_injection=True))
    texts = sum(len(r["text"]) for r in rows)
    assert _bytes(shared) - kept < 2 * texts  # nearly 6 times the texts when each stage kept all rows
    left = shuffles() - before
    assert sum(os.path.getsize(f) for f in left if os.path.exists(f)) < texts / 10  # nearly 9 times the texts before
    assert result.extractions.count() == len(rows) == result.stats.first()["total_extractions"] and result.edges.count() > 0
    keys.remove(spark, result.folder)
    assert _bytes(shared) - kept < texts / 2


def test_stages_with_odd_rows(spark):
    """Rows that share a place, have none or no text, stand in no document, or come with a file."""
    from vitaeflow.config import PipelineConfig
    from vitaeflow.plans import pipeline
    from vitaeflow.schema import EXTRACTION

    docs = spark.createDataFrame([("a", "a.md", "one two three\nfour five"), ("b", None, None)], "doc_key string, source_file string, text string")
    rows = [("a", 0, "one two"), ("a", 0, "four"), ("a", 0, "four"), ("a", None, "five"), ("a", 1, None), ("a", 2, ""), ("b", 0, "one"), ("c", 0, "one"), (None, 0, "one")]
    said = [{"doc_key": k, "ord": o, "type": "skill", "text": t, "source_file": "own.md" if t == "five" else None} for k, o, t in rows]
    frame = spark.createDataFrame([tuple(r.get(n) for n in EXTRACTION.fieldNames()) for r in said], EXTRACTION)
    told = lambda **flags: sorted(
        (str(r["doc_key"]), str(r["ord"]), str(r["text"]), str(r["source_file"]), r["source_location"] and r["source_location"]["match_type"], r["source_location"] and r["source_location"]["char_start"])
        for r in pipeline.run(docs, frame, PipelineConfig(**flags)).extractions.collect()
    )
    want = [
        ("None", "0", "one", "None", "none", None), ("a", "0", "four", "a.md", "exact", 14), ("a", "0", "four", "a.md", "exact", 14), ("a", "0", "one two", "a.md", "exact", 0), ("a", "1", "None", "a.md", None, None),
        ("a", "2", "", "a.md", None, None), ("a", "None", "five", "own.md", "exact", 19), ("b", "0", "one", "None", "none", None), ("c", "0", "one", "None", "none", None),
    ]
    assert told(overlap_dedup=False) == want
    assert told() == [w for w in want if "None" not in w[:2]]
    assert {w[4:] for w in told(source_grounding=False)} == {(None, None)}
