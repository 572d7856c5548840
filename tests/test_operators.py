"""Operators on small frames, against brute force where they are not plain SQL."""

import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaeflow.operators import grounding, layout, overlap, resolution
from vitaeflow.operators.keys import numbered


def located(spark, source, *queries):
    docs = spark.createDataFrame([("d", source)], "doc_key string, text string")
    rows = spark.createDataFrame([("d", i, q) for i, q in enumerate(queries)], "doc_key string, ord int, text string")
    return [r["source_location"] for r in grounding.ground(rows, docs).orderBy("ord").collect()]


def test_grounding_levels(spark):
    exact, blind, missing, nothing = located(spark, "first\nJava  and\tSQL here", "Java", "Java and SQL", "zzzz", None)
    assert exact.asDict() == {"char_start": 6, "char_end": 10, "line": 2, "match_type": "exact", "confidence": 1.0}
    assert (blind["char_start"], blind["char_end"], blind["match_type"]) == (6, 20, "normalized")  # the end is where the next solid character stands
    assert (missing["match_type"], missing["char_start"], missing["confidence"]) == ("none", None, 0.1)
    assert nothing is None


def test_grounding_edges(spark):
    wide, end, blank, emoji = located(spark, "😀a　b 漢 字", "ab", "漢字", "  ", "a")
    assert (wide["char_start"], wide["char_end"]) == (1, 5)
    assert (end["char_start"], end["char_end"]) == (5, 8)
    assert (blank["match_type"], blank["char_start"], blank["char_end"]) == ("normalized", 0, 0)
    assert (emoji["char_start"], emoji["match_type"]) == (1, "exact")


@pytest.mark.parametrize("length", [50, 400])
def test_fuzzy_is_the_longest_block(spark, length):
    rng = random.Random(length)
    source = "".join(rng.choice("abcdef ") for _ in range(length))
    query = source[10:30] + "#" * 20 + source[40:45]
    (got,) = located(spark, source, query)
    block = difflib.SequenceMatcher(None, query, source).find_longest_match(0, len(query), 0, len(source))
    if block.size / len(query) >= 0.3:
        assert (got["match_type"], got["char_start"], got["char_end"]) == ("fuzzy", block.b, block.b + block.size)
        assert got["confidence"] == pytest.approx(block.size / len(query) * 0.8)
    else:
        assert got["match_type"] == "none"


SPANS = "doc_key string, ord long, type string, name string, start long, end long, n_attrs long, text_length long, confidence double"


def fold(spans, threshold=0.5):
    """The rule, one span at a time."""
    kept = []
    for x in sorted((s for s in spans if s[4] is not None), key=lambda s: (s[4], s[1])):
        blocked, stay = False, []
        for k in kept:
            common, shorter = min(k[5], x[5]) - max(k[4], x[4]), min(k[5] - k[4], x[5] - x[4])
            named = bool(k[3]) and bool(x[3]) and k[3] != x[3]
            conflict = not blocked and k[2] == x[2] and not named and common > 0 and shorter > 0 and common / shorter > threshold
            if conflict and x[6:] > k[6:]:
                continue
            blocked = blocked or conflict
            stay.append(k)
        kept = stay if blocked else [*stay, x]
    return sorted([s[1] for s in kept] + [s[1] for s in spans if s[4] is None])


def test_greedy_dedup_is_the_fold(spark):
    rng = random.Random(3)
    spans = []
    for ord_ in range(400):
        start = rng.randrange(60) if rng.random() > 0.05 else None
        spans.append((f"d{ord_ % 10}", ord_, rng.choice(["a", "b"]), rng.choice(["", "x", "y"]), start, None if start is None else start + rng.randrange(25), rng.randrange(4), rng.randrange(5), rng.choice([0.1, 0.9])))
    got = overlap.survivors(spark.createDataFrame(spans, SPANS)).collect()
    for key in {s[0] for s in spans}:
        assert sorted(r["ord"] for r in got if r["doc_key"] == key) == fold([s for s in spans if s[0] == key])


def test_overlap_at_the_threshold_is_none(spark):
    rows = [("d", 0, "a", "", 0, 10, 1, 1, 0.5), ("d", 1, "a", "", 5, 15, 1, 1, 0.5), ("d", 2, "a", "", 4, 9, 1, 1, 0.5)]
    frame = spark.createDataFrame(rows, SPANS)
    for width in (3, 4096):
        assert sorted((r["ord"], r["other"]) for r in overlap.overlap_pairs(frame, bin_width=width).collect()) == [(0, 2), (1, 2)]


@settings(max_examples=60, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_similarity_bounds(a, b):
    assert 0.0 <= resolution.similarity(a, b) <= 1.0
    if a and a == b:
        assert resolution.similarity(a, b) == 1.0


def test_clusters(spark):
    names = ["Acme Corp", "AcmeCorp", "Acme Corporation", "Other", "Othr", "Other"]
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate(names)], "doc_key string, ord int, text string")
    got = {r["ord"]: r["canonical"] for r in resolution.clusters(rows).collect()}
    assert got[0] == got[1] == "AcmeCorp" and got[3] == got[4] == got[5] == "Other"


def test_dual_columns(spark):
    blocks = [("d", 1, x, y, x + 10.0, y + 5, t, 0, 100.0) for x, y, t in [(0.0, 2.0, "b"), (0.0, 1.0, "a"), (60.0, 1.0, "c"), (60.0, 2.0, "d")]]
    blocks += [("d", 2, 0.0, float(y), 90.0, 5.0, f"s{y}", 0, 100.0) for y in (2, 1)] + [("d", 2, 0.0, 0.0, 1.0, 1.0, "image", 1, 100.0)]
    frame = spark.createDataFrame(blocks, "doc_key string, page int, x0 double, y0 double, x1 double, y1 double, text string, kind int, width double")
    assert [r["text"] for r in layout.page_texts(frame).orderBy("page").collect()] == ["a\n\nb\n\n\n\nc\n\nd", "s1\n\ns2"]
    assert layout.document_texts(frame).first()["text"] == "a\n\nb\n\nc\n\nd\n\n---\n\ns1\n\ns2"


def test_numbers_are_dense_and_in_order(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"))
    got = numbered(rows, ["k"], "n", 10).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(11, 1011))
