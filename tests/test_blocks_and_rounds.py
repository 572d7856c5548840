"""Longest blocks, searches in one pass, clusters in rounds and segments against doing it one by one."""

import difflib
import random
import re

import numpy as np
import pytest

from vitaeflow.operators import blocks, grounding, overlap, resolution


def aligned(source: str, query: str):
    """The three searches, one text at a time."""
    at = source.find(query)
    if at >= 0:
        return at, at + len(query), "exact", 1.0
    solid = [k for k, c in enumerate(source) if not c.isspace()]
    place = lambda k: solid[k] if k < len(solid) else len(source)
    dense, own = re.sub(r"\s+", "", source), re.sub(r"\s+", "", query)
    at = dense.find(own)
    if at >= 0:
        return place(at), place(at + len(own)), "normalized", 0.85
    block = difflib.SequenceMatcher(None, query, source).find_longest_match(0, len(query), 0, len(source))
    if block.size and block.size / len(query) >= 0.3:
        return block.b, block.b + block.size, "fuzzy", block.size / len(query) * 0.8
    return None, None, "none", 0.1


def sources(rng):
    out = {}
    for k in range(40):
        letters = rng.choice(["ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789 .\n", "".join(chr(0x4E00 + c) for c in range(400)) + "，\n", "aé😀　\t\x1c x"])
        size = rng.choice([0, 1, 5, 60, 199, 200, 201, 700, 3000])
        out[f"d{k}"] = "".join(rng.choice(letters) for _ in range(size))
    return out


def texts_of(rng, source):
    out = ["x", " ", "zzzz", "\x1c"]
    for _ in range(12):
        a, b = sorted(rng.randrange(len(source) + 1) for _ in range(2))
        b = min(b, a + rng.choice([3, 20, 80]))
        own = source[a:b]
        out += [own, own.replace(" ", ""), " ".join(own), "~" + own, own + "QQ" * rng.randrange(9), own[::-1], own[: len(own) // 2] + "#" + own[len(own) // 2 :] + "##"]
    return [t for t in out if t]


@pytest.mark.parametrize("changed", [{}, {"PIECE": 7, "TEXTS": 5, "HOT_SHARE": 1000}])
def test_locations(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(grounding, name, value)
        if hasattr(blocks, name):
            monkeypatch.setattr(blocks, name, value)
    rng = random.Random(len(changed))
    held = sources(rng)
    asked = [(key, k, t) for key, source in held.items() for k, t in enumerate(texts_of(rng, source))] + [("nowhere", 0, "text"), ("d0", 999, None), ("d0", 998, ""), (None, 1, "x")]
    docs = spark.createDataFrame([*held.items(), ("unasked", "text")], "doc_key string, text string")
    rows = spark.createDataFrame(asked, "doc_key string, ord int, text string")
    got = {(r["doc_key"], r["ord"]): r["source_location"] for r in grounding.ground(rows, docs).collect()}
    assert len(got) == len(asked)
    kinds = set()
    for key, k, text in asked:
        where = got[key, k]
        if not text:
            assert where is None
            continue
        start, end, kind, sure = aligned(held[key], text) if key in held else (None, None, "none", 0.1)
        kinds.add(kind)
        line = None if start is None else held[key][:start].count("\n") + 1
        assert (where["char_start"], where["char_end"], where["match_type"], where["line"]) == (start, end, kind, line), (held[key], text)
        assert where["confidence"] == pytest.approx(sure)
    assert kinds == {"exact", "normalized", "fuzzy", "none"}


def test_places_of_many_patterns():
    rng = random.Random(2)
    source = "".join(rng.choice("ab ") for _ in range(2000))
    patterns = ["", "a", "aaaaaaaaaaaaaaaaa", *("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 14))) for _ in range(300))]
    assert grounding.first_places(source, patterns) == [source.find(p) for p in patterns]


def one_by_one(names, threshold=0.7):
    seed = {}
    for i, a in enumerate(names):
        if i in seed:
            continue
        seed[i] = i
        for j in range(i + 1, len(names)):
            if j not in seed and resolution.similarity(a, names[j]) >= threshold:
                seed[j] = i
    return seed


@pytest.mark.parametrize("changed", [{}, {"LEADERS": 7, "NAMES": 3}])
def test_clusters_in_rounds(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(resolution, name, value)
    rng = random.Random(4)
    held = {}
    for d in range(6):
        base = ["".join(rng.choice("abcdeé 漢") for _ in range(rng.randrange(1, 16))) for _ in range(25)]
        names = [b if rng.random() < 0.2 else b[:k] + rng.choice(["", "x", " ", "yy"]) + b[k:] for b in base for k in (rng.randrange(len(b) + 1),) for _ in range(3)]
        rng.shuffle(names)
        held[f"d{d}"] = [*names, "", None, *names[:3]]
    rows = spark.createDataFrame([(d, k, n) for d, names in held.items() for k, n in enumerate(names)], "doc_key string, ord long, text string")
    got = {(r["doc_key"], r["ord"]): (r["text"], r["canonical"]) for r in resolution.clusters(rows).collect()}
    for d, names in held.items():
        plain = [n or "" for n in names]
        seed = one_by_one(plain)
        for k, name in enumerate(names):
            own = [plain[j] for j in range(len(names)) if seed[j] == seed[k]]
            assert got[d, k] == (name, resolution.canonical(own))


def test_names_that_may_be_similar():
    rng = random.Random(9)
    names = ["".join(rng.choice("abcABC é漢") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    counts, sizes = resolution.histograms(names), np.array(list(map(len, names)))
    for k, a in enumerate(names):
        fits = resolution.may_be_similar(counts[k], len(a), counts, sizes, 0.7)
        assert all(fits[j] for j, b in enumerate(names) if resolution.similarity(a, b) >= 0.7)


def test_segments_are_apart_and_many(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BIN", 50)
    rng = random.Random(6)
    spans = [("d", k, rng.choice(["a", None]), "", s := rng.randrange(20_000), s + rng.randrange(12), 1, rng.randrange(9), 0.5) for k in range(3000)]
    spans += [("d", 5000, "b", "", 0, 20_000, 1, 1, 0.5), ("d", 5001, "b", "", 19_000, 19_001, 1, 9, 0.5)]
    frame = spark.createDataFrame(spans, "doc_key string, ord long, type string, name string, start long, end long, n_attrs long, text_length long, confidence double")
    cut = overlap.segments(frame).collect()
    assert len({(r["kind"], r["segment"]) for r in cut}) > 50
    ends = {}
    for r in sorted(cut, key=lambda r: (r["kind"], r["segment"], r["start"])):
        key = r["kind"]
        last = ends.get(key, (r["segment"], -1))
        assert r["segment"] == last[0] or r["start"] >= last[1]
        ends[key] = (r["segment"], max(last[1], r["end"]))
    left = {r["ord"] for r in overlap.survivors(frame).collect()}
    from tests.test_operators import fold

    assert sorted(left) == sorted(x for kind in ("a", None, "b") for x in fold([s for s in spans if s[2] == kind]))
