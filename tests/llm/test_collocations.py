"""Phrases against counting them all."""

import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaeflow.llm import collocations as phrases

KIND = "doc_id long, text string, lang string, source string, word string, h long, n int, `a b` string"


def by_hand(docs, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        rows = []
        for g, a in own.items():
            if len(g) < 2 or a < 10:
                continue
            if len(g) == 2 and any(100 * b >= 50 * a for h, b in own.items() if len(h) == 3 and b >= 10 and g in (h[:2], h[1:])):
                continue
            score, _, left, right = min((1000000 * a * a // (own[g[:k]] * own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "A", "b", "the", "of", "éa", "Éa", "x-y", "\x00", "\x1c", "#", "日本"] + [f"w{k}" for k in range(40)]
    weights = [40, 5, 30, 30, 20, 5, 5, 4, 2, 2, 3, 3] + [1 + 30 // (k + 1) for k in range(40)]
    seps = [" "] * 20 + ["\t", "  ", ". ", ", ", "\n", "\x0b", "\r", "!", "?;", ":"]
    fixed = ["new york city", "a a a a a", "once upon a time there"]
    out = []
    for k in range(n):
        text = "".join(w + rng.choice(seps) for w in rng.choices(words, weights, k=rng.randrange(30)))
        if rng.random() < 0.3:
            text += rng.choice(seps) + rng.choice(fixed)
        out.append((text, rng.choice(["en", "de", None, "und"])))
    return out + [(None, "en"), ("", "fr"), (" \n ", "fr"), ("same words again here " * 5, "es"), ("same words again here " * 5, "es"), (" ".join(["go on"] * 3000), "en")]


def frame(spark, docs):
    return spark.createDataFrame([(k if k % 7 else None, t, lang, "s", "x", 1, 2, "y") for k, (t, lang) in enumerate(docs)], KIND)


def found(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("changed", [{}, {"FLUSH": 50, "BUCKET": 300, "HELD": 20, "SLICE": 64}, {"ORDERED": 8, "BUCKET": 1000, "FLUSH": 700}, {"ORDERED": 0, "TOP": 7, "SALTS": 3}])
def test_all_phrases(spark, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(phrases, name, value)
    docs = corpus(len(changed))
    got = phrases.collocations(frame(spark, docs).repartition(3))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert found(got) == by_hand(docs, phrases.TOP)


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, corpus(0)).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [("", None), (None, "en"), (". , .", "en")])).count() == 0


def test_products_beyond_64_bits(spark):
    big = [(987_654_321_987_654, 987_654_321_987_655, 999_999_999_999_999), (3, 3, 3), (10**15 - 1, 10**15 - 1, 10**15 - 1), (123_456_789_012, 123_456_789_013, 123_456_789_012_345)]
    got = spark.createDataFrame([tuple(map(Decimal, b)) for b in big], "a decimal(15,0), l decimal(15,0), r decimal(15,0)").select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("x")).collect()
    assert [r["x"] for r in got] == [1000000 * a * a // (left * right) for a, left, right in big]


def test_an_ngram_has_one_owner():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = rng.integers(0, 6, size=40)
        place = rng.permutation(6).astype(np.uint64)
        given = np.array([False, True, True, True, bool(rng.integers(2)), True])
        cells = phrases.fragments(words, place, given)
        rows, sums = phrases.grams(cells, np.ones(len(cells), dtype=np.int64), 6)
        want = Counter(tuple(words[i : i + k].tolist()) for k in (2, 3) for i in range(len(words) - k + 1) if given[words[i : i + k]].all())
        assert {tuple(x for x in r if x): s for r, s in zip(rows.tolist(), sums.tolist())} == want
