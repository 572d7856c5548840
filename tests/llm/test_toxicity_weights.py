"""Weights of rare features and small tables; the regression's optimum."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_text_models import SYLLABLES, docs_of, prose
from vitaeflow.llm import toxicity


def table(spark, n, bad, insult):
    rng = random.Random(12)
    rows = [(i, prose(rng, SYLLABLES["en"], 30)[:-1] + (" " + insult(i) if bad(i) else "")) for i in range(n)]
    return docs_of(spark, rows), spark.createDataFrame([(i, int(bad(i))) for i in range(n)], "doc_id long, toxic int")


def predicted(spark, model, text):
    return toxicity.score(docs_of(spark, [(1, text)]), model, toxicity.held_out()).first()["predicted"]


def test_few_toxic_rows_are_learned_from(spark):
    model = toxicity.fit(*table(spark, 80, lambda i: i % 8 == 0, lambda i: "moron"))
    assert predicted(spark, model, "you moron") == 1 and predicted(spark, model, "you there") == 0


def test_rare_insults_are_learned(spark):
    model = toxicity.fit(*table(spark, 500, lambda i: i % 4 == 0, lambda i: "dolt" if i % 100 == 0 else "moron"))
    assert predicted(spark, model, "you dolt") == 1 and predicted(spark, model, "you there") == 0


def test_weights_are_the_optimum():
    rng = np.random.default_rng(13)
    held = rng.random((120, 40)) < 0.2
    toxic = (held[:, 0] | (rng.random(120) < 0.1)).astype(float)
    feature, owner = np.nonzero(held.T)
    intercept, weights = toxicity.fit_weights(owner, np.r_[0, np.cumsum(np.bincount(feature, minlength=40))], toxic)
    slopes = (toxic - 1 / (1 + np.exp(-intercept - held @ weights))) @ held
    assert weights[0] > 1 and (np.abs(slopes[weights == 0]) <= toxicity.PENALTY + toxicity.TOLERANCE).all()
    assert np.allclose(slopes[weights != 0], toxicity.PENALTY * np.sign(weights[weights != 0]), atol=toxicity.TOLERANCE)


def test_scores_are_those_of_brute_force(spark):
    """Plain words: a score is the logistic function of the summed weights of words and beginnings."""
    docs, labels = table(spark, 300, lambda i: i % 5 == 0, lambda i: ("dolt", "moron", "nitwit")[i % 3])
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, toxicity.held_out()).collect()}
    for r in docs.collect():
        words = {w.strip(".") for w in r["text"].lower().split()}
        held = words | {w[:k] + "-" for w in words for k in (4, 5, 6) if len(w) >= k}
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-model.prior - sum(model.weights.get(f, 0.0) for f in held))))


def test_letters_are_counted_by_characters_within_texts(spark):
    texts = ["abc", "", "é1x", None, "Ünü " * 5, "z"]
    want = Counter()
    for t in filter(None, texts):
        kind = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0 for c in t.replace("Ü", "ü").lower())]
        want.update(zip(kind, kind[1:], kind[2:]))
    column = pa.RecordBatch.from_arrays([pa.array([t or "" for t in texts])], names=["text"])
    (batch,) = toxicity._letter_counts(iter([column]))
    got = {(g // 784, g // 28 % 28, g % 28): n for g, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert {k: v for k, v in got.items() if k[2]} == {k: v for k, v in want.items() if k[2]}
