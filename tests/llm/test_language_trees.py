"""Context trees hold all strings seen, in one part or in many."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitaeflow.llm import language


def rows_of(spark):
    rng = random.Random(11)
    letters = {"de": "aeinstäöß", "en": "aeinstwyk", "zh": "的一是不了人我在"}
    rows = [(i, " ".join("".join(rng.choices(own, k=rng.randint(1, 7))) for _ in range(30)), lang) for i, (lang, own) in enumerate(list(letters.items()) * 20)]
    return rows, spark.createDataFrame([*rows, (900, "x", None)], "doc_id long, text string, lang string")


@pytest.mark.parametrize("cells", [4_000_000, 60])
def test_no_string_is_left_out_of_the_trees(spark, monkeypatch, cells):
    monkeypatch.setattr(language, "MAX_CELLS", cells)
    rows, frame = rows_of(spark)
    counted = {}
    for lang in ("de", "en", "zh"):
        own = np.concatenate([language.grams(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0])) for _, t, own in rows if own == lang])
        keys, n = np.unique(own, return_counts=True)
        counted[lang] = (keys.astype(np.uint64), n.astype(float))
    texts = pa.array([*(t for _, t, _ in rows[:9]), "neverseen Q#ሴ", "", "的"])
    want = language.Trees(counted).score(texts)
    model = language.learn(frame, F.lit(True))
    assert (len(model.trees) > 5) == (cells == 60)
    assert np.allclose(model.score(texts), want, rtol=1e-5)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame, model, F.lit(False)).collect()}
    assert len(got) == len(rows) + 1 and all(got[i] == lang for i, _, lang in rows)
