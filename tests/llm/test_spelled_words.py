"""Toxic words spelled letter by letter."""

import numpy as np
import pytest

from tests.llm.test_text_models import docs_of, toxic  # noqa: F401
from vitaeflow.llm import toxicity


@pytest.mark.parametrize("text", ["you are a m o r o n", "you i d i o t.", "such (m o r o n), indeed", "i d i o t m o r o n", "I c l 0 w n!", "“i d i o t”, they said", "a c. l. o. w. n."])
def test_spelled_words_are_found(spark, toxic, text):  # noqa: F811
    _, model, _ = toxic
    assert toxicity.score(docs_of(spark, [(1, text)]), model, toxicity.held_out()).first()["predicted"] == 1


def test_spelled_words_are_divided():
    costs = np.full((28, 28, 28), 4.0)
    text = " a moron a clown a moron a clown "
    kind = [ord(c) - 96 if c != " " else 0 for c in text]
    for a, b, c in zip(kind, kind[1:], kind[2:]):
        costs[a, b, c] = 0.5
    costs[0, 0, 1] = 0.5
    assert toxicity.decode("amoronaclown", costs, True).split() == ["a", "moron", "a", "clown"]
    assert toxicity.decode("am0ron", costs, True).split() == ["a", "moron"]
