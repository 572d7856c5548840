"""Benchmark items with signs glued to their words, or with some words changed."""

import pytest

from vitaeflow.llm import decontamination

WORDS = [f"word{k}" for k in range(200)]


def found(item, text):
    index = decontamination.Index([(7, item.encode())])
    return [x[0] for x in index.look_up([decontamination.words_of(text.encode())])[0]]


@pytest.mark.parametrize("n", [2, 5, 18, 30, 60])
@pytest.mark.parametrize("signs", ["{}.%%%", "({})", "“{}”…", "{}.» –"])
def test_signs_around_words_hide_nothing(n, signs):
    item = " ".join(WORDS[:n]) + "."
    text = " ".join(["before", *WORDS[: n - 1], signs.format(WORDS[n - 1]), "after"])
    assert found(item, text) == [7]


def test_letters_at_the_ends_stay():
    assert decontamination.words_of("éa ñ, «Ö» %% a-b".encode()) == ["éa".encode(), "ñ".encode(), "Ö".encode(), b"%%", b"a-b"]


@pytest.mark.parametrize("n", [20, 30])
def test_one_other_word_in_the_answer(n):
    words = WORDS[:n]
    words[n - 2] = "other"
    assert found(" ".join(WORDS[:n]), " ".join(words)) == [7]
    assert found(" ".join(WORDS[:n]), " ".join(WORDS[: n - n // 4])) == []  # without its answer


def test_long_items_are_judged_as_a_whole():
    words = list(WORDS)
    words[64:128:2] = [f"other{k}" for k in range(32)]  # one segment of four is lost
    words[66:96] = WORDS[66:96]
    assert found(" ".join(WORDS), " ".join(words)) == [7]
    assert found(" ".join(WORDS), " ".join(WORDS[:100])) == []
