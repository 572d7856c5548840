"""Token counts against the public library."""

import json
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from vitaeflow.llm.token_counts import Counter, Merges, count_tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def counter():
    return Counter(Merges(json.load(open(PATH))))


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


CASES = [
    "", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaaa", "Hello world", "  two  spaces \n\n\t x ", "it's they'll WE'RE", "1234567 890",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "naïve café über größe", "日本語のテキスト", "🙂🙃👩‍👩‍👧", "a b　c d",
    "\x1c\x1d\x1e\x1f x \x85 y", "===================================================", "ab" * 300, "\n" * 50 + "end", "x \n", "﻿start",
]


def test_fixed_cases(counter, library):
    for text in CASES:
        assert counter.texts([text]) == [len(library.encode(text, add_special_tokens=False).ids)], repr(text)


def test_random_texts(counter, library):
    rng = random.Random(5)
    alphabet = "aabcdeeest  \n\t'.,!?019ÄéßñЖ中  😀x"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 120))) for _ in range(2000)]
    assert counter.texts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_text_is_counted_in_pieces(counter, library, monkeypatch):
    monkeypatch.setattr("vitaeflow.llm.token_counts.CHUNK", 50)
    text = "some words, 12 of them; " * 400
    assert counter.texts([text, "x"]) == [len(library.encode(text, add_special_tokens=False).ids), 1]


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "plain text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(docs, PATH).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (None, 10, 2, False)], key=str)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        Merges(json.load(open(public_tokenizers.path("word_bpe_49k.json"))))
