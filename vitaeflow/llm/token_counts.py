"""Token counts by rank-synchronous merging of arrays.

A text is split into pre-tokens, whose bytes are held for a whole batch as one ragged array of
symbols. Every round looks up the rank of all neighbouring pairs, takes each sequence's lowest one
and merges its occurrences in all sequences at once, until no pair has a rank. What is left of a
pre-token is its number of tokens. Counts of pre-tokens are kept between batches in a table of at
most ``CACHE_ENTRIES`` entries, which is emptied when full.

Covered are byte-level vocabularies in the JSON format of the public ``tokenizers`` library (no
normalizer, the byte-level pre-tokenizer with its pattern); others are refused.

Nulls and edge cases: a null text counts as empty (0 bytes, 0 tokens); long texts are split into
pre-tokens piece by piece, never cut; added tokens that stand in a text count one each; a null
``doc_id`` passes through; repeated rows are counted alike; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import read

OVER_LIMIT = 1024
CACHE_ENTRIES = 400_000
#: Pre-tokens held at once.
CHUNK = 200_000

#: Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Merges:
    """The merge table of a vocabulary as arrays."""

    def __init__(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        if not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only plain byte-level BPE vocabularies are covered")
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with word or white space rules are not covered")
        vocab = model["vocab"]
        self.first = np.array([vocab[x] for x in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = np.int64(len(pairs))
        self.added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` if there is none) and place in the table of each pair."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none), at

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        left_over = lengths.copy()
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(symbols), self.none)
        place = np.zeros(len(symbols), dtype=np.int64)
        stale = np.arange(len(symbols) - 1)
        while len(symbols) > 1:
            # Only pairs with a symbol made in the last round are looked up anew.
            rank[-1] = self.none
            if len(stale):
                rank[stale], place[stale] = self.lookup(symbols[stale], symbols[stale + 1])
                rank[stale[owner[stale] != owner[stale + 1]]] = self.none
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            live = np.repeat(lowest < self.none, sizes)
            best = (rank == np.repeat(lowest, sizes)) & live
            # Of overlapping occurrences (x x x) every second one is merged, from the left.
            at = np.flatnonzero(best)
            if not len(at):
                break
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbols[at] = self.made[place[at]]
            gone = np.zeros(len(symbols), dtype=bool)
            gone[at + 1] = True
            np.subtract.at(left_over, owner[at], 1)
            changed = np.zeros(len(symbols), dtype=bool)
            changed[at] = True
            keep = live & ~gone  # finished sequences leave
            symbols, owner, rank, place, changed = symbols[keep], owner[keep], rank[keep], place[keep], changed[keep]
            if len(symbols) < 2:
                break
            stale = np.flatnonzero(changed[:-1] | changed[1:])
        return left_over


class Counter:
    """Counts tokens of texts, with the counts of pre-tokens kept between calls."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.known: dict[str, int] = {}
        self.pattern = regex.compile(PATTERN)
        self.added = regex.compile("|".join(map(regex.escape, merges.added))) if merges.added else None

    def learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = list(pieces)
        for k in range(0, len(new), CHUNK):
            part = new[k : k + CHUNK]
            self.known.update(zip(part, self.merges.count([x.encode() for x in part]).tolist(), strict=True))

    def plain_texts(self, texts: list[str]) -> list[int]:
        """Tokens of texts without added tokens; many short texts are taken at once."""
        totals, held, size = [0] * len(texts), [], 0

        def settle() -> None:
            if held:
                self.learn(set().union(*(pieces for _, pieces in held)))
                get = self.known.__getitem__
                for i, pieces in held:
                    totals[i] += sum(map(get, pieces))
                held.clear()

        for i, text in enumerate(texts):
            if len(text) < 4 * CHUNK:
                held.append((i, found := self.pattern.findall(text)))
                size += len(found)
            else:
                walk = self.pattern.finditer(text)
                while found := [m[0] for m in islice(walk, CHUNK)]:
                    held.append((i, found))
                    settle()
            if size > CHUNK:
                settle()
                size = 0
        settle()
        return totals

    def texts(self, texts: list[str]) -> list[int]:
        totals = [0] * len(texts)
        parts, owners = [], []
        for i, text in enumerate(texts):
            if self.added is not None and any(a in text for a in self.merges.added):
                pieces = self.added.split(text)
                totals[i] += len(pieces) - 1
            else:
                pieces = [text]
            parts += pieces
            owners += [i] * len(pieces)
        for i, n in zip(owners, self.plain_texts(parts), strict=True):
            totals[i] += n
        return totals


_counters: dict[str, Counter] = {}


def _counting(spec, key: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:  # kept while the worker process is
            _counters.clear()
            _counters[key] = Counter(Merges(json.loads(spec.value)))
        counter = _counters[key]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = pa.array(counter.texts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), tokens, pa.array(np.asarray(tokens) > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    ``vocabulary`` is the path of a vocabulary file that the driver can read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    Merges(json.loads(content))  # refuse what isn't covered before any task starts
    spec = docs.sparkSession.sparkContext.broadcast(content)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = light.schema["doc_id"].dataType.simpleString()
    return light.mapInArrow(_counting(spec, vocabulary, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by the 50k byte-level vocabulary."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op3_token_counts": op3_token_counts}
