"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The test items are cut into segments of at most ``SEGMENT_WORDS`` words and held in an inverted
index whose terms are word pairs; the impact of a pair in a segment is its BM25 weight as a share
of the segment's own score, so a passage that holds a whole segment scores 1. Postings are ordered
by segment and cut into blocks with their highest impacts.

Every training passage (windows of ``PASSAGE_WORDS`` words at steps of half of it, over the whole
text) is a query, and all segments at or above ``THRESHOLD`` are retrieved. A passage whose pairs
cannot reach it even with their highest impacts has an empty pivot and is skipped; this bound is
taken for all passages of a batch at once, the walk over the postings for those left.

Words are compared without the signs around them. A word of a segment is held by a passage if it
stands there next to its neighbour, or to the neighbour after next with one other word between. An
item is a candidate in a document once one of its segments is retrieved, and found if at least
``OVERLAP`` of the words of its questions and of its answers (the last quarter of each segment) are
held, over all of its segments: those not retrieved count with the passage that has most of their
pairs. An item's score is the mean of its segments' best scores by words.

Bounds: items are indexed in parts of at most ``MAX_INDEX_WORDS`` words (a longer item is a part of
its own), counted by the engine before any text is fetched. The driver holds one part's texts at a
time and its index, flat arrays of about 40 bytes a word besides the vocabulary. Every part is shipped
to the executors and all documents are searched with it, so no item is left out.

Nulls and edge cases: null texts of documents and items count as empty and match nothing; items
with fewer than two words have no pair and are found by equality of the whole document; repeated
items are reported each; a null ``doc_id`` passes through; repeated documents are reported each
time; very long texts are searched whole, passage by passage; of passages with equal scores the first
counts; empty tables give an empty result; other columns are ignored by ``find_leaks`` and kept, with
the rows, by ``without_leaks``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import arrow_map, cut, read, text_or_empty, word_count

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SEGMENT_WORDS = 64
PASSAGE_WORDS = 128
STEP = PASSAGE_WORDS // 2
BLOCK = 16
MAX_INDEX_WORDS = 1_000_000
#: Words of texts that are looked up at once.
CHUNK_WORDS = 400_000
# Signs that are taken off at both ends of words, as ASCII bytes and with UTF-8 signs.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SIGN = rb"(?:[!-/:-@\[-`{-~]|\xc2[\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\x83\x88-\x91])+"
_EDGES = re.compile(rb"\A" + _SIGN + rb"|" + _SIGN + rb"\Z")


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case (bytes methods know just these) and
    without signs at their ends; a word of signs only stays as it is."""
    words = [w.strip(SIGNS) or w for w in text.lower().split()]
    return words if text.isascii() else [w if w.isascii() else _EDGES.sub(b"", w) or w for w in words]


class Index:
    """The inverted index over the segments of (item_id, text) rows, in flat arrays.

    Segment k has the words ``words[starts[k] : starts[k + 1]]`` and belongs to row ``rows[k]``; the
    segments with pair p, and their impacts, are at ``heads[p] : heads[p + 1]`` of ``ids`` and
    ``weights``, their blocks' highest impacts at ``tops[p] : tops[p + 1]`` of ``highs``.
    """

    def __init__(self, items: Iterator[tuple[int | None, bytes]]):
        self.vocab: dict[bytes, int] = {}
        self.single: dict[bytes, list[int | None]] = {}
        self.items: list[int | None] = []
        pieces, rows = [], []
        for item, text in items:
            words = words_of(text)
            self.items.append(item)
            if len(words) < 2:
                if words:
                    self.single.setdefault(words[0], []).append(item)
                continue
            own = np.fromiter((self.vocab.setdefault(w, len(self.vocab)) for w in words), dtype=np.int32, count=len(words))
            for k in range(0, len(own), SEGMENT_WORDS):
                pieces.append(own[max(0, min(k, len(own) - SEGMENT_WORDS)) : k + SEGMENT_WORDS])
                rows.append(len(self.items) - 1)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.rows = np.array(rows, dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.words = np.concatenate([*pieces, np.zeros(0, dtype=np.int32)])
        del pieces
        self.cuts = lengths - np.maximum(1, lengths // 4)  # where the answers begin
        # All pairs with their segments, sorted; equal ones become one posting with its frequency.
        owner = np.repeat(np.arange(len(lengths)), lengths)
        inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else owner
        codes = self.words[inside].astype(np.int64) * len(self.vocab) + self.words[inside + 1]
        order = np.lexsort((owner[inside], codes))
        codes, owner = codes[order], owner[inside][order]
        new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])]) if len(codes) else order
        tf = np.diff(np.r_[new, len(codes)])
        codes, self.ids = codes[new], owner[new]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else new
        self.pairs, self.heads = codes[first], np.r_[first, len(codes)]
        held = np.diff(self.heads)
        idf = np.repeat(np.log(1 + (len(lengths) - held + 0.5) / (held + 0.5)), held)
        pairs_in = lengths - 1
        mean = pairs_in.mean() if len(pairs_in) else 1.0
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * pairs_in[self.ids] / mean))
        self.weights = impact / np.bincount(self.ids, weights=impact, minlength=len(lengths))[self.ids] if len(impact) else impact
        self.highest = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        blocks = -(-held // BLOCK)
        self.tops = np.r_[0, np.cumsum(blocks)]
        at = np.arange(blocks.sum()) - np.repeat(self.tops[:-1], blocks)  # the place of each block in its list
        self.highs = np.maximum.reduceat(self.weights, np.repeat(first, blocks) + at * BLOCK) if len(first) else np.zeros(0)

    def postings(self, pair: int) -> tuple[np.ndarray, np.ndarray]:
        """The segments that hold a pair, and its impacts in them."""
        return self.ids[self.heads[pair] : self.heads[pair + 1]], self.weights[self.heads[pair] : self.heads[pair + 1]]

    def segments_of(self, row: int) -> range:
        return range(int(np.searchsorted(self.rows, row)), int(np.searchsorted(self.rows, row, side="right")))

    def search(self, pairs: list[int], threshold: float) -> list[tuple[int, float]]:
        """All segments that score at least ``threshold`` for the pairs' lists: block-max WAND."""
        slack = threshold - 1e-9
        lists = {p: self.postings(p) for p in pairs}
        cursors = [[int(lists[p][0][0]), p, 0] for p in pairs]  # segment, list, place
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, (_, p, _) in enumerate(cursors):
                bound += self.highest[p]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            segment = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == segment:
                pivot += 1
            # The blocks in which the segment would stand bound its score more tightly.
            tight, ends = 0.0, []
            for _, p, at in cursors[: pivot + 1]:
                ids = lists[p][0]
                block = (at + int(np.searchsorted(ids[at:], segment))) // BLOCK
                if block < self.tops[p + 1] - self.tops[p]:
                    tight += self.highs[self.tops[p] + block]
                    ends.append(int(ids[min(len(ids), (block + 1) * BLOCK) - 1]))
            if tight >= slack:
                if cursors[0][0] == segment:
                    score = sum(lists[p][1][at] for s, p, at in cursors[: pivot + 1] if s == segment)
                    if score >= slack:
                        found.append((segment, float(score)))
                    target = segment + 1
                else:
                    target = segment
            else:
                target = max(segment, min([*ends, math.inf])) + 1
                if pivot + 1 < len(cursors):
                    target = min(target, max(segment + 1, cursors[pivot + 1][0]))
            moved = []
            for i, c in enumerate(cursors):
                if i <= pivot and c[0] < target:
                    ids = lists[c[1]][0]
                    c[2] += int(np.searchsorted(ids[c[2] :], target))
                    if c[2] == len(ids):
                        continue
                    c[0] = int(ids[c[2]])
                moved.append(c)
            cursors = moved
        return found

    def verify(self, segment: int, passage: list[int]) -> np.ndarray:
        """Which words of a segment a passage (numbers of its words, -1 for others) holds."""
        words = self.words[self.starts[segment] : self.starts[segment + 1]].tolist()
        held = np.zeros(len(words), dtype=bool)
        for step in (1, 2):
            there = set(zip(passage, passage[step:], strict=False))
            both = np.fromiter((x in there for x in zip(words, words[step:], strict=False)), dtype=bool, count=max(0, len(words) - step))
            held[: len(both)] |= both
            held[step:] |= both
        return held

    def nearest(self, segment: int, places: np.ndarray, at: np.ndarray) -> tuple[int, float] | None:
        """The passage that has most of a segment's pairs and its score, from the pairs of a text
        (``places``) and where they stand; None if it has none of them."""
        own = {}
        for p in np.unique(places).tolist():
            ids, weights = self.postings(p)
            k = int(np.searchsorted(ids, segment))
            if k < len(ids) and ids[k] == segment:
                own[p] = float(weights[k])
        if not own:
            return None
        mine = np.isin(places, list(own))
        steps = np.bincount(at[mine] // STEP, minlength=2)
        start = int(np.argmax(steps[:-1] + steps[1:])) * STEP
        inside = mine & (at >= start) & (at < start + PASSAGE_WORDS - 1)
        return start, sum(own[p] for p in sorted(set(places[inside].tolist())))

    def look_up(self, texts: list[list[bytes]]) -> list[list[tuple]]:
        """For each text, as words: (item, score, question overlap, answer overlap, first word)."""
        out: list[list[tuple]] = [[] for _ in texts]
        for t, words in enumerate(texts):
            if len(words) == 1:
                out[t] += [(item, 1.0, 1.0, 1.0, 0) for item in self.single.get(words[0], [])]
        if not len(self.pairs):
            return out
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ids = np.fromiter((i for words in texts for i in map(self.vocab.get, words, repeat(-1))), dtype=np.int64, count=int(lengths.sum()))
        first = np.r_[0, np.cumsum(lengths)]
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        codes = ids[at] * len(self.vocab) + ids[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = self.pairs[place] == codes
        at, place = at[hit], place[hit]
        owner = np.searchsorted(first, at, side="right") - 1
        inside = at + 1 < first[owner + 1]  # a pair doesn't reach into the next text
        at, place, owner = at[inside], place[inside], owner[inside]
        bound = np.r_[0.0, np.cumsum(self.highest[place])]
        for t in np.unique(owner).tolist():
            lo, hi = np.searchsorted(owner, t), np.searchsorted(owner, t, side="right")
            if bound[hi] - bound[lo] < THRESHOLD - 1e-6:
                continue
            starts = np.arange(0, max(1, lengths[t] - STEP), STEP)
            a = np.searchsorted(at[lo:hi], first[t] + starts) + lo
            b = np.searchsorted(at[lo:hi], first[t] + starts + PASSAGE_WORDS - 1) + lo
            best: dict[int, tuple] = {}
            held: dict[int, np.ndarray] = {}
            for k in np.flatnonzero(bound[b] - bound[a] >= THRESHOLD - 1e-6).tolist():
                start = int(starts[k])
                for segment, score in self.search(sorted(set(place[a[k] : b[k]].tolist())), THRESHOLD):
                    own = self.verify(segment, ids[first[t] + start : min(first[t] + start + PASSAGE_WORDS, first[t + 1])].tolist())
                    held[segment] = held[segment] | own if segment in held else own
                    if segment not in best or score > best[segment][0] + 1e-9:
                        best[segment] = (score, start)
            for row in sorted({int(self.rows[s]) for s in best}):
                parts = self.segments_of(row)
                for segment in parts:
                    if segment not in best and (near := self.nearest(segment, place[lo:hi], at[lo:hi] - first[t])):
                        best[segment] = (near[1], near[0])
                        begin = first[t] + near[0]
                        held[segment] = self.verify(segment, ids[begin : min(begin + PASSAGE_WORDS, first[t + 1])].tolist())
                n, cut_at = np.diff(self.starts[parts.start : parts.stop + 1]), self.cuts[parts.start : parts.stop]
                question = sum(int(held[s][: self.cuts[s]].sum()) for s in parts if s in held) / int(cut_at.sum())
                answer = sum(int(held[s][self.cuts[s] :].sum()) for s in parts if s in held) / int((n - cut_at).sum())
                if question >= OVERLAP and answer >= OVERLAP:
                    score = sum(best[s][0] * int(n[s - parts.start]) for s in parts if s in best) / int(n.sum())
                    out[t].append((self.items[row], score, question, answer, next(best[s][1] for s in parts if s in best)))
        return out


_FIELDS = [("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]


def _searching(shipped, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shipped.value
        for batch in batches:
            keys = batch.column("doc_id")
            held, rows, size = [], [], 0
            for row, text in enumerate([*batch.column("text").to_pylist(), None]):
                if text is not None:
                    held.append(words_of(text))
                    rows.append(row)
                    size += len(held[-1])
                if held and (text is None or size >= CHUNK_WORDS):
                    found = [(rows[t], *x) for t, own in enumerate(index.look_up(held)) for x in own]
                    if found:
                        at, *columns = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(at)), *(pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS, strict=True))], names=names
                        )
                    held, rows, size = [], [], 0

    return run


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over all items, each of a bounded part of them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    order = ["item_id", "text"]
    # Parts are ranges of a running number of words, taken range by range of items.
    parts = int(benchmark.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(items.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()).withColumn("words", word_count(F.col("text"))))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = ranged.groupBy("range").agg(F.sum("words").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("first") + F.coalesce(F.sum("words").over(within), F.lit(0))
    numbered = cut(ranged.join(F.broadcast(first), "range").withColumn("part", F.floor(at / MAX_INDEX_WORDS)))
    for part in [r["part"] for r in numbered.select("part").distinct().orderBy("part").collect()]:
        own = numbered.filter(F.col("part") == part).select("item_id", F.col("text").cast("binary").alias("text")).orderBy(*order)
        yield Index((r[0], bytes(r[1])) for r in own.toLocalIterator())


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of all items found in
    documents, first_word being where the passage begins."""
    spark = docs.sparkSession
    light = docs.select("doc_id", text_or_empty().cast("binary").alias("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(n for n, _ in _FIELDS)]
    schema = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    found = None
    for index in indexes(benchmark):
        own = light.transform(arrow_map, _searching(spark.sparkContext.broadcast(index), names), schema)
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""

    def keeping(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                clean = []
                for k in range(0, len(texts), 500):
                    clean += [not own for own in shipped.value.look_up([words_of(t) for t in texts[k : k + 500]])]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for index in indexes(benchmark):
        docs = docs.transform(arrow_map, keeping(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents and benchmark items that they hold."""
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op10_benchmark_leaks": op10_benchmark_leaks}
