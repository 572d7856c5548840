"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of up to three bytes. A byte costs what its longest
context says of it; a context that never saw the byte pays its escape (method C: with n
observations of d different bytes, a byte seen c times has c / (n + d), the escape d / (n + d)) and
hands over to the context one byte shorter, at last to 1 / 256. The statistics are frozen after
training, so the exact code length of a byte in all languages is a row of a table: one hashed by
the four bytes, and for those not in it the tables of the shorter contexts. The language with the
shortest code for the whole text wins; its share among all languages, 2 ** -length each, is the
score.

The trees are learned from all eligible rows and hold every byte string seen. The counts of strings
of one and two bytes (at most 65,792 a language) are in every part of the model; those of three and
four bytes are split by the two bytes before the last into parts of at most ``MAX_CELLS`` code
lengths, as far as one such pair of bytes allows (65,536 strings a language). The driver builds one
part at a time, a worker holds one at a time: it scores ``HELD_BYTES`` of text with each part in
turn and adds up the bits. Most models are one part.

Nulls and edge cases: texts that are null or have no letter get ``und`` with score 0, as does
every text if nothing could be learned; a null ``doc_id`` is neither learned from nor held out;
rows without a language are not learned from; ties go to the language first in order; long texts
are scored whole, in pieces; repeated rows are scored alike; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import cut, id_remainder, read

FOLDS = 5
HELD_OUT_FOLD = 0
UNDETERMINED = "und"
ORDER = 3
#: Code lengths in a part of the model: its strings times the languages.
MAX_CELLS = 4_000_000
#: Bytes of text that are scored with one part of a model of several before the next is loaded.
HELD_BYTES = 32 << 20
#: Bytes scored or counted at once.
PIECE = 1 << 20
#: Contexts before a text's first byte.
_PAD = np.full(ORDER, 10, dtype=np.uint8)


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte the number of four bytes that ends with it; ``starts`` are the texts' first bytes."""
    wide = data.astype(np.uint32)
    out = wide.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= wide[:-k] << np.uint32(8 * k)
        out[:k] |= np.uint32(10) << np.uint32(8 * k)
    for at in range(ORDER):  # no context reaches into the text before
        first = starts + at
        first = first[first < len(data)]
        # A text may be shorter than this, then a later text's bytes are set again below.
        own = np.zeros(len(first), dtype=np.uint32)
        for k in range(at + 1):
            own |= wide[first - k] << np.uint32(8 * k)
        for k in range(at + 1, ORDER + 1):
            own |= np.uint32(10) << np.uint32(8 * k)
        inside = np.searchsorted(starts, first, side="right") - 1
        same = starts[inside] + at == first
        out[first[same]] = own[same]
    return out


def _pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of a text column in pieces of about PIECE: bytes with ORDER before them, the first
    bytes of texts in it, and the row of each byte run as (row, from) pairs."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = offsets[:-1]
    for a in range(int(offsets[0]), int(offsets[-1]), PIECE):
        b = min(a + PIECE, int(offsets[-1]))
        lead = min(ORDER, a - int(offsets[0]))
        lo = np.searchsorted(first, a - lead, side="left")
        hi = np.searchsorted(first, b, side="left")
        inner = np.unique(first[lo:hi])
        got = grams(data[a - lead : b], inner - (a - lead))[lead:]
        rows_from = np.searchsorted(offsets, a, side="right") - 1
        rows_to = np.searchsorted(offsets, b, side="left")
        rows = np.arange(rows_from, rows_to)
        bounds = np.clip(offsets[rows_from : rows_to + 1], a, b) - a
        yield got, rows, bounds


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four-byte numbers by language, one set for the task."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def settle(lang: str) -> None:
        keys = np.concatenate([k for k, _ in held[lang]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([c for _, c in held[lang]])[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        held[lang] = [(keys[at], np.add.reduceat(counts, at))]
        size[lang] = 0

    for batch in batches:
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            texts = batch.column("text").filter(pa.compute.equal(langs, lang))
            for got, _, _ in _pieces(texts):
                held.setdefault(lang, []).append(np.unique(got, return_counts=True))
                size[lang] = size.get(lang, 0) + len(held[lang][-1][0])
                if size[lang] > 4 * PIECE:
                    settle(lang)
    for lang in held:
        settle(lang)
        keys, counts = held[lang][0]
        for k in range(0, len(keys), 65536):
            part = keys[k : k + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part.astype(np.int64)), pa.array(counts[k : k + 65536].astype(np.int64))],
                names=["lang", "gram", "n"],
            )


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text), neither of them null."""
    return rows.mapInArrow(_counting, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=counts, minlength=len(found))


class Hashed:
    """Rows by 32-bit key in an open hash table; row 0 is all zeros, for absent keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.zeros(1 << self.bits, dtype=np.uint32)
        self.at = np.zeros(1 << self.bits, dtype=np.int32)
        self.rows = np.vstack([np.zeros((1, rows.shape[1])), rows]).astype(np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys.astype(np.uint32))
        while len(left):  # the first of those that meet in a free slot stays, the rest go on
            free = self.at[slot] == 0
            _, pick = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            pick = pick[free[pick]]
            self.at[slot[pick]] = left[pick] + 1
            self.keys[slot[pick]] = keys[left[pick]]
            rest = np.ones(len(left), dtype=bool)
            rest[pick] = False
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.at[slot]
        wrong = np.flatnonzero((self.keys[slot] != keys) & (out > 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            now = self.at[slot]
            out[wrong] = now
            miss = (self.keys[slot] != keys[wrong]) & (now > 0)
            wrong, slot = wrong[miss], slot[miss]
        return out


class Trees:
    """Frozen context trees of all languages, as tables of code lengths in bits.

    A part of them is made from the four-byte strings of some contexts of two bytes (``mine``, a mark
    for each), and the counts of all two-byte strings.
    """

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]], pairs: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, mine: np.ndarray | None = None):
        self.langs = sorted(counted if pairs is None else pairs)
        self.mine = mine
        none = (np.zeros(0, dtype=np.uint64), np.zeros(0))
        n = len(self.langs)
        levels = {o: [] for o in range(ORDER + 1)}  # by order: (keys, counts) of each language
        for lang in self.langs:
            for o in range(ORDER, -1, -1):
                keys, counts = counted.get(lang, none) if o > 1 or pairs is None else pairs[lang]
                levels[o].append((keys, counts) if o == ORDER else _sum_by(keys & np.uint64((1 << 8 * (o + 1)) - 1), counts))
        # Escapes of contexts and lengths of contexts with their next byte, from short to long.
        self.escape: dict[int, Hashed | None] = {}
        self.length: dict[int, Hashed] = {}
        for o in range(ORDER + 1):
            contexts = np.unique(np.concatenate([k >> np.uint64(8) for k, _ in levels[o]]))
            escapes = np.zeros((len(contexts), n))
            total = np.zeros((len(contexts), n))
            for j, (keys, counts) in enumerate(levels[o]):
                own, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                seen, kinds = np.bincount(at, weights=counts), np.bincount(at)
                place = np.searchsorted(contexts, own)
                escapes[place, j] = -np.log2(kinds / (seen + kinds))
                total[place, j] = seen + kinds
            self.escape[o] = Hashed(contexts, escapes)
            union = np.unique(np.concatenate([k for k, _ in levels[o]]))
            shorter = self.bits((union & np.uint64((1 << 8 * max(o, 1)) - 1)).astype(np.uint32), o - 1)
            lengths = shorter + escapes[np.searchsorted(contexts, union >> np.uint64(8))]
            for j, (keys, counts) in enumerate(levels[o]):
                lengths[np.searchsorted(union, keys), j] = -np.log2(counts / total[np.searchsorted(contexts, keys >> np.uint64(8)), j])
            self.length[o] = Hashed(union, lengths)

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of the last byte of each key after ``order`` bytes of context."""
        if order < 0:
            return np.full((len(keys), len(self.langs)), 8.0, dtype=np.float32)
        table = self.length[order]
        at = table.find(keys)
        out = table.rows[at]
        rest = np.flatnonzero(at == 0)
        if len(rest):
            short = keys[rest]
            up = self.escape[order]
            less = short & np.uint32((1 << 8 * order) - 1) if order else short
            out[rest] = up.rows[up.find(short >> np.uint32(8))] + self.bits(less, order - 1)
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        """Bits that each text of a column without nulls takes in each language."""
        total = np.zeros((len(column), len(self.langs)))
        for got, rows, bounds in _pieces(column):
            bits = self.bits(got, ORDER) if self.mine is None else np.zeros((len(got), len(self.langs)), dtype=np.float32)
            if self.mine is not None:
                own = np.flatnonzero(self.mine[(got >> np.uint32(8)) & np.uint32(0xFFFF)])
                bits[own] = self.bits(got[own], ORDER)
            sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(bits, axis=0, dtype=np.float64)])
            total[rows] += sums[bounds[1:]] - sums[bounds[:-1]]
        return total


class Parts:
    """The languages and the broadcast parts of their trees, which add up."""

    def __init__(self, langs: list[str], trees: list):
        self.langs, self.trees = langs, trees

    def score(self, column: pa.Array) -> np.ndarray:
        """Bits that each text of a column without nulls takes in each language."""
        total = np.zeros((len(column), len(self.langs)))
        for shipped in self.trees:
            total += shipped.value.score(column)
            if len(self.trees) > 1:
                shipped.__dict__.pop("_value", None)  # loaded again when it is needed
        return total


def _by_lang(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted strings and counts of each language in a table of lang, gram and n."""
    found = {}
    for lang in table.column("lang").unique().to_pylist():
        part = table.filter(pa.compute.equal(table.column("lang"), lang))
        keys = part.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        found[lang] = (keys[order], part.column("n").to_numpy().astype(np.float64)[order])
    return found


def learn(docs: DataFrame, eligible: Column) -> Parts | None:
    """Trees from text and lang of the eligible rows; None if there are none."""
    rows = docs.filter(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = cut(gram_counts(rows)).withColumn("context", F.shiftright("gram", 8).bitwiseAND(0xFFFF).cast("int"))
    pairs = _by_lang(counts.groupBy("lang", F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow())
    if not pairs:
        return None
    sizes = counts.groupBy("context").agg(F.count("*").alias("n")).orderBy("context").collect()  # 65,536 at most
    part_of, part, size = np.zeros(1 << 16, dtype=np.int32), 0, 0
    for context, n in sizes:
        if size and (size + n) * len(pairs) > MAX_CELLS:
            part, size = part + 1, 0
        part_of[context] = part
        size += n
    spark, trees = docs.sparkSession, []
    for k in range(part + 1):
        own = counts
        if part:
            contexts = spark.createDataFrame([(c,) for c, _ in sizes if part_of[c] == k], "context int")
            own = counts.join(F.broadcast(contexts), "context")
        trees.append(spark.sparkContext.broadcast(Trees(_by_lang(own.select("lang", "gram", "n").toArrow()), pairs, part_of == k if part else None)))
    return Parts(sorted(pairs), trees)


def _batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes, or as they come for 0."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held = []
    if held:
        yield pa.concat_batches(held)


def _predicting(model: Parts, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches_of(batches, HELD_BYTES if len(model.trees) > 1 else 0):
            bits = model.score(batch.column("text"))
            shares = np.exp2(bits.min(axis=1, keepdims=True) - bits)
            best = bits.argmin(axis=1)
            sure = batch.column("known").to_numpy(zero_copy_only=False)
            lang = np.where(sure, np.array(model.langs, dtype=object)[best], UNDETERMINED)
            score = np.where(sure, 1.0 / shares.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=names)

    return run


def identify(docs: DataFrame, trees: Parts | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select("doc_id", text.alias("text"), held_out.alias("held_out"), text.rlike(r"\p{L}").alias("known"))
    if trees is None:
        return light.select("doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = light.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "lang_pred", "score"]
    return light.mapInArrow(_predicting(trees, names), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; rows of one fold in five are not learned from."""
    docs = read(spark, sf_dir, "documents")
    fold = id_remainder(F.col("doc_id"), FOLDS)
    trees = learn(docs, fold != HELD_OUT_FOLD)
    return identify(docs, trees, F.coalesce(fold == HELD_OUT_FOLD, F.lit(False)))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op9_language_id": op9_language_id}
