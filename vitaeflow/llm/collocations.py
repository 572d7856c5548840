"""Phrases whose words stand together more often than chance, mined by pivot partitioning.

As in MG-FSM, all words of a language have a total order, from frequent to rare, and an n-gram belongs
to its rarest word, its pivot (the first of them, if it stands there twice). For every occurrence of a
word, the words around it are rewritten: of the two to its left and right, those rarer than it are
blanked, with all beyond them. What is left, a fragment, holds all n-grams of the occurrence that the
word owns, and no other word's partition needs them. Equal fragments of a run of texts are counted
before they are shuffled; partitions of pivots mine theirs on their own, in buckets of about ``BUCKET``
occurrences, so an n-gram's count needs no further shuffle.

Words are 64-bit hashes of language and text in all of this; texts come back for what is returned.
(Two of 10 million words share a hash with a probability of 3e-6.) The counted order of at most
``ORDERED`` words, the most frequent ones, is told to all tasks. If these are all words that are
frequent enough, others are blanked as well. If not, others follow in the order of their hashes: any
total order gives the same counts, and those that turn out too rare are dropped at the end.

Skew: a pivot with over ``BUCKET`` occurrences is dealt to several buckets, whose sums are added up
afterwards. Ranks per language are taken in two steps: the best of each of ``SALTS`` parts, then of
those. Joins on words are left to the engine's splitting.

Nulls and edge cases: a null text counts as empty and has no words; a null lang counts as ``und``; the
text of a row counts whatever its ``doc_id``, repeated rows once each; very long texts are read in slices
that end between words; ties are ranked by count, then by the phrase's bytes; an empty table gives an
empty result; other columns are ignored. Products are exact for counts up to 10 ** 15.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import arrow_map, cut, cut_in_batches, read, text_or_empty

MIN_COUNT = 10
TOP = 2000
#: A candidate is dropped if a longer one around it has so many percent of its count.
PART_PERCENT = 50
#: Words whose order by frequency is told to all tasks.
ORDERED = 1 << 20
#: Words read before fragments are counted and sent; occurrences in a bucket; words counted at once.
FLUSH = 1 << 20
BUCKET = 1 << 20
HELD = 300_000
#: Characters of a text that are split at once.
SLICE = 1 << 20
SALTS = 32
#: Rows of a batch when rows hold fragments of a bucket.
PACKS = 256

_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b"." * 10)
_BREAK = b"."


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with a ``.`` wherever a piece ends, many at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            found = text.find(b" ", at + SLICE)
            end = found if found >= 0 else end
        yield text[at:end].replace(b".", b" . ").split()
        at = end


def hashes_of(lang: str, words: Iterable[bytes]) -> np.ndarray:
    """Hashes of a language's words, 0 for the end of a piece."""
    before = lang.encode() + b"\0"
    return np.array([0 if w == _BREAK else xxhash.xxh3_64_intdigest(before + w) - (1 << 63) for w in words], dtype=np.int64)


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[bytes, int]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(_BREAK, None)
            words = list(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(hashes_of(lang, words)), pa.array(own.values(), pa.int64())], names=["lang", "word", "h", "n"]
            )
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            own = counts.setdefault(lang, Counter())
            for words in slices(text.as_py()):
                own.update(words)
        if sum(map(len, counts.values())) > HELD:
            yield from out()
    yield from out()


class Order(NamedTuple):
    """Hashes of the most frequent words, sorted; the place of each by frequency; to how many buckets its
    fragments are dealt; and whether these are all words that are frequent enough."""

    hashes: np.ndarray
    ranks: np.ndarray
    deals: np.ndarray
    complete: bool

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's place (frequent first), whether it is to be looked at, and its number of buckets."""
        place = (hashes.view(np.uint64) >> np.uint64(1)) | np.uint64(1 << 63)
        known, deals = np.zeros(len(hashes), dtype=bool), np.ones(len(hashes), dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            place[known], deals[known] = self.ranks[at[known]].astype(np.uint64), self.deals[at[known]]
        return place, known if self.complete else np.ones(len(hashes), dtype=bool), deals


def fragments(words: np.ndarray, place: np.ndarray, given: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """Rows (two words to the left, the pivot, two to the right) for the occurrences of words, which are
    numbered from 1 (0: end of a piece); what the pivot doesn't own is 0. ``place`` and ``given`` are by word,
    the first one for 0. Only occurrences from ``start`` to ``end`` are pivots."""
    n = len(words)
    padded = np.zeros(n + 4, dtype=np.int64)
    padded[2:-2] = np.where(given[words], words, 0)
    own = padded[2:-2]
    at = place[padded]
    out = np.zeros((n, 5), dtype=np.int64)
    out[:, 2] = own
    for step, side in ((1, (1, 3)), (2, (0, 4))):
        left, right = padded[2 - step : n + 2 - step], padded[2 + step : n + 2 + step]
        fits_left, fits_right = (left > 0) & (at[2 - step : n + 2 - step] < at[2:-2]), (right > 0) & (at[2 + step : n + 2 + step] <= at[2:-2])
        if step == 2:
            fits_left &= out[:, 1] > 0
            fits_right &= out[:, 3] > 0
        out[:, side[0]], out[:, side[1]] = np.where(fits_left, left, 0), np.where(fits_right, right, 0)
    out = out[start:end]
    return out[(out[:, 2] > 0) & ((out[:, 1] > 0) | (out[:, 3] > 0))]


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the first of all equal rows, and the sums of their counts."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    fresh = np.zeros(len(order), dtype=bool)
    fresh[:1] = True
    for c in columns:
        ranked = c[order]
        fresh[1:] |= ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(fresh)
    return order[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts[:0]


def compact(cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers under n that stand in ``cells``, and ``cells`` with their places among these."""
    if cells.size * 8 < n:
        used, places = np.unique(cells, return_inverse=True)
        return used, places.reshape(cells.shape)
    seen = np.zeros(n, dtype=bool)
    seen[cells] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[cells]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


_PACKED = "bucket long, hot boolean, words binary, cells binary, cell_type string, counts binary, count_type string"


def _mixed(hashes: np.ndarray, deal: np.ndarray, buckets: int) -> np.ndarray:
    x = hashes.view(np.uint64) + deal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _rewriting(shared, buckets: int):
    """Counted fragments, a row for each bucket and run of texts."""

    def pack(bucket: int, hot: bool, cells: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple:
        used, cells = compact(cells, len(hashes))
        cells, counts = _narrow(cells), _narrow(counts)
        return bucket, hot, hashes[used].tobytes(), cells.tobytes(), cells.dtype.str, counts.tobytes(), counts.dtype.str

    def sent(lang: str, known: dict[bytes, int], words: np.ndarray, start: int, end: int, turn: int) -> Iterator[pa.RecordBatch]:
        hashes = hashes_of(lang, known)
        place, given, deals = shared.value.of(hashes)
        given[0] = False
        rows = fragments(words, place, given, start, end)
        if not len(rows):
            return
        wide = rows.astype(np.uint64)
        first, counts = summed([(wide[:, 0] << np.uint64(42)) | (wide[:, 1] << np.uint64(21)) | wide[:, 2], (wide[:, 3] << np.uint64(21)) | wide[:, 4]], np.ones(len(rows), dtype=np.int64))
        rows = rows[first]
        pivots = rows[:, 2]
        to = _mixed(hashes[pivots], turn % deals[pivots], buckets) * 2 + (deals[pivots] > 1)
        order = np.argsort(to, kind="stable")
        rows, counts, to = rows[order], counts[order], to[order]
        ends = [*np.flatnonzero(np.diff(to)) + 1, len(to)]
        packed, start = [], 0
        for end in ends:
            packed.append(pack(int(to[start]) // 2, bool(to[start] % 2), rows[start:end], counts[start:end], hashes))
            start = end
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), kinds, strict=True)], names=["bucket", "hot", "words", "cells", "cell_type", "counts", "count_type"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        turn = TaskContext.get().partitionId()
        # By language: words numbered from 1 (0: end of a piece), runs of them, and how many of the first are
        # there as neighbours only.
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray], int]] = {}
        size = 0

        def numbers() -> dict[bytes, int]:
            known: dict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            known[_BREAK] = 0
            return known

        def settle(part: str | None = None) -> Iterator[pa.RecordBatch]:
            """Sends what is held; the last words of ``part``, whose text goes on, stay as neighbours."""
            nonlocal size, turn
            size = 0
            for lang in list(held):
                known, runs, start = held.pop(lang)
                words = np.concatenate(runs)
                end = max(start, len(words) - 2) if lang == part else len(words)
                yield from sent(lang, known, words, start, end, turn)
                turn += 1
                if lang == part:
                    names, fresh, first = list(known), numbers(), max(0, end - 2)
                    rest = np.array([fresh[names[k]] for k in words[first:].tolist()], dtype=np.int64)
                    held[lang] = fresh, [rest], end - first
                    size += len(rest)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for words in slices(text.as_py()):
                    known, runs, _ = held.setdefault(lang, (numbers(), [], 0))
                    runs.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
                    size += len(words)
                    if size > FLUSH:
                        yield from settle(lang)
                if lang in held:
                    held[lang][1].append(np.zeros(1, dtype=np.int64))  # texts don't run on
                    size += 1
        yield from settle()

    return run


def grams(cells: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of three words (the third 0 in pairs) that fragments hold, and their counts."""
    parts, sums = [], []
    for take in ((1, 2), (2, 3), (0, 1, 2), (1, 2, 3), (2, 3, 4)):
        own = cells[:, take]
        at = np.flatnonzero((own > 0).all(axis=1))
        parts.append(np.pad(own[at], ((0, 0), (0, 3 - len(take)))))
        sums.append(counts[at])
    rows, sums = np.concatenate(parts), np.concatenate(sums)
    if words < 1 << 21:
        wide = rows.astype(np.uint64)
        columns = [(wide[:, 0] << np.uint64(42)) | (wide[:, 1] << np.uint64(21)) | wide[:, 2]]
    else:
        columns = [rows[:, k] for k in range(3)]
    first, sums = summed(columns, sums)
    return rows[first], sums


def _mining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of each bucket, whose rows are next to each other: those with ``MIN_COUNT`` occurrences at
    least, or all if their pivot is dealt to several buckets (hot)."""

    def mined(hot: bool, packs: list[tuple]) -> pa.RecordBatch:
        named = np.concatenate([w for w, _, _ in packs])
        words = np.unique(named)
        words = np.concatenate([[0], words[words != 0]])
        numbers = np.where(named == 0, 0, np.searchsorted(words[1:], named) + 1)
        ends = np.cumsum([len(w) for w, _, _ in packs])
        cells = [numbers[end - len(w) : end][rows] for end, (w, rows, _) in zip(ends, packs, strict=True)]
        rows, sums = grams(np.concatenate(cells), np.concatenate([c for _, _, c in packs]), len(words))
        if not hot:
            often = sums >= MIN_COUNT
            rows, sums = rows[often], sums[often]
        third = pa.array(words[rows[:, 2]], mask=rows[:, 2] == 0)
        return pa.RecordBatch.from_arrays([pa.array(words[rows[:, 0]]), pa.array(words[rows[:, 1]]), third, pa.array(sums), pa.array(np.full(len(rows), hot))], names=["h1", "h2", "h3", "a", "hot"])

    last, held = None, []
    for batch in batches:
        for bucket, hot, *row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if (bucket, hot) != last:
                if last:
                    yield mined(last[1], held)
                last, held = (bucket, hot), []
            words, cells, cell_type, counts, count_type = row
            held.append((np.frombuffer(words, dtype=np.int64), np.frombuffer(cells, dtype=cell_type).reshape(-1, 5), np.frombuffer(counts, dtype=count_type).astype(np.int64)))
    if last:
        yield mined(last[1], held)


def ordered_words(frequent: DataFrame) -> Order:
    """The order of the most frequent of the words (h, n). How many there are of each size is counted
    first, so that no more than ``ORDERED`` of them come to the driver."""
    size = F.floor(F.log2("n") * 16).cast("int")
    sizes = frequent.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect()  # at most 16 * 64 rows
    least, total = None, 0
    for row in sizes:
        if total + row["words"] > ORDERED:
            break
        least, total = row["size"], total + row["words"]
    complete = total == sum(row["words"] for row in sizes)
    if least is None:
        return Order(np.zeros(0, dtype=np.int64), *(np.zeros(0, dtype=np.int32) for _ in range(2)), complete)
    told = frequent.filter(size >= least).select("h", "n").toPandas()
    h, n = told["h"].to_numpy(np.int64), told["n"].to_numpy(np.int64)
    ranks = np.empty(len(h), dtype=np.int32)
    ranks[np.lexsort((h, -n))] = np.arange(len(h))
    by_hash = np.argsort(h)
    return Order(h[by_hash], ranks[by_hash], (-(-n // BUCKET))[by_hash].astype(np.int32), complete)


def frequent_grams(texts: DataFrame, frequent: DataFrame, words: int) -> DataFrame:
    """(h1, h2, h3, a) of all n-grams of two (h3 null) or three words with ``MIN_COUNT`` occurrences."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(ordered_words(frequent))
    buckets = max(1, -(-words // BUCKET))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, 1 << 15))
    packed = texts.transform(arrow_map, _rewriting(shared, buckets), _PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket", "hot")
    mined = cut_in_batches(packed.mapInArrow(_mining, "h1 long, h2 long, h3 long, a long, hot boolean"), PACKS)
    dealt = mined.filter("hot").groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")).filter(F.col("a") >= MIN_COUNT)
    return mined.filter("NOT hot").drop("hot").unionByName(dealt)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in exact arithmetic."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def candidates(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, h1, h2, h3, a, l, r, score) of the n-grams that aren't part of a longer one as frequent."""
    single = frequent.select("h", "n")
    pairs, triples = (found.filter(f"h3 IS {kind}").select("h1", "h2", *more, "a") for kind, more in (("NULL", ()), ("NOT NULL", ("h3",))))
    of = lambda name, key: single.select(F.col("h").alias(key), F.col("n").alias(name))
    two = lambda name, x, y: pairs.select(F.col("h1").alias(x), F.col("h2").alias(y), F.col("a").alias(name))
    around = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("part"), "a")
    longest = around.groupBy("part.h1", "part.h2").agg(F.max("a").alias("longer"))
    own = pairs.join(longest, ["h1", "h2"], "left").filter(F.coalesce(100 * F.col("longer") < PART_PERCENT * F.col("a"), F.lit(True)))
    own = own.join(of("l", "h1"), "h1").join(of("r", "h2"), "h2").withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    cuts = triples.join(two("l2", "h1", "h2"), ["h1", "h2"]).join(two("r1", "h2", "h3"), ["h2", "h3"]).join(of("l1", "h1"), "h1").join(of("r2", "h3"), "h3")
    cut_at = lambda k: F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    whole = cuts.withColumn("x", F.least(cut_at(1), cut_at(2))).select("h1", "h2", "h3", "a", "x.l", "x.r", "x.score")
    columns = ["h1", "h2", "h3", "a", "l", "r", "score"]
    both = own.withColumn("h3", F.lit(None).cast("long")).select(*columns).unionByName(whole.select(*columns))
    return both.join(frequent.select(F.col("h").alias("h1"), "lang"), "h1")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``TOP`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    counted = cut(
        texts.transform(arrow_map, _counting, "lang string, word binary, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))
    )
    sizes = cut(counted.groupBy("lang").agg(F.sum("n").alias("total")))
    frequent = cut(counted.filter(F.col("n") >= MIN_COUNT))
    words = sizes.agg(F.sum("total")).first()[0] or 0
    found = cut(frequent_grams(texts, frequent, words))
    rated = cut(candidates(found, frequent))
    best = lambda *by: F.rank().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a")))
    salt = F.pmod(F.xxhash64("h1", "h2", "h3"), F.lit(SALTS))
    some = rated.withColumn("salt", salt).withColumn("k", best("lang", "salt")).filter(F.col("k") <= TOP).withColumn("k", best("lang")).filter(F.col("k") <= TOP)
    for k in (1, 2, 3):
        some = some.join(frequent.select(F.col("h").alias(f"h{k}"), F.col("word").cast("string").alias(f"w{k}")), f"h{k}", "left")
    named = some.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.withColumn("rank", place.cast("long")).filter(F.col("rank") <= TOP)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language of the documents."""
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], chr(32)) AS phrase, ws[i:i + k - 1] AS g
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, any_value(g) AS g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND f >= {MIN_COUNT}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, i AS first, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
  JOIN f x ON x.lang = c.lang AND x.k = i AND x.phrase = array_to_string(c.g[1:i], chr(32))
  JOIN f y ON y.lang = c.lang AND y.k = c.k - i AND y.phrase = array_to_string(c.g[i + 1:c.k], chr(32))),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, first) = 1),
inner_parts AS (SELECT lang, unnest([array_to_string(g[1:2], chr(32)), array_to_string(g[2:3], chr(32))]) AS phrase, f FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase AND s.k = 2 WHERE o.f IS NULL OR 100 * o.f < {PART_PERCENT} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t USING (lang) WHERE rank <= {TOP}
"""
}
QUERIES = {"op12_collocations": op12_collocations}
