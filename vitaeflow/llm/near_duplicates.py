"""Near-duplicates by MinHash with a multi-index Hamming join.

A document's set holds its distinct five-word shingles. Documents with equal sets are one class.
Each class gets a signature of ``SYMBOLS`` b-bit symbols (the low 16 bits of minimum hashes). Two
sets of similarity J differ in about (1 - J) of the symbols; all pairs of signatures with at most
``DISTANCE`` differing symbols are found, which for J = 0.85 misses a pair with a probability near
1e-5. For that, signatures are cut into ``CHUNKS`` chunks. By the pigeonhole principle one chunk of
such a pair has at most ``CHUNK_ERRORS`` = DISTANCE // CHUNKS errors; all ways to place them are
enumerated by leaving so many symbols of a chunk out of its key, so the pair meets in a bucket.

Links are confirmed on the full sets, as 64-bit hashes of all shingles. What is wanted are the
components of the links, so a bucket isn't expanded into pairs. First each bucket's members are
compared with one of them, its center, which is the one with most bucket mates overall. The members
of buckets that then still hold several components are put together by center, once for all buckets
of that center, and compared with each other, all with all, by their full sets. Only links that
connect different components are returned, fewer than there are members: no link between components
is lost, and links within a component needn't be known.

Skew: exact copies collapse before anything is joined, counts are aggregated on the map side, and
joins on buckets are left to the engine's splitting. Classes with more than 1 / ``HOT_SHARE`` of all
rows, of which there can't be more than ``HOT_SHARE``, are broadcast to their rows. The members around a center are cut into blocks
of about ``BLOCK_MEMBERS`` members and ``BLOCK_SHINGLES`` shingles; every pair of blocks is a piece
of work of its own, so a group of any size is spread over tasks and a task holds two blocks.

Nulls and edge cases: a null text, or one without words, has the empty set and is linked with
nothing; with fewer than five words the whole sequence is the one shingle; a row with a null
``doc_id`` is linked with nothing and has a null component (``kept`` false); repeated rows share
their component and are all kept or not; texts under one ``doc_id`` are texts of their own, linked
each by itself; very long texts are taken whole, in blocks of their own; an empty table gives an
empty result; other columns of the input are ignored. ``without_copies`` keeps one row of each
component (that with the smallest ``doc_id``, then the smallest hash of the row) with all its
columns, and all rows without words or ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaeflow.llm.common import arrow_map, cut, read, row_hash, text_or_empty, trimmed

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
SYMBOLS = 64
CHUNKS = 12
DISTANCE = 23
CHUNK_ERRORS = DISTANCE // CHUNKS
#: Members and shingles of a block of sets that are compared all with all, about.
BLOCK_MEMBERS = 512
BLOCK_SHINGLES = 1 << 19
#: Shingles multiplied at once when blocks are compared.
COLUMNS = 2048
CACHE_ENTRIES = 100_000
#: Classes with more than this share of all rows are broadcast to them.
HOT_SHARE = 1000
#: Keys under which the members around a center learn their number of blocks.
SALTS = 32
#: Texts of a batch that are held as Python objects at once.
SLICE = 500
#: Shingles hashed at once.
PIECE = 1 << 18

_rng = np.random.default_rng(20)
_ADD = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_MULTIPLY = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_SEQUENCE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case: bytes methods know just these."""
    return text.lower().split()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted distinct hashes, are linked."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Sketcher:
    """Hashes shingles of texts and takes their signatures."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's shingles."""
        if not words:
            return np.zeros(0, dtype=np.uint64)
        own = self.word_hashes(words)
        n = min(SHINGLE, len(own))
        mixed = np.full(len(own) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            mixed = _stir(mixed * _SEQUENCE + own[k : len(own) - n + 1 + k])
        return np.unique(mixed)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each run of ``hashes`` that begins at ``starts``."""
    out = np.empty((len(starts), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        lowest = np.minimum.reduceat((hashes + _ADD[k]) * _MULTIPLY[k], starts)
        out[:, k] = (_stir(lowest) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def bucket_keys(symbols: np.ndarray, chunks: int = CHUNKS, errors: int = CHUNK_ERRORS) -> np.ndarray:
    """Keys of the buckets of each signature: for every chunk, every way to leave ``errors`` symbols out."""
    wide, keys, place = symbols.astype(np.uint64), [], 0
    for own in np.array_split(np.arange(symbols.shape[1]), chunks):
        for out in combinations(own.tolist(), errors):
            place += 1
            key = np.full(len(wide), place, dtype=np.uint64)
            for k in own:
                if k not in out:
                    key = _stir(key * _SEQUENCE + wide[:, k])
            keys.append(key)
    return np.stack(keys, axis=1).view(np.int64) if keys else np.zeros((len(wide), 0), dtype=np.int64)


def values(column: pa.Array) -> Iterator:
    """The values of a column, few of them as Python objects at a time."""
    for k in range(0, len(column), SLICE):
        yield from column.slice(k, SLICE).to_pylist()


_SKETCH = "doc_id long, row long, n_shingles long, set_key binary, signature binary"


def _sketching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketcher = Sketcher()
    for batch in batches:
        sizes, set_keys, signed = [], [], []
        held, filled = [], 0

        def settle() -> None:
            if held:
                starts = np.cumsum([0, *map(len, held[:-1])])
                signed.extend(row.tobytes() for row in signatures(np.concatenate(held), starts))
                held.clear()

        for text in values(batch.column("text")):
            own = sketcher.hashes(words_of(text))
            sizes.append(len(own))
            set_keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            if len(own):
                held.append(own)
                filled += len(own)
                if filled > PIECE:
                    settle()
                    filled = 0
        settle()
        rows = iter(signed)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(set_keys, pa.binary()), pa.array([next(rows) if n else None for n in sizes], pa.binary())],
            names=["doc_id", "row", "n_shingles", "set_key", "signature"],
        )


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets of texts, as sorted hashes, in batches of at most SLICE rows."""
    sketcher = Sketcher()
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            raw = [sketcher.hashes(words_of(text)).tobytes() for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(xxhash.xxh3_128_digest, raw), pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "set_key", "hashes"]
            )


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column of hashes, without copying them."""
    for k in range(len(column)):
        yield np.frombuffer(column[k].as_buffer(), dtype=np.uint64)


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join(batch.column("signature").to_pylist())
        symbols = np.frombuffer(raw, dtype=np.uint16).reshape(-1, SYMBOLS)
        keys = bucket_keys(symbols)
        width = keys.shape[1]
        for k in range(0, len(keys), 2000):
            part = keys[k : k + 2000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("rep").to_numpy()[k : k + 2000], width)), pa.array(part.reshape(-1))], names=["rep", "key"]
            )


def _checking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(_sets(batch.column("hashes_a")), _sets(batch.column("hashes_b")), strict=True)
        yield batch.select(["a", "b"]).filter(pa.array([linked(a, b) for a, b in pairs], pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are linked."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("hashes_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hashes_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "hashes_a", "hashes_b").transform(arrow_map, _checking, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(rep, component): for the ends of links, the smallest end that can be reached."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("component")).withColumnRenamed("a", "rep"))
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("rep") == F.col("a")).select("rep", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # Jump to the label of the label.
        of = labels.select(F.col("rep").alias("label"), F.col("component").alias("further"))
        now = cut(step.join(of, F.col("component") == F.col("label"), "left").select("rep", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = now.select("rep", "component")
        if now.filter("old <> component").isEmpty():
            return labels


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets in ``a`` (rows) with all in ``b`` (columns)."""
    both = np.zeros((len(a), len(b)), dtype=np.int64)
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(all_a, all_b)
    if not len(shared):
        return both

    def by_column(entries: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), list(map(len, sets)))
        at = np.minimum(np.searchsorted(shared, entries), len(shared) - 1)
        hit = shared[at] == entries
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        return at, owner, np.searchsorted(at, np.arange(0, len(shared) + COLUMNS, COLUMNS))

    (at_a, owner_a, cut_a), (at_b, owner_b, cut_b) = by_column(all_a, a), by_column(all_b, b)
    for k, first in enumerate(range(0, len(shared), COLUMNS)):
        width = min(COLUMNS, len(shared) - first)
        one, two = np.zeros((len(a), width), dtype=np.float32), np.zeros((len(b), width), dtype=np.float32)
        one[owner_a[cut_a[k] : cut_a[k + 1]], at_a[cut_a[k] : cut_a[k + 1]] - first] = 1
        two[owner_b[cut_b[k] : cut_b[k + 1]], at_b[cut_b[k] : cut_b[k + 1]] - first] = 1
        both += (one @ two.T).astype(np.int64)
    return both


def spanning_links(a: list[np.ndarray], b: list[np.ndarray], names: list[int]) -> list[tuple[int, int]]:
    """Links between sets of ``a`` and sets of ``b`` (counted on from the last of ``a``) that connect
    whatever all links between them connect; ``names`` are the sets' components so far."""
    _, label = np.unique(np.asarray(names), return_inverse=True)
    if (label == label[0]).all():
        return []
    both = overlaps(a, b)
    sizes_a, sizes_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    near = (both > 0) & (100 * both >= PERCENT * (sizes_a[:, None] + sizes_b[None, :] - both)) & (label[: len(a), None] != label[None, len(a) :])
    found = []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        for j in (np.flatnonzero(near[i]) + len(a)).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def _linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the two blocks of a piece of work, whose rows are next to each other."""

    def settle() -> Iterator[pa.RecordBatch]:
        if last is not None:
            a, b = held[: len(held) if last[1] == last[2] else first], held[0 if last[1] == last[2] else first :]
            if a and b:
                links = spanning_links([h for _, _, h in a], [h for _, _, h in b], [n for _, n, _ in (*a, *b)])
                if links:
                    both = [r for r, _, _ in (*a, *b)]
                    yield pa.RecordBatch.from_arrays([pa.array([both[k[e]] for k in links], pa.int64()) for e in (0, 1)], names=["a", "b"])

    last, held, first = None, [], 0
    for batch in batches:
        light = zip(*(batch.column(k).to_pylist() for k in ("center", "low", "high", "block", "rep", "component")), strict=True)
        for (center, low, high, block, rep, component), own in zip(light, _sets(batch.column("hashes")), strict=True):
            if (center, low, high) != last:
                yield from settle()
                last, held, first = (center, low, high), [], 0
            held.append((rep, component, own.copy()))  # the batch needn't stay
            first += block == low
    yield from settle()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (its hash), n_shingles, set_key and signature of every row; the last two null for
    empty sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("row"), text_or_empty().cast("binary").alias("text"))
    return rows.transform(arrow_map, _sketching, _SKETCH)


def named_classes(sketched: DataFrame) -> DataFrame:
    """(set_key, first, rep, rows, n_shingles, signature) of all classes. A class is named by its smallest
    ``doc_id``, first; of several classes with the same one (texts under one ``doc_id``) all but one
    are named by a hash."""
    of_set = cut(
        sketched.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    )
    name = F.xxhash64("set_key")
    twice = of_set.groupBy("first").agg(F.count("*").alias("n"), F.min(name).alias("owner")).filter("n > 1").drop("n")
    rep = F.when(F.col("owner").isNull() | (F.col("owner") == name), F.col("first")).otherwise(name)
    return of_set.join(twice, "first", "left").select("set_key", "first", rep.alias("rep"), "rows", "n_shingles", "signature")


def classes(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(set_key, rows, component, component_id) of all classes: their number of rows, the name of their
    component and the smallest ``doc_id`` in it."""
    of_set = cut(named_classes(sketched))
    keyed = of_set.select("rep", "signature").transform(arrow_map, _keying, "rep long, key long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = cut(keyed.join(shared, "key"))
    mates = cut(buckets.groupBy("rep").agg(F.sum("size").alias("mates")))
    centers = buckets.join(mates, "rep").groupBy("key").agg((-F.max(F.struct("mates", (-F.col("rep")).alias("r")))["r"]).alias("center"))
    star = cut(buckets.select("key", "rep").join(centers, "key"))
    tried = cut(star.filter("rep <> center").select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct())
    # Only sets that share a bucket with another are needed from here on.
    needed = of_set.select("set_key", "first", "rep", "n_shingles").join(mates.select("rep"), "rep")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    some = raw.join(needed.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").transform(arrow_map, _hashing, "doc_id long, set_key binary, hashes binary")
    sets = cut(
        some.join(needed.withColumnRenamed("first", "doc_id"), ["doc_id", "set_key"])
        .groupBy("rep")
        .agg(F.first("n_shingles").alias("n_shingles"), F.first("hashes").alias("hashes"))
    )
    edges = cut(confirmed(tried, sets))
    labels = components(edges)
    # Buckets that still hold several components, without their centers, which were compared with all.
    named = star.filter("rep <> center").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    asked = cut(named.join(mixed, "key", "left_semi").select("center", "rep", "component").distinct().join(sets.select("rep", "n_shingles"), "rep"))
    work = F.greatest(F.count("*") / F.lit(BLOCK_MEMBERS), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    # Only centers of several blocks are told, under SALTS keys each, as their members are many.
    parts = asked.groupBy("center").agg(F.ceil(work).cast("int").alias("parts")).filter("parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(SALTS)).cast("int")).join(parts, ["center", "salt"], "left")
    placed = salted.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pieces = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "center", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component"
    )
    work_of = ["center", "low", "high"]
    whole = pieces.join(sets.select("rep", "hashes"), "rep").repartition(*work_of).sortWithinPartitions(*work_of, "block", "rep")
    more = cut(whole.select(*work_of, "block", "rep", "component", "hashes").transform(arrow_map, _linking, "a long, b long").distinct())
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    linked_sets = of_set.select("set_key", "first", "rep").join(labels, "rep")
    smallest = linked_sets.groupBy("component").agg(F.min("first").alias("component_id"))
    met = linked_sets.join(smallest, "component").select("set_key", "component", "component_id")
    return of_set.select("set_key", "first", "rep", "rows").join(met, "set_key", "left").select(
        "set_key", "rows", F.coalesce("component", "rep").alias("component"), F.coalesce("component_id", "first").alias("component_id")
    )


def _resolved(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, set_key, component and component_id of every row of ``docs``; the
    component is null without words or ``doc_id``."""
    sketched = cut(sketches(docs))
    named = cut(classes(docs, sketched))
    total = named.agg(F.sum("rows")).first()[0] or 0
    hot, cold = (named.filter(f"rows * {HOT_SHARE} {sign} {total}").drop("rows") for sign in (">", "<="))
    rows = sketched.drop("signature")
    some = rows.filter(F.col("set_key").isNotNull())
    none = rows.filter(F.col("set_key").isNull()).withColumns({"component": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    met = some.join(F.broadcast(hot), "set_key").unionByName(some.join(F.broadcast(hot), "set_key", "left_anti").join(cold, "set_key", "left"))
    known = F.col("doc_id").isNotNull()
    return (
        met.unionByName(none)
        .withColumn("component", F.when(known, F.col("component")))
        .withColumn("component_id", F.when(known, F.coalesce("component_id", "doc_id")))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    return _resolved(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns; rows without words or ``doc_id`` all stay."""
    chosen = (
        _resolved(docs)
        .filter(F.col("component").isNotNull())
        .groupBy("component")
        .agg(F.min(F.struct("doc_id", "row")).alias("x"))
        .select(F.col("x.doc_id").alias("chosen_id"), F.col("x.row").alias("chosen_row"))
        .distinct()
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col("doc_id").cast("long").alias("id"), row_hash(docs).alias("hash"))
    one = rows.join(chosen, (F.col("id") == F.col("chosen_id")) & (F.col("hash") == F.col("chosen_row")), "left_semi").dropDuplicates(["id", "hash"]).select("whole.*")
    return one.unionByName(docs.filter(F.col("doc_id").isNull() | (trimmed(text_or_empty()) == "")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op6_near_duplicates": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], chr(32)) AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair_counts AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pair_counts JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS u FROM w UNION SELECT v, b FROM reach JOIN links ON a = u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS c FROM reach GROUP BY v) r ON r.v = w.doc_id
"""
}
QUERIES = {"op6_near_duplicates": op6_near_duplicates}
