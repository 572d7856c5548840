"""How the sources of a language differ in their words, by integer-dictionary encoding.

Terms are runs of letters of A-Z, lower-cased, and of all characters beyond ASCII. A language keeps the
terms that stand in at least ``MIN_DOCS`` of its documents. Kept terms are sorted by their bytes and cut into
chunks, sorted arrays of at most ``CHUNK`` terms, in which ids are found by binary search; as ids keep
the order of the terms, ties need no texts. Within a chunk, the counts of a group (language, source) are
a dense vector by id. So shares of terms, differences of groups and the best terms are arithmetic on
whole vectors; sums over chunks, and the best of the chunks' best, give the result.

All arithmetic is on integers: a share is ``1 + floor(10 ** 9 * (count + 2) / (N + 2 * V))``, taken by long
division, so that no product passes 64 bits (for N + 2 * V up to 9 * 10 ** 15).

Skew: a task counts the terms of its own texts first, by group; what is shuffled are these counts, by
language and term, so that the size of a source or language makes no difference. Chunks have equal numbers
of terms. The sources of a language are put into blocks of about ``SOURCES``; pairs of blocks meet chunk by
chunk, so a task holds two blocks of one chunk.

Nulls and edge cases: a null text, lang or source counts as the empty string; a group without kept terms, or
without any, has its pairs (all terms count 0 there) and no terms of its own; a language that keeps no term
has pairs of value 0; repeated rows are documents of their own; a ``doc_id`` isn't looked at; very long texts
are split piece by piece; ties are ranked by the item's bytes; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import arrow_map, cut, cut_in_batches, read, text_or_empty

MIN_DOCS = 10
TOP = 10
SCALE_STEPS = 3  # long division in steps of 1000: 10 ** 9
#: Terms of a chunk, and counts that a task holds for it at most before it begins a new one.
CHUNK = 8192
ENTRIES = 1 << 19
#: Sources of a block, about.
SOURCES = 128
#: Counts and terms that a task holds before it sends them.
HELD = 1 << 20
TERMS = 400_000
SLICE = 1 << 20
#: Rows of a batch when rows hold vectors.
VECTORS = 64

#: Letters of A-Z in lower case and bytes beyond ASCII stay, all else separates.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, many at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else -1
        end = end if end >= 0 else len(text)
        yield text[at:end].split()
        at = end


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, n, docs): occurrences of terms in a task's texts, and texts with them."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    groups: dict[tuple, int] = defaultdict()
    groups.default_factory = groups.__len__
    held: list[tuple] = []  # keys of group and term, occurrences, documents
    size = 0

    def merged() -> tuple:
        keys, n, docs = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(n[order], starts), np.add.reduceat(docs[order], starts)

    def out(rows: tuple) -> Iterator[pa.RecordBatch]:
        keys, n, docs = rows
        of_group, of_term = keys >> 32, keys & 0xFFFFFFFF
        langs, sources, terms = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.array(ids, pa.binary())
        for k in range(0, len(keys), 1 << 16):
            g, t = (pa.array(x[k : k + (1 << 16)]) for x in (of_group, of_term))
            yield pa.RecordBatch.from_arrays([langs.take(g), terms.take(t), sources.take(g), pa.array(n[k : k + (1 << 16)]), pa.array(docs[k : k + (1 << 16)])], names=["lang", "term", "source", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            runs = [np.fromiter(map(ids.__getitem__, terms), dtype=np.int64, count=len(terms)) for terms in slices(text.as_py())]
            if runs:
                own, n = np.unique(np.concatenate(runs), return_counts=True)
                held.append(((groups[lang, source] << 32) | own, n, np.ones(len(own), dtype=np.int64)))
                size += len(own)
            if size > 2 * HELD or len(ids) > TERMS:
                rows = merged()
                if len(rows[0]) > HELD or len(ids) > TERMS:
                    yield from out(rows)
                    held, size = [], 0
                    ids.clear()
                    groups.clear()
                else:
                    held, size = [rows], len(rows[0])
    if held:
        yield from out(merged())


_ENCODED = "lang string, chunk long, source string, size long, total long, ids binary, counts binary, terms array<string>"


def _encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from rows (lang, term, source, n, total) in the order of terms: one row with the terms and
    the language's counts (source null), and a row for each source that has some of them."""
    from pyspark.taskcontext import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: list[tuple] = []  # term, source, n, total
    lang = last = None
    kinds = 0

    def chunk() -> pa.RecordBatch:
        nonlocal number, kinds
        rows = np.array([r[0] for r in held], dtype=object)
        terms = rows[np.concatenate([[True], rows[1:] != rows[:-1]])]  # sorted
        ids = np.searchsorted(terms, rows)
        totals = np.zeros(len(terms), dtype=np.int64)
        totals[ids] = [r[3] for r in held]
        sources, of = np.unique(np.array([r[1] for r in held], dtype=object), return_inverse=True)
        n = np.array([r[2] for r in held], dtype=np.int64)
        out = [(lang, number, None, len(terms), int(totals.sum()), None, totals.tobytes(), [t.decode() for t in terms])]
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(sources)))
        for source, end, start in zip(sources, ends, [0, *ends[:-1]], strict=True):
            at = order[start:end]
            out.append((lang, number, source, 0, int(n[at].sum()), ids[at].astype(np.int32).tobytes(), n[at].tobytes(), None))
        number, kinds = number + 1, 0
        held.clear()
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["lang", "chunk", "source", "size", "total", "ids", "counts", "terms"])

    for batch in batches:
        for own, term, *row in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "n", "total")), strict=True):
            if (own, term) != last:
                if held and (own != lang or kinds == CHUNK or len(held) > ENTRIES):
                    yield chunk()
                last, lang = (own, term), own
                kinds += 1
            held.append((term, *row))
    if held:
        yield chunk()


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * terms))."""
    whole = total + 2 * terms
    quotient, rest = np.divmod(counts + 2, whole)
    for _ in range(SCALE_STEPS):
        step, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + step
    return quotient + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _dense(row: dict, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    if row["counts"] is not None:
        out[np.frombuffer(row["ids"], dtype=np.int32)] = np.frombuffer(row["counts"], dtype=np.int64)
    return out


def _rating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best terms of each source in each chunk, whose rows are next to each other, its terms first."""
    terms = usual = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["source"] is None:
                terms, usual = row["terms"], shares(np.frombuffer(row["counts"], dtype=np.int64), row["lang_total"], row["kept"])
                continue
            ids, counts = np.frombuffer(row["ids"], dtype=np.int32), np.frombuffer(row["counts"], dtype=np.int64)
            p, q = shares(counts, row["group_total"], row["kept"]), usual[ids]
            above = np.flatnonzero(p > q)
            value = differences(p[above], q[above])
            best = np.lexsort((ids[above], -value))[:TOP]
            out += [(row["lang"], row["source"], terms[ids[above[k]]], int(value[k])) for k in best.tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "source", "item", "value"])


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) of a chunk for the sources of two blocks, whose rows are next to each other."""

    def settle() -> Iterator[pa.RecordBatch]:
        lang, _, low, high = last
        (names, one), (others, two) = ((([n for n, _ in side]), np.array([p for _, p in side])) for side in held)
        if low == high:
            others, two = names, one
        out = []
        for k, p in enumerate(one):
            first = k + 1 if low == high else 0
            values = differences(p, two[first:]).sum(axis=1).tolist() if first < len(two) else []
            out += [(lang, names[k], other, v) for other, v in zip(others[first:], values, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "a", "b", "value"])

    last, held = None, ([], [])
    for batch in batches:
        for row in batch.to_pylist():
            piece = tuple(row[c] for c in ("lang", "chunk", "low", "high"))
            if piece != last:
                if last:
                    yield from settle()
                last, held = piece, ([], [])
            held[int(row["block"] != row["low"])].append((row["source"], shares(_dense(row, row["size"]), row["group_total"], row["kept"])))
    if last:
        yield from settle()


def encoded_counts(docs: DataFrame) -> DataFrame:
    """Chunks of the kept terms and their counts by source (see :func:`_encoding`)."""
    texts = docs.select("lang", "source", text_or_empty().cast("binary").alias("text"))
    counted = texts.transform(arrow_map, _counting, "lang string, term binary, source string, n long, docs long")
    by_term = Window.partitionBy("lang", "term")
    # One shuffle by language and term serves the sums of a source and those of all sources.
    sums = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = cut(sums.withColumn("total", F.sum("n").over(by_term)).withColumn("docs", F.sum("docs").over(by_term)).filter(F.col("docs") >= MIN_DOCS).drop("docs"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return cut(ranged.select("lang", "term", "source", "n", "total").mapInArrow(_encoding, _ENCODED))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank for every group (lang, source) of ``docs``."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    chunks = encoded_counts(named)
    heads, vectors = chunks.filter("source IS NULL"), chunks.filter("source IS NOT NULL")
    langs = heads.groupBy("lang").agg(F.sum("size").alias("kept"), F.sum("total").alias("lang_total"))
    found = named.select("lang", "source").distinct().join(vectors.groupBy("lang", "source").agg(F.sum("total").alias("group_total")), ["lang", "source"], "left")
    blocks = found.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    none = F.lit(0).cast("long")
    groups = cut(
        found.join(blocks, "lang").join(langs, "lang", "left")
        .select("lang", "source", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"), "blocks", *(F.coalesce(c, none).alias(c) for c in ("group_total", "kept", "lang_total")))
    )
    # Terms: each chunk's rows, its head first.
    totals = groups.select("lang", "source", "group_total", "kept")
    beside = heads.join(langs, "lang").select(*chunks.columns, F.lit(None).cast("long").alias("group_total"), "kept", "lang_total").unionByName(
        vectors.join(totals, ["lang", "source"]).select(*chunks.columns, "group_total", "kept", F.lit(None).cast("long").alias("lang_total"))
    )
    rated = cut_in_batches(beside.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", F.asc_nulls_first("source")).mapInArrow(_rating, "lang string, source string, item string, value long"), VECTORS)
    # Pairs: all sources of a language in every chunk, those without its terms too.
    some = groups.filter("kept > 0")
    every = heads.select("lang", "chunk", "size").join(some, "lang").join(vectors.select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    pieces = every.withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1))).select(
        "lang", "chunk", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "source", "size", "ids", "counts", "group_total", "kept"
    )
    work = ["lang", "chunk", "low", "high"]
    compared = cut_in_batches(pieces.repartition(*work).sortWithinPartitions(*work, "block", "source").mapInArrow(_comparing, "lang string, a string, b string, value long"), VECTORS)
    sums = compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    empty = groups.filter("kept = 0").select("lang", "source")
    nothing = empty.join(empty.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", "item", none.alias("value"))
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    )
    pairs = ranked(both.select("lang", "x.source", "x.item", "value").unionByName(nothing), "pair")
    return pairs.unionByName(ranked(rated, "term").filter(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of all documents differ."""
    return divergence(read(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op13_source_divergence": rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
t AS (SELECT lang, source, rid, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
own AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(o.n, 0) AS n, l.v, l.n AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM own GROUP BY ALL) o USING (lang, source) LEFT JOIN langs l USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
    CAST(1 + (1000000000::HUGEINT * (coalesce(o.c, 0) + 2)) // (g.n + 2 * g.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.c + 2)) // (g.lang_n + 2 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)::HUGEINT * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::HUGEINT * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
}
QUERIES = {"op13_source_divergence": op13_source_divergence}
