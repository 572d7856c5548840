"""Overlapping spans: which pairs overlap, and which spans stay when they mean the same.

Spans: (doc_key, ord, type, name, start, end, n_attrs, text_length, confidence).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

THRESHOLD = 0.5
#: Characters of a bin. Spans count for the bin where they start, however long they are.
BIN = 4096


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common length as a share of the shorter span; 0 for apart or empty ones."""
    common = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when((common > 0) & (shorter > 0), common / shorter).otherwise(0.0)


def distinct_entities(a_type: Column, b_type: Column, a_name: Column, b_name: Column) -> Column:
    """Spans of other types, or with other names, are not the same thing."""
    named = F.coalesce((a_name != "") & (b_name != "") & (a_name != b_name), F.lit(False))
    return ~a_type.eqNullSafe(b_type) | named


def overlap_pairs(spans: DataFrame, threshold: float = THRESHOLD, bin_width: int = 4096) -> DataFrame:
    """Pairs of one document and type that overlap by more than the threshold.

    Spans are put into the bins they touch, and pairs are formed within a bin; a pair belongs to the
    bin where its later start lies. So the work follows the overlaps, not a document's pairs.
    """
    first, last = (F.floor(F.col(c) / bin_width) for c in ("start", "end"))
    binned = spans.filter("end > start").withColumn("bin", F.explode(F.sequence(first, last)))
    a, b = binned.alias("a"), binned.alias("b")
    ratio = overlap_ratio(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))
    met = (F.col("a.doc_key") == F.col("b.doc_key")) & F.col("a.type").eqNullSafe(F.col("b.type")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.ord") < F.col("b.ord"))
    here = F.floor(F.greatest("a.start", "b.start") / bin_width) == F.col("a.bin")
    pairs = a.join(b, met & here & (ratio > threshold) & ~distinct_entities(F.col("a.type"), F.col("b.type"), F.col("a.name"), F.col("b.name")))
    return pairs.select(F.col("a.doc_key").alias("doc_key"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("other"), ratio.alias("ratio"))


def segments(spans: DataFrame) -> DataFrame:
    """``spans`` with ``segment``: spans of one document and type in different segments don't overlap.

    A sweep over bins of starts: a segment ends before a bin that no span of an earlier bin reaches into.
    Only bins are put in order, so a document of any size is cut without a task that sees all its spans.
    """
    kind = F.coalesce(F.concat(F.lit("="), "type"), F.lit("")).alias("kind")  # null is a type of its own
    binned = spans.select("*", kind, F.floor(F.col("start") / BIN).alias("bin"))
    bins = binned.groupBy("doc_key", "kind", "bin").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    along = Window.partitionBy("doc_key", "kind").orderBy("bin")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    cuts = bins.withColumn("fresh", F.coalesce(reach <= F.col("low"), F.lit(True)).cast("int"))
    numbered = cuts.select("doc_key", "kind", "bin", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))
    return binned.join(numbered, ["doc_key", "kind", "bin"]).drop("bin")


def _folding(threshold: float, key_type: pa.DataType):
    """(doc_key, ord) of the spans that stay, segment by segment, whose spans come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("doc_key", "kind", "segment", "start", "end", "ord", "name", "n_attrs", "text_length", "confidence")
        last, active = None, []  # kept spans that later ones may overlap, in order
        for batch in batches:
            out = []
            for *place, start, end, order, name, n, size, sure in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if place != last:
                    out += [(x[0], x[3]) for x in active]
                    last, active = place, []
                kept, blocked, rank = [], False, (n, size, sure)
                for x in active:
                    _, low, high, other, label, strength = x
                    if high <= start:  # nothing that follows overlaps it
                        out.append((x[0], other))
                        continue
                    common, shorter = min(end, high) - max(start, low), min(end - start, high - low)
                    conflict = not blocked and common > 0 and shorter > 0 and common / shorter > threshold and not (name and label and name != label)
                    if conflict and rank > strength:
                        continue
                    blocked = blocked or conflict
                    kept.append(x)
                if not blocked:
                    kept.append((place[0], start, end, order, name, rank))
                active = kept
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], key_type), pa.array([x[1] for x in out], pa.int64())], names=["doc_key", "ord"])
        if active:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in active], key_type), pa.array([x[3] for x in active], pa.int64())], names=["doc_key", "ord"])

    return run


def survivors(spans: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, ord) of the spans that stay.

    In order of their start, each span meets those kept so far: of two that overlap, the one with
    more attributes (then longer text, then confidence) stays; one that loses to any kept span is
    left out. Segments are folded on their own; a fold holds the spans that reach beyond the last start.
    """
    longs = [F.col(c).cast("long").alias(c) for c in ("start", "end", "ord", "n_attrs", "text_length")]
    located = spans.filter(F.col("start").isNotNull()).select("doc_key", "type", F.coalesce("name", F.lit("")).alias("name"), *longs, F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    dealt = segments(located).repartition("doc_key", "kind", "segment").sortWithinPartitions("doc_key", "kind", "segment", "start", "ord")
    key = spans.schema["doc_key"].dataType
    kept = dealt.mapInArrow(_folding(threshold, to_arrow_type(key)), f"doc_key {key.simpleString()}, ord long")
    return kept.unionByName(spans.filter(F.col("start").isNull()).select("doc_key", F.col("ord").cast("long").alias("ord")))


def fold_counts(spans: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: how many spans there were, how many were removed, how many remain."""
    both = spans.select(F.lit(1).alias("before"), F.lit(0).alias("remaining")).unionByName(kept.select(F.lit(0).alias("before"), F.lit(1).alias("remaining")))
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("before", "remaining"))).select("before", (F.col("before") - F.col("remaining")).alias("removed"), "remaining")


def n_given(extractions: DataFrame, *names: str) -> Column:
    """How many of the named columns of extractions say something."""
    nested = lambda f: isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    values = [F.to_json(n) if nested(extractions.schema[n]) else F.col(n).cast("string") for n in names]
    return sum((F.coalesce(~v.isin("", "0", "false", "[]", "{}"), F.lit(False)).cast("int") for v in values), F.lit(0))


def attributes_of(extractions: DataFrame) -> list[str]:
    """The columns that count as an extraction's attributes."""
    return [c for c in extractions.columns if c not in ("text", "source_location", "type", "confidence", "doc_key", "ord")]


def spans_of(extractions: DataFrame) -> DataFrame:
    """The spans of grounded extractions."""
    given = n_given(extractions, *attributes_of(extractions))
    return extractions.select(
        "doc_key", "ord", "type", F.col("attributes.name").alias("name"), F.col("source_location.char_start").alias("start"), F.col("source_location.char_end").alias("end"),
        given.alias("n_attrs"), F.length(F.coalesce("text", F.lit(""))).alias("text_length"), "confidence",
    )


def deduplicate(extractions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    kept = survivors(spans_of(extractions), threshold)
    return extractions.join(kept.withColumn("ord", F.col("ord").cast("int")), ["doc_key", "ord"], "left_semi")
