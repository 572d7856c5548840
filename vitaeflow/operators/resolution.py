"""Entity resolution within a document: similar names become one.

Greedy, in the order of the names: a name joins the first seed that is similar, or else is a seed itself. Equal
names collapse first. Names are decided in rounds: the first ``LEADERS`` undecided names of each document decide
among themselves, then all others meet the new seeds, in parts of a document; so a name is compared with seeds
only, a task holds one round's seeds and ``NAMES`` names, and a document of a few thousand names takes one
round. What can't be similar is told by lengths and counts of characters, for many names at once.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vitaeflow.functions.coerce import truthy
from vitaeflow.operators.keys import cut, many, told

THRESHOLD = 0.7
#: What a name inside another counts for, at most.
INSIDE = 0.9
#: Names of a document that are decided among themselves in a round, and names that meet the seeds at once.
LEADERS, NAMES = 1000, 1024
#: Pairs of names whose counts of characters are compared at once.
PAIRS = 4096
#: Counters of characters; several characters may share one.
COUNTERS = 64


def similarity(a: str, b: str) -> float:
    """Equal 1, one inside the other 0.9 times the share of lengths, else the ratio of matching blocks."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return INSIDE * min(len(a), len(b)) / max(len(a), len(b))
    return difflib.SequenceMatcher(None, a, b).ratio()


def containment_similarity(a: Column, b: Column) -> Column:
    """:func:`similarity` where it needs no blocks; null elsewhere."""
    inside = a.contains(b) | b.contains(a)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).when(inside, INSIDE * short / long)


def histograms(names: list[str]) -> np.ndarray:
    """Counts of the characters of each name."""
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    places = np.repeat(np.arange(len(names)) * COUNTERS, list(map(len, names))) + codes % COUNTERS
    return np.minimum(np.bincount(places, minlength=len(names) * COUNTERS), 32767).astype(np.int16).reshape(-1, COUNTERS)


def may_be_similar(one: np.ndarray, size: int | np.ndarray, many: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of many names could be similar to one, or to each of some that stand along a first axis: matching blocks
    can't hold more characters than both names have in common, whatever their order."""
    least = threshold * (size + sizes) - 1e-9
    common = np.minimum(one, many).sum(axis=-1, dtype=np.int64)
    return (2 * np.minimum(size, sizes) >= least) & ((2 * common >= least) | (size > 32767))


def cluster(names: list[str], threshold: float) -> list[int]:
    """For each of distinct names the place of its cluster's seed: a name joins the first similar seed."""
    if len(names) == 1:
        return [0]
    seed = np.full(len(names), -1)
    counts, sizes = histograms(names), np.array(list(map(len, names)), dtype=np.int64)
    step = max(1, PAIRS // len(names))
    for low in range(0, len(names), step):
        first = low + np.flatnonzero(seed[low : low + step] < 0)  # names that may be seeds, against all that follow
        later = low + np.flatnonzero(seed[low:] < 0)
        pairs = may_be_similar(counts[first][:, None], sizes[first][:, None], counts[later], sizes[later], threshold)
        for i, j in zip(*(x[y].tolist() for x, y in zip((first, later), np.nonzero(pairs), strict=True)), strict=True):
            if i < j and seed[i] < 0 and seed[j] < 0 and similarity(names[i], names[j]) >= threshold:
                seed[j] = i
    return np.where(seed < 0, np.arange(len(names)), seed).tolist()


def first_similar(seeds: list[str], names: list[str], threshold: float) -> list[int]:
    """For each name the place of the first seed that is similar, -1 for none."""
    counts, sizes = histograms(seeds), np.array(list(map(len, seeds)), dtype=np.int64)
    out = []
    for own, name in zip(histograms(names), names, strict=True):
        some = np.flatnonzero(may_be_similar(own, len(name), counts, sizes, threshold)).tolist()
        out.append(next((k for k in some if similarity(seeds[k], name) >= threshold), -1))
    return out


def canonical(names: list[str]) -> str:
    """Of several names one without spaces, then the longest, then the first."""
    return max(names, key=lambda n: (" " not in n, len(n)))


def _leading(threshold: float, kinds: list[pa.DataType]):
    """(doc_key, place, name, seed) of the leaders of each document, which are next to each other in order."""
    schema = dict(zip(("doc_key", "place", "name", "seed"), kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            if names:
                chosen = [names[k] for k in cluster(names, threshold)]
                for column, more in zip(held, ([last] * len(names), places, names, chosen), strict=True):
                    column.extend(more)
                yield from told(held, schema, NAMES)

        held: list[list] = [[] for _ in schema]
        last, places, names = None, [], []
        for batch in batches:
            for key, place, name in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "place", "name")), strict=True):
                if key != last or not names:
                    yield from settle()
                    last, places, names = key, [], []
                places.append(place)
                names.append(name)
        yield from settle()
        yield from told(held, schema)

    return run


def _joining(threshold: float, kinds: list[pa.DataType]):
    """(doc_key, place, name, seed) of names that meet seeds: those of a part of a document come first, in
    order, then names; seed is null without a similar one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle() -> Iterator[pa.RecordBatch]:
            if names:
                found = first_similar(seeds, names, threshold)
                columns = ([last[0]] * len(names), places, names, [seeds[k] if k >= 0 else None for k in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_key", "place", "name", "seed"])

        last, seeds, places, names = None, [], [], []
        for batch in batches:
            for key, part, is_seed, place, name in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "part", "is_seed", "place", "name")), strict=True):
                if (key, part) != last:
                    yield from settle()
                    last, seeds, places, names = (key, part), [], [], []
                if is_seed:
                    seeds.append(name)
                    continue
                places.append(place)
                names.append(name)
                if len(names) == NAMES:
                    yield from settle()
                    places, names = [], []
        yield from settle()

    return run


def seeds(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, place, name, seed): of the distinct names (doc_key, place, name) of each document, in the order of
    their places, the name of the seed that each joins."""
    columns = ["doc_key", "place", "name"]
    schema = T.StructType([*(names.schema[c] for c in columns), T.StructField("seed", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    left, done = names.select(*columns), []
    while True:
        dealt = left.repartition(many(names.sparkSession), "doc_key")
        first = dealt.withColumn("_k", F.row_number().over(_in_document())).filter(F.col("_k") <= LEADERS).drop("_k")
        decided = cut(first.sortWithinPartitions("doc_key", "place", "name").mapInArrow(_leading(threshold, kinds), schema))
        done.append(decided)
        ends = decided.groupBy("doc_key").agg(F.max(F.struct("place", "name")).alias("end"), F.count("*").alias("n")).filter(F.col("n") == LEADERS)
        if ends.isEmpty():
            break
        rest = cut(left.join(ends.drop("n"), "doc_key").filter(F.struct("place", "name") > F.col("end")).drop("end"))
        sizes = rest.groupBy("doc_key").agg(F.ceil(F.count("*") / (4 * NAMES)).cast("int").alias("parts"))
        fresh = decided.filter("name = seed").join(sizes, "doc_key").select("doc_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_seed"), "place", "name")
        asked = rest.join(sizes, "doc_key").select("doc_key", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_seed"), "place", "name")
        order = ["doc_key", "part", F.desc("is_seed"), "place", "name"]
        met = cut(fresh.unionByName(asked).repartition(many(names.sparkSession), "doc_key", "part").sortWithinPartitions(*order).mapInArrow(_joining(threshold, kinds), schema))
        done.append(met.filter("seed IS NOT NULL"))
        left = met.filter("seed IS NULL").select(*columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _in_document() -> WindowSpec:
    return Window.partitionBy("doc_key").orderBy("place", "name")


def clusters(entities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_key, ord, text, canonical) for the entities (doc_key, ord, text) of each document. Entities without
    text are clusters of their own. The names are decided at once; what each joins is kept in the shared folder."""
    rows = entities.select("doc_key", "ord", "text")
    given = truthy(F.col("text"))
    names = rows.filter(given).groupBy("doc_key", F.col("text").alias("name")).agg(F.min("ord").alias("place"))
    found = seeds(names, threshold)
    # Of a cluster's names one without spaces, then the longest, then the first.
    rank = F.struct((~F.contains("name", F.lit(" "))).alias("whole"), F.length("name").alias("size"), (-F.col("place").cast("long")).alias("early"), "name")
    chosen = found.groupBy("doc_key", "seed").agg(F.max(rank)["name"].alias("canonical"))
    named = found.join(chosen, ["doc_key", "seed"]).select("doc_key", F.col("name").alias("text"), "canonical")
    alone = rows.filter(F.coalesce(~given, F.lit(True))).withColumn("canonical", F.coalesce("text", F.lit("")))
    return rows.join(named, ["doc_key", "text"]).select("doc_key", "ord", "text", "canonical").unionByName(alone)


def rewrite_aliases(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations with from and to replaced by the canonical names of (doc_key, text, canonical)."""
    names = aliases.groupBy("doc_key", "text").agg(F.min("canonical").alias("canonical"))
    for end in ("from", "to"):
        own = names.select("doc_key", F.col("text").alias(end), F.col("canonical").alias("_name"))
        relations = relations.join(own, ["doc_key", end], "left").withColumn(end, F.coalesce("_name", end)).drop("_name")
    return relations


def resolve(extractions: DataFrame, threshold: float = THRESHOLD, kind: str = "entity") -> DataFrame:
    """Keeps the entities whose text is a canonical one and rewrites the ends of relations."""
    is_entity = F.col("type").eqNullSafe(kind)
    entities = extractions.filter(is_entity)
    if entities.isEmpty():
        return extractions
    found = clusters(entities, threshold)
    kept = entities.join(found.select("doc_key", F.col("canonical").alias("text")).distinct(), ["doc_key", "text"], "left_semi")
    relations = rewrite_aliases(extractions.filter(F.col("type") == "relation"), found).select(*extractions.columns)
    others = extractions.filter(~is_entity & ~F.col("type").eqNullSafe("relation"))
    return others.unionByName(relations).unionByName(kept.select(*extractions.columns))
