"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Sources share all words by weight; no source may get more than ``MAX_COPIES`` times what it has.
Within a source, the rates closest to 1 (in relative entropy, each at most ``MAX_COPIES``) whose
weighted words meet the target are ``min(MAX_COPIES, exp(lambda * size / mean size))``. The
multipliers are the maximum of a convex dual, found by Newton steps on all sources at once; a step
is one aggregation over the table of distinct (source, size), never over the documents.

Rates become copies: all documents of one source and size get the whole part of their rate, and
so many of them get one copy more that the words taken so far stay nearest to those wished for
(sizes from large to small). Which of them get it follows from a hash of the document.

Skew: documents are pre-aggregated by (source, size); a pair holding over 1/1000 of all documents
is split into parts, of which there are so few that their list may be broadcast. Sources are numbered
range by range, and the level at which they are filled follows from sums over all of them, so that
their number may be large as well.

Nulls and edge cases: a null or empty text has size 0, takes 0 words and gets copy 1; null sources
are one source, ordered last; repeated rows are counted one by one; a source without words has
target 0; very long texts are counted whole; documents of one size and source with equal hashes are
ordered by ``doc_id``, and those that are equal in that too get copies as if they were one; an empty
table gives an empty result; further columns are ignored by ``mix`` and kept by ``mixed_rows``, which
tells rows apart by all of their columns. If the balance isn't reached, an error says for how many
sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import cut, let, read, row_hash, word_count

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Newton stops when each source's words are within this share of its target.
TOLERANCE = 1e-7
#: Steps after which the balance counts as not to be reached: far more than halving needs.
MAX_STEPS = 200
#: Sizes that are folded into a list of their own.
FOLDED = 128
#: (source, size) pairs with more than 1 / HOT_SHARE of all documents are dealt out in parts.
HOT_SHARE = 1000
_EXP_LIMIT = 50.0


def source_targets(sources: DataFrame) -> DataFrame:
    """(source, words) to (source, words, weight, target).

    Weights 1, 2, 3 repeat in code point order, null last. Sources that a share by weight would take
    over their room are filled, and the rest is shared again until none is.
    """
    by_name = F.col("source").asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(sources.repartitionByRange(parts, by_name).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    first = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    weighed = cut(ranged.join(F.broadcast(first), "part").withColumn("weight", weight).withColumn("room", MAX_COPIES * F.col("words")).select("source", "words", "weight", "room"))
    total, level, filled = weighed.agg(F.sum("words")).first()[0] or 0, 0.0, -1
    while True:
        full = F.col("room") <= F.col("weight") * level
        now = weighed.agg(F.sum(full.cast("long")).alias("filled"), F.sum(F.when(full, F.col("room"))).alias("room"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if now["filled"] in (None, filled) or not now["weight"]:
            break
        filled, level = now["filled"], (total - (now["room"] or 0)) / now["weight"]
    return weighed.select("source", "words", "weight", F.least(F.col("room").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(lam, size, mean):
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(F.lit(_EXP_LIMIT), lam * size / mean)))


def balance(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Solve the dual: (source, lam, mean) for ``sizes`` (source, size, n) and ``targets``.

    A source that must be taken whole three times has a null multiplier: its rate is the cap. A step
    that leaves the bounds known so far (none at first) halves what is between them, or doubles.
    """
    whole = F.col("target") >= MAX_COPIES * F.col("words")
    none = F.lit(None).cast("double")
    state = cut(
        targets.select(
            "source", "target", F.greatest(F.col("mean"), F.lit(1.0)).alias("mean"), F.lit(0.0).alias("lam"), none.alias("low"), none.alias("high"),
            whole.alias("capped"), ((F.col("words") == 0) | whole).alias("done"),
        )
    )
    for _ in range(MAX_STEPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"))
        slope = F.when(rate < MAX_COPIES, rate * F.col("size") * F.col("size") / F.col("mean")).otherwise(0.0)
        now = (
            sizes.alias("z")
            .join(state.filter(~F.col("done")).alias("s"), F.col("z.source").eqNullSafe(F.col("s.source")))
            .groupBy("s.source")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * slope).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(gap, F.col("slope"))
        wide = 2 * F.abs(F.col("lam")) + 1
        middle = F.when(low.isNull(), F.col("lam") - wide).when(high.isNull(), F.col("lam") + wide).otherwise((low + high) / 2)
        inside = newton.isNotNull() & F.coalesce(newton > low, newton > F.col("lam") - 4 * wide) & F.coalesce(newton < high, newton < F.col("lam") + 4 * wide)
        step = F.when(inside, newton).otherwise(middle)
        # Between neighbouring numbers there is nothing nearer.
        near = (F.abs(gap) <= TOLERANCE * F.col("target")) | F.coalesce(high - low <= 1e-14 * F.abs(F.col("lam")), F.lit(False))
        over = F.col("done") | near
        state = cut(
            state.alias("s")
            .join(now.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
            .select(
                F.col("s.source").alias("source"), "target", "mean", F.when(over, F.col("lam")).otherwise(step).alias("lam"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                "capped", over.alias("done"),
            )
        )
    left = state.filter(~F.col("done")).count()
    if left:
        raise RuntimeError(f"{left} sources have no balance after {MAX_STEPS} steps")
    return state.select("source", "target", "mean", F.when(~F.col("capped"), F.col("lam")).alias("lam"))


def size_plan(sizes: DataFrame, solved: DataFrame) -> DataFrame:
    """(source, size, n, whole, extra): the copies all get, and how many documents get one more.

    A source's distinct sizes, at most as many as its longest text has words, are folded in one row
    (24 bytes each).
    """
    rate = F.when(F.col("lam").isNull(), F.lit(float(MAX_COPIES))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean")))
    rated = (
        sizes.alias("z")
        .join(solved.alias("s"), F.col("z.source").eqNullSafe(F.col("s.source")))
        .filter("size > 0")
        .select(F.col("z.source").alias("source"), "size", "n", "target", rate.alias("rate"))
        .withColumn("whole", F.floor(F.col("rate") + 1e-9))
    )
    item = F.struct(F.col("size"), "n", F.col("whole"), (F.col("rate") - F.col("whole")).alias("part"))
    folded = rated.groupBy("source").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    extras = "array<struct<size:bigint,n:bigint,whole:bigint,extra:bigint>>"

    def take(state, x):
        owed = state["owed"] + x["n"] * x["part"] * x["size"]
        # Without a share of its own a size takes no part, so that capped sources stay at the cap.
        most = F.when(x["part"] > 1e-9, x["n"]).otherwise(F.lit(0))
        extra = F.greatest(F.lit(0), F.least(most, F.round(owed / x["size"]))).cast("bigint")
        return F.struct(
            (owed - extra * x["size"]).cast("double").alias("owed"),
            F.array_append(state["out"], F.struct(x["size"].alias("size"), x["n"].alias("n"), x["whole"].cast("bigint").alias("whole"), extra.alias("extra"))).alias("out"),
        )

    def take_some(state, first):
        """Some sizes on a list of their own, as appending copies a list."""
        some = F.aggregate(F.slice("items", first, FOLDED), F.struct(state["owed"].alias("owed"), F.array().cast(extras).alias("out")), take)
        return let(some, lambda x: F.struct(x["owed"].alias("owed"), F.array_append(state["out"], x["out"]).alias("out")))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast(f"array<{extras}>").alias("out"))
    every = F.aggregate(F.sequence(F.lit(1), F.size("items"), F.lit(FOLDED)), start, take_some)
    return folded.select("source", F.explode(F.flatten(every["out"])).alias("x")).select("source", "x.*")


def _draw() -> Column:
    return F.xxhash64(F.col("doc_id"), F.crc32(F.col("text").cast("string").cast("binary")))


def _mixed(docs: DataFrame, draw: Column) -> DataFrame:
    light = cut(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
            draw.alias("draw"),
        )
    )
    sizes = cut(light.groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"))
    targets = cut(
        source_targets(per_source.select("source", "words")).alias("t")
        .join(per_source.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")))
        .select(F.col("t.source").alias("source"), F.col("t.words").alias("words"), "target", (F.col("p.words") / F.col("docs")).alias("mean"))
    )
    plan = cut(size_plan(sizes, balance(sizes, targets)))
    # Hot pairs: at most HOT_SHARE of them by their definition, so the list may be broadcast.
    total = sizes.agg(F.sum("n").alias("total"))
    hot = (
        sizes.crossJoin(F.broadcast(total))
        .filter(F.col("n") * HOT_SHARE > F.col("total"))
        .select(F.col("source").alias("h_source"), F.col("size").alias("h_size"), F.ceil(F.col("n") * HOT_SHARE / F.col("total")).cast("int").alias("parts"))
    )
    dealt = (
        light.join(F.broadcast(hot), F.col("source").eqNullSafe(F.col("h_source")) & (F.col("size") == F.col("h_size")), "left")
        .withColumn("part", F.coalesce(F.pmod(F.shiftright("draw", 7), F.col("parts")), F.lit(0)).cast("int"))
        .drop("h_source", "h_size", "parts")
    )
    # A part's share of the extra copies: differences of the rounded-down running share.
    running = Window.partitionBy("source", "size").orderBy("part")
    quota = (
        dealt.groupBy("source", "size", "part")
        .agg(F.count("*").alias("here"))
        .withColumn("upto", F.sum("here").over(running))
        .alias("q")
        .join(plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source")) & (F.col("q.size") == F.col("p.size")))
        .withColumn("most", F.floor(F.col("extra") * F.col("upto") / F.col("n")))
        .withColumn("least_", F.floor(F.col("extra") * (F.col("upto") - F.col("here")) / F.col("n")))
        .select(F.col("q.source").alias("source"), F.col("q.size").alias("size"), "part", "whole", (F.col("most") - F.col("least_")).alias("quota"))
    )
    order = Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id")
    ranked = dealt.withColumn("rank", F.row_number().over(order))
    copies = F.when(F.col("d.size") == 0, F.lit(1)).otherwise(F.col("whole") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)).cast("int")
    placed = ranked.alias("d").join(
        quota.alias("q"),
        F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.part") == F.col("q.part")),
        "left",
    )
    return (
        placed.select("d.doc_id", F.col("d.source").alias("source"), F.col("d.size").alias("size"), copies.alias("copies"), "draw")
        .alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select(
            "doc_id",
            F.col("d.source").alias("source"),
            "size",
            F.col("words").cast("long").alias("source_size"),
            "target",
            "copies",
            (F.col("copies") * F.col("size")).cast("long").alias("taken"),
            "draw",
        )
    )


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of ``docs``."""
    return _mixed(docs, _draw()).drop("draw")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; rows that are
    equal in all columns get their copies together."""
    whole = row_hash(docs)
    copies = _mixed(docs, whole).groupBy("doc_id", "draw").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), whole.alias("draw")).dropDuplicates(["doc_id", "draw"])
    met = rows.alias("d").join(copies.alias("c"), (F.col("d.draw") == F.col("c.draw")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")))
    return met.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def op1_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(read(spark, sf_dir, "documents"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op1_entropy_mix": op1_entropy_mix}
