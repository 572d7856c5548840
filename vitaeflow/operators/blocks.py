"""The longest block that a text and its source have in common, found by joining short runs of characters.

Seed and extend: characters that make up over a hundredth of a source (of 200 characters or more) are too
common to begin a block and break runs. Of what is left, the longest equal run counts, of several that
with the smallest place in the text, then in the source; it is then extended by all equal characters
around it. Without any such run the block is what both begin with.

Sources and texts are cut into pieces of ``PIECE`` characters, whose runs of 1 to ``GRAM`` characters meet
by document. Runs of ``GRAM`` keep all their places: those on one diagonal (place in the source less place in
the text) that follow each other are one longer run. Shorter ones need their first place only, as a run that
isn't part of a longer one is equal to the run itself; so a text has no more matches than characters
there. Nothing is compared that doesn't share a run, and no task needs a whole source but to extend.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaeflow.functions.text import line_number

GRAM = 4
PIECE = 256
#: Stands for common characters. It is no character of any language; in a text it matches nothing.
BREAK = "￿"


def _pieces(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, at, own, more): pieces of a text and the first characters of what follows each."""
    pattern = F.lit(rf"(?s)(.{{1,{PIECE}}})(?=(.{{0,{GRAM - 1}}}))")
    both = F.arrays_zip(F.regexp_extract_all(column, pattern, F.lit(1)).alias("own"), F.regexp_extract_all(column, pattern, F.lit(2)).alias("more"))
    return df.select(*keys, F.posexplode(both).alias("k", "piece")).select(*keys, (F.col("k") * PIECE).alias("at"), "piece.own", "piece.more")


def _grams(df: DataFrame, column: str, keys: list[str], place: str) -> DataFrame:
    """(keys, n, gram, first, all): runs of 1 to GRAM characters of a text without one of those in
    ``common``, the first place of each, and all places of those of GRAM."""
    body = F.call_function("translate", F.concat("own", "more"), F.col("common"), F.repeat(F.lit(BREAK), F.length("common")))
    masked = _pieces(df, column, [*keys, "common"]).select(*keys, "at", F.length("own").alias("size"), body.alias("body"))
    starts = masked.select("*", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("o")).select(*keys, (F.col("at") + F.col("o") - 1).alias("place"), F.expr(f"substring(body, o, {GRAM})").alias("run"))
    # The run up to the next common character; its beginnings are all runs that start here.
    some = starts.select(*keys, "place", F.substring_index("run", BREAK, 1).alias("run")).filter("run <> ''")
    every = some.select(*keys, "place", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("n")).select(*keys, "n", "place", F.expr("substring(run, 1, n)").alias("gram"))
    return every.groupBy(*keys, "n", "gram").agg(F.min("place").alias(place), F.collect_list(F.when(F.col("n") == GRAM, F.col("place"))).alias(f"all_{place}"))


def _shared_beginning(a: str, b: str) -> Column:
    """How many first characters two columns have in common: the largest number, bit by bit."""

    def step(done: Column, more: Column) -> Column:
        longer = done + more
        same = (longer <= F.least(F.length(a), F.length(b))) & (F.substring(a, done + 1, more) == F.substring(b, done + 1, more))
        return F.when(same, longer).otherwise(done)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), step)


def longest_blocks(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_key, text, start, size, line) of the longest block of each of the distinct texts (doc_key, text,
    common) in the source of its document (doc_key, text); size 0 without any. ``common``: the characters
    that are too common in the source, or the empty string."""
    commons = texts.select("doc_key", "common").distinct()
    sources = documents.select("doc_key", F.coalesce("text", F.lit("")).alias("source")).join(commons, "doc_key")
    own = texts.withColumn("id", F.xxhash64("text"))
    met = _grams(own, "text", ["doc_key", "id"], "i").join(_grams(sources, "source", ["doc_key"], "j"), ["doc_key", "n", "gram"])
    short = met.filter(f"n < {GRAM}").select("doc_key", "id", "n", "i", "j")
    # Neighbours on a diagonal are one run.
    pairs = met.filter(f"n = {GRAM}").select("doc_key", "id", "all_j", F.explode("all_i").alias("i")).select("doc_key", "id", "i", F.explode("all_j").alias("j")).withColumn("diagonal", F.col("j") - F.col("i"))
    along = Window.partitionBy("doc_key", "id", "diagonal").orderBy("i")
    runs = pairs.withColumn("run", F.col("i") - F.row_number().over(along)).groupBy("doc_key", "id", "diagonal", "run").agg(F.min("i").alias("i"), (F.count("*") + GRAM - 1).cast("int").alias("n"))
    every = short.unionByName(runs.select("doc_key", "id", "n", "i", (F.col("i") + F.col("diagonal")).alias("j")))
    best = every.groupBy("doc_key", "id").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("x"))
    seeds = own.join(best.select("doc_key", "id", F.col("x.n").alias("n"), (-F.col("x.i")).alias("i"), (-F.col("x.j")).alias("j")), ["doc_key", "id"], "left").fillna(0, ["n", "i", "j"])
    placed = seeds.join(sources.drop("common"), "doc_key")
    reach = F.least("i", "j")
    sides = F.struct(
        F.reverse(F.substring("text", F.col("i") - reach + 1, reach)).alias("a"), F.reverse(F.substring("source", F.col("j") - reach + 1, reach)).alias("b"),
        F.substring("text", F.col("i") + F.col("n") + 1, F.length("text")).alias("c"), F.substring("source", F.col("j") + F.col("n") + 1, F.length("text")).alias("d"),
    )
    around = placed.select("*", F.inline(F.array(sides)))  # computed once: projections aren't moved through a generator
    grown = around.select("doc_key", "text", "source", "n", "j", F.inline(F.array(F.struct(_shared_beginning("a", "b").alias("before"), _shared_beginning("c", "d").alias("after")))))
    start = (F.col("j") - F.col("before")).cast("int")
    return grown.select("doc_key", "text", start.alias("start"), (F.col("before") + F.col("n") + F.col("after")).cast("int").alias("size"), line_number(F.col("source"), start).alias("line"))
