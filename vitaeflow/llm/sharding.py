"""Sharding by jump consistent hashing.

A document's shard follows from its ``doc_id`` and the number of shards alone. There is no ring
table, and when a shard is appended only the rows that move into the new shard change place.

Within a shard, rows get slots 0, 1, ... in the order of their part, then of the mixed key. Parts are
told by the first bits of the mixed key and of the text's crc32, and numbered on their own with the
part's first slot added. So no task sorts a whole shard, and rows with one ``doc_id`` or none, which
the law puts into one shard, are spread by their texts.

Nulls and edge cases: a null ``doc_id`` is hashed as if it were -1; a null or empty text has size
16 and crc32 0; repeated rows share a shard and get slots of their own, in no particular order among
equal ones; very long texts are read whole for their size and crc32 and not moved by
``assign_shards``; an empty table gives an empty result; further columns of the input are ignored by
``assign_shards`` and kept by ``sharded_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaeflow.llm.common import cut, read

SHARDS = 40
#: Parts of a shard that are numbered on their own: the top bits of the mixed key.
SUB_BUCKET_BITS = 6
#: Parts of each of these: the top bits of the text's crc32.
TEXT_BITS = 4
#: Bytes a row takes besides its text.
ROW_OVERHEAD = 16

# The splitmix64 finaliser and the jump hash generator.
_MIX_ADD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_JUMP_MULTIPLIER = np.uint64(2862933555777941757)


def mix(keys: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (splitmix64)."""
    x = keys.astype(np.int64).view(np.uint64) + _MIX_ADD
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def jump(mixed: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of mixed keys, for a whole array at once."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = mixed.astype(np.uint64, copy=True)
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    after = np.zeros(len(state), dtype=np.int64)
    while len(live):
        shard[live] = after[live]
        state[live] = state[live] * _JUMP_MULTIPLIER + np.uint64(1)
        step = (after[live] + 1) * (2147483648.0 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        after[live] = np.minimum(step, 9e15).astype(np.int64)
        live = live[after[live] < shards]
    return shard.astype(np.int32)


def _with_shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            mixed = mix(keys)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in ("doc_id", "size", "text_crc32")),
                    pa.array((mixed >> np.uint64(1)).astype(np.int64)),
                    pa.array(jump(mixed, shards)),
                    pa.array(jump(mixed, shards + 1)),
                ],
                names=["doc_id", "size", "text_crc32", "place", "shard", "grown_shard"],
            )

    return run


def _placed(key: Column, shards: int) -> Column:
    def place(keys: pd.Series) -> pd.DataFrame:
        mixed = mix(keys.to_numpy(np.int64))
        return pd.DataFrame({"place": (mixed >> np.uint64(1)).astype(np.int64), "shard": jump(mixed, shards), "grown_shard": jump(mixed, shards + 1)})

    return F.pandas_udf(place, "place long, shard int, grown_shard int")(key)


def _first_slots(placed: DataFrame) -> DataFrame:
    """(shard, part, first_slot): at most shards * 2 ** (SUB_BUCKET_BITS + TEXT_BITS) rows whatever the
    input's size."""
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    return counted.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first_slot"))


def _part(crc: str) -> Column:
    """A row's part of its shard, from the columns place and ``crc`` (32 bits, unsigned)."""
    return (F.shiftright("place", 63 - SUB_BUCKET_BITS) * F.lit(1 << TEXT_BITS) + F.shiftright(crc, 32 - TEXT_BITS)).cast("int")


def sharded_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with all their columns and shard, slot and grown_shard (in place of
    columns of those names)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    kept = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("crc")
    placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), crc, _placed(key, shards).alias("x")).select("row", "crc", "x.*").withColumn("part", _part("crc"))
    light = docs.select(crc, _placed(key, shards).alias("x")).select("crc", "x.*").withColumn("part", _part("crc"))
    order = Window.partitionBy("shard", "part").orderBy("place", "row.doc_id", "crc")
    return (
        placed.withColumn("within", F.row_number().over(order))
        .join(F.broadcast(_first_slots(light)), ["shard", "part"])
        .select("row.*", "shard", (F.col("first_slot") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = cut(
        light.mapInArrow(_with_shards(shards), "doc_id long, size long, text_crc32 long, place long, shard int, grown_shard int")
    ).withColumn("part", _part("text_crc32"))
    order = Window.partitionBy("shard", "part").orderBy("place", "doc_id", "text_crc32", "size")
    return (
        placed.withColumn("within", F.row_number().over(order))
        .join(F.broadcast(_first_slots(placed)), ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("within") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by their doc_id."""
    return assign_shards(read(spark, sf_dir, "documents"))


#: crc32 bit by bit: each byte is followed by seven zeros, and every step shifts one bit out.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
  regexp_extract_all(hex(t), '..'), lambda h: [('0x' || h)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295::BIGINT)"""

ORACLE_SQL = {
    "op8_jump_sharding": f"""
WITH RECURSIVE base AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, row_number() OVER () AS rid,
         CAST(coalesce(strlen(text), 0) + {ROW_OVERHEAD} AS BIGINT) AS size, coalesce(text, '') AS t,
         CAST(CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616 ELSE doc_id END AS UHUGEINT) AS k
  FROM documents),
m0 AS (SELECT *, (k + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS x0 FROM base),
m1 AS (SELECT *, (xor(x0, x0 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS x1 FROM m0),
m2 AS (SELECT *, (xor(x1, x1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS x2 FROM m1),
keyed AS (SELECT doc_id, rid, size, xor(x2, x2 // 2147483648::UHUGEINT) AS mixed, {_CRC_SQL} AS crc FROM m2),
counts AS (SELECT unnest([{SHARDS}, {SHARDS + 1}]) AS shards),
walk AS (
  SELECT rid, shards, mixed AS state, CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS after FROM keyed, counts
  UNION ALL
  SELECT rid, shards, nxt, after, CAST(floor((after + 1) * (2147483648.0::DOUBLE / (CAST(nxt // 8589934592::UHUGEINT AS DOUBLE) + 1.0))) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS nxt FROM walk WHERE after < shards)
),
landed AS (SELECT rid, shards, max(shard) AS shard FROM walk GROUP BY rid, shards)
SELECT k.doc_id, k.size, k.crc AS text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY a.shard ORDER BY k.mixed // {1 << 64 - SUB_BUCKET_BITS}::UHUGEINT, k.crc // {1 << 32 - TEXT_BITS}, k.mixed // 2::UHUGEINT, k.doc_id, k.crc, k.size) - 1 AS BIGINT) AS slot,
  CAST(g.shard AS INTEGER) AS grown_shard
FROM keyed k JOIN landed a ON a.rid = k.rid AND a.shards = {SHARDS} JOIN landed g ON g.rid = k.rid AND g.shards = {SHARDS + 1}
"""
}
QUERIES = {"op8_jump_sharding": op8_jump_sharding}
