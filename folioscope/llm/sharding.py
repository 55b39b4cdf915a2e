"""Operator 1: sharding by jump consistent hashing, in Spark SQL functions only.

The key and the number of shards decide: no ring table is kept, and with one more shard a row stays or
moves into the new one. 64-bit wrapping arithmetic is done on 32-bit halves, so ANSI overflow checks hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import materialize, table

#: Multiplier of the published generator (a fixed value), and jumps that are tried: expected are ln(shards).
MULTIPLIER, JUMPS = 2862933555777941757, 128
HIGH, LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
MASK = 0xFFFFFFFF
#: Pieces of a shard that are numbered independently; equal rows in a piece are laid out in runs of RUN.
CHUNKS, RUN = 4096, 65_536
SHARDS = 16


def _times(x: str, factor: int) -> str:
    """SQL: x * factor for 32-bit x and factor, as (value modulo 2^48, rest): here modulo 2^32 only."""
    return f"((({x}) & 65535) * {factor}L + (((shiftright({x}, 16) * {factor}L) & 65535) * 65536L))"


def _next(hi: str, lo: str) -> tuple[str, str]:
    """SQL of the halves of (hi * 2^32 + lo) * MULTIPLIER + 1 modulo 2^64."""
    low = f"({_times(lo, LOW)} + 1L)"
    carry = f"(shiftright({low}, 32) + shiftright(shiftright({lo}, 16) * {LOW}L, 16))"
    return f"(({carry} + {_times(lo, HIGH)} + {_times(hi, LOW)}) & {MASK}L)", f"({low} & {MASK}L)"


def jump(key: str, shards: int) -> str:
    """SQL: shard of a 64-bit key, 0 to shards - 1; fails rather than give a wrong shard."""
    hi, lo = _next("s.hi", "s.lo")
    step = (
        f"if(s.j >= {shards}, s, element_at(transform(array(named_struct('hi', {hi}, 'lo', {lo})), "
        f"n -> named_struct('hi', n.hi, 'lo', n.lo, 'b', s.j, 'j', cast(floor((s.j + 1) * (2147483648D / (shiftright(n.hi, 1) + 1))) as bigint))), 1))"
    )
    start = f"named_struct('hi', shiftrightunsigned({key}, 32), 'lo', {key} & {MASK}L, 'b', -1L, 'j', 0L)"
    return f"aggregate(sequence(1, {min(shards, JUMPS)}), {start}, (s, i) -> {step}, s -> if(s.j >= {shards}, cast(s.b as int), cast(raise_error('too many jumps') as int)))"


def key_of(df: DataFrame, key_col: str) -> str:
    """SQL of a column's 64-bit key: an integer itself, anything else its XXH64; null is key 0."""
    kind = df.schema[key_col].dataType.simpleString()
    own = f"cast(`{key_col}` as bigint)" if kind in ("tinyint", "smallint", "int", "bigint") else f"if(`{key_col}` is null, null, xxhash64(`{key_col}`))"
    return f"coalesce({own}, 0L)"


def with_shard(df: DataFrame, key_col: str, shards: int, name: str = "shard") -> DataFrame:
    """df with the shard of each row as a new column; narrow, all other columns stay. Equal keys share a shard."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.expr(jump(key_of(df, key_col), shards)))


def assigned(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes and 1 (a null text has none; its checksum is 0). slot: gapless from 0 in each shard,
    ordered by piece, id, size and checksum. Rows that are equal in all of these are counted before they
    are numbered, so a row repeated any number of times is one row until the last step. A null id has
    key 0. An empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = key_of(docs, id_col)
    hi, _ = _next(f"shiftrightunsigned({key}, 32)", f"({key} & {MASK}L)")
    digest = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.expr(jump(key, shards)).alias("shard"),
        F.expr(jump(key, shards + 1)).alias("grown_shard"),
        F.expr(f"shiftright({hi}, 1) % {CHUNKS}").alias("piece"),
    )
    rows = ["shard", "piece", "id", "size", "text_crc32", "grown_shard"]
    keys = materialize(digest.groupBy(*rows).agg(F.count("*").alias("n")))
    # CHUNKS rows a shard at most
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = keys.groupBy("shard", "piece").agg(F.sum("n").alias("held")).select("shard", "piece", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "piece").orderBy("id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0)
    placed = keys.withColumn("upto", F.sum("n").over(inside)).join(pieces, ["shard", "piece"]).withColumn("at", F.col("base") + F.col("upto") - F.col("n"))
    runs = placed.withColumn("run", F.explode(F.expr(f"sequence(0L, n - 1, {RUN}L)")))
    slots = runs.withColumn("slot", F.explode(F.expr(f"sequence(at + run, at + least(run + {RUN - 1}, n - 1))")))
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(table(spark, sf_dir, "documents"))


QUERIES = {"op1_jump_sharding": op1_jump_sharding}
ORACLE = {
    "op1_jump_sharding": f"""
WITH RECURSIVE poly AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
    FROM range(256) AS r(i))),
src AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 0) AS k0, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT r, doc_id, k0, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM src, poly),
jump AS (
  SELECT DISTINCT k0, n, (CAST(k0 AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j
  FROM src, (VALUES ({SHARDS}), ({SHARDS + 1})) AS v(n)
  UNION ALL
  SELECT k0, n, k2, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / (k2 // 8589934592 + 1))) AS BIGINT)
  FROM (SELECT *, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < n)),
shard AS (SELECT k0, CAST(max(b) FILTER (n = {SHARDS}) AS INTEGER) AS shard, CAST(max(b) FILTER (n = {SHARDS + 1}) AS INTEGER) AS grown_shard FROM jump WHERE j >= n GROUP BY k0),
piece AS (SELECT DISTINCT k0, ((((CAST(k0 AS HUGEINT) + 18446744073709551616) % 18446744073709551616) * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 % {CHUNKS} AS piece FROM src)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY piece, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM crc JOIN shard USING (k0) JOIN piece USING (k0)""",
}
