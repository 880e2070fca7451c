"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame operations only.

A key and the number of shards decide the shard; there is no ring table. With one shard more, a key either stays
or moves to the new shard, so only 1/(n+1) of the rows move.

Defined results: a null key counts as key 0; a null text has no bytes, and one of any length counts whole; rows with equal keys share a shard; an empty table gives an empty
result. Slots number the rows of each shard from 0 without gaps in the order of the given columns (nulls first);
rows equal in all of these take neighbouring slots in any order. Only the named columns are read, so further
columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlstrata.llm.common import stash, table

#: The multiplier of the generator that the paper fixes, and its low, middle and high 22, 22 and 20 bits.
MULTIPLIER = 2862933555777941757
M22, M20 = (1 << 22) - 1, (1 << 20) - 1
A0, A1, A2 = MULTIPLIER & M22, MULTIPLIER >> 22 & M22, MULTIPLIER >> 44


def stable_key(*columns: str) -> Column:
    """A 64-bit key of any columns."""
    return F.xxhash64(*columns)


def jump_hash(key: Column, shards: int) -> Column:
    """struct<shard int, grown_shard int>: the shard of a long key among ``shards``, and among one more.

    The generator works modulo 2**64. Its state is held in limbs of 22, 22 and 20 bits, so no product overflows a
    long, whatever the ANSI setting. A jump goes at least one shard forward, so ``shards`` steps always suffice;
    steps after the last jump only compare.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    long = lambda v: F.lit(v).cast("long")

    def step(s: Column, _: Column) -> Column:
        k0, k1, k2 = s["k0"], s["k1"], s["k2"]
        low = k0 * long(A0) + long(1)
        mid = k0 * long(A1) + k1 * long(A0) + F.shiftright(low, 22)
        high = k0 * long(A2) + k1 * long(A1) + k2 * long(A0) + F.shiftright(mid, 22)
        n1, n2 = mid.bitwiseAND(long(M22)), high.bitwiseAND(long(M20))
        top31 = n2 * long(1 << 11) + F.shiftright(n1, 11)
        jump = F.floor((s["j"] + long(1)).cast("double") * (F.lit(float(1 << 31)) / (top31 + long(1)).cast("double"))).cast("long")
        moved = F.struct(low.bitwiseAND(long(M22)).alias("k0"), n1.alias("k1"), n2.alias("k2"), s["j"].alias("b"), jump.alias("j"))
        return F.when(s["j"] < long(shards), moved).otherwise(s)

    start = F.struct(
        key.bitwiseAND(long(M22)).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(long(M22)).alias("k1"),
        F.shiftrightunsigned(key, 44).alias("k2"),
        long(-1).alias("b"),
        long(0).alias("j"),
    )

    def finish(s: Column) -> Column:
        grown = F.when(s["j"] == long(shards), s["j"]).otherwise(s["b"])
        return F.struct(s["b"].cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, finish)


def assign_shards(df: DataFrame, key: Column, shards: int, columns: list[Column]) -> DataFrame:
    """``columns`` with shard and grown_shard; no shuffle."""
    placed = df.select(*columns, jump_hash(key, shards).alias("_jump"))
    return placed.select("*", F.col("_jump.shard").alias("shard"), F.col("_jump.grown_shard").alias("grown_shard")).drop("_jump")


def number_slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``: the place of a row within its shard in the given order, from 0.

    A shard is far too large for one window task. Rows are range-partitioned by (shard, order, row number as tie-break),
    so even equal rows spread evenly; each partition numbers its own rows, and the counts of earlier partitions of the
    same shard (a table of at most partitions + shards rows) are added.
    """
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(shard, *order, "_tie")
    ranged = stash(ranged.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(shard, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part", shard).orderBy(*order, "_tie")
    numbered = ranged.withColumn("_rank", F.row_number().over(within))
    joined = numbered.join(offsets, ["_part", shard])
    return joined.withColumn("slot", F.col("_offset") + F.col("_rank") - 1).drop("_part", "_tie", "_offset", "_rank")


def write_shards(df: DataFrame, key: Column, shards: int, path: str, files_per_shard: int = 8) -> None:
    """Write all columns of df as Parquet, one folder for each shard, each dealt over several tasks and files."""
    placed = df.withColumn("shard", jump_hash(key, shards)["shard"])
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)


def op1_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Shards 0 to 23 for all documents, with the shard each would have among 25."""
    docs = table(spark, sf_dir, "documents")
    columns = [
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    ]
    placed = assign_shards(docs, F.col("doc_id"), shards, columns)
    out = number_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op1_jump_sharding": op1_jump_sharding}

#: The query in SQL; crc32 by its definition, byte after byte.
ORACLE_SQL = {
    "op1_jump_sharding": f"""with recursive rounds as (select i as entry, i as v, 0 as step from range(256) t(i)
 union all select entry, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from rounds where step < 8),
crc as (select list(cast(v as bigint) order by entry) as entries from rounds where step = 8),
d as (select row_number() over () as r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as bytes from documents),
summed as (select r, doc_id, cast(len(bytes) + 8 as bigint) as size,
 xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(bytes, lambda x: cast('0x' || x as bigint))), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32
 from d, crc),
jumps as (select r, cast(coalesce(doc_id, 0) as hugeint) as key, cast(-1 as bigint) as b, cast(0 as bigint) as j from d
 union all select r, k, j, cast(floor((j + 1) * (2147483648.0::double / cast((k >> 33) + 1 as double))) as bigint)
 from (select r, j, (key * {MULTIPLIER} + 1) % 18446744073709551616 as k from jumps where j < 24)),
placed as (select r, cast(arg_max(b, j) as int) as shard, cast(case when max(j) = 24 then 24 else arg_max(b, j) end as int) as grown_shard from jumps group by r)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1 as slot, grown_shard
from summed join placed using (r)""",
}
