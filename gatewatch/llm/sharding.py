"""Sharding by rendezvous hashing: every record key draws one number per shard, the best shard wins.

With weights, shard ``s`` scores ``ln(u) / weight`` and wins with probability ``weight / sum``.  A new shard only
adds draws, so it takes records and no record moves between old shards.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import query, saved, table


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard number for ``key`` (as text; a null key is the text ``null``).

    The draw is the first 52 bits of ``md5(key#shard)``; equal scores go to the smaller shard.
    """
    k = F.coalesce(key.cast("string"), F.lit("null"))
    scores = []
    for s, w in enumerate(weights):
        if w <= 0:
            raise ValueError("weights are positive")
        draw = F.conv(F.substring(F.md5(F.concat(k, F.lit(f"#{s}"))), 1, 13), 16, 10).cast("double")
        scores.append(F.struct((F.log((draw + 1) / F.lit(float(2**52 + 1))) / F.lit(float(w))).alias("score"),
                               F.lit(-s).alias("neg")))
    return (-F.greatest(*scores)["neg"]).cast("int") if len(scores) > 1 else F.lit(0)


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``shard``, ``slot``
    (gapless from 0 in the shard, in order of key, checksum and size) and ``grown_shard`` under the longer
    list of weights ``grown`` (null without one).

    Null texts count as empty in size and checksum; null keys are placed like a key of their own.  Slots come
    from range-sorted rows: counts per (range, shard) give each range its first slot, so no shard is ever
    ranked in one task.  Rows that are equal in key and text are told apart by their place in the saved table, so they
    spread over ranges too; which of them has which slot does not show.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    light = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 1).cast("long").alias("size"),
                        F.crc32(body).alias("crc"), F.xxhash64(body).alias("salt"),
                        F.monotonically_increasing_id().alias("u"))
    light = light.withColumns({"shard": rendezvous(F.col("k"), weights),
                               "grown": rendezvous(F.col("k"), grown) if grown else F.lit(None).cast("int")})
    order = ["k", "crc", "size", "salt", "u"]
    placed = saved(saved(light).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = placed.groupBy("range", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("range", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("range", "shard").orderBy(*order)
    ranked = placed.withColumn("in_range", F.row_number().over(inside) - 1)
    return (ranked.join(first, ["range", "shard"])
            .select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("first") + F.col("in_range")).cast("long").alias("slot"), F.col("grown").alias("grown_shard")))


def shards_after(docs: DataFrame, weights: list[float], key: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``shard``, for a writer that partitions by it; a column of that name is replaced."""
    return docs.withColumn("shard", rendezvous(F.col(key), weights))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
