"""What the operators share: saved intermediate tables, word hashes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, where SQL can say the same, its check."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see (``spark.checkpoint.dir``); a temporary one only on a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        folder = found.get()
    if folder is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return folder


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, so that it is computed once and a lost executor costs
    nothing.  The table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def running(df: DataFrame, group: str, order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` (default 1, so the rank from 0) over the rows of its ``group``
    that come before it in ``order``; also ``total_<name>``, the sum over the whole group.

    No group meets in one task: rows are range-sorted, each range sums its own rows, and the sums per (range,
    group) give each range its opening value.  ``df`` must be a saved table and ``order`` end in something unique.
    """
    v = F.lit(1) if value is None else value
    placed = saved(df.withColumn("v_", v.cast("long")).repartitionByRange(group, *order)
                   .withColumn("range_", F.spark_partition_id()))
    sums = placed.groupBy(group, "range_").agg(F.sum("v_").alias("s_"))
    before = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("g_"), F.col("range_").alias("r_"), F.coalesce(F.sum("s_").over(before), F.lit(0)).alias("open_"),
                       F.sum("s_").over(Window.partitionBy(group)).alias(f"total_{name}"))
    inside = Window.partitionBy(group, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("in_", F.coalesce(F.sum("v_").over(inside), F.lit(0)))
    out = out.join(sums, out[group].eqNullSafe(F.col("g_")) & (F.col("range_") == F.col("r_")))
    return out.withColumn(name, F.col("open_") + F.col("in_")).drop("v_", "range_", "in_", "g_", "r_", "open_")


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets all words when it holds ``most`` of them."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)``: the smallest id reachable by ``edges``, for every id on an edge.

    Labels fall to the smallest neighbouring label and are then followed once more (pointer jumping), so
    rounds grow with the logarithm of the longest path.  Sums over neighbours are combined before the
    shuffle; a hub with very many edges is a skewed join side that adaptive execution splits.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    e = saved(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = e.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l"))
    labels = saved(labels)
    while True:
        near = (e.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("l").alias("m")))
        step = labels.join(near, "x").select("x", "l", F.least("l", "m").alias("m"))
        jump = labels.select(F.col("x").alias("m"), F.col("l").alias("j"))
        new = saved(step.join(jump, "m", "left").select("x", "l", F.least("m", F.coalesce("j", "m")).alias("n")))
        moved = new.filter("n < l").limit(1).count()
        labels = new.select("x", F.col("n").alias("l"))
        if not moved:
            return labels.select(F.col("x").alias("id"), F.col("l").alias("component"))
