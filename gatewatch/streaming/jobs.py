"""Starting streams: triggers, checkpoints and batch sinks.

A sink may see a micro batch twice: after a failure Spark runs the last one again.  ``Sinks`` keeps a ledger, a folder
with one small row set per (batch, sink) whose write succeeded; a batch that comes again skips those sinks, and data
folders are named by batch, so a half-written one is replaced.  Readers see complete batches only.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import newest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "batch bigint, sink string, ok boolean, rows bigint, seconds double, error string"


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], every: str | None = "30 seconds",
          mode: str = "append", name: str | None = None) -> StreamingQuery:
    """ST11: one micro batch every ``every`` (the flush interval); ``None`` drains what is there and
    stops.  The checkpoint folder holds offsets and state, so it has to be shared storage.  State lies in RocksDB,
    on disk beside the executor."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    if name:
        w = w.queryName(name)
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """One folder per micro batch: a batch that is retried replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class Sinks:
    """The rows of each micro batch to several tables under ``folder``; a failing sink does not stop the others.

    ``tables`` maps a sink's name to a function of the batch that gives its rows.  ``targets`` lists the names
    in use (default all); unknown names are ignored.  ``capped`` maps names of tables that keep their newest rows only to
    ``(most, time column, tie column)`` (S05).  With ``retry``, a batch with a failed sink fails as a whole
    after the ledger is written, and Spark's next run of the batch does the failed sinks again.
    """

    def __init__(self, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]], targets: list[str] | None = None,
                 capped: dict[str, tuple[int, str, str]] | None = None, retry: bool = False):
        self.folder, self.tables, self.capped, self.retry = folder.rstrip("/"), tables, capped or {}, retry
        self.targets = [t for t in (targets or list(tables)) if t in tables]

    def __call__(self, df: DataFrame, batch: int) -> None:
        done = {r.sink: r for r in self.ledger(df.sparkSession).where((F.col("batch") == batch) & F.col("ok")).collect()}
        todo = [t for t in self.targets if t not in done]
        if not todo:
            return
        df.persist()  # the sinks read it one after another
        results = [self._write(df, batch, t) for t in todo]
        df.unpersist()
        kept = [tuple(done[t]) for t in self.targets if t in done]
        (df.sparkSession.createDataFrame([*kept, *results], LEDGER).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}"))
        if self.retry and not all(r[2] for r in results):
            raise RuntimeError(f"batch {batch}: " + "; ".join(f"{r[1]}: {r[5]}" for r in results if not r[2]))

    def _write(self, df: DataFrame, batch: int, name: str) -> tuple:
        began = time.monotonic()
        path = f"{self.folder}/{name}/batch={batch}"
        try:
            rows = self.tables[name](df)
            if name in self.capped:
                most, ts, tie = self.capped[name]
                before = self._capped_before(df.sparkSession, name, batch, rows)
                rows = newest(rows if before is None else before.unionByName(rows), most, ts, tie)
            rows.write.mode("overwrite").parquet(path)
            n, error = df.sparkSession.read.schema(rows.schema).parquet(path).count(), None
        except Exception as e:  # noqa: BLE001 - the ledger records it
            n, error = None, str(e).splitlines()[0][:500]
        return batch, name, error is None, n, round(time.monotonic() - began, 3), error

    def _batches(self, spark: SparkSession, name: str) -> list[int]:
        """Batches whose write of this sink succeeded: one number each."""
        return sorted(r.batch for r in self.ledger(spark).where((F.col("sink") == name) & F.col("ok")).select("batch").collect())

    def _capped_before(self, spark: SparkSession, name: str, batch: int, like: DataFrame) -> DataFrame | None:
        """The list as the last earlier batch left it; it never changes, so a repeated batch reads the same."""
        earlier = [b for b in self._batches(spark, name) if b < batch]
        return spark.read.schema(like.schema).parquet(f"{self.folder}/{name}/batch={earlier[-1]}") if earlier else None

    def ledger(self, spark: SparkSession) -> DataFrame:
        """One row per batch and sink: whether it was written, how many rows, how long it took, what went wrong."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], LEDGER)
        names = [f.split()[0] for f in LEDGER.split(", ")]
        return spark.read.option("recursiveFileLookup", True).schema(LEDGER).parquet(f"{self.folder}/ledger").select(names)

    def read(self, spark: SparkSession, name: str) -> DataFrame | None:
        """The rows of a sink's complete batches; of a capped table, the list as it stands.  ``None`` before the first."""
        batches = self._batches(spark, name)
        if not batches:
            return None
        if name in self.capped:
            batches = batches[-1:]
        return spark.read.parquet(*[f"{self.folder}/{name}/batch={b}" for b in batches])
