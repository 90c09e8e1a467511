"""Reading logs: files, streams, batches, lists and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse as P
from ..session import shared_folder, stored

LOG_STRUCT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("remote_addr", T.StringType()),
    T.StructField("ts_us", T.LongType()), T.StructField("request_method", T.StringType()),
    T.StructField("request_uri", T.StringType()), T.StructField("status", T.LongType()),
    T.StructField("body_bytes_sent", T.LongType()), T.StructField("http_user_agent", T.StringType()),
    T.StructField("http_referer", T.StringType())])
ENVELOPE = T.StructType([
    T.StructField("node_id", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("batch_size", T.LongType()), T.StructField("logs", T.ArrayType(LOG_STRUCT))])
ENTRY = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("ip_address", T.StringType()), T.StructField("user_agent", T.StringType()),
    T.StructField("request_method", T.StringType()), T.StructField("request_url", T.StringType()),
    T.StructField("response_status", T.LongType()), T.StructField("response_size", T.LongType()),
    T.StructField("extra_fields", T.MapType(T.StringType(), T.StringType()))])


def tail_logs(spark: SparkSession, folder: str, latest_first: bool = False,
              max_files_per_trigger: int | None = None) -> DataFrame:
    """New lines of a folder as a stream; the checkpoint is the saved offset.

    Blank lines are dropped here, lines that do not parse by the parser.
    """
    r = spark.readStream.format("text").option("latestFirst", latest_first)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder).where(F.trim("value") != "")


def count_lines(lines: DataFrame, name: str = "agent") -> DataFrame:
    """S01 counters, reported with each micro batch (or job) at no extra pass."""
    return lines.observe(name, F.count(F.lit(1)).alias("lines"),
                         F.sum(F.octet_length("value")).alias("bytes"))


def flatten_envelopes(batches: DataFrame, col: str = "value") -> DataFrame:
    """Agent batches (JSON) to log rows that carry the batch's node."""
    return (batches.select(F.from_json(col, ENVELOPE).alias("_b"))
            .select(F.col("_b.node_id").alias("node_id"), F.explode("_b.logs").alias("_l"))
            .select("_l.*", "node_id"))


def make_envelopes(rows: DataFrame, size: int = 100, order: str = "event_id") -> DataFrame:
    """Batches of at most ``size`` consecutive ids of one node, as the agents send them."""
    logs = F.array_sort(F.collect_list(F.struct(*[c for c in LOG_STRUCT.fieldNames()])))
    return (rows.groupBy("node_id", F.expr(f"{order} div {size}").alias("_b")).agg(logs.alias("logs"))
            .select(F.to_json(F.struct("node_id", F.lit("").alias("timestamp"),
                                       F.size("logs").cast("bigint").alias("batch_size"), "logs")).alias("value")))


def parse_entries(lines: DataFrame, fmt: str, source: str, custom_pattern: str | None = None,
                  since: Column | None = None, line: str = "value", keep=(), as_of: Column | None = None) -> DataFrame:
    """S03 without the file: lines in one of the formats to entries at or after ``since``."""
    if fmt == "custom":
        out = P.parse_custom_entry(lines, source, custom_pattern, line, as_of, keep)
    else:
        out = P.ENTRY_PARSERS.get(fmt, P.parse_clf_entry)(lines, source, line, keep=keep)
    return out if since is None else out.where(F.col("timestamp") >= since)


def read_log_file(spark: SparkSession, path: str, fmt: str, source: str, since: Column | None = None,
                  limit: int | None = None, custom_pattern: str | None = None) -> DataFrame:
    """A limit counts lines, in order of file and place (first byte of the split, then line), and is applied before
    ``since``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if limit is not None:
        lines = (lines.withColumn("_f", F.col("_metadata.file_path")).withColumn("_b", F.col("_metadata.file_block_start"))
                 .withColumn("_at", F.monotonically_increasing_id()).orderBy("_f", "_b", "_at").limit(limit).drop("_f", "_b", "_at"))
    return parse_entries(lines, fmt, source, custom_pattern, since)


def read_entry_list(entries: DataFrame, since: Column | None = None, limit: int | None = None,
                    line: str = "value", position: str = "position") -> DataFrame:
    """JSON entries of a list whose head is the newest; all of them, or the *last*
    ``limit`` positions, that is the oldest entries, are read, then filtered by time."""
    tail = entries if limit is None else entries.orderBy(F.desc(position)).limit(limit)
    e = tail.select(position, F.from_json(line, ENTRY, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("_e"))
    e = e.where("_e.timestamp is not null").select(position, "_e.*")
    return e if since is None else e.where(F.col("timestamp") >= since)


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources by time.  The global order is one range-partitioned sort."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.orderBy("timestamp")


def read_all_sources(readers: dict, folder: str | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the sources that can be opened *and read*, and the error text of the others.

    Each source is staged as a table of its own under ``folder`` first, so one that breaks while it is read (a cut-off
    archive, a lost server) leaves the others whole and adds nothing half.  Without a folder, tables go to the shared one
    and last as long as the session's JVM."""
    frames, errors = [], {}
    if folder is None:
        shared_folder(SparkSession.active())  # where it cannot be had, no source is to blame
    for i, (name, reader) in enumerate(readers.items()):
        try:
            df = reader()
            if folder is None:
                frames.append(stored(df))
                continue
            path = f"{folder.rstrip('/')}/source={i}"
            df.write.mode("overwrite").parquet(path)
            frames.append(df.sparkSession.read.schema(df.schema).parquet(path))
        except Exception as e:  # noqa: BLE001 - a failing source is counted and skipped
            errors[name] = str(e)
    return (union_sources(frames) if frames else None), errors


def read_threat_list(spark: SparkSession, path: str) -> DataFrame:
    """S10."""
    return clean_list(spark.read.text(path))


def clean_list(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.select(P.strip(F.col(col)).alias(col)).where(F.col(col) != "").distinct()


def import_samples(spark: SparkSession, path: str) -> DataFrame:
    """S17."""
    return spark.read.schema(
        "label string, timestamp timestamp, features map<string,double>, request_data map<string,string>").json(path)
