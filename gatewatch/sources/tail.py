"""Following log files as a stream.

``spark.readStream.format("tail")`` gives the lines that are added to the files of a pattern after the start.  The
offset is a length per file, so Spark's checkpoint is the saved position of each.  A file that is shorter than its
position has been rotated and is read from its beginning; what was added to the old one after the last batch is
lost, as for any reader that holds no handle.  A last line without line break waits until it is complete.

Files are opened by path in the tasks: the folder must be mounted where executors run (an agent tails its own machine
with a local master).  Long stretches are cut into splits of ``split`` bytes, each read by its own task.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, bytes bigint, value string"
BLOCK = 1 << 16


def complete_length(path: str) -> int:
    """Bytes up to and with the last line break; 0 for a file that is gone."""
    try:
        with open(path, "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end > 0:
                begin = max(0, end - BLOCK)
                f.seek(begin)
                found = f.read(end - begin).rfind(b"\n")
                if found >= 0:
                    return begin + found + 1
                end = begin
    except FileNotFoundError:
        pass
    return 0


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int, to: int):
        """Lines that begin in ``[start, end)``; the file counts up to ``to``."""
        self.path, self.start, self.end, self.to = path, start, end, to


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.at_end = options.get("start", "end").lower() == "end"
        self.split = int(options.get("split", 64 << 20))

    def _lengths(self) -> dict[str, int]:
        return {p: complete_length(p) for p in sorted(glob.glob(self.pattern))}

    def initialOffset(self) -> dict:
        return {"at": json.dumps(self._lengths() if self.at_end else {})}

    def latestOffset(self) -> dict:
        return {"at": json.dumps(self._lengths())}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        old, new = json.loads(start["at"]), json.loads(end["at"])
        out = []
        for path, to in new.items():
            a = old.get(path, 0)
            a = 0 if to < a else a  # rotated
            out += [Stretch(path, x, min(x + self.split, to), to) for x in range(a, to, self.split)]
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            if part.start:
                f.seek(part.start - 1)
                if f.read(1) != b"\n":  # the line that runs into this split belongs to the one before
                    f.readline()
            at = f.tell()
            while at < part.end:
                line = f.readline()
                if not line or at + len(line) > part.to:
                    return
                yield part.path, at, len(line), line.decode("utf-8", "ignore").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Options: ``path`` (a pattern), ``start`` (``end``, the default, or ``beginning``), ``split`` (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_files(spark: SparkSession, pattern: str, start: str = "end", split: int = 64 << 20) -> DataFrame:
    """Lines added to the files of ``pattern``: file, place, bytes and text (bytes that are no UTF-8 left out).
    Files that appear later are read from their beginning; blank lines count as bytes and are told by their text."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", pattern).option("start", start).option("split", split).load()


def read_counts(lines: DataFrame) -> DataFrame:
    """Lines that hold text, and their bytes without line breaks, per file."""
    kept = lines.where(F.trim("value") != "")
    return kept.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("value")).alias("bytes"))
