"""The event-stream source: append-only JSON Lines under ``<base>/<pipeline>/<run>/events.jsonl``.

A file is read whole, because only then an unterminated last line (a crash in the middle of a write, tolerated) differs
from a terminated line that is no JSON (an error). Run files are small; at many runs the files are the parallelism.
"""

from __future__ import annotations

import json
import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.schemas import RECORD


PATTERN = "*/*/events.jsonl"


def discover(spark: SparkSession, base: str) -> list[str]:
    """All run files under ``base``, sorted; none if it doesn't exist."""
    return sorted(str(s.getPath()) for s in _glob(spark, base))


def count_files(spark: SparkSession, base: str) -> int:
    return len(_glob(spark, base))


def run_files(spark: SparkSession, base: str) -> str | list:
    """What ``read_lines`` takes for all run files under ``base``: the pattern itself, so that no list of files goes
    through the driver's Python; nothing if there is none."""
    return f"{base}/{PATTERN}" if len(_glob(spark, base)) else []


def _glob(spark: SparkSession, base: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{PATTERN}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, line, text, terminated) of every line that isn't blank. A file is one cell until it is split, 2 GB at most."""
    if not paths:
        return spark.createDataFrame([], "path string, line int, text string, terminated boolean")
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\n", -1).alias("lines"))
    lines = files.select("path", F.posexplode("lines").alias("line", "text"), F.size("lines").alias("n"))
    return lines.where(F.trim("text") != "").select("path", "line", "text", (F.col("line") < F.col("n") - 1).alias("terminated"))


def parse(lines: DataFrame) -> DataFrame:
    """The lines with ``rec``, and ``bad``: whether the text is no JSON object of the stream's types. One parse a line."""
    whole = F.from_json("text", T.StructType([*RECORD.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("_rec", whole)
    rec = F.struct(*(F.col(f"_rec.{f.name}").alias(f.name) for f in RECORD.fields))
    bad = F.col("_rec").isNull() | F.col("_rec._bad").isNotNull() | ~F.trim("text").endswith("}")
    return parsed.select("path", "line", "text", "terminated", rec.alias("rec"), bad.alias("bad"))


def records_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("NOT bad").select("path", "rec.*")


def status_of(parsed: DataFrame) -> DataFrame:
    """One row per file: records, trailing_partial (a tail was dropped), error_line (the first terminated line that is no
    JSON, 0-based) and reason: a bad file doesn't fail the job."""
    out = parsed.groupBy("path").agg(
        F.count_if(~F.col("bad")).alias("records"),
        F.coalesce(F.bool_or(F.col("bad") & ~F.col("terminated")), F.lit(False)).alias("trailing_partial"),
        F.min(F.when(F.col("bad") & F.col("terminated"), F.col("line"))).alias("error_line"),
        F.coalesce(F.bool_or(~F.col("bad") & (F.col("rec.kind") == "run-started")), F.lit(False)).alias("started"),
    )
    return out.withColumn("reason", F.when(F.col("error_line").isNotNull(), "corrupt record").when(~F.col("started"), "no run-started record"))


def read_records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """The records of all files, with ``path``; unterminated tails that aren't JSON are left out."""
    return records_of(parse(read_lines(spark, paths)))


def read_status(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return status_of(parse(read_lines(spark, paths)))


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Sink(Protocol):
    """Where lines of a stream go."""

    def append(self, line: str) -> None: ...

    def flush(self) -> None: ...


class FileSink:
    """A run file in a store, made durable at each flush."""

    def __init__(self, base: str, pipeline: str, run_id: str):
        os.makedirs(f"{base}/{pipeline}/{run_id}", exist_ok=True)
        self.path = f"{base}/{pipeline}/{run_id}/events.jsonl"
        self.out = open(self.path, "a", encoding="utf-8")

    def append(self, line: str) -> None:
        self.out.write(line + "\n")

    def flush(self) -> None:
        self.out.flush()
        os.fsync(self.out.fileno())


class TeeSink:
    """One stream to several sinks; a sink that fails gets no more lines, the first goes on."""

    def __init__(self, first: Sink, *others: Sink):
        self.first, self.others, self.faults = first, list(others), []

    def append(self, line: str) -> None:
        self.first.append(line)
        for sink in list(self.others):
            try:
                sink.append(line)
            except Exception as e:
                self.faults.append(e)
                self.others.remove(sink)

    def flush(self) -> None:
        for sink in (self.first, *self.others):
            sink.flush()


class IndexSink:
    """Lines of one run, folded into an index at each flush and after so many lines: the run is there while it goes on."""

    def __init__(self, spark: SparkSession, index, every: int = 1000):
        self.spark, self.index, self.every, self.lines, self.new = spark, index, every, [], 0

    def append(self, line: str) -> None:
        self.lines.append(line)
        self.new += 1
        if self.new >= self.every:
            self.flush()

    def flush(self) -> None:
        from runfold.operators.index import project

        if self.new:
            rows = self.spark.createDataFrame([(x,) for x in self.lines], "value string")  # one run: a few thousand lines
            self.index.apply(project(rows.select(F.from_json("value", RECORD).alias("r")).select("r.*"), live=True))
            self.new = 0


class EventWriter:
    """Writes one run's stream: gapless ``seq``, canonical lines, and after a fault nothing more."""

    VERSION = "event-stream@1"

    def __init__(self, sink: Sink, clock, run_id: str, pipeline: str, version: str = VERSION):
        self.sink, self.clock, self.run_id, self.pipeline, self.version = sink, clock, run_id, pipeline, version
        self.seq, self.fault = 0, None

    def emit(self, kind: str, **fields: object) -> None:
        if self.fault:
            raise self.fault
        record = {"schema_version": self.version, "run_id": self.run_id, "seq": self.seq, "offset_ns": self.clock(), "kind": kind}
        try:
            self.sink.append(canonical(record | {k: v for k, v in fields.items() if v is not None}))
        except Exception as e:
            self.fault = e
            raise
        self.seq += 1
        if kind == "run-finished":
            self.sink.flush()
