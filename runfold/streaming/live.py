"""Live runs: segments of event streams in, the index kept up to date by whole runs.

The file source reads a file once and does not tail one that grows, so live runs come as segment files, one per flush. A
micro-batch names the runs that changed; those are folded again from their own part of the log and merged. A batch that
runs twice gives the same index, and a finished live run the same rows as a later sync.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runfold.operators import fold
from runfold.operators.index import Index, project
from runfold.schemas import RECORD

#: Buckets of the log by run, and its rows: batch and bucket are folders.
BUCKETS = 64
LOGGED = T.StructType([*RECORD.fields, T.StructField("batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A stream of records from a folder of segment files of whole lines."""
    return spark.readStream.text(path).select(F.from_json("value", RECORD).alias("r")).select("r.*").where("run_id IS NOT NULL")


def into_index(stream: DataFrame, index: Index, log: str, checkpoint: str, *, every: str | None = None, failed: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Appends each batch to the log (a Parquet folder by batch) and folds the runs it touches into the index. Without
    ``every`` (such as ``500 milliseconds``) the query takes what is there and ends.
    ``failed`` is told of a batch that could not be applied."""

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int")
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{log}/batch={n}")
        logged = spark.read.schema(LOGGED).parquet(log)
        touched = logged.where(F.col("batch") == n).select("run_id", "_bucket").distinct().persist()
        try:
            buckets = [r._bucket for r in touched.select("_bucket").distinct().collect()]
            whole = logged.where(F.col("_bucket").isin(buckets)).drop("batch", "_bucket")  # of the log only these folders
            own = whole.join(touched.select("run_id"), "run_id", "left_semi").dropDuplicates(["run_id", "seq"])
            index.apply(project(own, live=True))
        except Exception as e:  # the query ends with it, and the batch is tried again when it is started anew
            if failed:
                failed(n, e)
            raise
        finally:
            touched.unpersist()

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def running(records: DataFrame) -> DataFrame:
    """Runs without a run-finished record."""
    return fold.runs(records).where("interrupted AND has_header").select("run_id", "last_offset_ns")


def follow(start: Callable[[], StreamingQuery], *, tries: int = 8, wait: Callable[[float], None] = time.sleep, report: Callable[[Exception], None] | None = None) -> int:
    """Keeps a query going: one that fails is reported and started anew from its checkpoint, in waits that double from 0.1 s,
    until it ends by itself or has failed ``tries`` times in a row without a batch between. How often it was started."""
    began = failed = 0
    while True:
        query = start()
        began += 1
        try:
            query.awaitTermination()
            return began
        except StreamingQueryException as e:
            failed = 1 if query.lastProgress and query.lastProgress.numInputRows else failed + 1
            if report:
                report(e)
            if failed >= tries:
                raise
            wait(0.1 * 2 ** (failed - 1))


WATCHED = "run_id string, state string, last_seq long, missing long, last_offset_ns long"


def watch(stream: DataFrame) -> DataFrame:
    """What is known of each run so far, by keyed state: ``running`` until its end comes, then its outcome; the last seq,
    and how many before it have not come. A row for each run that a batch touches; use it in update mode."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        outcome, last, seen, at = state.get if state.exists else (None, -1, 0, 0)
        for b in batches:
            ends = b[b["kind"] == "run-finished"].sort_values("seq")
            if len(ends) and outcome is None:
                outcome = ends["outcome"].iloc[0] or "succeeded"
            last, seen, at = max(last, int(b["seq"].max())), seen + b["seq"].nunique(), max(at, int(b["offset_ns"].max()))
        state.update((outcome, last, seen, at))
        yield pd.DataFrame([(key[0], outcome or "running", last, last + 1 - seen, at)], columns=["run_id", "state", "last_seq", "missing", "last_offset_ns"])

    rows = stream.select("run_id", "seq", "offset_ns", "kind", "outcome")
    return rows.groupBy("run_id").applyInPandasWithState(step, WATCHED, "outcome string, last long, seen long, at long", "update", GroupStateTimeout.NoTimeout)
