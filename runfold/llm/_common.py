"""Helpers that the training-data operators share: tables in the shared folder, words, row sources."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if all run
    on this machine, else an error: executors elsewhere would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="runfold-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Tables:
    """Parquet tables in the shared folder. They cut lineage and outlive executors; ``drop`` frees what is done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/runfold-{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Writes ``df`` and returns a reader of it."""
        path = f"{self.root}/{name}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*by) if by else out).parquet(path)
        self.spark.sparkContext._jvm.System.gc()  # Spark frees the shuffle files of plans that are garbage
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then cut at ASCII white space (x20, x09-x0D), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before; the memory is bounded."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python few at a time: at most so many rows and bytes in an Arrow batch, where the session has no
    settings of its own for it. These are the session's from then on."""
    own = spark._jsparkSession.sessionState().conf()
    for name, value in (("maxRecordsPerBatch", "512"), ("maxBytesPerBatch", str(8 << 20))):
        if not own.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def texts(batches: Iterator[pa.RecordBatch], step: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices of the Arrow batches, so that few whole texts are in Python at a time. What they took goes back to
    the system, as a worker lives on with other tasks."""
    pa.set_memory_pool(pa.system_memory_pool())
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def trim() -> None:
    """The allocator's free memory goes back to the system."""
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        give(0)


def keep_freed() -> None:
    """Until ``trim``, freed arrays below 32 MB stay with the process: else each one of a long row of equal ones asks the
    system for its pages anew."""
    if mallopt := getattr(ctypes.CDLL(None), "mallopt", None):  # of glibc
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def gives_back(run: Pass) -> Pass:
    """A pass after whose end the allocator's free memory goes back to the system too: an idle worker would keep it beside
    whatever comes after."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def sampled(rows: DataFrame, most: int, *by: str, seed: int = 0) -> DataFrame:
    """About ``most`` of the different rows, chosen by a hash of the columns ``by``: the same ones at each run. Equal
    rows are chosen together. All rows if there are no more than ``most``."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 40)) < F.lit(int((1 << 40) * most / n)))
