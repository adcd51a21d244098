"""Sharding: a uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

For input partitions of n_p rows and shards of exact sizes s_k, the driver draws how many rows go from each partition to
each shard (multivariate hypergeometric, so the outcome is as for a shuffle of all rows). Each task permutes its own
labels locally and streams its rows out under them, the rows are exchanged, and within each shard they are permuted
again by random numbers. The shard is cut into blocks by those numbers, of about ``block_bytes`` each, so that no task
sorts a whole shard; a block is a partition of the exchange, and where its slots begin is known from the seeds alone.

Everything random follows from the seed, the partition and the row's place in it, so a task that runs again after a lost
executor gives the same rows. That needs input whose partitions are the same each time, as a scan's are; a partition that
has more or fewer rows than were counted is an error. For other input set ``stable=False``, and the rows are written to
the shared folder first.

Sizes differ by one at most; an empty table gives empty shards. Null, empty or repeated rows are rows like others, very
long texts too. Columns of the input named ``shard`` or ``slot`` are replaced; ``_cell``, ``_at`` and ``_start`` are taken,
and an input that has them is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.llm._common import Tables, small_batches

SHARDS, BLOCK_BYTES = 16, 16 << 20
#: More blocks than this are not made; they grow instead, and a task that sorts one spills.
MOST_BLOCKS = 100_000


def sizes_of(rows: int, shards: int) -> np.ndarray:
    """Exact shard sizes, one apart at most."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows from each partition to each shard: the partitions' counts across, the shards' sizes down."""
    rng, left, out = np.random.default_rng([seed, 1]), sizes.astype(np.int64).copy(), np.zeros((len(counts), len(sizes)), np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def labels(row: np.ndarray, part: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A partition's shard labels in random order, and a random 62-bit number for each of its rows."""
    rng = np.random.default_rng([seed, 2, part])
    return rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row)), rng.integers(0, 2**62, int(row.sum()), dtype=np.int64)


def bytes_of(df: DataFrame) -> Column:
    """About how many bytes a row has."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema]
    return sum(sizes, F.lit(8)).cast("long")


def shuffle(df: DataFrame, shards: int = SHARDS, *, seed: int = 5, block_bytes: int = BLOCK_BYTES, stable: bool = True) -> DataFrame:
    """The rows of ``df`` with ``shard`` and ``slot``, gapless from 0 in each shard."""
    spark = df.sparkSession
    small_batches(df.sparkSession)
    df = df.drop("shard", "slot")
    if not stable:
        df = Tables(spark, "shards").keep(df, "rows")
    names = df.columns
    if taken := {"_cell", "_at", "_start"} & set(names):
        raise ValueError(f"columns {sorted(taken)} are taken")
    counted = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.sum(bytes_of(df)).alias("size")).collect()
    parts, size = {r.part: r.n for r in counted}, sum(r["size"] for r in counted)
    order = sorted(parts)
    total = sum(parts.values())
    drawn = dict(zip(order, matrix([parts[p] for p in order], sizes_of(total, shards), seed)))
    blocks = max(1, min(-(-size // (shards * block_bytes)), MOST_BLOCKS // shards))
    width = -(-(2**62) // blocks)
    known = spark.sparkContext.broadcast(drawn)  # shards numbers for each input partition

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                shard, at = labels(known.value[part], part, seed)
                u, n = np.unique(shard.astype(np.int64) * blocks + at // width, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    seeds = spark.createDataFrame([(p,) for p in order], "part int").repartition(max(1, len(order) // 16)) if order else spark.createDataFrame([], "part int")
    cells = np.zeros(shards * blocks, dtype=np.int64)
    for r in seeds.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one for each block
        cells[r.cell] = r.n
    starts = (np.cumsum(cells.reshape(shards, blocks), axis=1) - cells.reshape(shards, blocks)).ravel()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, mine = TaskContext.get().partitionId(), 0, None
        want = int(known.value[part].sum()) if part in known.value else 0
        for b in batches:
            if done + b.num_rows > want:
                raise RuntimeError(f"partition {part} has more rows than were counted: set stable=False")
            if b.num_rows:
                mine = mine or labels(known.value[part], part, seed)
                shard, at = (x[done : done + b.num_rows] for x in mine)
                done += b.num_rows
                cell = shard.astype(np.int64) * blocks + at // width
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32()), pa.array(cell, pa.int32()), pa.array(at, pa.int64()), pa.array(starts[cell], pa.int64())], names=[*names, "shard", "_cell", "_at", "_start"])
        if done < want:
            raise RuntimeError(f"partition {part} has {done} rows of {want} that were counted: set stable=False")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", shard int, _cell int, _at long, _start long"
    out = df.mapInArrow(label, schema).repartitionById(shards * blocks, F.col("_cell")).sortWithinPartitions("_at")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's place in its partition, a block
    return out.withColumn("slot", F.col("_start") + place).drop("_cell", "_at", "_start")


def digest(sharded: DataFrame) -> DataFrame:
    """Each row's place under the law ``rows``: shard sizes one apart at most."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
