"""Questions across runs, over the index tables by name. Each takes the tables as DataFrames, so that any source of them
can be asked: a published index, a fold in memory, or other tables in their shape."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


def runs_per_dag_state(t: Tables) -> DataFrame:
    """How many runs of each pipeline ended how."""
    return t["dag_run"].join(t["dag"].select("dag_id", "name"), "dag_id").groupBy(F.col("name").alias("dag"), "state").agg(F.count("*").alias("runs"))


def slowest_nodes(t: Tables, most: int = 5) -> DataFrame:
    """The nodes with the longest executing phase; equal ones by name."""
    spent = F.get_json_object("phase_durations_json", "$.executing").cast("long")
    return t["node_attempt"].where(F.col("phase_durations_json").isNotNull()).groupBy("node_id").agg(F.max(spent).alias("exec_ns")).orderBy(F.desc("exec_ns"), "node_id").limit(most)


def latest_states(t: Tables) -> DataFrame:
    """The terminal state of every node in every run, with the pipeline's name."""
    return t["node_terminal"].join(t["dag_run"].select("run_id", "dag_id"), "run_id").join(t["dag"].select("dag_id", "name"), "dag_id").select(F.col("name").alias("dag"), "run_id", "node_id", "state")


def produced(t: Tables, uri: str) -> DataFrame:
    return t["output_produced"].where(F.col("uri") == uri).select("run_id", "node_id", "attempt", "content_hash", "size_bytes", "produced_at_offset_ns").orderBy("run_id", "node_id", "attempt")


def consumed(t: Tables, uri: str) -> DataFrame:
    return t["input_consumed"].where(F.col("uri") == uri).select("run_id", "node_id", "attempt", "content_hash").orderBy("run_id", "node_id", "attempt")


def asset_rollup(t: Tables) -> DataFrame:
    """For each dataset, how many runs produced and how many consumed it. Each side is counted before the join, which
    spares the product of the two."""
    p = t["output_produced"].groupBy("uri").agg(F.count_distinct("run_id").alias("p"))
    c = t["input_consumed"].groupBy("uri").agg(F.count_distinct("run_id").alias("c"))
    out = t["asset"].select("uri").join(p, "uri", "left").join(c, "uri", "left")
    return out.select("uri", F.coalesce("p", F.lit(0)).alias("produced_by_runs"), F.coalesce("c", F.lit(0)).alias("consumed_by_runs"))


def launch_inputs(t: Tables, node: str, attempt: int = 1) -> DataFrame:
    """What an attempt of a node was launched with, by position."""
    s = t["attempt_submitted"].where((F.col("node_id") == node) & (F.col("attempt") == attempt)).select("run_id", "node_id", "attempt", "image_digest", "tool_version")
    return s.join(t["attempt_submitted_input"], ["run_id", "node_id", "attempt"]).select("run_id", "position", "uri", "content_hash", "image_digest", "tool_version")


def launched(t: Tables) -> DataFrame:
    """Submitted attempts with what became of them."""
    s = t["attempt_submitted"].select("run_id", "node_id", "attempt", "target_name", "image_digest")
    a = t["node_attempt"].select("run_id", "node_id", F.col("try_number").alias("attempt"), "state")
    return s.join(a, ["run_id", "node_id", "attempt"])


def producers(t: Tables) -> DataFrame:
    """Each dataset's productions; datasets that nothing produced are left out."""
    return t["asset"].select("uri").join(t["output_produced"], "uri").select("uri", "run_id", "node_id", "attempt", "content_hash")


def sizes(t: Tables) -> DataFrame:
    """Scalar counts in one row: rows, known hashes, different datasets, and different (run, dataset) pairs with those of
    an unknown hash counted as well."""
    c = t["input_consumed"]
    return c.agg(F.count("*").alias("reads"), F.count("content_hash").alias("hashed"), F.count_distinct("uri").alias("datasets"), F.count_distinct("uri", "content_hash").alias("known_versions"), F.count_distinct(F.struct("uri", "content_hash")).alias("versions"))


def stranded(t: Tables) -> DataFrame:
    """Attempts that were submitted and never reported an outcome."""
    return t["attempt_submitted"].where("completed = 0").select("run_id", "node_id", "attempt", "target_name", "observed_name", "observed_host")


def divergence(t: Tables) -> DataFrame:
    """Attempts that read another content than they were submitted with; a missing hash differs from a given one."""
    s, c = t["attempt_submitted_input"], t["input_consumed"].withColumnRenamed("content_hash", "read_hash")
    both = s.join(c, ["run_id", "node_id", "attempt", "uri"]).where(~F.col("read_hash").eqNullSafe(F.col("content_hash")))
    return both.select("run_id", "node_id", "attempt", "position", "uri", F.col("content_hash").alias("submitted_hash"), "read_hash")


def launched_against(t: Tables, uri: str) -> DataFrame:
    """Attempts launched against a dataset: how many runs produced it, and whether the attempt's own run consumed it."""
    s = t["attempt_submitted_input"].where(F.col("uri") == uri).select("run_id", "node_id", "attempt", "position").distinct()
    n = t["output_produced"].where(F.col("uri") == uri).agg(F.count_distinct("run_id").alias("produced_by_runs"))
    c = t["input_consumed"].where(F.col("uri") == uri).select("run_id").distinct().withColumn("consumed_by_runs", F.lit(1).cast("long"))
    return s.join(c, "run_id", "left").join(F.broadcast(n)).select("run_id", "node_id", "attempt", "position", "produced_by_runs", F.coalesce("consumed_by_runs", F.lit(0)).alias("consumed_by_runs"))


ALL: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (runs_per_dag_state, slowest_nodes, latest_states, produced, consumed, asset_rollup, launch_inputs, launched, producers, sizes, stranded, divergence, launched_against)}
