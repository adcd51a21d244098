"""Views of the driver's tables as run records, for testing: no feature of the engine.

``events`` becomes event streams: a run per user, in the order of time. ``orders`` and ``lineitem`` become event
streams (``streams``) and, without a fold, tables in the shape of the index (``index``): a run per order, a node per line
number, an attempt per row of a line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runfold.functions import rules
from runfold.schemas import state_class


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records of all runs: run_id, seq, offset_ns, kind, node, attempt, status, state, outcome, and some more."""
    e = table(spark, sf_dir, "events")
    user = Window.partitionBy("user_id")
    at, k, i, t = F.unix_micros(F.col("ts").cast("timestamp")), F.get_json_object("props", "$.k").cast("long"), F.col("event_id"), F.col("event_type")
    ends, finishes = (t == "view") & (i % 3 == 0), (t == "signup") & (i % 5 == 0)
    kind = F.when(ends, "node-terminal").when(finishes, "run-finished").when(t == "signup", "run-started").when(t == "view", "node-ready").when(t == "click", "attempt-started").otherwise("attempt-outcome")
    node = F.when(ends & (k >= 90), F.concat(F.lit("z"), k.cast("string"))).when(t != "signup", F.concat(F.lit("k"), (k % 8).cast("string")))
    out = e.select(
        F.col("user_id").cast("string").alias("run_id"), (F.row_number().over(user.orderBy("ts", "event_id")) - 1).cast("long").alias("seq"), ((at - F.min(at).over(user)) * 1000).alias("offset_ns"),
        kind.alias("kind"), node.alias("node"), F.when(kind.isin("attempt-started", "attempt-outcome"), 1 + i % 3).cast("int").alias("attempt"),
        F.when(t == "purchase", "succeeded").when(t == "error", F.when(i % 7 == 0, F.lit(None).cast("string")).otherwise("failed")).alias("status"), F.when(ends, F.when(i % 2 == 0, "skipped").otherwise("upstream-skipped")).alias("state"),
        F.when(finishes, F.when(i % 10 == 0, "failed").otherwise("succeeded")).alias("outcome"), F.when(t == "purchase", F.round(F.col("value") * 100).cast("long")).alias("slot_residency"),
        F.when(kind == "attempt-outcome", i % 4 == 0).alias("retained"), F.col("event_id"),
    )
    return out


#: The state that a line's flags stand for.
FLAGS = {"AF": "failed", "AO": "timed-out", "RF": "cancelled", "RO": "skipped", "NF": "upstream-failed"}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by order and line number."""
    li = table(spark, sf_dir, "lineitem")
    turn = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    flag = F.concat("l_returnflag", "l_linestatus")
    state = F.coalesce(*(F.when(flag == k, F.lit(v)) for k, v in FLAGS.items()), F.lit("succeeded"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("run_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("node_id"), F.row_number().over(turn).alias("try_number"), state.alias("state"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("executing"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("made"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("used"),
        F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"), F.col("l_shipdate"),
    )


def index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Index tables in the shape that the cookbook asks."""
    a = lines(spark, sf_dir)
    hash_ = F.concat(F.lit("h"), F.col("q").cast("string"))
    last = a.groupBy("run_id", "node_id").agg(F.max_by("state", "try_number").alias("state"))
    c: Column = state_class(F.col("state"))
    outcome = last.groupBy("run_id").agg(rules.run_outcome(F.count_if(c == "failure"), F.count_if(c == "stop")).alias("state"))
    dag = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("dag_id"))
    key = ["run_id", "node_id", F.col("try_number").alias("attempt")]
    produced = a.where("state = 'succeeded'").select(*key, F.col("made").alias("uri"), hash_.alias("content_hash"), F.col("executing").alias("size_bytes"), F.col("executing").alias("produced_at_offset_ns"))
    consumed = a.select(*key, F.col("used").alias("uri"), F.when(F.col("q") % 7 == 0, F.lit(None).cast("string")).when(F.col("q") % 5 == 0, "x").otherwise(hash_).alias("content_hash"))
    sent = a.select(*key, F.concat(F.lit("t"), F.col("tax").cast("string")).alias("target_name"), F.when(F.col("tax") > 2, F.lit("pod")).alias("observed_name"), F.lit(None).cast("string").alias("observed_host"), F.concat(F.lit("i"), F.col("tax").cast("string")).alias("image_digest"), F.lit("1.0").alias("tool_version"), F.when(F.col("tax") % 3 == 0, 0).otherwise(1).alias("completed"))
    inputs = a.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("position"), F.col("used").alias("uri"), hash_.alias("content_hash")), F.struct(F.lit(1).alias("position"), F.col("made").alias("uri"), F.lit("g").alias("content_hash")))).alias("i")).select("run_id", "node_id", "attempt", "i.*")
    return {
        "dag": dag.select("dag_id", F.col("dag_id").alias("name")).distinct(), "dag_run": outcome.join(dag, "run_id"), "node_terminal": last,
        "node_attempt": a.select("run_id", "node_id", "try_number", "state", F.to_json(F.struct("executing")).alias("phase_durations_json")),
        "output_produced": produced, "input_consumed": consumed, "asset": produced.select("uri").union(consumed.select("uri")).distinct(), "attempt_submitted": sent, "attempt_submitted_input": inputs,
    }


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records of all orders. Each attempt is submitted and started, and ends unless its tax is 0, 3 or 6 percent; a
    success gives an output. A run ends unless its order's status is P."""
    a = lines(spark, sf_dir)
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy("node_id", "try_number"))
    hash_ = F.concat(F.lit("h"), F.col("q").cast("string"))
    read = F.when(F.col("q") % 7 == 0, F.lit(None).cast("string")).when(F.col("q") % 5 == 0, "x").otherwise(hash_)
    ref = lambda uri, h: F.struct(F.col(uri).alias("uri"), h.alias("content_hash"))
    a = a.withColumn("turn", turn)
    at = F.col("turn").cast("long") * 10_000_000_000_000

    def event(step: int, kind: str, offset: Column, when: Column | None = None, **fields: Column) -> Column:
        types = {"status": "string", "inputs": "array<struct<uri:string,content_hash:string>>", "uri": "string", "content_hash": "string", "size_bytes": "long", "target_name": "string", "observed_name": "string", "image_digest": "string", "tool_version": "string"}
        made = F.struct((F.col("turn").cast("long") * 4 + step).alias("seq"), F.lit(kind).alias("kind"), offset.alias("offset_ns"), *(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))
        return made if when is None else F.when(when, made)

    ended = F.col("tax") % 3 != 0
    events = F.filter(
        F.array(
            event(0, "attempt-submitted", at, inputs=F.array(ref("used", hash_), ref("made", F.lit("g"))), target_name=F.concat(F.lit("t"), F.col("tax").cast("string")), observed_name=F.when(F.col("tax") > 2, "pod"), image_digest=F.concat(F.lit("i"), F.col("tax").cast("string")), tool_version=F.lit("1.0")),
            event(1, "attempt-started", at),
            event(2, "attempt-outcome", at + F.col("executing") * 1000, ended, status=F.col("state"), inputs=F.array(ref("used", read))),
            event(3, "output-produced", at + F.col("executing") * 1000, ended & (F.col("state") == "succeeded"), uri=F.col("made"), content_hash=hash_, size_bytes=F.col("executing")),
        ),
        lambda e: e.isNotNull(),
    )
    tried = a.select("run_id", F.col("node_id").alias("node"), F.col("try_number").alias("attempt"), F.explode(events).alias("e")).select("run_id", "node", "attempt", "e.*")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("status"))
    fingerprint = F.concat(F.lit("fnv1a-64:v1:"), F.upper(F.hex(F.col("c") % 350)))
    header = F.struct(F.col("run_id"), F.concat(F.lit("c"), (F.col("c") % 50).cast("string")).alias("pipeline"), fingerprint.alias("fingerprint_structural"), F.lit("p").alias("fingerprint_policy"), F.lit(1).cast("long").alias("fingerprint_algorithm_version"), F.lit("{}").alias("parameters"), F.lit(None).cast("struct<start:string,end:string>").alias("data_interval"), F.lit("{}").alias("captured_environment"), F.lit(None).cast("struct<run_id:string,parent_run_id:string,lineage_root_run_id:string>").alias("resume_lineage"))
    begun = o.select("run_id", F.lit(0).cast("long").alias("seq"), F.lit("run-started").alias("kind"), F.lit(0).cast("long").alias("offset_ns"), header.alias("header"))
    done = o.where("status <> 'P'").select("run_id", F.lit(1 << 40).alias("seq"), F.lit("run-finished").alias("kind"), F.lit(10**17).alias("offset_ns"), F.when(F.col("status") == "F", "failed").otherwise("succeeded").alias("outcome"))
    return tried.unionByName(begun, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)
