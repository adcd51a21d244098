"""The queries over the driver's tables, with DuckDB SQL that gives the same rows, written for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.functions import rules
from runfold.operators import fold, index, propagation, simulate
from runfold.plans import adapters, cookbook, graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENTS = """
WITH base AS (
  SELECT event_id AS i, event_type AS t, value AS v, cast(user_id AS varchar) AS run_id, cast(json_extract_string(props, '$.k') AS bigint) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) * 1000 AS off FROM events),
rec AS (
  SELECT *, CASE WHEN t = 'view' AND i % 3 = 0 THEN 'node-terminal' WHEN t = 'signup' AND i % 5 = 0 THEN 'run-finished' WHEN t = 'signup' THEN 'run-started'
    WHEN t = 'view' THEN 'node-ready' WHEN t = 'click' THEN 'attempt-started' ELSE 'attempt-outcome' END AS kind,
    CASE WHEN t = 'view' AND i % 3 = 0 AND k >= 90 THEN 'z' || k WHEN t <> 'signup' THEN 'k' || (k % 8) END AS node, cast(1 + i % 3 AS int) AS attempt,
    CASE WHEN t = 'purchase' THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN i % 2 = 0 THEN 'skipped' ELSE 'upstream-skipped' END AS state FROM base),
anchored AS (
  SELECT *, last_value(CASE WHEN kind = 'node-ready' THEN off END IGNORE NULLS) OVER w AS ready, last_value(CASE WHEN kind = 'attempt-started' THEN off END IGNORE NULLS) OVER w AS begun,
    last_value(CASE WHEN kind = 'attempt-outcome' THEN off END IGNORE NULLS) OVER w AS prev
  FROM rec WHERE node IS NOT NULL WINDOW w AS (PARTITION BY run_id, node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, least(coalesce(begun, off), off) AS start FROM anchored WHERE kind = 'attempt-outcome'),
waited AS (SELECT *, off - start AS total, CASE WHEN ready > start AND ready <= off THEN ready - start ELSE 0 END AS rw,
    CASE WHEN attempt > 1 AND prev > start AND prev <= off THEN prev - start ELSE 0 END AS bo FROM cut),
tried AS (SELECT run_id, node, seq, attempt, status, off, total, rw, least(bo, total - rw) AS bo, total - rw - least(bo, total - rw) AS ex FROM waited),
never AS (SELECT run_id, node, arg_max(state, seq) AS state FROM rec r WHERE kind = 'node-terminal' AND NOT EXISTS (SELECT 1 FROM tried x WHERE x.run_id = r.run_id AND x.node = r.node) GROUP BY run_id, node)
"""

LINES = """
WITH att AS (
  SELECT cast(l_orderkey AS varchar) AS run_id, 'n' || l_linenumber AS node_id,
    cast(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS int) AS attempt,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'failed' WHEN 'AO' THEN 'timed-out' WHEN 'RF' THEN 'cancelled' WHEN 'RO' THEN 'skipped' WHEN 'NF' THEN 'upstream-failed' ELSE 'succeeded' END AS state,
    cast(round(l_extendedprice * 100) AS bigint) AS spent, 'p' || l_partkey AS made, 's' || l_suppkey AS used, cast(l_quantity AS int) AS q, cast(round(l_tax * 100) AS int) AS tax, l_shipdate FROM lineitem),
term AS (SELECT run_id, node_id, arg_max(state, attempt) AS state FROM att GROUP BY run_id, node_id),
run AS (SELECT run_id, CASE WHEN bool_or(state IN ('failed', 'timed-out', 'abandoned', 'upstream-failed')) THEN 'failed' WHEN bool_or(state = 'cancelled') THEN 'cancelled' ELSE 'succeeded' END AS state FROM term GROUP BY run_id),
dag AS (SELECT cast(o_orderkey AS varchar) AS run_id, 'c' || (o_custkey % 50) AS dag FROM orders),
produced AS (SELECT run_id, node_id, attempt, made AS uri, 'h' || q AS content_hash, spent FROM att WHERE state = 'succeeded'),
consumed AS (SELECT run_id, node_id, attempt, used AS uri, CASE WHEN q % 7 = 0 THEN NULL WHEN q % 5 = 0 THEN 'x' ELSE 'h' || q END AS content_hash FROM att),
sent AS (SELECT run_id, node_id, attempt, 0 AS position, used AS uri, 'h' || q AS content_hash FROM att UNION ALL SELECT run_id, node_id, attempt, 1, made, 'g' FROM att)
"""


def query(sql: str, head: str = ""):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, head + sql
        return f

    return add


# ---- over event streams -------------------------------------------------------------------------------------------


@query("SELECT run_id, node, attempt, status, rw AS ready_wait_ns, bo AS backoff_ns, ex AS executing_ns, total AS total_ns FROM tried", EVENTS)
def attempt_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt's time by phase."""
    return fold.outcomes(adapters.records(spark, sf_dir)).select("run_id", "node", "attempt", "status", "ready_wait_ns", "backoff_ns", "executing_ns", "total_ns")


@query("SELECT run_id, node, state FROM never", EVENTS)
def never_ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that only have a terminal record."""
    return fold.attempts(adapters.records(spark, sf_dir)).where("origin = 'terminal'").select("run_id", "node", F.col("status").alias("state"))


@query("""SELECT run_id, count(*) FILTER (kind = 'run-started') > 0 AS has_header, coalesce(arg_min(CASE WHEN i % 10 = 0 THEN 'failed' ELSE 'succeeded' END, seq) FILTER (kind = 'run-finished'), 'cancelled') AS outcome,
  count(*) FILTER (kind = 'run-finished') = 0 AS interrupted, max(off) AS last_offset_ns FROM rec GROUP BY run_id""", EVENTS)  # fmt: skip
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, outcome and interruption of each run."""
    return fold.runs(adapters.records(spark, sf_dir)).select("run_id", "has_header", "outcome", "interrupted", "last_offset_ns")


@query("""SELECT run_id, max(off) AS total_elapsed_ns, coalesce(max(CASE WHEN t = 'purchase' THEN cast(round(v * 100) AS bigint) END), 0) AS peak_slot_residency,
  coalesce((SELECT string_agg(node, ',' ORDER BY node) FROM (SELECT node, arg_max(i % 4 = 0, seq) AS kept FROM rec x WHERE x.run_id = rec.run_id AND kind = 'attempt-outcome' GROUP BY node) WHERE kept), '') AS retained FROM rec GROUP BY run_id""", EVENTS)  # fmt: skip
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's summary."""
    return fold.summaries(adapters.records(spark, sf_dir)).select("run_id", "total_elapsed_ns", "peak_slot_residency", F.array_join("retained_values", ",").alias("retained"))


@query(""", vert AS (
  SELECT run_id, node, coalesce(min(CASE WHEN kind = 'node-ready' THEN off END), greatest(max(t_at), max(o_at)), 0) AS ready, greatest(max(t_at), max(o_at)) AS ended
  FROM (SELECT *, max(off) FILTER (kind = 'attempt-outcome' AND seq > coalesce(t_seq, -1)) OVER (PARTITION BY run_id, node) AS o_at
    FROM (SELECT *, max(seq) FILTER (kind = 'node-terminal') OVER (PARTITION BY run_id, node) AS t_seq, arg_max(off, seq) FILTER (kind = 'node-terminal') OVER (PARTITION BY run_id, node) AS t_at
      FROM rec WHERE node IS NOT NULL AND kind IN ('node-ready', 'node-terminal', 'attempt-outcome')))
  GROUP BY run_id, node),
spent AS (SELECT run_id, node, sum(ex)::BIGINT AS c FROM tried GROUP BY run_id, node),
placed AS (SELECT run_id, ready, ended, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY run_id ORDER BY ready, node) AS n FROM vert LEFT JOIN spent USING (run_id, node)),
walk AS (
  SELECT run_id, 0::BIGINT AS n, []::STRUCT(e BIGINT, p BIGINT)[] AS seen FROM (SELECT DISTINCT run_id FROM placed)
  UNION ALL
  SELECT w.run_id, w.n + 1, list_append(w.seen, {'e': v.ended, 'p': v.c + coalesce(list_max([x.p for x in w.seen if x.e <= v.ready]), 0)}) FROM walk w JOIN placed v ON v.run_id = w.run_id AND v.n = w.n + 1)
SELECT run_id, list_max([x.p for x in arg_max(seen, n)]) AS critical_path_ns FROM walk GROUP BY run_id""", EVENTS.replace("WITH base", "WITH RECURSIVE base", 1))  # fmt: skip
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chain of executing times by what had ended when."""
    return fold.critical_paths(adapters.records(spark, sf_dir))


@query("SELECT run_id, seq, before FROM (SELECT run_id, i AS seq, lag(i) OVER (PARTITION BY run_id ORDER BY i) AS before FROM rec) WHERE coalesce(seq - before, seq + 1) <> 1", EVENTS)
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where records are missing. The events' ids, which users share, are taken for the users' numbering."""
    return fold.sequence_gaps(adapters.records(spark, sf_dir).withColumn("seq", F.col("event_id")))


# ---- over index tables --------------------------------------------------------------------------------------------


@query("SELECT dag, state, count(*) AS runs FROM run JOIN dag USING (run_id) GROUP BY dag, state", LINES)
def runs_per_dag_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, A1."""
    return cookbook.runs_per_dag_state(adapters.index(spark, sf_dir))


@query("SELECT node_id, max(spent) AS exec_ns FROM att GROUP BY node_id ORDER BY exec_ns DESC, node_id LIMIT 5", LINES)
def slowest_nodes_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, O2, P5, P6."""
    return cookbook.slowest_nodes(adapters.index(spark, sf_dir))


@query("SELECT dag, term.run_id, node_id, state FROM term JOIN dag USING (run_id)", LINES)
def latest_state_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, W3."""
    return cookbook.latest_states(adapters.index(spark, sf_dir))


@query("SELECT run_id, node_id, state FROM (SELECT *, row_number() OVER (PARTITION BY run_id, node_id ORDER BY attempt DESC) AS k FROM att) WHERE k = 1", LINES)
def node_terminal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last attempt's state of every node, in the adapter's tables."""
    return adapters.index(spark, sf_dir)["node_terminal"]


@query("SELECT run_id, node_id, attempt, content_hash, spent AS size_bytes, spent AS produced_at_offset_ns FROM produced WHERE uri = 'p7'", LINES)
def lineage_produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, O1 (the rows come ordered)."""
    return cookbook.produced(adapters.index(spark, sf_dir), "p7")


@query("SELECT run_id, node_id, attempt, content_hash FROM consumed WHERE uri = 's7'", LINES)
def lineage_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2."""
    return cookbook.consumed(adapters.index(spark, sf_dir), "s7")


@query("SELECT a.uri, count(DISTINCT p.run_id) AS produced_by_runs, (SELECT count(DISTINCT c.run_id) FROM consumed c WHERE c.uri = a.uri) AS consumed_by_runs FROM (SELECT uri FROM produced UNION SELECT uri FROM consumed) a LEFT JOIN produced p USING (uri) GROUP BY a.uri", LINES)
def asset_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, A3."""
    return cookbook.asset_rollup(adapters.index(spark, sf_dir))


@query("SELECT run_id, position, uri, content_hash, 'i' || tax AS image_digest, '1.0' AS tool_version FROM sent JOIN att USING (run_id, node_id, attempt) WHERE node_id = 'n3' AND attempt = 1", LINES)
def launch_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    return cookbook.launch_inputs(adapters.index(spark, sf_dir), "n3")


@query("SELECT run_id, node_id, attempt, 't' || tax AS target_name, CASE WHEN tax > 2 THEN 'pod' END AS observed_name, cast(NULL AS varchar) AS observed_host FROM att WHERE tax % 3 = 0", LINES)
def stranded_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    return cookbook.stranded(adapters.index(spark, sf_dir))


@query("SELECT s.run_id, s.node_id, s.attempt, s.position, s.uri, s.content_hash AS submitted_hash, c.content_hash AS read_hash FROM sent s JOIN consumed c USING (run_id, node_id, attempt, uri) WHERE c.content_hash IS DISTINCT FROM s.content_hash", LINES)
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, P4."""
    return cookbook.divergence(adapters.index(spark, sf_dir))


@query("SELECT s.run_id, s.node_id, s.attempt, s.position, count(DISTINCT p.run_id) AS produced_by_runs, count(DISTINCT c.run_id) AS consumed_by_runs FROM sent s LEFT JOIN produced p ON p.uri = s.uri LEFT JOIN consumed c ON c.uri = s.uri AND c.run_id = s.run_id WHERE s.uri = 'p7' GROUP BY ALL", LINES)
def launched_against_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return cookbook.launched_against(adapters.index(spark, sf_dir), "p7")


@query("SELECT run_id, state AS outcome, CASE WHEN bad > 0 THEN 1 WHEN state = 'cancelled' THEN 5 ELSE 0 END AS exit_code FROM run JOIN (SELECT run_id, count(*) FILTER (state IN ('failed', 'timed-out')) AS bad FROM term GROUP BY run_id) USING (run_id)", LINES)
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, G11."""
    t = adapters.index(spark, sf_dir)
    bad = t["node_terminal"].groupBy("run_id").agg(F.count_if(F.col("state").isin("failed", "timed-out")).alias("bad"))
    return t["dag_run"].join(bad, "run_id").select("run_id", F.col("state").alias("outcome"), rules.exit_code(F.col("state"), F.col("bad")).alias("exit_code"))


@query(""", cls AS (SELECT run_id, node_id, cast(substr(node_id, 2) AS int) AS k, CASE WHEN state = 'succeeded' THEN 's' WHEN state = 'skipped' THEN 'k' WHEN state = 'cancelled' THEN 'c' ELSE 'f' END AS c FROM term),
sums AS (SELECT d.run_id, d.node_id, d.k % 3 AS rule, count(u.c) AS n, count(*) FILTER (u.c = 's') AS s, count(*) FILTER (u.c = 'k') AS k, count(*) FILTER (u.c = 'c') AS c, count(*) FILTER (u.c = 'f') AS f FROM cls d LEFT JOIN cls u ON u.run_id = d.run_id AND u.k < d.k GROUP BY ALL)
SELECT run_id, node_id, CASE WHEN rule = 1 THEN 'run' WHEN rule = 2 THEN CASE WHEN f > 0 THEN 'run' ELSE 'skipped' END WHEN s = n THEN 'run' WHEN s + k = n THEN 'upstream-skipped' WHEN s + c = n THEN 'cancelled' ELSE 'upstream-failed' END AS decision FROM sums""", LINES)  # fmt: skip
def trigger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each node's rule says after the nodes before it in its order."""
    t = adapters.index(spark, sf_dir)["node_terminal"]
    k = F.substring("node_id", 2, 9).cast("int")
    rule = F.when(k % 3 == 1, "all-terminal").when(k % 3 == 2, "any-failed").otherwise("all-succeeded")
    nodes = t.select("run_id", F.col("node_id").alias("node"), rule.alias("rule"), k.alias("k"))
    edges = nodes.select("run_id", F.col("node").alias("consumer"), "k").join(nodes.select("run_id", F.col("node").alias("producer"), F.col("k").alias("j")), "run_id").where("j < k")
    states = t.select("run_id", F.col("node_id").alias("node"), "state")
    return propagation.decisions(edges, states, nodes).select("run_id", F.col("node").alias("node_id"), "decision")


@query(" SELECT node, sum(o)::BIGINT AS consumers, sum(i)::BIGINT AS remaining FROM (SELECT used AS node, count(*) AS o, 0 AS i FROM att GROUP BY 1 UNION ALL SELECT made, 0, count(DISTINCT used) FROM att GROUP BY 1) GROUP BY node", LINES)
def consumer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges out of every dataset, repeated ones counted, and the different ones into it."""
    edge = adapters.lines(spark, sf_dir).select(F.col("used").alias("producer"), F.col("made").alias("consumer"))
    out = edge.groupBy(F.col("producer").alias("node")).agg(F.count("*").alias("o")).withColumn("i", F.lit(0).cast("long"))
    into = edge.distinct().groupBy(F.col("consumer").alias("node")).agg(F.lit(0).cast("long").alias("o"), F.count("*").alias("i"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("consumers"), F.sum("i").alias("remaining"))


@query(""", snap AS (SELECT made AS node, used AS source, l_shipdate < TIMESTAMP '1995-01-01' AS old FROM att),
a AS (SELECT node, min(source) AS s FROM snap WHERE old GROUP BY node), b AS (SELECT node, min(source) AS s FROM snap WHERE NOT old GROUP BY node)
SELECT coalesce(a.node, b.node) AS node, CASE WHEN a.node IS NULL THEN 'added' WHEN b.node IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.node = b.node WHERE a.node IS NULL OR b.node IS NULL OR a.s <> b.s""", LINES)  # fmt: skip
def structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of producers, before and from 1995."""
    a = adapters.lines(spark, sf_dir).select(F.col("made").alias("node"), F.col("used").alias("source"), (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("old"))
    snap = lambda old: a.where(F.col("old") == old).groupBy("node").agg(F.min("source").alias("source"))
    return graph.difference(snap(True), snap(False), ["node"])


@query(" SELECT DISTINCT uri AS key FROM produced WHERE uri NOT IN (SELECT made FROM att WHERE q > 40)", LINES)
def blob_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nothing kept refers to."""
    held = adapters.index(spark, sf_dir)["output_produced"].select(F.col("uri").alias("key")).distinct()
    return graph.unreachable(held, adapters.lines(spark, sf_dir).where("q > 40").select(F.col("made").alias("key")))


@query("SELECT 'p' || p_partkey AS node, pool, demand, capacity FROM (SELECT p_partkey, 'memory' AS pool, cast(round(p_retailprice) AS bigint) AS demand, cast(1500 AS bigint) AS capacity FROM part UNION ALL SELECT p_partkey, 'compute', cast(p_size AS bigint), 40 FROM part) WHERE demand > capacity")
def capacity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that ask for more of a pool than there is."""
    part = adapters.table(spark, sf_dir, "part")
    demands = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.round("p_retailprice").cast("long").alias("memory"), F.col("p_size").cast("long").alias("compute"))
    return graph.capacity_violations(demands, {"memory": 1500, "compute": 40})


@query("SELECT l_orderkey AS run, l_linenumber AS n, count(*) AS k, cast(round(least(100 * power(2.0, l_linenumber), 2500)) AS bigint) AS wait_ms FROM lineitem GROUP BY ALL")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nominal wait before each retry."""
    li = adapters.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("n")).agg(F.count("*").alias("k"))
    wait = rules.backoff_ms(F.col("n"), F.lit(100.0), F.lit(2.0), F.lit(2500.0))
    return li.select("run", "n", "k", F.round(wait).cast("long").alias("wait_ms"))


# ---- over the fold of whole event streams, merged into an index that had seen them earlier --------------------------------

FOLDED = LINES + """,
ran AS (SELECT cast(o_orderkey AS varchar) AS run_id, o_custkey AS c, 'c' || (o_custkey % 50) AS dag, 'fnv1a-64:v1:' || upper(printf('%x', o_custkey % 350)) AS print, o_orderstatus AS status FROM orders),
turn AS (SELECT att.*, row_number() OVER (PARTITION BY run_id ORDER BY node_id, attempt) AS turn, tax % 3 <> 0 AS ended FROM att JOIN ran USING (run_id)),
whole AS (SELECT * FROM turn WHERE ended)
"""


def merged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ten tables of an index that took the runs while none had ended, and then as they are."""
    now = adapters.streams(spark, sf_dir)
    then = index.project(now.where("kind <> 'run-finished' AND (kind <> 'attempt-outcome' OR status <> 'succeeded')"), live=True)
    return {name: index.merge(then[name], rows, name) for name, rows in index.project(now).items()}


@query(" SELECT DISTINCT dag AS dag_id, dag AS name FROM ran", FOLDED)
def index_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, F2."""
    return merged(spark, sf_dir)["dag"].select("dag_id", "name")


@query(" SELECT DISTINCT dag || '@' || print AS dag_version_id, dag AS dag_id, print AS structural_fingerprint FROM ran", FOLDED)
def index_dag_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    return merged(spark, sf_dir)["dag_version"].select("dag_version_id", "dag_id", "structural_fingerprint")


@query(""" SELECT run_id, dag AS dag_id, dag || '@' || print AS dag_version_id, CASE status WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS state, cast(status = 'P' AS int) AS interrupted,
  CASE WHEN status <> 'P' THEN 100000000000 ELSE coalesce(ms, 0) END AS finished_ms FROM ran LEFT JOIN (SELECT run_id, max((turn * 10000000000000 + CASE WHEN ended THEN spent * 1000 ELSE 0 END) // 1000000) AS ms FROM turn GROUP BY run_id) USING (run_id)""", FOLDED)  # fmt: skip
def index_dag_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that was live is replaced."""
    return merged(spark, sf_dir)["dag_run"].select("run_id", "dag_id", "dag_version_id", "state", "interrupted", "finished_ms")


@query(" SELECT run_id, node_id, attempt AS try_number, state, spent // 1000 AS finished_ms, spent * 1000 AS executing FROM whole", FOLDED)
def index_node_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M12, P6."""
    spent = F.get_json_object("phase_durations_json", "$.executing").cast("long")
    return merged(spark, sf_dir)["node_attempt"].select("run_id", "node_id", "try_number", "state", "finished_ms", spent.alias("executing"))


@query(" SELECT run_id, node_id, arg_max(state, attempt) AS state FROM whole GROUP BY run_id, node_id", FOLDED)
def index_node_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5."""
    return merged(spark, sf_dir)["node_terminal"].select("run_id", "node_id", "state")


@query(" SELECT run_id, node_id, attempt, made AS uri, 'h' || q AS content_hash, spent AS size_bytes, turn * 10000000000000 + spent * 1000 AS produced_at_offset_ns, run_id AS originating_run FROM whole WHERE state = 'succeeded'", FOLDED)
def index_output_produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6, F9."""
    return merged(spark, sf_dir)["output_produced"].select("run_id", "node_id", "attempt", "uri", "content_hash", "size_bytes", "produced_at_offset_ns", "originating_run")


@query(" SELECT run_id, node_id, attempt, used AS uri, CASE WHEN q % 7 = 0 THEN NULL WHEN q % 5 = 0 THEN 'x' ELSE 'h' || q END AS content_hash FROM whole", FOLDED)
def index_input_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null hashes are one value of the key."""
    return merged(spark, sf_dir)["input_consumed"]


@query(" SELECT used AS uri FROM whole UNION SELECT made FROM whole WHERE state = 'succeeded'", FOLDED)
def index_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    return merged(spark, sf_dir)["asset"].select("uri")


@query(" SELECT run_id, node_id, attempt, 't' || tax AS target_name, CASE WHEN tax > 2 THEN 'pod' END AS observed_name, 2 AS input_count, turn * 10000000000000 AS submitted_at_offset_ns, cast(ended AS int) AS completed, CASE WHEN ended THEN state END AS outcome_state FROM turn", FOLDED)
def index_attempt_submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9, F10."""
    return merged(spark, sf_dir)["attempt_submitted"].select("run_id", "node_id", "attempt", "target_name", "observed_name", "input_count", "submitted_at_offset_ns", "completed", "outcome_state")


@query(" SELECT run_id, node_id, attempt, 0 AS position, used AS uri, 'h' || q AS content_hash FROM turn UNION ALL SELECT run_id, node_id, attempt, 1, made, 'g' FROM turn", FOLDED)
def index_attempt_submitted_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, W5."""
    return merged(spark, sf_dir)["attempt_submitted_input"]


@query(" SELECT run_id, node_id, attempt, 't' || tax AS target_name, 'i' || tax AS image_digest, state FROM whole", FOLDED)
def launched_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with the attempts that came of them."""
    return cookbook.launched(index.project(adapters.streams(spark, sf_dir)))


@query(" SELECT made AS uri, run_id, node_id, attempt, 'h' || q AS content_hash FROM whole WHERE state = 'succeeded'", FOLDED)
def asset_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8."""
    return cookbook.producers(index.project(adapters.streams(spark, sf_dir)))


@query("""SELECT count(*) AS reads, count(content_hash) AS hashed, count(DISTINCT uri) AS datasets, count(DISTINCT CASE WHEN content_hash IS NOT NULL THEN uri || ' ' || content_hash END) AS known_versions,
  count(DISTINCT uri || ' ' || coalesce(content_hash, '')) AS versions FROM consumed""", LINES)  # fmt: skip
def input_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5."""
    return cookbook.sizes(adapters.index(spark, sf_dir))


@query(" SELECT run_id, dag AS pipeline, printf('%x', c % 350) AS digits FROM ran", FOLDED)
def runs_of_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their graphs, whose fingerprints are spelled otherwise."""
    runs = fold.runs(adapters.streams(spark, sf_dir)).select("run_id", F.col("header.fingerprint_structural").alias("fingerprint"), F.col("header.pipeline").alias("own"))
    c = F.col("o_custkey")
    graphs = adapters.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (c % 50).cast("string")).alias("pipeline"), F.lower(F.hex(c % 350)).alias("fingerprint")).distinct()
    return index.runs_of_graphs(runs, graphs).select("run_id", "pipeline", "digits")


@query("""SELECT run_id, greatest(max(held), 0)::BIGINT AS peak_bytes FROM (SELECT run_id, sum(delta) OVER (PARTITION BY run_id ORDER BY t, fills) AS held
  FROM (SELECT run_id, t, delta > 0 AS fills, sum(delta) AS delta FROM (SELECT run_id, epoch_us(l_shipdate) AS t, spent AS delta FROM att UNION ALL SELECT run_id, epoch_us(l_shipdate) + q * 86400000000, -spent FROM att WHERE q % 9 <> 0) GROUP BY ALL)) GROUP BY run_id""", LINES)  # fmt: skip
def peak_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that a run's outputs held at one time; some stay to the end."""
    at = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    a = adapters.lines(spark, sf_dir)
    return simulate.peak_residency(a.select("run_id", at.alias("filled_ns"), F.when(F.col("q") % 9 != 0, at + F.col("q").cast("long") * 86_400_000_000).alias("released_ns"), F.col("executing").alias("bytes")))


CHAIN = """,
chain AS (SELECT run_id, node_id, state, cast(substr(node_id, 2) AS int) AS k, row_number() OVER (PARTITION BY run_id ORDER BY node_id) AS r FROM term),
walk AS (
  SELECT run_id, 0::BIGINT AS r, []::VARCHAR[] AS seen FROM (SELECT DISTINCT run_id FROM chain)
  UNION ALL
  SELECT w.run_id, w.r + 1, list_append(w.seen, CASE WHEN d = 'run' THEN state ELSE d END)
  FROM (SELECT w.run_id, w.r, w.seen, c.state, CASE WHEN c.k % 3 = 1 THEN 'run'
      WHEN c.k % 3 = 2 THEN CASE WHEN len(list_filter(w.seen[-2:], lambda x: x IN ('failed', 'timed-out', 'upstream-failed'))) > 0 THEN 'run' ELSE 'skipped' END
      WHEN len(list_filter(w.seen[-2:], lambda x: x <> 'succeeded')) = 0 THEN 'run'
      WHEN len(list_filter(w.seen[-2:], lambda x: x NOT IN ('succeeded', 'skipped', 'upstream-skipped'))) = 0 THEN 'upstream-skipped'
      WHEN len(list_filter(w.seen[-2:], lambda x: x NOT IN ('succeeded', 'cancelled'))) = 0 THEN 'cancelled' ELSE 'upstream-failed' END AS d
    FROM walk w JOIN chain c ON c.run_id = w.run_id AND c.r = w.r + 1) w)
SELECT c.run_id, c.node_id, w.seen[c.r] AS state FROM chain c JOIN (SELECT run_id, arg_max(seen, r) AS seen FROM walk GROUP BY run_id) w ON w.run_id = c.run_id"""


def chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each order's nodes by number (``r``), and edges: a node reads from the one before it and comes after the one before
    that."""
    from pyspark.sql import Window

    k = F.substring("node_id", 2, 9).cast("int")
    nodes = adapters.index(spark, sf_dir)["node_terminal"].select("run_id", F.col("node_id").alias("node"), "state", k.alias("k"), F.row_number().over(Window.partitionBy("run_id").orderBy("node_id")).alias("r"))
    by = Window.partitionBy("run_id").orderBy("r")
    before = nodes.withColumns({"one": F.lag("node", 1).over(by), "two": F.lag("node", 2).over(by)})
    near = before.select("run_id", F.col("node").alias("consumer"), F.explode(F.array(F.struct(F.col("one").alias("producer"), F.lit("data").alias("kind")), F.struct(F.col("two").alias("producer"), F.lit("ordering").alias("kind")))).alias("e"))
    return nodes, near.select("run_id", "consumer", "e.*").where("producer IS NOT NULL")


@query(CHAIN, LINES.replace("WITH att", "WITH RECURSIVE att", 1))
def state_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's state when each depends on the two before it."""
    nodes, edges = chains(spark, sf_dir)
    rule = F.when(F.col("k") % 3 == 1, "all-terminal").when(F.col("k") % 3 == 2, "any-failed").otherwise("all-succeeded")
    out = propagation.propagate(nodes.withColumn("rule", rule), edges, nodes)
    return out.select("run_id", F.col("node").alias("node_id"), "state")


@query(""",
chain AS (SELECT run_id, node_id, state, cast(substr(node_id, 2) AS int) AS k, row_number() OVER (PARTITION BY run_id ORDER BY node_id) AS r FROM term),
seed AS (SELECT run_id, min(r) AS f FROM chain WHERE state <> 'succeeded' GROUP BY run_id),
held AS (SELECT c.run_id, max(c.r) AS d FROM chain c JOIN seed s ON s.run_id = c.run_id WHERE c.r < s.f AND c.k % 2 = 0 GROUP BY c.run_id)
SELECT run_id, node_id, CASE WHEN f IS NOT NULL AND r > coalesce(d, 0) THEN 'run' ELSE 'satisfied-from-prior' END AS decision, state <> 'succeeded' AS seed, CASE WHEN r = d THEN 't/' || node_id END AS rehydrate,
  CASE WHEN r = d AND k = 4 THEN 'dangling reference' END AS refusal FROM chain LEFT JOIN seed USING (run_id) LEFT JOIN held USING (run_id)""", LINES)  # fmt: skip
def resume_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resuming each run would do; even nodes are durable, odd ones are not or have nothing on record."""
    nodes, edges = chains(spark, sf_dir)
    even = F.col("k") % 2 == 0
    prior = nodes.select("run_id", "node", "state", F.when(even, F.concat(F.lit("t/"), F.col("node"))).alias("durable_reference"), F.lit(None).cast("string").alias("originating_run"))
    probes = nodes.select("run_id", "node", F.when(F.col("k") == 4, "absent").when(F.col("k") == 2, "present").otherwise("unknown").alias("found"))
    out = propagation.resume(nodes.select("run_id", "node", (even | (F.col("k") == 3)).alias("durable"), F.lit(False).alias("covered")), edges, prior, probes)
    return out.select("run_id", F.col("node").alias("node_id"), "decision", "seed", "rehydrate", "refusal")


@query("SELECT x.run_id, x.attempts, x.outputs, x.outcome FROM (SELECT run_id, (SELECT count(*) FROM whole w WHERE w.run_id = ran.run_id) AS attempts, (SELECT count(*) FROM whole w WHERE w.run_id = ran.run_id AND state = 'succeeded') AS outputs, CASE status WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS outcome FROM ran) x", FOLDED)
def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what each run's artifact holds, read back from its JSON."""
    doc = fold.artifacts(adapters.streams(spark, sf_dir))
    return doc.select("run_id", F.json_array_length(F.get_json_object("artifact", "$.attempts")).cast("long").alias("attempts"), F.json_array_length(F.get_json_object("artifact", "$.outputs")).cast("long").alias("outputs"), F.get_json_object("artifact", "$.header.overall_outcome").alias("outcome"))
