"""Flows by name, tasks by decoration, and the verbs that work on them.

    @task(retries=2, durable=True)
    def load(ctx): ...

    @flow()
    def daily():
        p = Pipeline("daily")
        p.node("load", **load.node)
        return p

    main(["run", "daily", "--store", "/runs", "--durable", "/tables"], spark)
"""

from __future__ import annotations

import argparse
import json
import os
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runfold.functions import rules
from runfold.operators import fold, propagation
from runfold.operators.index import Index
from runfold.plans import graph, runtime
from runfold.plans.graph import Pipeline, Policy
from runfold.sources import jsonl, local

FLOWS: dict[str, Callable[[], Pipeline]] = {}


def flow(name: str | None = None, registry: dict | None = None):
    """Registers a function that makes a pipeline; a name stands for one flow only."""

    def add(make: Callable[[], Pipeline]) -> Callable[[], Pipeline]:
        own, into = name or make.__name__, FLOWS if registry is None else registry
        if not own or not all(c.isascii() and (c.isalnum() or c in "_.:-") for c in own):
            raise ValueError(f"{own!r} is no stable name")
        if own in into:
            raise ValueError(f"there is a flow {own} already")
        into[own] = make
        return make

    return add


def payload(name: str | None = None):
    """Gives a class the name by which a graph knows it as a node's input or output."""

    def add(kind: type) -> type:
        kind.payload_name = name or kind.__qualname__
        return kind

    return add


def type_name(kind: type | str | None) -> str | None:
    return kind if kind is None or isinstance(kind, str) else getattr(kind, "payload_name", kind.__qualname__)


def task(*, resources: tuple[str, ...] = (), inputs: tuple[type | str, ...] = (), output: type | str | None = None, contract: bool = False, rule: str = "all-succeeded", **policy: object):
    """Gives a function what a node of it needs: ``function.node`` are arguments of ``Pipeline.node``."""

    def add(function):
        function.resources = tuple(resources)
        function.node = {"run": function, "task": function.__name__, "input_types": tuple(map(type_name, inputs)), "output_type": type_name(output), "rule": rule, "policy": Policy(**policy), "contract": contract or bool(policy.get("durable"))}
        return function

    return add


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runfold")
    p.add_argument("--config", help="a JSON file of settings")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a, required=a in ("--store", "--index")) if a.startswith("--") else v.add_argument(a)
        return v

    verb("list")
    verb("graph", "flow").add_argument("--as", dest="form", choices=("json", "dot", "mermaid"), default="json")
    for name in ("run", "resume"):
        v = verb(name, "flow", "--store", "--durable", "--local", *(["parent"] if name == "resume" else []))
        v.add_argument("--parameter", action="append", default=[], help="name=value")
        v.add_argument("--stop-on-failure", action="store_true")
    verb("replay", "flow", "run_id", "node", "--store", "--durable")
    verb("fold", "--store")
    verb("sync", "--store", "--index")
    verb("prune", "--index").add_argument("--keep", type=int, default=10)
    return p


def main(argv: list[str], spark: SparkSession, registry: dict | None = None, out: Callable[[str], None] = print) -> int:
    """Runs a verb and gives its exit code."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return rules.EXIT["usage"] if e.code else 0
    flows = FLOWS if registry is None else registry
    if getattr(a, "flow", None) is not None and a.flow not in flows:
        out(f"no flow {a.flow}; there are {', '.join(sorted(flows)) or 'none'}")
        return rules.EXIT["usage"]
    return _VERBS[a.verb](a, spark, flows, out)


def _list(a, spark, flows, out) -> int:
    for name in sorted(flows):
        out(name)
    return 0


def _graph(a, spark, flows, out) -> int:
    p = flows[a.flow]()
    out({"json": lambda: jsonl.canonical(p.artifact()), "dot": p.dot, "mermaid": p.mermaid}[a.form]())
    return rules.EXIT["assembly-failed"] if p.problems() else 0


def _setting(a, name: str) -> str | None:
    value = getattr(a, name)
    return runtime.setting(name, {} if value is None else {name: value}, dict(os.environ), runtime.config_file(a.config))


def _execute(p: Pipeline, spark, a, **more: object) -> int:
    run_id = runtime.new_run_id()
    began = time.monotonic_ns()
    writer = jsonl.EventWriter(jsonl.FileSink(a.store, p.name, run_id), lambda: time.monotonic_ns() - began, run_id, p.name)
    parameters = dict(x.split("=", 1) for x in getattr(a, "parameter", []))
    where = _setting(a, "local")
    log = local.SubmissionLog(f"{where}/submissions.jsonl") if where else None
    runtime.run(p, spark, writer, runtime.Options(parameters=parameters, durable_base=_setting(a, "durable"), local_base=where, stop_on_failure=a.stop_on_failure, submissions=log, **more))
    return _exit_code(spark, f"{a.store}/{p.name}/{run_id}/events.jsonl")


def _exit_code(spark, path: str) -> int:
    records = jsonl.read_records(spark, [path])
    own = fold.attempts(records).agg(F.count_if(F.col("status").isin("failed", "timed-out")).alias("bad"))
    return fold.runs(records).join(own).select(rules.exit_code(F.col("outcome"), F.col("bad")).alias("code")).first().code


def _run(a, spark, flows, out) -> int:
    return _execute(flows[a.flow](), spark, a)


def prior_of(records, run_id: str):
    """What a resume has to know of a run: node, state, durable_reference and originating_run of each node."""
    own = fold.attempts(records.where(F.col("run_id") == run_id))
    last = own.groupBy("run_id", "node").agg(F.max_by(F.struct("status", "durable_reference", "satisfied_from_run"), F.coalesce("seq", F.lit(-1))).alias("t"))
    return last.select("run_id", "node", F.col("t.status").alias("state"), "t.durable_reference", F.col("t.satisfied_from_run").alias("originating_run"))


def _resume(a, spark, flows, out) -> int:
    p = flows[a.flow]()
    records = jsonl.read_records(spark, [f"{a.store}/{p.name}/{a.parent}/events.jsonl"])
    head = fold.runs(records).select("header.*").first()
    now = {"algorithm": head.fingerprint_algorithm_version, "tool": "", "structural": p.structural(), "policy": p.policy_hash()}
    before = {"algorithm": 1, "tool": "", "structural": head.fingerprint_structural, "policy": head.fingerprint_policy}
    gate = spark.range(1).select(rules.resume_gate({k: F.lit(v) for k, v in before.items()}, {k: F.lit(v) for k, v in now.items()}).alias("g")).first().g
    if gate.startswith("refused"):
        out(gate)
        return rules.EXIT["resume-refused"]
    nodes, edges = p.tables(spark)
    covered = [c for n in p.nodes for c in n.covers]
    prior = prior_of(records, a.parent).persist()
    refs = prior.where("durable_reference IS NOT NULL").select("node", "durable_reference").collect()  # a graph's nodes
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda r: (x := path(r)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(x)
    probes = spark.createDataFrame([(a.parent, r.node, "present" if there(r.durable_reference) else "absent") for r in refs], "run_id string, node string, found string")
    one = F.lit(a.parent).alias("run_id")
    plan = propagation.resume(nodes.select(one, "node", "durable", F.col("node").isin(covered).alias("covered")), edges.select(one, "consumer", "producer", "kind"), prior, probes).collect()
    refused = sorted(f"refused: {r.refusal}: {r.node}" for r in plan if r.refusal)
    for line in refused:
        out(line)
    if refused:
        return rules.EXIT["resume-refused"]
    lineage = propagation.lineage(a.parent, head.resume_lineage.asDict() if head.resume_lineage else None)
    return _execute(p, spark, a, satisfied={r.node: r.originating_run for r in plan if r.decision != "run"}, lineage=lineage)


def _replay(a, spark, flows, out) -> int:
    p = flows[a.flow]()
    records = jsonl.read_records(spark, [f"{a.store}/{p.name}/{a.run_id}/events.jsonl"])
    refs = prior_of(records, a.run_id).select("node", "durable_reference")
    gone = [r.node for r in propagation.not_replayable(a.node, p.tables(spark)[1].where("kind = 'data'"), refs).collect()]
    if gone:
        out(f"refused: no durable output of {', '.join(sorted(gone))}")
        return rules.EXIT["resume-refused"]
    run_id, began = runtime.new_run_id(), time.monotonic_ns()
    writer = jsonl.EventWriter(jsonl.FileSink(a.store, p.name, run_id), lambda: time.monotonic_ns() - began, run_id, p.name)
    inputs = {r.node: r.durable_reference for r in refs.collect() if r.durable_reference}
    state = runtime.exec_node(p, spark, a.node, writer, inputs, runtime.Options(durable_base=_setting(a, "durable")))
    return 0 if state in ("succeeded", "skipped") else rules.EXIT["run-failed"]


def _fold(a, spark, flows, out) -> int:
    """One artifact a line, as they come: a partition of runs at a time."""
    bad = 0
    for r in fold.artifacts(jsonl.read_records(spark, jsonl.run_files(spark, a.store))).toLocalIterator():
        bad += r.artifact is None
        out(r.artifact or json.dumps({"error": r.error, "run_id": r.run_id}))
    return rules.EXIT["run-failed"] if bad else 0


def _sync(a, spark, flows, out) -> int:
    out(json.dumps(Index(spark, a.index).sync(a.store), sort_keys=True))
    return 0


def _prune(a, spark, flows, out) -> int:
    """Names the runs beyond the newest of each pipeline; their ids sort by time."""
    runs = Index(spark, a.index).table("dag_run").select("dag_id", "run_id", F.conv(F.regexp_replace(F.substring("run_id", 1, 13), "-", ""), 16, 10).cast("long").alias("at_ms"))
    for r in graph.prunable(runs, a.keep).orderBy("dag_id", "run_id").toLocalIterator():
        out(f"{r.dag_id}/{r.run_id}")
    return 0


_VERBS = {"list": _list, "graph": _graph, "run": _run, "resume": _resume, "replay": _replay, "fold": _fold, "sync": _sync, "prune": _prune}
