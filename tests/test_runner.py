"""The runner, its local files, flows and verbs, and the kit for tests."""

import io
import json
import logging
import os
import threading
import time
import types

import pytest

from runfold import cli, testkit
from runfold.operators import fold
from runfold.operators.index import Index
from runfold.plans import runtime
from runfold.plans.graph import Pipeline, Policy
from runfold.sources import blobs, jsonl, local
from runfold.sources.jsonl import EventWriter


def execute(p, spark, **options):
    sink = testkit.Lines()
    states = runtime.run(p, spark, EventWriter(sink, time.monotonic_ns, "r", p.name), runtime.Options(**options))
    return states, [json.loads(x) for x in sink.lines]


def test_a_node_that_outlives_its_time_is_left_behind(spark):
    free, p = threading.Event(), Pipeline("p")
    p.node("slow", run=lambda ctx: free.wait(20), policy=Policy(timeout_ns=50_000_000, working_memory=7))
    p.node("ends", run=lambda ctx: time.sleep(0.2), policy=Policy(timeout_ns=50_000_000))
    states, events = execute(p, spark, grace=0.3)
    free.set()
    assert states == {"slow": "timed-out", "ends": "timed-out"}
    assert [(e["node"], e["pinned_capacity"]) for e in events if e["kind"] == "zombie-at-exit"] == [("slow", 7)]
    assert events[-1]["kind"] == "run-finished" and [e["seq"] for e in events] == list(range(len(events)))


def test_cancellation(spark):
    """A node that listens is cancelled, one that does not is abandoned, the rest never runs, teardowns do."""
    control, free, p, seen = runtime.Control(), threading.Event(), Pipeline("p"), []

    def listens(ctx):
        control.cancel()
        while not ctx.cancelled():
            time.sleep(0.01)
        raise RuntimeError("told to")

    a, b = p.node("a", run=listens), p.node("deaf", run=lambda ctx: free.wait(20))
    p.node("later", a, run=lambda ctx, x: None)
    p.node("always", after=(a,), rule="all-terminal", run=lambda ctx: None)
    p.teardown("clean", a, b, run=lambda ctx: seen.append((ctx.cancelled(), dict(ctx.covered))))
    states, events = execute(p, spark, control=control, grace=0.3)
    free.set()
    assert states == {"a": "cancelled", "deaf": "abandoned", "later": "cancelled", "always": "cancelled", "clean": "succeeded"}
    assert seen == [(False, {"a": "cancelled", "deaf": "abandoned"})]
    assert [e["node"] for e in events if e["kind"] == "zombie-at-exit"] == ["deaf"] and events[-1]["outcome"] == "failed"


def test_a_node_that_ends_at_once_when_cancelled(spark, monkeypatch):
    """Its thread is gone before the runner looks; it is cancelled all the same, and one that failed before is not."""

    class Quick(threading.Thread):
        def start(self):
            super().start()
            self.join(5)

    monkeypatch.setattr(runtime, "threading", types.SimpleNamespace(**{**vars(threading), "Thread": Quick}))
    control, p = runtime.Control(), Pipeline("p")

    def ends(ctx):
        control.cancel()
        raise RuntimeError("told to")

    first = p.node("first", run=lambda ctx: 1 / 0)
    p.node("ends", after=(first,), rule="all-terminal", run=ends)
    assert execute(p, spark, control=control)[0] == {"first": "failed", "ends": "cancelled"}


def test_teardowns_have_a_deadline(spark):
    p = Pipeline("p")
    a = p.node("a", run=lambda ctx: None)

    def clean(ctx):
        while not ctx.cancelled():
            time.sleep(0.01)
        raise RuntimeError("late")

    p.teardown("clean", a, run=clean)
    states, events = execute(p, spark, teardown_deadline=0.1)
    assert states == {"a": "succeeded", "clean": "cancelled"} and events[-1]["outcome"] == "succeeded"


def test_failure_modes_classes_and_metrics(spark):
    p, threads = Pipeline("p"), {}

    def note(ctx):
        threads[ctx.node] = None
        ctx.metrics["rows"] = 3

    bad = p.node("bad", run=lambda ctx: 1 / 0)
    p.node("z", run=note, policy=Policy(execution_class="compute"), after=(bad,))
    p.node("contingency", run=note, rule="any-failed", after=(bad,), policy=Policy(execution_class="async", class_override="blocking"))
    states, events = execute(p, spark, stop_on_failure=True)
    assert states == {"bad": "failed", "z": "upstream-failed", "contingency": "succeeded"}
    done = {e["node"]: e for e in events if e["kind"] == "attempt-outcome"}
    assert done["contingency"]["metrics"] == {"rows": 3.0} and done["contingency"]["worker"].startswith("blocking#") and "ZeroDivision" in done["bad"]["message"]
    q = Pipeline("q")
    q.node("n", run=cli.task(resources=("db",))(lambda ctx: None))
    states, events = execute(q, spark)
    assert states == {} and (events[-1]["outcome"], events[-1]["errors"]) == ("bootstrap-failed", ["n: no resource db"])


def test_scratch_folders_and_submissions(spark, tmp_path):
    base, p, seen = str(tmp_path), Pipeline("p"), []

    def task(ctx):
        seen.append((ctx.scratch.get("k"), os.path.isdir(ctx.temp)))
        ctx.scratch.put("k", b"at %d" % ctx.attempt)
        if ctx.attempt == 1:
            raise runtime.Retryable("once")

    p.node("n", run=task, policy=Policy(retries=1))
    log = local.SubmissionLog(f"{base}/log/submissions.jsonl")
    states, events = execute(p, spark, local_base=base, submissions=log, sleep=lambda s: None)
    assert states == {"n": "succeeded"} and seen == [(None, True), (b"at 1", True)] and os.listdir(f"{base}/tmp") == []
    assert [(r["node"], r["attempt"]) for r in log.read()] == [("n", 1), ("n", 2)] == [(e["node"], e["attempt"]) for e in events if e["kind"] == "attempt-submitted"]
    with open(log.path, "a") as f:
        f.write('{"run_id":"r","no')
    assert log.stranded({("r", "n", 1)}) == [{"run_id": "r", "node": "n", "attempt": 2, "executor": "local"}]
    after = local.Scratch(f"{base}/scratch", "next", "n")
    after.put("mine", b"x\ny")
    assert after.carry_forward("r") == ["k"] and after.keys() == ["k", "mine"] and after.get("k") == b"at 2" and after.get("mine") == b"x\ny"
    after.remove("k")
    after.keep_until_success()
    after.remove_on_success()
    assert after.keys() == [] and local.Scratch(f"{base}/scratch", "r", "n").keys() == ["k"]
    left = local.run_folder(base, "gone")
    (tmp_path / "tmp" / os.path.basename(left) / "owner").write_text("999999999")
    mine = local.run_folder(base, "mine")
    assert local.sweep(base) == [left] and os.path.isdir(mine)


def test_log_lines():
    out, people = io.StringIO(), io.StringIO()
    handlers = [local.log_to(out), local.log_to(people, structured=False)]
    local.span_logger("r", "n", 2).info("read %d", 3)
    for h in handlers:
        logging.getLogger("runfold").removeHandler(h)
    row = json.loads(out.getvalue())
    assert (row["message"], row["run_id"], row["node"], row["attempt"], row["level"]) == ("read 3", "r", "n", 2, "info") and "r/n/2: read 3" in people.getvalue()


def test_run_ids_sort_by_time():
    a, b = runtime.new_run_id(1000, b"\xff" * 10), runtime.new_run_id(1001, b"\0" * 10)
    assert a < b and a[14] == b[14] == "7" and a[19] in "89ab" and b == "00000000-03e9-7000-8000-000000000000"


@cli.payload("T")
class Rows:
    pass


@cli.task(durable=True, output=Rows)
def load(ctx):
    if ctx.parameters.get("fail") == "load":
        raise RuntimeError("asked to")
    return ctx.spark.range(int(ctx.parameters.get("n", 4)))


@cli.task(output=Rows, inputs=(Rows,), durable=True)
def double(ctx, rows):
    if ctx.parameters.get("fail") == "double":
        raise RuntimeError("asked to")
    return rows.selectExpr("id * 2 AS id")


def test_verbs(spark, tmp_path):
    flows, lines = {}, []

    @cli.flow("demo", registry=flows)
    def demo():
        p = Pipeline("demo")
        p.node("double", p.node("load", **load.node), **double.node)
        return p

    store, tables = str(tmp_path / "store"), str(tmp_path / "tables")
    do = lambda *argv: cli.main([*argv], spark, flows, lines.append)
    assert do("list") == 0 and lines == ["demo"] and do("run", "none", "--store", store) == 2 and do("what") == 2
    assert do("run", "demo", "--store", store, "--durable", tables, "--parameter", "fail=double") == 1
    parent = os.listdir(f"{store}/demo")[0]
    assert do("resume", "demo", parent, "--store", store, "--durable", tables, "--local", str(tmp_path / "here")) == 0
    child = next(x for x in os.listdir(f"{store}/demo") if x != parent)
    head = fold.runs(jsonl.read_records(spark, [f"{store}/demo/{child}/events.jsonl"])).first().header
    assert (head.resume_lineage.parent_run_id, head.resume_lineage.lineage_root_run_id) == (parent, parent)
    line = fold.headers(jsonl.read_records(spark, jsonl.run_files(spark, store))).where("run_id <> lineage_root_run_id").collect()
    assert [(r.run_id, r.pipeline, r.parent_run_id) for r in line] == [(child, "demo", parent)]
    assert os.path.isdir(f"{tables}/{child}/double") and not os.path.isdir(f"{tables}/{child}/load")
    assert do("replay", "demo", child, "double", "--store", store, "--durable", tables) == 0
    lines.clear()
    assert do("fold", "--store", store) == 0 and len(lines) == 3 and {json.loads(x)["header"]["overall_outcome"] for x in lines} == {"succeeded", "failed"}
    lines.clear()
    assert do("sync", "--store", store, "--index", str(tmp_path / "index")) == 0 and json.loads(lines[0])["synced"] == 3
    lines.clear()
    assert do("prune", "--index", str(tmp_path / "index"), "--keep", "1") == 0 and len(lines) == 2 and f"demo/{parent}" in lines
    lines.clear()
    assert do("graph", "demo") == 0 and json.loads(lines[0])["order"] == ["load", "double"] and json.loads(lines[0])["edges"] == [{"from": "load", "to": "double", "kind": "data", "type_name": "T"}]
    import shutil

    shutil.rmtree(f"{tables}/{parent}/load")
    lines.clear()
    assert do("resume", "demo", parent, "--store", store, "--durable", tables) == 6 and lines == ["refused: dangling reference: load"]
    with pytest.raises(ValueError, match="already"):
        cli.flow("demo", registry=flows)(demo)


def test_kit(spark, tmp_path):
    ok = testkit.run_task(load, spark, parameters={"n": "2"})
    assert ok.status == "succeeded" and ok.value.count() == 2 and testkit.run_task(double, spark, None, parameters={"fail": "double"}).error == "RuntimeError: asked to"
    p = Pipeline("p")
    a = p.node("a", policy=Policy(retries=2))
    p.node("b", a)
    p.node("c", after=(a,), rule="any-failed")
    play = testkit.Rehearsal(p).script("a", "retry", "ok").script("b", "fail")
    states, records = play.run(spark)
    assert states == {"a": "succeeded", "b": "failed", "c": "skipped"} and play.calls == [("a", 1), ("a", 2), ("b", 1)]
    assert {(r.node, r.attempt, r.status) for r in fold.attempts(records).collect()} == {("a", 1, "failed"), ("a", 2, "succeeded"), ("b", 1, "failed"), ("c", 1, "skipped")}
    path = str(tmp_path / "p.json")
    testkit.bless_structure(p, path)
    testkit.assert_structure(p, path)
    p.node("d", a)
    with pytest.raises(AssertionError, match='"d"'):
        testkit.assert_structure(p, path)


def test_time_for_each_node(spark):
    testkit.overhead_ns(spark, 50)
    assert testkit.overhead_ns(spark, 300) < 16_000_000


def test_values_as_blobs_and_shards(spark, tmp_path):
    value = blobs.BlobValue(blobs.BlobStore(spark, f"file://{tmp_path}/b"))
    reference, meta = value.put(b"x" * 10)
    assert value.get(reference) == b"x" * 10 and value.probe(reference, meta["content_hash"]) == "present" and value.probe(reference, "sha256:00") == "changed"
    assert value.probe(reference[:-64] + "0" * 64) == "absent" and value.probe("s3://elsewhere") == "unknown" and value.store.keys() == [reference[-64:]]
    (tmp_path / "b" / reference[-64:]).unlink()
    (tmp_path / "b" / reference[-64:]).write_bytes(b"y")
    (tmp_path / "b" / f".{reference[-64:]}.crc").unlink(missing_ok=True)
    assert value.probe(reference) == "changed"
    lines = blobs.shard_lines({"run_id": "r", "tool_version": "1"}, [{"kind": "attempt-started"}, {"kind": "attempt-outcome"}])
    assert blobs.read_shard(lines, {"tool_version": "1"}) == ({"run_id": "r", "tool_version": "1"}, [{"kind": "attempt-started"}, {"kind": "attempt-outcome"}])
    for bad, build in ((lines[:-1], {}), (lines[:1] + lines[2:], {}), (lines, {"tool_version": "2"}), ([], {})):
        with pytest.raises(blobs.ShardError):
            blobs.read_shard(bad, build)


def test_watching_and_tee(spark, tmp_path):
    from runfold.streaming import live

    index = Index(spark, str(tmp_path / "index"))
    sink = jsonl.IndexSink(spark, index, every=2)
    kept = testkit.Lines()
    w = EventWriter(jsonl.TeeSink(kept, sink), testkit.Ticks(), "r1", "p")
    w.emit("run-started", header={"run_id": "r1", "pipeline": "p"})
    w.emit("node-ready", node="a")
    assert index.table("dag_run").first().state == "running"
    w.emit("run-finished", outcome="failed")
    assert index.table("dag_run").first().state == "failed"
    seg = tmp_path / "seg"
    seg.mkdir()
    (seg / "1.jsonl").write_text(kept.lines[0] + "\n" + kept.lines[2] + "\n")
    query = lambda: live.watch(live.read_segments(spark, str(seg))).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    seen: list = []
    query()
    assert [(r.run_id, r.state, r.last_seq, r.missing) for r in seen] == [("r1", "failed", 2, 1)]
    (seg / "2.jsonl").write_text(kept.lines[1] + "\n")
    seen.clear()
    query()
    assert [(r.run_id, r.state, r.last_seq, r.missing) for r in seen] == [("r1", "failed", 2, 0)]


def test_following_a_query_that_fails(spark, tmp_path):
    from runfold.streaming import live

    seg = tmp_path / "seg"
    seg.mkdir()
    (seg / "1.jsonl").write_text('{"run_id":"r","seq":0}\n')
    faults, waits, told = [1, 1], [], []

    def batch(df, n):
        if faults:
            faults.pop()
            raise OSError("away")
        told.append(df.count())

    start = lambda: live.read_segments(spark, str(seg)).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert live.follow(start, wait=waits.append, report=lambda e: told.append("fault")) == 3 and told == ["fault", "fault", 1] and waits == [0.1, 0.2]


def test_artifacts_are_checked(tmp_path):
    from runfold.schemas import artifact_violations

    p = Pipeline("p")
    p.node("b", p.node("a", output_type="T"))
    doc = json.loads(jsonl.canonical(p.artifact()))
    assert artifact_violations("graph", doc) == []
    doc["edges"][0] |= {"to": "z"}
    assert artifact_violations("graph", doc) == [("edges[0]", "an end is no node")]
    bad = {"header": {}, "attempts": [{"node": "a", "attempt": 1, "worker": "w", "phase_durations_ns": {}, "status": "odd"}], "outputs": 1, "interrupted": False}
    assert artifact_violations("run", bad) == [("summary", "is required"), ("header.overall_outcome", "is required"), ("attempts[0].status", "is no terminal state"), ("outputs", "must be an array")]
    (tmp_path / "c.json").write_text('{"durable": "/t", "pool": {"memory": 3}}')
    file = runtime.config_file(str(tmp_path / "c.json"))
    assert file == {"durable": "/t", "pool.memory": 3} and runtime.setting("pool.memory", {}, {"RUNFOLD_POOL_MEMORY": "5"}, file) == "5" and runtime.config_file(None) == {}


def test_columns(spark):
    from pyspark.sql import functions as F

    from runfold.functions import rules
    from runfold.plans import graph

    ns = [850_000_000, 12_500_000_000, 30_000_000_000, 200_000_000_000, 7_500_000_000_000]
    got = [r.t for r in spark.createDataFrame([(x,) for x in ns], "ns long").select(rules.duration_text(F.col("ns")).alias("t")).collect()]
    assert got == ["850ms", "12.5s", "30s", "3m 20s", "2h 5m"]
    own = dict(run_id="r", node="n", attempt=1, structural_fingerprint="f", tool_version="1", image_digest="i")
    verdict = lambda **k: spark.range(1).select(rules.adoption({a: F.lit(v) for a, v in (own | k).items()}, {a: F.lit(v) for a, v in own.items()}).alias("v")).first().v
    assert verdict() == "adopt" and verdict(node="m", image_digest="j") == "refused: node" and verdict(tool_version=None) == "refused: tool_version"
    nodes = spark.createDataFrame([(0, "a"), (1, "b")], "place int, node string")
    edges = spark.createDataFrame([(0, 1, "data"), (0, 7, "data")], "producer_place int, consumer_place int, kind string")
    assert [(r.producer, r.consumer, r.kind) for r in graph.edge_names(nodes, edges).collect()] == [("a", "b", "data")]
    assert graph.short("x" * 100) == "x" * 29 + "…" + "x" * 30 and rules.EXIT["sink-failed"] == 7
    code = spark.range(1).select(rules.exit_code(F.lit("cancelled"), F.lit(0), F.lit(True)).alias("c")).first().c
    assert code == 7
