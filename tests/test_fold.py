import json
import random

import pytest

from runfold.operators import fold
from runfold.operators.index import TABLES, Index, Refused, project
from runfold.plans import cookbook
from runfold.schemas import violations
from runfold.sources import jsonl

FIELDS = "run_id string, seq long, offset_ns long, kind string, node string, attempt int, status string, state string, outcome string, pinned_capacity long"


def frame(spark, events, run="r"):
    return spark.createDataFrame([(run, i, e[0], e[1], e[2], *(list(e[3:]) + [None] * 5)[:5]) for i, e in enumerate(events)], FIELDS)


def node_run(node, ready, admitted, started, ended, status="succeeded", attempt=1):
    return [(ready, "node-ready", node), (admitted, "node-admitted", node), (started, "attempt-started", node, attempt), (ended, "attempt-outcome", node, attempt, status), (ended, "node-terminal", node, None, None, status)]


def stream(*nodes, end=None):
    body = sorted((e for n in nodes for e in n), key=lambda e: e[0])
    return [(0, "run-started", None), *body, (end or max(e[0] for e in body), "run-finished", None, None, None, None, "succeeded")]


def plain_phases(events):
    """The fold of attempts for a list of events, in plain Python."""
    at, out = {}, []
    for off, kind, node, *rest in events:
        if kind == "attempt-outcome":
            s = min(at.get((node, "attempt-started"), off), off)
            total, inside = off - s, lambda k: (x - s if (x := at.get((node, k))) is not None and s < x <= off else 0)
            r = min(inside("node-ready"), total)
            p = min(inside("node-admitted"), total - r)
            b = min(inside("attempt-outcome") if rest[0] > 1 else 0, total - r - p)
            out.append((node, rest[0], r, p, b, total - r - p - b))
        at[node, kind] = off
    return sorted(out)


def path_of(spark, events):
    return fold.critical_paths(frame(spark, events)).first().critical_path_ns


def test_diamond(spark):
    events = stream(node_run("a", 0, 0, 0, 1000), node_run("b", 1000, 5000, 5000, 5500), node_run("c", 1000, 1000, 1000, 3000), node_run("d", 5500, 5500, 5500, 6500))
    assert path_of(spark, events) == 4000


def test_single_node_and_empty_run(spark):
    assert path_of(spark, stream(node_run("a", 0, 0, 5, 30))) == 25
    got = fold.summaries(frame(spark, [(0, "run-started", None), (9, "run-finished", None)])).first()
    assert (got.critical_path_ns, got.total_elapsed_ns, got.retained_values) == (0, 9, [])


def test_never_ran_and_roster(spark):
    events = stream(node_run("a", 0, 0, 0, 10, "failed"), [(10, "node-terminal", "b", None, None, "skipped"), (11, "node-terminal", "b", None, None, "upstream-failed")])
    roster = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "c")], "run_id string, node string")
    got = {r.node: (r.status, r.total_ns, r.origin) for r in fold.attempts(frame(spark, events), roster).collect()}
    assert got == {"a": ("failed", 10, "outcome"), "b": ("upstream-failed", 0, "terminal"), "c": ("upstream-failed", 0, "roster")}
    assert path_of(spark, events) == 10


def test_zombie_pins_time_and_capacity(spark):
    events = stream([(0, "attempt-started", "a", 1), (5, "attempt-outcome", "a", 1, "timed-out")], [(20, "zombie-at-exit", "a", 1, None, None, None, 7)], end=25)
    got = fold.summaries(frame(spark, events)).first()
    assert (got.abandoned_pinned_time_ns, got.abandoned_pinned_capacity) == (15, 7)


def test_outcomes_of_runs(spark):
    cut = frame(spark, [(0, "run-started", None), (3, "node-ready", "a")])
    got = fold.runs(cut).first()
    assert (got.outcome, got.interrupted) == ("cancelled", True)
    early = frame(spark, [(0, "run-started", None), (1, "attempt-outcome", "a", 1, "failed"), (2, "run-finished", None, None, None, None, "assembly-failed")])
    assert fold.attempts(early).count() == 0 and fold.summaries(early).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_phases_as_in_plain_python(spark, seed):
    rnd, events, t = random.Random(seed), [(0, "run-started", None)], 0
    for _ in range(150):
        t += rnd.randint(0, 3)
        kind = rnd.choice(["node-ready", "node-admitted", "attempt-started", "attempt-outcome"])
        events.append((t, kind, rnd.choice("abc"), rnd.randint(1, 3), "succeeded"))
    rows = fold.outcomes(frame(spark, events).orderBy("kind").repartition(3)).collect()
    assert sorted((r.node, r.attempt, r.ready_wait_ns, r.permit_wait_ns, r.backoff_ns, r.executing_ns) for r in rows) == plain_phases([e for e in events if e[1] != "run-started"])
    assert all(r.ready_wait_ns + r.permit_wait_ns + r.backoff_ns + r.executing_ns == r.total_ns for r in rows)


def write_run(base, run, *, stranded=False, uri="blob://x", read="h1"):
    clock = iter(range(0, 10_000_000_000, 1_000_000))
    w = jsonl.EventWriter(jsonl.FileSink(base, "p", run), lambda: next(clock), run, "p")
    w.emit("run-started", header={"run_id": run, "pipeline": "p", "fingerprint_structural": "00ff", "parameters": {"k": 1}})
    w.emit("attempt-submitted", node="load", attempt=1, inputs=[{"uri": "zeta", "content_hash": "h1"}, {"uri": "alpha"}, {"uri": "mid"}], target_name="t")
    w.emit("attempt-submitted", node="load", attempt=1, observed_name="pod-1")
    if not stranded:
        w.emit("attempt-started", node="load", attempt=1)
        w.emit("attempt-outcome", node="load", attempt=1, status="succeeded", inputs=[{"uri": "zeta", "content_hash": read}], metrics={"rows": 2.0})
        w.emit("output-produced", node="load", attempt=1, uri=uri, produced_at_offset_ns=5)
        w.emit("node-terminal", node="load", state="succeeded")
        w.emit("run-finished", outcome="succeeded")
    w.sink.flush()
    return w


def test_index_sync_is_idempotent(spark, tmp_path):
    base, index = str(tmp_path / "store"), Index(spark, str(tmp_path / "index"))
    write_run(base, "r1"), write_run(base, "r2", stranded=True), write_run(base, "r3", read="h2")
    (tmp_path / "store/p/bad").mkdir()
    (tmp_path / "store/p/bad/events.jsonl").write_text('{"kind":\n{"kind":"run-started"}\n')
    assert index.sync(base) == {"synced": 3, "skipped": 1, "newly_synced": 3}
    first = {t: sorted(map(repr, index.table(t).collect())) for t in TABLES}
    assert index.sync(base) == {"synced": 3, "skipped": 1, "newly_synced": 0}
    assert first == {t: sorted(map(repr, index.table(t).collect())) for t in TABLES}
    t = {n: index.table(n) for n in TABLES}
    assert {(r.state, r.runs) for r in cookbook.runs_per_dag_state(t).collect()} == {("succeeded", 2), ("cancelled", 1)}
    assert [(r.run_id, r.node_id, r.observed_name) for r in cookbook.stranded(t).collect()] == [("r2", "load", "pod-1")]
    assert [r.uri for r in cookbook.launch_inputs(t, "load").where("run_id = 'r1'").orderBy("position").collect()] == ["zeta", "alpha", "mid"]
    assert [(r.run_id, r.submitted_hash, r.read_hash) for r in cookbook.divergence(t).collect()] == [("r3", "h1", "h2")]
    assert {r.uri: (r.produced_by_runs, r.consumed_by_runs) for r in cookbook.asset_rollup(t).collect()} == {"blob://x": (2, 0), "zeta": (0, 2)}
    assert cookbook.launched_against(t, "zeta").count() == 3 and index.has_run("r1") and not index.has_run("r9")
    assert t["output_produced"].where("content_hash IS NULL").count() == 2  # null-safe keys: no second row after the second sync


def test_files_of_many_kinds(spark, tmp_path):
    def put(name, text):
        (tmp_path / "p" / name).mkdir(parents=True)
        (tmp_path / "p" / name / "events.jsonl").write_text(text)

    good = json.dumps({"run_id": "r", "seq": 0, "offset_ns": 0, "kind": "run-started", "header": {"pipeline": "p"}, "extra": [1]})
    put("whole", good + "\n"), put("tail_kept", good + "\n\n" + good), put("tail_cut", good + '\n{"run_'), put("corrupt", good + '\n{"run_\n'), put("headless", '{"kind":"node-ready","run_id":"q","seq":0}\n')
    rows = {r.path.split("/")[-2]: r for r in jsonl.read_status(spark, jsonl.discover(spark, str(tmp_path))).collect()}
    assert {k: (r.records, r.trailing_partial, r.error_line, r.reason) for k, r in rows.items()} == {
        "whole": (1, False, None, None), "tail_kept": (2, False, None, None), "tail_cut": (1, True, None, None),
        "corrupt": (1, False, 1, "corrupt record"), "headless": (1, False, None, "no run-started record"),
    }
    assert jsonl.discover(spark, str(tmp_path / "none")) == [] and jsonl.read_lines(spark, []).count() == 0


def test_artifacts(spark, tmp_path):
    """The whole fold as canonical JSON: names in order, no spaces, the same at each read; without a beginning, an error."""
    base = str(tmp_path)
    write_run(base, "r1"), write_run(base, "r2", stranded=True)
    (tmp_path / "p/r3").mkdir()
    (tmp_path / "p/r3/events.jsonl").write_text('{"kind":"node-ready","run_id":"r3","seq":0,"node":"x","offset_ns":1}\n')
    records = jsonl.read_records(spark, jsonl.discover(spark, base))
    rows = {r.run_id: r for r in fold.artifacts(records, spark.createDataFrame([("r1", "later")], "run_id string, node string")).collect()}
    assert rows["r3"].artifact is None and rows["r3"].error == "no run-started record" and rows["r1"].error is None
    doc = json.loads(rows["r1"].artifact)
    assert rows["r1"].artifact == jsonl.canonical(doc) and list(doc) == ["attempts", "header", "interrupted", "outputs", "summary"]
    assert [(a["node"], a["status"]) for a in doc["attempts"]] == [("load", "succeeded"), ("later", "upstream-failed")]
    assert doc["attempts"][0]["phase_durations_ns"].keys() == {"backoff", "executing", "permit-wait", "ready-wait"} and doc["attempts"][0]["metrics"] == {"rows": 2.0}
    assert doc["header"]["overall_outcome"] == "succeeded" and doc["outputs"][0]["uri"] == "blob://x" and doc["summary"]["critical_path_ns"] >= 0 and doc["interrupted"] is False
    assert json.loads(rows["r2"].artifact)["interrupted"] is True
    write_run(base, "r4")
    records = jsonl.read_records(spark, jsonl.run_files(spark, base))
    early = frame(spark, [(0, "run-started", None), (1, "attempt-outcome", "a", 1, "failed"), (2, "run-finished", None, None, None, None, "assembly-failed")])
    doc = json.loads(fold.artifacts(early).first().artifact)
    assert (doc["attempts"], doc["outputs"], doc["summary"]) == ([], [], None)
    a, b = (fold.masked(records.where(f"run_id = '{r}'")).drop("path", "seq") for r in ("r1", "r4"))
    assert "run_id" not in a.columns and "captured_environment" not in a.schema["header"].dataType.names and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_index_survives_crashes_and_second_writers(spark, tmp_path, monkeypatch):
    base, path = str(tmp_path / "store"), str(tmp_path / "index")
    write_run(base, "r1")
    a = Index(spark, path)
    a.sync(base)
    one = {t: sorted(map(repr, a.table(t).collect())) for t in TABLES}
    write_run(base, "r2")
    # a writer that dies before its manifest, and one that dies while it writes it
    with monkeypatch.context() as m:
        m.setattr(Index, "_publish", lambda self, *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            a.sync(base)
    (tmp_path / "index/manifest-2.json").write_text('{"version": 2, "tab')
    again = Index(spark, path)
    assert again.version() == 1 and {t: sorted(map(repr, again.table(t).collect())) for t in TABLES} == one
    assert again.sync(base) == {"synced": 2, "skipped": 0, "newly_synced": 1} and again.version() == 3 and again.table("dag_run").count() == 2
    # a writer that another one overtakes between its reading and its manifest
    rows = {"asset": spark.createDataFrame([("u1", None)], "uri string, extra string")}
    real, done = Index._publish, []

    def late(self, version, tables):
        if not done:
            done.append(1)
            Index(spark, path).apply({"asset": spark.createDataFrame([("u2", None)], "uri string, extra string")})
        return real(self, version, tables)

    monkeypatch.setattr(Index, "_publish", late)
    with pytest.raises(Refused):
        again.apply(rows, tries=1)
    done.clear()
    again.apply(rows)
    assert {"u1", "u2"} <= {r.uri for r in again.table("asset").collect()} and again.table("dag_run").count() == 2
    monkeypatch.undo()
    files = lambda: set((tmp_path / "index").glob("commit-*/dag_run"))
    assert again.vacuum(1) and again.table("dag_run").count() == 2 and len(files()) == 1


def test_violations(spark):
    rows = frame(spark, [(0, "run-started", None), (-1, "node-ready", None), (0, "what", "a"), (1, "attempt-outcome", "a", 0, "odd")])
    got = {(r.seq, r.path) for r in violations(fold.widened(rows)).collect()}
    assert got == {(0, "header"), (1, "offset_ns"), (1, "node"), (2, "kind"), (3, "attempt"), (3, "status")}


def test_live_equals_sync(spark, tmp_path):
    from runfold.streaming import live

    base, seg = str(tmp_path / "store"), tmp_path / "segments"
    seg.mkdir()
    for i, run in enumerate(("r1", "r2")):
        write_run(base, run, stranded=i == 1)
        lines = (tmp_path / f"store/p/{run}/events.jsonl").read_text().splitlines()
        for k in range(0, len(lines), 3):
            (seg / f"{run}-{k}.jsonl").write_text("\n".join(lines[k : k + 3]) + "\n")
    a, b = Index(spark, str(tmp_path / "a")), Index(spark, str(tmp_path / "b"))
    a.sync(base)
    live.into_index(live.read_segments(spark, str(seg)), b, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    for t in TABLES:
        drop = ["events_path", "state"] if t == "dag_run" else []
        assert sorted(map(repr, a.table(t).drop(*drop).collect())) == sorted(map(repr, b.table(t).drop(*drop).collect())), t
    assert {r.run_id: r.state for r in b.table("dag_run").collect()} == {"r1": "succeeded", "r2": "running"}


def test_projection_checks_states(spark):
    from runfold.operators.index import check

    rows = project(frame(spark, stream(node_run("a", 0, 0, 0, 1, "odd"))).withColumn("header", __import__("pyspark.sql.functions", fromlist=["x"]).expr("CASE WHEN kind = 'run-started' THEN named_struct('run_id', 'r', 'pipeline', 'p', 'fingerprint_structural', 'f', 'fingerprint_policy', 'g', 'fingerprint_algorithm_version', 1L, 'parameters', '{}', 'data_interval', named_struct('start', 'a', 'end', 'b'), 'captured_environment', '{}', 'resume_lineage', named_struct('run_id', 'q', 'parent_run_id', 'q', 'lineage_root_run_id', 'q')) END")))
    assert rows["dag_run"].first().resumed_from == "q"
    with pytest.raises(Exception, match="no such state"):
        check("node_attempt", rows["node_attempt"]).collect()
