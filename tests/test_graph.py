import random

import pytest
from pyspark.sql import functions as F

from runfold.functions import rules
from runfold.operators import propagation
from runfold.operators.simulate import ReservedName, admissions, capped_metrics, pool_sizes
from runfold.plans import graph, runtime
from runfold.plans.graph import Pipeline, Policy
from runfold.schemas import class_of
from runfold.sources.jsonl import EventWriter


def small():
    p = Pipeline("p")
    a = p.node("a", output_type="T", task="A")
    b, c = p.node("b", a, output_type="T", task="B"), p.node("c", a, after=(a,), output_type="T", task="C")
    p.node("d", b, c, output_type="()", task="D")
    return p


def test_order_counts_and_fingerprint():
    p, q = small(), Pipeline("p")
    a = q.node("a", output_type="T", task="A")
    c, b = q.node("c", a, after=(a,), output_type="T", task="C"), q.node("b", a, output_type="T", task="B")
    q.node("d", b, c, output_type="()", task="D")
    assert p.order() == ["a", "b", "c", "d"] and p.consumer_counts() == {"a": 2, "b": 1, "c": 1, "d": 0} and p.remaining() == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert p.structural() == q.structural() and p.policy_hash() == q.policy_hash()
    q.nodes[-1].rule = "all-terminal"
    assert p.structural() != q.structural() and p.policy_hash() == q.policy_hash()
    assert graph.fnv1a(b"") == graph.FNV_OFFSET and graph.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_problems_are_all_found():
    p = Pipeline("bad")
    a = p.node("a", output_type="T")
    p.node("a", output_type="T")
    p.node("b", (a, "owned"), policy=Policy(retries=1, durable=True))
    p.node("c", (a, "owned"), policy=Policy(execution_class="compute", class_override="async"))
    p.teardown("t", a, policy=Policy(working_memory=5))
    assert {k for k, _ in p.problems()} == {"duplicate node name", "ownership-mode conflict", "durable node without the durable-output contract", "invalid execution-class override", "nonzero teardown cost"}
    assert Pipeline("none").problems() == [("empty pipeline", "none")]
    with pytest.raises(ValueError):
        Pipeline("other").node("x", a)
    assert small().warnings() == []


def test_drawings():
    assert '"a" -> "b";' in small().dot() and "style=dashed" in small().dot() and "n0 -.-> n2" in small().mermaid()


@pytest.mark.parametrize("seed", range(4))
def test_propagation_as_in_plain_python(spark, seed):
    rnd = random.Random(seed)
    nodes, edges, ran, want = [], [], [], {}
    for g in range(30):
        for i in range(rnd.randint(1, 9)):
            name, rule = f"n{i}", rnd.choice(["all-succeeded", "all-terminal", "any-failed"])
            ups = rnd.sample(range(i), min(i, rnd.randint(0, 3)))
            nodes.append((str(g), name, rule))
            edges += [(str(g), name, f"n{u}") for u in ups for _ in range(rnd.randint(1, 2))]
            own = rnd.choice(["succeeded", "failed", "skipped", "timed-out", "cancelled", "succeeded"])
            ran.append((str(g), name, own))
            verdict = rules.verdict(rule, [class_of(want[str(g), f"n{u}"]) for u in ups])
            want[str(g), name] = own if verdict == "run" else verdict
    got = propagation.propagate(spark.createDataFrame(nodes, "run_id string, node string, rule string"), spark.createDataFrame(edges or [("x", "y", "z")], "run_id string, consumer string, producer string"), spark.createDataFrame(ran, "run_id string, node string, state string"))
    assert {(r.run_id, r.node): r.state for r in got.collect()} == want


def test_origin(spark):
    edges = spark.createDataFrame([("r", "c", "a"), ("r", "c", "b"), ("r", "c", "s")], "run_id string, consumer string, producer string")
    states = spark.createDataFrame([("r", "s", "skipped", 1), ("r", "b", "failed", 2), ("r", "a", "failed", 3), ("r", "c", "upstream-failed", 4)], "run_id string, node string, state string, seq long")
    assert propagation.origins(edges, states).first().origin == "b"


def test_a_chain_of_a_thousand(spark):
    """The plan does not grow with the depth."""
    n = 1000
    nodes = spark.createDataFrame([("r", f"n{i:04}", "all-succeeded") for i in range(n)], "run_id string, node string, rule string")
    edges = spark.createDataFrame([("r", f"n{i:04}", f"n{i - 1:04}") for i in range(1, n)], "run_id string, consumer string, producer string")
    ran = nodes.select("run_id", "node", F.when(F.col("node") == "n0500", "failed").otherwise("succeeded").alias("state"))
    got = {r.node: r.state for r in propagation.propagate(nodes, edges, ran).collect()}
    assert got["n0499"] == "succeeded" and got["n0500"] == "failed" and got["n0501"] == got["n0999"] == "upstream-failed" and len(got) == n


def plain_resume(nodes, edges, state, refs, found):
    """The least set that holds what the rules say, and what must still be there."""
    again = {n for n, (_, covered) in nodes.items() if state.get(n) != "succeeded" or covered}
    while True:
        more = {c for c, p, _ in edges if p in again}
        more |= {p for c, p, k in edges if k == "data" and c in again and p not in again and not (nodes[p][0] and refs.get(p))}
        if more <= again:
            break
        again |= more
    read = {p for c, p, k in edges if k == "data" and c in again and p not in again}
    return again, {p: refs[p] for p in read}, {p for p in read if found.get(p) in ("absent", "changed")}


@pytest.mark.parametrize("seed", range(3))
def test_resume_as_in_plain_python(spark, seed):
    rnd, rows, arcs, prior, probes, want = random.Random(seed), [], [], [], [], {}
    for g in range(40):
        names = [f"n{i}" for i in range(rnd.randint(1, 9))]
        nodes = {n: (rnd.random() < 0.6, rnd.random() < 0.05) for n in names}
        edges = [(names[i], names[j], rnd.choice(["data", "data", "ordering"])) for i in range(len(names)) for j in rnd.sample(range(i), min(i, rnd.randint(0, 3)))]
        state = {n: rnd.choice(["succeeded"] * 8 + ["failed", "satisfied-from-prior", "skipped"]) for n in names if rnd.random() < 0.97}
        refs = {n: f"t/{n}" for n in state if rnd.random() < 0.85}
        found = {n: rnd.choice(["present"] * 6 + ["unknown", "absent", "changed"]) for n in names if rnd.random() < 0.9}
        rows += [(str(g), n, *f) for n, f in nodes.items()]
        arcs += [(str(g), *e) for e in edges]
        prior += [(str(g), n, s, refs.get(n), None if rnd.random() < 0.8 else "older") for n, s in state.items()]
        probes += [(str(g), n, f) for n, f in found.items()]
        want[str(g)] = plain_resume(nodes, edges, state, refs, found)
    before = spark.createDataFrame(prior, "run_id string, node string, state string, durable_reference string, originating_run string")
    plan = propagation.resume(spark.createDataFrame(rows, "run_id string, node string, durable boolean, covered boolean"), spark.createDataFrame(arcs, "run_id string, consumer string, producer string, kind string"), before, spark.createDataFrame(probes, "run_id string, node string, found string")).persist()
    got = {}
    for r in plan.collect():
        again, read, refused = got.setdefault(r.run_id, (set(), {}, set()))
        again |= {r.node} if r.decision == "run" else set()
        read |= {r.node: r.rehydrate} if r.rehydrate else {}
        refused |= {r.node} if r.refusal else set()
        assert (r.originating_run is None) == (r.decision == "run")
    assert got == want
    records = propagation.resumed_records(plan.where("run_id = '0'"), before, "again")
    assert {r.node for r in records.collect()} == {r.node for r in plan.where("run_id = '0' AND decision <> 'run'").collect()}
    assert propagation.lineage("b", {"lineage_root_run_id": "a"}) == {"run_id": "b", "parent_run_id": "b", "lineage_root_run_id": "a"} and propagation.lineage("a", None)["lineage_root_run_id"] == "a"


def test_ordering_edges_and_missing_references(spark):
    nodes = spark.createDataFrame([("r", n, d, False) for n, d in (("a", False), ("b", True), ("c", True), ("d", True))], "run_id string, node string, durable boolean, covered boolean")
    edges = spark.createDataFrame([("r", "b", "a", "ordering"), ("r", "d", "c", "data")], "run_id string, consumer string, producer string, kind string")
    prior = spark.createDataFrame([("r", "a", "failed", None, None), ("r", "b", "succeeded", "t/b", None), ("r", "c", "succeeded", None, None), ("r", "d", "failed", None, None)], "run_id string, node string, state string, durable_reference string, originating_run string")
    plan = propagation.resume(nodes, edges, prior, spark.createDataFrame([], "run_id string, node string, found string"))
    # b comes after a, which runs again; c is durable by its policy, but nothing is on record to read
    assert {r.node for r in plan.where("decision = 'run'").collect()} == {"a", "b", "c", "d"}
    refs = spark.createDataFrame([("b", "x"), ("c", None)], "node string, durable_reference string")
    assert propagation.not_replayable("d", edges, refs).count() == 1


def test_gate_and_scalars(spark):
    lit = {k: F.lit(v) for k, v in {"algorithm": 1, "tool": "1", "structural": "fnv1a-64:v1:00FF", "policy": "aa"}.items()}
    one = spark.range(1)
    gate = lambda **k: one.select(rules.resume_gate(lit, lit | {x: F.lit(v) for x, v in k.items()}).alias("g")).first().g
    assert gate(structural="00ff") == "proceed" and gate(policy="bb") == "proceed: policy differs" and gate(structural="0") == "refused: structure" and gate(tool="2", structural="0") == "refused: tool version" and gate(algorithm=2, tool="2") == "refused: fingerprint algorithm"
    r = one.select(rules.duration_ns(F.lit("10")).alias("a"), rules.duration_ns(F.lit("10ms")).alias("b"), rules.duration_ns(F.lit("x")).alias("c"), rules.rfc3339(F.lit(1500)).alias("d"), rules.stable_name(F.lit("a b")).alias("e"), rules.blob_reference(F.lit("x-blob+local://base/sha256/ab12"))["digest"].alias("f"), rules.backoff_ms(F.lit(3), F.lit(10.0), F.lit(2.0), F.lit(50.0)).alias("g")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (10_000_000_000, 10_000_000, None, "1970-01-01T00:00:01.500Z", False, "ab12", 50.0)


def test_prune_and_overlay(spark):
    runs = spark.createDataFrame([("d", f"r{i}", i * 10) for i in range(5)], "dag_id string, run_id string, at_ms long")
    assert sorted(r.run_id for r in graph.prunable(runs, 3).collect()) == ["r0", "r1"] and graph.prunable(runs, 9, 15).count() == 2
    tries = spark.createDataFrame([("a", 1, "failed", 5, 1), ("a", 2, "succeeded", 7, 2), ("x", 1, "failed", 1, 3)], "node string, attempt int, status string, total_ns long, seq long")
    got = {r.node: (r.state, r.total_ns, r.in_graph) for r in graph.overlay(small().tables(spark)[0], tries).collect()}
    assert got["a"] == ("succeeded", 12, True) and got["b"] == ("not-run", 0, True) and got["x"] == ("failed", 1, False)
    with pytest.raises(ValueError):
        graph.unreachable(runs, runs, certain=False)


def test_admission(spark):
    rows = [("r", "a", 0, 10, 6, 0, 0, 0), ("r", "b", 1, 10, 6, 0, 0, 0), ("r", "c", 2, 5, 4, 0, 0, 0), ("r", "x", 3, 1, 99, 0, 0, 0)]
    demands = spark.createDataFrame(rows, "run_id string, node string, ready long, spent long, memory long, blocking long, compute long, remote long")
    got = {r.node: (r.admitted_ns, r.outcome) for r in admissions(demands, {"memory": 10}).collect()}
    assert got == {"a": (0, "admitted"), "b": (10, "admitted"), "c": (2, "admitted"), "x": (3, "never fits")}
    strict = {r.node: r.admitted_ns for r in admissions(demands, {"memory": 10}, overtake=False).collect()}
    assert strict["c"] == 10
    assert capped_metrics({"b" * 90: 1.0, "a": 1.0, "c": 2.0}, most_bytes=30) == ({"a": 1.0, "c": 2.0}, 1)
    with pytest.raises(ReservedName, match="run.x"):
        capped_metrics({"run.x": 1.0})
    assert pool_sizes([None, 1000, 9000], [None, 0.5]) == {"memory": 800, "blocking": 1, "compute": 1, "remote": 0} and pool_sizes([], [], {"memory": 7})["memory"] == 7


def test_run_retries_propagates_and_tears_down(spark, tmp_path):
    class Lines:
        def __init__(self):
            self.lines = []

        def append(self, line):
            self.lines.append(line)

        def flush(self):
            pass

    tries = []

    def flaky(ctx, df):
        tries.append(ctx.attempt)
        if ctx.attempt == 1:
            raise runtime.Retryable("again")
        return df.selectExpr("id * 2 AS id")

    def broken(ctx, df):
        raise ValueError("no")

    p, seen = Pipeline("demo"), {}
    src = p.node("src", run=lambda ctx: ctx.spark.range(5))
    good = p.node("good", src, policy=Policy(retries=2, durable=True), contract=True, run=flaky)
    bad = p.node("bad", src, run=broken)
    p.node("after_bad", bad, run=lambda ctx, df: df)
    p.node("on_failure", rule="any-failed", after=(bad,), run=lambda ctx: None)
    p.teardown("clean", good, run=lambda ctx: seen.update(ctx.covered))
    sink, ticks = Lines(), iter(range(10_000))
    states = runtime.run(p, spark, EventWriter(sink, lambda: next(ticks), "r1", "demo"), runtime.Options(durable_base=str(tmp_path), sleep=lambda s: None))
    assert states == {"src": "succeeded", "good": "succeeded", "bad": "failed", "after_bad": "upstream-failed", "on_failure": "succeeded", "clean": "succeeded"}
    assert tries == [1, 2] and seen == {"good": "succeeded"} and sorted(r.id for r in spark.read.parquet(f"{tmp_path}/r1/good").collect()) == [0, 2, 4, 6, 8]
    from runfold.operators import fold
    from runfold.schemas import RECORD

    records = spark.createDataFrame([(x,) for x in sink.lines], "value string").select(F.from_json("value", RECORD).alias("r")).select("r.*")
    assert fold.sequence_gaps(records).count() == 0 and fold.runs(records).first().outcome == "failed"
    assert {(r.node, r.attempt, r.status) for r in fold.attempts(records).collect()} >= {("good", 1, "failed"), ("good", 2, "succeeded"), ("after_bad", 1, "upstream-failed")}
    second = runtime.run(p, spark, EventWriter(Lines(), lambda: 0, "r2", "demo"), runtime.Options(durable_base=str(tmp_path), satisfied={"good": "r1"}))
    assert second["good"] == "satisfied-from-prior"
    assert runtime.setting("a", {}, {"RUNFOLD_A": "2"}, {"a": "3"}) == "2"


def test_blobs(spark, tmp_path):
    from runfold.sources import blobs

    store = blobs.BlobStore(spark, str(tmp_path / "b"))
    key = store.put(b"foo")
    assert key.startswith("2c26b46b") and store.get(key) == b"foo"
    (tmp_path / "b" / ("0" * 64)).write_bytes(b"bar")
    assert {r.key[:4]: r.sound for r in blobs.held(spark, str(tmp_path / "b"), verify=True).collect()} == {"2c26": True, "0000": False}
    with pytest.raises(ValueError):
        store.get("0" * 64)
    lines = spark.createDataFrame([("a", 0, "header", None), ("a", 1, "x", None), ("a", 2, "trailer", 1), ("b", 0, "header", None), ("b", 1, "trailer", 3)], "path string, line int, kind string, n long")
    assert {r.path: r.whole for r in blobs.shard_status(lines).collect()} == {"a": True, "b": False}
