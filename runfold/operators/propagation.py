"""State propagation and resume over node and edge tables, for many runs at once.

What needs one look at a node's upstreams is relational. What walks a graph (the cascade, the closure of a resume) walks
each run's graph in one function: a run has a thousand nodes at most, its nodes and edges meet in one shuffle by run_id,
and the plan is the same whatever the depth.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.functions import rules
from runfold.schemas import class_of, state_class


def decisions(edges: DataFrame, states: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each (run_id, node) whose upstreams are all terminal: what its rule says (``run`` or a state). edges: run_id,
    consumer, producer; states: run_id, node, state; nodes: run_id, node, rule."""
    up = edges.select("run_id", F.col("consumer").alias("node"), "producer").distinct()
    met = up.join(states.select("run_id", F.col("node").alias("producer"), "state"), ["run_id", "producer"], "left")
    c = state_class(F.col("state"))
    sums = met.groupBy("run_id", "node").agg(F.count("*").alias("n"), F.count("state").alias("known"), *(F.count_if(c == k).alias(k) for k in ("success", "skip", "failure", "stop")))
    out = nodes.select("run_id", "node", "rule").join(sums, ["run_id", "node"], "left").na.fill(0)
    return out.where("n = known").select("run_id", "node", rules.decide(F.col("rule"), *(F.col(k) for k in ("n", "success", "skip", "failure", "stop"))).alias("decision"))


ARROW = {"string": pa.string(), "boolean": pa.bool_()}


def by_run(nodes: DataFrame, edges: DataFrame, fields: list[str], walk: Callable, schema: str) -> DataFrame:
    """Rows that ``walk`` makes of each run's nodes (dicts of node and the fields) and edges (consumer, producer, kind). A
    run's nodes and edges come together in one row; many runs are walked in one batch."""
    kind = F.col("kind") if "kind" in edges.columns else F.lit("data")
    own = nodes.select("run_id", F.struct("node", *fields).alias("n"), F.lit(None).cast("struct<consumer:string,producer:string,kind:string>").alias("e"))
    arcs = edges.select("run_id", F.lit(None).cast(own.schema["n"].dataType).alias("n"), F.struct("consumer", "producer", kind.alias("kind")).alias("e"))
    whole = own.unionByName(arcs).groupBy("run_id").agg(F.collect_list("n").alias("ns"), F.collect_list("e").alias("es"))
    columns = [tuple(c.split()) for c in f"run_id string, {schema}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ns = sorted(r["ns"], key=lambda n: n["node"])
                es = sorted({(e["consumer"], e["producer"], e["kind"]) for e in r["es"]})
                rows += [(r["run_id"], *x) for x in walk(ns, es)]
            made = list(zip(*rows)) if rows else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays([pa.array(v, ARROW[k]) for v, (_, k) in zip(made, columns)], names=[n for n, _ in columns])

    return whole.mapInArrow(run, f"run_id string, {schema}")


def cascade(nodes: list[dict], edges: list[tuple[str, str, str]]) -> list[tuple]:
    """The states of one run's nodes: each is decided once, when the last of its upstreams has ended."""
    ups, downs = defaultdict(set), defaultdict(set)
    for consumer, producer, _ in edges:
        ups[consumer].add(producer)
        downs[producer].add(consumer)
    own = {n["node"]: n for n in nodes}
    waits = {n: len(ups[n] & own.keys()) for n in own}
    ready, states = deque(sorted(n for n, k in waits.items() if not k)), {}
    while ready:
        node = ready.popleft()
        counts = [class_of(states[u]) for u in ups[node] if u in own]
        verdict = rules.verdict(own[node]["rule"], counts)
        state = own[node]["own"] if verdict == "run" else verdict
        if state is None:  # it runs, and nothing says how it ended
            continue
        states[node] = state
        for down in sorted(downs[node]):
            if down in own:
                waits[down] -= 1
                if not waits[down]:
                    ready.append(down)
    return list(states.items())


def propagate(nodes: DataFrame, edges: DataFrame, ran: DataFrame) -> DataFrame:
    """The states of all nodes, given what those that run end as. ``ran``: run_id, node, state. A node that runs but isn't
    in ``ran`` stays undecided, and so does what hangs on it."""
    known = nodes.select("run_id", "node", "rule").join(ran.select("run_id", "node", F.col("state").alias("own")), ["run_id", "node"], "left")
    return by_run(known, edges, ["rule", "own"], cascade, "node string, state string")


def origins(edges: DataFrame, states: DataFrame) -> DataFrame:
    """For each node that a propagated state reached: the upstream that decided it, the earliest recorded one of the
    deciding class, else the earliest that is no success. states: run_id, node, state, seq."""
    own = states.where("state IN ('upstream-failed', 'upstream-skipped', 'cancelled')").select("run_id", F.col("node").alias("consumer"), F.col("state").alias("own"))
    up = edges.select("run_id", "consumer", "producer").distinct().join(states.select("run_id", F.col("node").alias("producer"), "state", "seq"), ["run_id", "producer"])
    both = own.join(up, ["run_id", "consumer"]).where(state_class(F.col("state")) != "success")
    same = state_class(F.col("state")) == state_class(F.col("own"))
    return both.groupBy("run_id", F.col("consumer").alias("node")).agg(F.min_by("producer", F.struct((~same).alias("other"), "seq", "producer")).alias("origin"))


def resumption(nodes: list[dict], edges: list[tuple[str, str, str]]) -> list[tuple]:
    """What a resume does with each node of one run; see ``resume``."""
    own = {n["node"]: n for n in nodes}
    downs, inputs = defaultdict(set), defaultdict(set)
    for consumer, producer, kind in edges:
        downs[producer].add(consumer)  # by data or by order
        if kind == "data":
            inputs[consumer].add(producer)
    seed = {k for k, n in own.items() if n["state"] != "succeeded" or n["covered"]}
    again, todo, demanded = set(), deque(sorted(seed)), set()
    while todo:
        node = todo.popleft()
        if node in again or node not in own:
            continue
        again.add(node)
        todo.extend(sorted(downs[node]))
        for p in sorted(inputs[node] & own.keys()):
            n = own[p]
            stands = n["state"] == "succeeded" and n["durable"] and n["durable_reference"] is not None
            demanded |= {p} if stands else set()
            todo.extend([] if stands else [p])
    out = []
    for k, n in own.items():
        read = k in demanded and k not in again
        refusal = {"absent": "dangling reference", "changed": "mutated reference"}.get(n["found"]) if read else None
        out.append((k, "run" if k in again else "satisfied-from-prior", k in seed, n["durable_reference"] if read else None, refusal, None if k in again else n["originating_run"]))
    return out


def resume(nodes: DataFrame, edges: DataFrame, prior: DataFrame, probes: DataFrame) -> DataFrame:
    """For each run to resume, what becomes of its nodes: node, decision (``run`` or ``satisfied-from-prior``), seed,
    rehydrate (the durable reference that something that runs will read), refusal and originating_run.

    A node runs again if it did not succeed before (a state carried over from an earlier resume counts as not), if a
    teardown covers it, if something upstream of it runs again, by data or by order, or if something that runs again
    reads from it and it has no durable output on record. Outputs that are read again are looked for: if one is gone or
    not what it was, the resume is refused; if nothing can be told, it goes on.

    nodes: run_id, node, durable, covered; edges: run_id, consumer, producer, kind (``data`` or ``ordering``); prior:
    run_id, node, state, durable_reference, originating_run; probes: run_id, node, found (``present``, ``absent``,
    ``changed`` or ``unknown``).
    """
    before = prior.select("run_id", "node", "state", "durable_reference", F.coalesce("originating_run", "run_id").alias("originating_run"))
    known = nodes.select("run_id", "node", F.coalesce("durable", F.lit(False)).alias("durable"), F.coalesce("covered", F.lit(False)).alias("covered")).join(before, ["run_id", "node"], "left").join(probes.select("run_id", "node", "found"), ["run_id", "node"], "left")
    fields = ["durable", "covered", "state", "durable_reference", "originating_run", "found"]
    return by_run(known, edges, fields, resumption, "node string, decision string, seed boolean, rehydrate string, refusal string, originating_run string")


def resumed_records(plan: DataFrame, prior: DataFrame, run_id: str) -> DataFrame:
    """What a resumed run's stream says of nodes that aren't run again: a terminal record for each, with the reference and
    the run that it comes from. plan: what ``resume`` gave; prior: as there."""
    kept = plan.where("decision = 'satisfied-from-prior'").select(F.col("run_id").alias("parent"), "node", "originating_run")
    refs = prior.select(F.col("run_id").alias("parent"), "node", "durable_reference")
    out = kept.join(refs, ["parent", "node"], "left")
    return out.select(F.lit(run_id).alias("run_id"), F.lit("node-terminal").alias("kind"), "node", F.lit("satisfied-from-prior").alias("state"), "durable_reference", F.col("originating_run").alias("satisfied_from_run"))


def lineage(parent: str, parent_lineage: dict | None) -> dict:
    """A resumed run's lineage: the run it resumes, and the first of the line."""
    return {"run_id": parent, "parent_run_id": parent, "lineage_root_run_id": (parent_lineage or {}).get("lineage_root_run_id") or parent}


def not_replayable(node: str, edges: DataFrame, references: DataFrame) -> DataFrame:
    """Inputs of a node without a durable reference; with none of these, the node can be run alone."""
    up = edges.where(F.col("consumer") == node).select(F.col("producer").alias("node")).distinct()
    return up.join(references.where("durable_reference IS NOT NULL").select("node"), "node", "left_anti")
