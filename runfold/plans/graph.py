"""Pipelines as graphs: building, checking, ordering, fingerprints, differences. Graphs have a thousand nodes at most and
live on the driver; their node and edge tables are DataFrames for everything that meets runs."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.sources.jsonl import canonical

# The execution classes in order, and the digest's constants.
CLASS_CODES = {"async": 0, "blocking": 1, "compute": 2}
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
ALGORITHM = 1
MOST_INPUTS = 8


@dataclass(frozen=True)
class Policy:
    retries: int = 0
    base_ns: int = 0
    factor: float = 2.0
    cap_ns: int = 2**64 - 1
    timeout_ns: int | None = None
    working_memory: int = 0
    output_residency: int = 0
    blocking_threads: int = 0
    compute_threads: int = 0
    execution_class: str = "async"
    class_override: str | None = None
    retained: bool = False
    durable: bool = False
    teardown: bool = False
    placement: tuple[tuple[str, str], ...] | None = None

    @property
    def cost(self) -> tuple[int, int, int, int]:
        return self.working_memory, self.output_residency, self.blocking_threads, self.compute_threads


@dataclass(frozen=True)
class Handle:
    """A claim on a node's output; only registering a node gives one, so a cycle can't be written down."""

    name: str
    pipeline: int


@dataclass
class Node:
    name: str
    inputs: list[tuple[Handle, str]] = field(default_factory=list)
    after: list[Handle] = field(default_factory=list)
    rule: str = "all-succeeded"
    policy: Policy = Policy()
    task: str | None = None
    input_types: tuple[str, ...] = ()
    output_type: str | None = None
    group: str | None = None
    contract: bool = False
    covers: list[str] = field(default_factory=list)
    run: object = None


class Pipeline:
    def __init__(self, name: str, env: tuple[str, ...] = ()):
        self.name, self.env, self.nodes = name, env, []

    def node(self, name: str, *inputs: Handle | tuple[Handle, str], after: tuple[Handle, ...] = (), **kw: object) -> Handle:
        """Registers a node. Inputs are handles, shared unless given with a mode (``shared``, ``clone`` or ``owned``)."""
        if len(inputs) > MOST_INPUTS:
            raise ValueError(f"{name}: more than {MOST_INPUTS} inputs")
        pairs = [i if isinstance(i, tuple) else (i, "shared") for i in inputs]
        for h in (*(p[0] for p in pairs), *after):
            if h.pipeline != id(self):
                raise ValueError(f"{name}: {h.name} is a handle of another pipeline")
        self.nodes.append(Node(name, pairs, list(after), **kw))
        return Handle(name, id(self))

    def teardown(self, name: str, *covers: Handle, policy: Policy = Policy(), **kw: object) -> Handle:
        from dataclasses import replace

        return self.node(name, after=covers, rule="all-terminal", policy=replace(policy, teardown=True), covers=[c.name for c in covers], **kw)

    def ordered(self) -> list[Node]:
        return sorted(self.nodes, key=lambda n: n.name)

    # -- checks ---------------------------------------------------------------------------------------------------

    def problems(self) -> list[tuple[str, str]]:
        """(kind, message) of everything that is wrong."""
        out = [("duplicate node name", f"{n} is declared {k} times") for n, k in sorted(Counter(x.name for x in self.nodes).items()) if k > 1]
        if not self.nodes:
            out.append(("empty pipeline", self.name))
        readers: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for n in self.ordered():
            p = n.policy
            if p.class_override and p.class_override not in CLASS_CODES or p.class_override and CLASS_CODES[p.class_override] < CLASS_CODES[p.execution_class]:
                out.append(("invalid execution-class override", f"{n.name}: {p.execution_class} as {p.class_override}"))
            if p.durable and not n.contract:
                out.append(("durable node without the durable-output contract", n.name))
            if p.teardown and any(p.cost):
                out.append(("nonzero teardown cost", n.name))
            for h, mode in n.inputs:
                readers[h.name].append((n.name, mode))
                if mode == "owned" and p.retries:
                    out.append(("ownership-mode conflict", f"{n.name} retries and owns {h.name}"))
        for producer, own in sorted(readers.items()):
            if len(own) > 1:
                out += [("ownership-mode conflict", f"{who} owns {producer}, which has {len(own)} consumers") for who, mode in own if mode == "owned"]
        return out

    def warnings(self) -> list[str]:
        used = self.consumer_counts()
        return [n.name for n in self.ordered() if not used[n.name] and n.output_type not in (None, "()") and not n.policy.retained and not n.policy.durable]

    def consumer_counts(self) -> dict[str, int]:
        """Data edges out of each node, repeated ones counted."""
        return {n.name: 0 for n in self.nodes} | Counter(h.name for n in self.nodes for h, _ in n.inputs)

    def remaining(self) -> dict[str, int]:
        """Different nodes that each waits for, by data or order."""
        return {n.name: len({h.name for h, _ in n.inputs} | {h.name for h in n.after}) for n in self.nodes}

    def order(self) -> list[str]:
        """Topological order; of the nodes that are ready, the smallest name comes first."""
        left, out, nexts = self.remaining(), [], defaultdict(set)
        for n in self.nodes:
            for h in (*(i[0] for i in n.inputs), *n.after):
                nexts[h.name].add(n.name)
        ready = [n for n, k in left.items() if not k]
        heapq.heapify(ready)
        while ready:
            out.append(n := heapq.heappop(ready))
            for m in nexts[n]:
                left[m] -= 1
                if not left[m]:
                    heapq.heappush(ready, m)
        return out

    # -- fingerprints ---------------------------------------------------------------------------------------------

    def structure(self) -> dict:
        """Names, types, rules and edges: what a resume must find unchanged."""
        types = {n.name: n.output_type if n.task else None for n in self.nodes}
        nodes = [{"name": n.name, "rule": n.rule, "task": n.task, "inputs": list(n.input_types) if n.task else [], "output": n.output_type if n.task else None} for n in self.ordered()]
        data = sorted((n.name, k, h.name) for n in self.nodes for k, (h, _) in enumerate(n.inputs))
        return {"nodes": nodes, "data": [[c, k, p, types.get(p)] for c, k, p in data], "ordering": [list(e) for e in sorted({(n.name, h.name) for n in self.nodes for h in n.after})]}

    def policies(self) -> dict:
        """Retries, backoff, timeouts, costs, classes and flags."""
        out = {}
        for n in self.ordered():
            own = asdict(n.policy)
            own["execution_class"] = own.pop("class_override") or own["execution_class"]
            own["placement"] = None if n.policy.placement is None else sorted(map(list, n.policy.placement))
            out[n.name] = own
        return out

    def structural(self) -> str:
        return digest(self.structure())

    def policy_hash(self) -> str:
        return digest(self.policies())

    # -- artifact -------------------------------------------------------------------------------------------------

    def artifact(self, volatile: bool = True) -> dict:
        """The graph as one JSON object: nodes, edges by name, order and fingerprints. Without ``volatile``, only what a
        review compares: no environment and no policies' fingerprint."""
        deps = {n.name: sorted({h.name for h, _ in n.inputs} | {h.name for h in n.after}) for n in self.nodes}
        nodes = [
            {"name": n.name, "group": n.group, "task_name": n.task, "input_type_names": list(n.input_types), "output_type_name": n.output_type, "execution_class": n.policy.class_override or n.policy.execution_class,
             "trigger_rule": n.rule, "policy": self.policies()[n.name], "dependencies": deps[n.name], "covers": sorted(n.covers)} for n in self.ordered()
        ]
        edges = [{"from": p, "to": c, "kind": kind, **({"type_name": t} if t else {})} for c, p, kind, t in sorted([(n.name, h.name, "data", next(m.output_type for m in self.nodes if m.name == h.name)) for n in self.nodes for h, _ in n.inputs] + [(n.name, h.name, "ordering", None) for n in self.nodes for h in n.after], key=lambda e: (e[0], e[1], e[2]))]
        out = {"pipeline": self.name, "nodes": nodes, "edges": edges, "order": self.order(), "fingerprint_structural": self.structural()}
        return out | ({"fingerprint_policy": self.policy_hash(), "environment": list(self.env)} if volatile else {})

    # -- tables ---------------------------------------------------------------------------------------------------

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges): name, rule, group, task, output_type, policy flags; consumer, producer, kind, position."""
        nodes = [(n.name, n.rule, n.group, n.task, n.output_type, n.policy.retries, n.policy.durable, n.policy.retained, n.policy.teardown) for n in self.ordered()]
        edges = [(n.name, h.name, "data", k) for n in self.ordered() for k, (h, _) in enumerate(n.inputs)] + [(c, p, "ordering", None) for c, p in sorted({(n.name, h.name) for n in self.nodes for h in n.after})]
        return (
            spark.createDataFrame(nodes, "node string, rule string, group string, task string, output_type string, retries int, durable boolean, retained boolean, teardown boolean"),
            spark.createDataFrame(edges, "consumer string, producer string, kind string, position int"),
        )

    # -- drawings -------------------------------------------------------------------------------------------------

    def dot(self, states: dict[str, str] | None = None) -> str:
        s_ = short  # labels are cut, names are not
        q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = [f"  {q(n.name)}" + (f" [label={q(s_(n.name) + ': ' + states[n.name])}]" if states and n.name in states else "") + ";" for n in self.ordered()]
        lines += [f"  {q(p)} -> {q(c)}" + (" [style=dashed]" if kind == "ordering" else "") + ";" for c, p, kind in self._edges()]
        return "\n".join([f"digraph {q(self.name)} {{", *lines, "}"])

    def mermaid(self) -> str:
        at = {n.name: f"n{i}" for i, n in enumerate(self.ordered())}
        esc = lambda s: s.replace('"', "#quot;")
        return "\n".join(["flowchart TD", *(f'  {i}["{esc(short(n))}"]' for n, i in at.items()), *(f"  {at[p]} {'-.->' if kind == 'ordering' else '-->'} {at[c]}" for c, p, kind in self._edges())])

    def _edges(self) -> list[tuple[str, str, str]]:
        return sorted({(n.name, h.name, "data") for n in self.nodes for h, _ in n.inputs} | {(n.name, h.name, "ordering") for n in self.nodes for h in n.after})


def short(label: str, most: int = 60) -> str:
    """A label that fits in a drawing: its beginning and its end."""
    return label if len(label) <= most else label[: most // 2 - 1] + "…" + label[-(most - most // 2) :]


def edge_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between positions with the names of their ends. nodes: place, node; edges: producer_place, consumer_place and
    more; an edge to a place that is not there is left out."""
    ends = [nodes.select(F.col("place").alias(f"{e}_place"), F.col("node").alias(e)) for e in ("producer", "consumer")]
    return edges.join(ends[0], "producer_place").join(ends[1], "consumer_place").drop("producer_place", "consumer_place")


def digest(value: object) -> str:
    """The digest of a value's canonical JSON."""
    return f"{fnv1a(canonical(value).encode()):016x}"


def fnv1a(raw: bytes) -> int:
    h = FNV_OFFSET
    for b in raw:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two snapshots by key: ``added``, ``removed``, or ``changed`` in some other column."""
    rest = [c for c in old.columns if c not in key]
    body = F.to_json(F.struct(*rest)) if rest else F.lit("")
    a, b = old.select(*key, body.alias("a")).distinct(), new.select(*key, body.alias("b")).distinct()
    added = b.join(a, key, "left_anti").select(*key, F.lit("added").alias("change"))
    removed = a.join(b, key, "left_anti").select(*key, F.lit("removed").alias("change"))
    changed = a.join(b, key).where("a <> b").select(*key, F.lit("changed").alias("change")).distinct()
    return added.unionByName(removed).unionByName(changed)


def overlay(nodes: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each node with its state in a run (its last attempt's; ``not-run`` without one) and its summed time; nodes that only
    the run has come last, as ``unknown``."""
    own = attempts.groupBy("node").agg(F.max_by("status", F.struct("attempt", "seq")).alias("state"), F.sum("total_ns").alias("total_ns"))
    known = nodes.select("node").join(own, "node", "left").select("node", F.coalesce("state", F.lit("not-run")).alias("state"), F.coalesce("total_ns", F.lit(0)).alias("total_ns"), F.lit(True).alias("in_graph"))
    extra = own.join(nodes.select("node"), "node", "left_anti").select("node", "state", "total_ns", F.lit(False).alias("in_graph"))
    return known.unionByName(extra)


def capacity_violations(demands: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(node, pool, demand, capacity) where one node asks for more of a pool than there is. demands: node and a column per pool."""
    pools = [c for c in demands.columns if c != "node"]
    long = demands.unpivot(["node"], pools, "pool", "demand")
    capacity = F.coalesce(*(F.when(F.col("pool") == p, F.lit(totals[p])) for p in pools))
    return long.withColumn("capacity", capacity.cast("long")).where("demand > capacity")


def unreachable(held: DataFrame, reachable: DataFrame, certain: bool = True) -> DataFrame:
    """Blobs that no kept run refers to. If what is reachable isn't certain, nothing may be swept."""
    if not certain:
        raise ValueError("a kept run could not be read; nothing is swept")
    return held.join(reachable, "key", "left_anti")


def prunable(runs: DataFrame, keep: int, oldest_ms: int | None = None) -> DataFrame:
    """Runs beyond the newest ``keep`` of each pipeline, or older than a time."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("dag_id").orderBy(F.desc("at_ms"), "run_id"))
    old = F.lit(False) if oldest_ms is None else F.col("at_ms") < oldest_ms
    return runs.withColumn("rank", rank).where((F.col("rank") > keep) | old).drop("rank")
