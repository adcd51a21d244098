"""For tests of pipelines: one task alone, a whole pipeline with scripted outcomes, structures held against a file, and the
runner's own time for a node."""

from __future__ import annotations

import difflib
import json
import os
import tempfile
import time
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfold.plans import runtime
from runfold.plans.graph import Pipeline
from runfold.schemas import RECORD
from runfold.sources.jsonl import EventWriter, canonical
from runfold.sources.local import Scratch, span_logger


class Lines:
    """A sink that keeps its lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def append(self, line: str) -> None:
        self.lines.append(line)

    def flush(self) -> None:
        pass

    def records(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([(x,) for x in self.lines], "value string")
        return rows.select(F.from_json("value", RECORD).alias("r")).select("r.*")


class Ticks:
    """A clock that goes on by a step each time it is asked."""

    def __init__(self, step: int = 1) -> None:
        self.now, self.step = -step, step

    def __call__(self) -> int:
        self.now += self.step
        return self.now


@dataclass
class Outcome:
    """What a task did: ``succeeded``, ``skipped``, ``retryable`` or ``failed``."""

    status: str
    value: object = None
    error: str | None = None
    metrics: dict = field(default_factory=dict)


def run_task(function, spark: SparkSession, *inputs: object, parameters: dict | None = None, resources: dict | None = None, attempt: int = 1, max_attempts: int = 1, cancelled: bool = False, covered: dict | None = None, scratch: str | None = None) -> Outcome:
    """One task with a context of its own, without a pipeline."""
    missing = sorted(set(getattr(function, "resources", ())) - set(resources or {}))
    if missing:
        raise ValueError(f"no resource {', '.join(missing)}")
    metrics: dict = {}
    kept = Scratch(scratch, "test", "task") if scratch else None
    ctx = runtime.Context(spark, "test", "test", "task", attempt, max_attempts, MappingProxyType(parameters or {}), None, MappingProxyType(resources or {}), MappingProxyType(covered or {}), lambda: cancelled, kept, None, metrics, span_logger("test", "task", attempt))
    try:
        return Outcome("succeeded", function(ctx, *inputs), metrics=metrics)
    except runtime.Skip as e:
        return Outcome("skipped", error=str(e), metrics=metrics)
    except Exception as e:
        return Outcome("retryable" if isinstance(e, runtime.Retryable) else "failed", error=f"{type(e).__name__}: {e}", metrics=metrics)


class Rehearsal:
    """A pipeline whose nodes do what a script says: ``ok``, ``fail``, ``retry``, ``skip`` or a value, one for each attempt.
    Nodes without a script succeed with nothing."""

    def __init__(self, pipeline: Pipeline):
        self.pipeline, self.scripts, self.calls = pipeline, {}, []

    def script(self, node: str, *steps: object) -> Rehearsal:
        self.scripts[node] = steps
        return self

    def _fake(self, name: str):
        def body(ctx: runtime.Context, *inputs: object) -> object:
            self.calls.append((name, ctx.attempt))
            steps = self.scripts.get(name, ("ok",))
            step = steps[min(ctx.attempt, len(steps)) - 1]
            if step == "fail":
                raise runtime.Permanent("scripted")
            if step == "retry":
                raise runtime.Retryable("scripted")
            if step == "skip":
                raise runtime.Skip("scripted")
            return None if step == "ok" else step

        return body

    def run(self, spark: SparkSession, **options: object) -> tuple[dict[str, str], DataFrame]:
        """The states, and the records of the stream, ready to be folded."""
        own = {n.name: n.run for n in self.pipeline.nodes}
        sink = Lines()
        try:
            for n in self.pipeline.nodes:
                n.run = self._fake(n.name)
            with tempfile.TemporaryDirectory() as base:
                states = runtime.run(self.pipeline, spark, EventWriter(sink, Ticks(), "rehearsal", self.pipeline.name), runtime.Options(**{"sleep": lambda s: None, "durable_base": base} | options))
        finally:
            for n in self.pipeline.nodes:
                n.run = own[n.name]
        return states, sink.records(spark)


def bless_structure(pipeline: Pipeline, path: str) -> None:
    """Writes what ``assert_structure`` holds a pipeline against."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(json.loads(canonical(pipeline.artifact(volatile=False))), indent=1, sort_keys=True) + "\n")


def assert_structure(pipeline: Pipeline, path: str) -> None:
    """An error with what differs, if a pipeline is not what was blessed."""
    now = json.dumps(json.loads(canonical(pipeline.artifact(volatile=False))), indent=1, sort_keys=True) + "\n"
    with open(path, encoding="utf-8") as f:
        then = f.read()
    if now != then:
        raise AssertionError("\n".join(difflib.unified_diff(then.splitlines(), now.splitlines(), "blessed", "now", lineterm="")))


def overhead_ns(spark: SparkSession, nodes: int = 1000) -> float:
    """The runner's time for each of so many nodes that do nothing: the whole run by their number."""
    p = Pipeline("overhead")
    for i in range(nodes):
        p.node(f"n{i:05}", run=lambda ctx: None)
    began = time.perf_counter_ns()
    states = runtime.run(p, spark, EventWriter(Lines(), time.monotonic_ns, "overhead", "overhead"))
    if set(states.values()) != {"succeeded"}:
        raise AssertionError("a node that does nothing failed")
    return (time.perf_counter_ns() - began) / nodes
