"""Explicit schemas and closed vocabularies. Unknown fields drop out of a read, missing ones are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of the event stream and the index.
SUCCESS_LIKE = ("succeeded", "satisfied-from-prior")
SKIP_LIKE = ("skipped", "upstream-skipped")
FAILURE_LIKE = ("failed", "timed-out", "abandoned", "upstream-failed")
STOP_LIKE = ("cancelled",)
TERMINAL_STATES = (*SUCCESS_LIKE, *SKIP_LIKE, *FAILURE_LIKE, *STOP_LIKE)
RUN_OUTCOMES = ("succeeded", "failed", "cancelled", "assembly-failed", "bootstrap-failed")
PRE_EXECUTION = ("assembly-failed", "bootstrap-failed")
EVENT_KINDS = ("run-started", "node-ready", "node-admitted", "attempt-started", "attempt-succeeded", "attempt-failed", "attempt-outcome", "output-produced", "attempt-submitted", "node-terminal", "zombie-at-exit", "run-finished")
TRIGGER_RULES = ("all-succeeded", "all-terminal", "any-failed")
POOLS = ("memory", "blocking-threads", "compute-threads", "remote-slots")

_REF = T.StructType([T.StructField("uri", T.StringType()), T.StructField("content_hash", T.StringType())])
_META = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("scheme", T.StringType()), T.StructField("produced_at_offset_ns", T.LongType())])
_LINEAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "parent_run_id", "lineage_root_run_id")])
_INTERVAL = T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])
_HEADER = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("run_id", "pipeline", "fingerprint_structural", "fingerprint_policy")),
    T.StructField("fingerprint_algorithm_version", T.LongType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("data_interval", _INTERVAL),
    T.StructField("captured_environment", T.StringType()),
    T.StructField("resume_lineage", _LINEAGE),
])

#: One record of the stream, all kinds in one struct. Opaque JSON objects stay text.
RECORD = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("wall", T.StringType()), T.StructField("offset_ns", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("header", _HEADER), T.StructField("node", T.StringType()), T.StructField("attempt", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("state", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("worker", T.StringType()), T.StructField("pool", T.StringType()), T.StructField("thread", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("error", T.StringType()), T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cost_declared", T.StringType()), T.StructField("cost_measured", T.StringType()),
    T.StructField("durable_reference", T.StringType()), T.StructField("durable_reference_meta", _META),
    T.StructField("satisfied_from_run", T.StringType()), T.StructField("originating_node", T.StringType()),
    T.StructField("inputs", T.ArrayType(_REF)), T.StructField("slot_residency", T.LongType()), T.StructField("retained", T.BooleanType()),
    T.StructField("pinned_capacity", T.LongType()), T.StructField("uri", T.StringType()), T.StructField("content_hash", T.StringType()),
    T.StructField("size_bytes", T.LongType()), T.StructField("output_kind", T.StringType()), T.StructField("produced_at_offset_ns", T.LongType()),
    T.StructField("originating_run", T.StringType()), T.StructField("executor", T.StringType()), T.StructField("target_name", T.StringType()),
    T.StructField("observed_name", T.StringType()), T.StructField("observed_uid", T.StringType()), T.StructField("observed_host", T.StringType()),
    T.StructField("structural_fingerprint", T.StringType()), T.StructField("policy_hash", T.StringType()), T.StructField("tool_version", T.StringType()),
    T.StructField("image_digest", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType())),
])


def state_class(state: Column) -> Column:
    """The class of a terminal state; null for anything else."""
    return F.when(state.isin(*SUCCESS_LIKE), "success").when(state.isin(*SKIP_LIKE), "skip").when(state.isin(*FAILURE_LIKE), "failure").when(state.isin(*STOP_LIKE), "stop")


def class_of(state: str) -> str | None:
    """The same for one state."""
    return next((c for c, of in (("success", SUCCESS_LIKE), ("skip", SKIP_LIKE), ("failure", FAILURE_LIKE), ("stop", STOP_LIKE)) if state in of), None)


def violations(records: DataFrame) -> DataFrame:
    """(run_id, seq, path, reason) for every rule that a record breaks."""
    text = lambda c: F.col(c).isNull() | (F.col(c) == "")
    of = lambda *k: F.col("kind").isin(*k)
    rules = [
        ("run_id", text("run_id"), "must be a non-empty string"),
        ("seq", F.col("seq").isNull() | (F.col("seq") < 0), "must be an integer of at least 0"),
        ("offset_ns", F.col("offset_ns").isNull() | (F.col("offset_ns") < 0), "must be an integer of at least 0"),
        ("kind", ~F.coalesce(of(*EVENT_KINDS), F.lit(False)), "is no event kind"),
        ("header", of("run-started") & F.col("header").isNull(), "is required on run-started"),
        ("node", of(*EVENT_KINDS[1:11]) & text("node"), "is required on node and attempt records"),
        ("attempt", of("attempt-started", "attempt-succeeded", "attempt-failed", "attempt-outcome", "output-produced", "attempt-submitted", "zombie-at-exit") & (F.coalesce("attempt", F.lit(0)) < 1), "must be an integer of at least 1"),
        ("status", of("attempt-outcome") & ~F.coalesce(F.col("status").isin(*TERMINAL_STATES), F.lit(False)), "is no terminal state"),
        ("state", of("node-terminal") & ~F.coalesce(F.col("state").isin(*TERMINAL_STATES), F.lit(False)), "is no terminal state"),
        ("uri", of("output-produced") & text("uri"), "is required on output-produced"),
        ("inputs", of("attempt-submitted") & (F.col("inputs").isNull() | (F.size("inputs") > 8)), "must be an array of at most 8"),
        ("outcome", of("run-finished") & ~F.coalesce(F.col("outcome").isin(*RUN_OUTCOMES), F.lit(False)), "is no run outcome"),
    ]
    found = F.filter(F.array(*(F.when(bad, F.struct(F.lit(p).alias("path"), F.lit(why).alias("reason"))) for p, bad, why in rules)), lambda x: x.isNotNull())
    return records.select("run_id", "seq", F.explode(found).alias("v")).select("run_id", "seq", "v.path", "v.reason")


#: What artifacts must have: the keys of the object, of its members that are objects, and of the items of its lists.
ARTIFACTS = {
    "run": {"": ("attempts", "header", "interrupted", "outputs", "summary"), "header": ("overall_outcome",), "attempts": ("attempt", "node", "phase_durations_ns", "status", "worker"), "outputs": ("attempt", "node", "originating_run", "produced_at_offset_ns", "uri")},
    "graph": {"": ("edges", "fingerprint_structural", "nodes", "order", "pipeline"), "nodes": ("dependencies", "execution_class", "name", "policy", "trigger_rule"), "edges": ("from", "kind", "to")},
}


def artifact_violations(kind: str, doc: object) -> list[tuple[str, str]]:
    """(path, reason) of everything that is wrong with an artifact's JSON; unknown fields are none of it."""
    out = []
    for part, keys in ARTIFACTS[kind].items():
        value = doc.get(part) if part and isinstance(doc, dict) else doc
        many = part in ("attempts", "outputs", "nodes", "edges")
        if many and not isinstance(value, list):
            out.append((part, "must be an array"))
            continue
        for i, item in enumerate(value if many else [value]):
            at = f"{part}[{i}]" if many else part
            if not isinstance(item, dict):
                out.append((at, "must be an object"))
            else:
                out += [(f"{at}.{k}".lstrip("."), "is required") for k in keys if k not in item]
                if "status" in keys and item.get("status") not in (None, *TERMINAL_STATES):
                    out.append((f"{at}.status", "is no terminal state"))
    if kind == "graph" and not out:
        names = {n["name"] for n in doc["nodes"]}
        out += [(f"edges[{i}]", "an end is no node") for i, e in enumerate(doc["edges"]) if not {e["from"], e["to"]} <= names]
        out += [(f"edges[{i}].type_name", "is required on data edges") for i, e in enumerate(doc["edges"]) if e["kind"] == "data" and "type_name" not in e]
    return out
