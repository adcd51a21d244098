"""The fold: from a stream's records to attempts, outputs, submissions and a summary, for all runs at once.

Every function takes records (one row per event: run_id, seq, offset_ns, kind, ...; fields that a source lacks may be
missing) and works per ``run_id``; first, last and as-of always mean by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runfold.functions import rules
from runfold.schemas import PRE_EXECUTION, RECORD

OUTCOME_FIELDS = ("message", "error", "metrics", "cost_declared", "cost_measured", "durable_reference", "durable_reference_meta", "satisfied_from_run", "originating_node", "inputs")
TERMINAL_FIELDS = ("message", "error", "durable_reference", "durable_reference_meta", "satisfied_from_run", "originating_node")
SUBMITTED_FIELDS = ("inputs", "executor", "target_name", "observed_name", "observed_uid", "observed_host", "structural_fingerprint", "policy_hash", "tool_version", "image_digest")
PHASES = ("ready_wait_ns", "permit_wait_ns", "backoff_ns", "executing_ns")


def widened(records: DataFrame) -> DataFrame:
    """The records with every field of the stream; those the source lacks are null."""
    have = set(records.columns)
    return records.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD if f.name not in have))


def first_of(value: Column, where: Column) -> Column:
    """By seq, the first row's value where a condition holds, be it null."""
    return F.min_by(F.struct(value.alias("v")), F.when(where, F.col("seq")))["v"]


def runs(records: DataFrame) -> DataFrame:
    """One row per run: the first run-started's header, the first run-finished's outcome (``succeeded`` if it names none;
    without one the run is ``cancelled`` and interrupted), and whether it has a header at all."""
    r = widened(records)
    started, finished = F.col("kind") == "run-started", F.col("kind") == "run-finished"
    out = r.groupBy("run_id").agg(
        first_of(F.col("header"), started).alias("header"),
        F.bool_or(started).alias("has_header"),
        F.bool_or(finished).alias("finished"),
        first_of(F.col("outcome"), finished).alias("outcome"),
        F.max("offset_ns").alias("last_offset_ns"),
    )
    return out.select("run_id", "header", "has_header", F.when(F.col("finished"), F.coalesce("outcome", F.lit("succeeded"))).otherwise("cancelled").alias("outcome"), (~F.col("finished")).alias("interrupted"), "last_offset_ns")


def headers(records: DataFrame) -> DataFrame:
    """One row per run that has a header: its fields as columns, the interval and the lineage taken apart. A run that
    resumes none is its own root."""
    r = runs(records).where("has_header")
    plain = [f for f in r.schema["header"].dataType.names if f not in ("run_id", "data_interval", "resume_lineage")]
    line = lambda f: F.col(f"header.resume_lineage.{f}")
    return r.select(
        "run_id", "outcome", "interrupted", "last_offset_ns", *(F.col(f"header.{f}").alias(f) for f in plain), F.col("header.data_interval.start").alias("interval_start"), F.col("header.data_interval.end").alias("interval_end"),
        F.coalesce(line("parent_run_id"), line("run_id")).alias("parent_run_id"), F.coalesce(line("lineage_root_run_id"), line("parent_run_id"), line("run_id"), "run_id").alias("lineage_root_run_id"),
    )


def executed(records: DataFrame) -> DataFrame:
    """The records of runs that got as far as executing."""
    out = runs(records).where(F.col("outcome").isin(*PRE_EXECUTION)).select("run_id")
    return records.join(out, "run_id", "left_anti")


def worker() -> Column:
    """The worker given, or one made of pool and thread."""
    return F.coalesce("worker", F.when(F.col("thread").isNotNull(), F.concat(F.coalesce("pool", F.lit("unknown")), F.lit("#"), F.col("thread"))), F.col("pool"), F.lit("unknown"))


def phases(outcomes: DataFrame) -> DataFrame:
    """Cuts each attempt's time from start to outcome into four parts that add up to it. A wait counts only if it ended
    inside that time; each part is what is left of it at most, and executing is the remainder."""
    end = F.col("offset_ns")
    d = outcomes.withColumn("start_ns", F.least(F.coalesce("started_at", end), end)).withColumn("total_ns", end - F.col("start_ns"))

    def inside(at: str, also: Column | None = None) -> Column:
        ok = (F.col(at) > F.col("start_ns")) & (F.col(at) <= end)
        return F.when(ok & also if also is not None else ok, F.col(at) - F.col("start_ns")).otherwise(F.lit(0).cast("long"))

    d = d.withColumn("ready_wait_ns", F.least(inside("ready_at"), "total_ns"))
    d = d.withColumn("permit_wait_ns", F.least(inside("admitted_at"), F.col("total_ns") - F.col("ready_wait_ns")))
    d = d.withColumn("backoff_ns", F.least(inside("previous_at", F.col("attempt") > 1), F.col("total_ns") - F.col("ready_wait_ns") - F.col("permit_wait_ns")))
    return d.withColumn("executing_ns", F.col("total_ns") - F.col("ready_wait_ns") - F.col("permit_wait_ns") - F.col("backoff_ns"))


def anchored(records: DataFrame) -> DataFrame:
    """The records of nodes that time is told by, with the node's last anchors before each in the stream; of an
    attempt-outcome also its phases."""
    r = widened(records).where(F.col("node").isNotNull() & F.col("kind").isin("node-ready", "node-admitted", "attempt-started", "attempt-outcome", "node-terminal"))
    before = Window.partitionBy("run_id", "node").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("offset_ns")), ignorenulls=True).over(before)
    r = r.withColumns({"ready_at": at("node-ready"), "admitted_at": at("node-admitted"), "started_at": at("attempt-started"), "previous_at": at("attempt-outcome")})
    return phases(r.withColumn("attempt", F.coalesce("attempt", F.lit(1))))


def outcomes(records: DataFrame) -> DataFrame:
    """One row per attempt-outcome, with its phases: the anchors are the node's last ones before it in the stream."""
    r = anchored(records).where("kind = 'attempt-outcome'")
    r = r.withColumns({"status": F.coalesce("status", F.lit("failed")), "worker": worker(), "inputs": F.filter("inputs", lambda x: x.isNotNull())})
    return r.select("run_id", "node", "attempt", "status", *PHASES, "total_ns", "worker", *OUTCOME_FIELDS, "seq", F.col("offset_ns").alias("finished_ns"), F.lit("outcome").alias("origin"))


def _without_attempt(rows: DataFrame, status: Column, like: DataFrame, origin: str, fields: tuple[str, ...], seq: Column) -> DataFrame:
    kinds = {f.name: f.dataType for f in like.schema}
    null = lambda n: F.lit(None).cast(kinds[n]).alias(n)
    return rows.select("run_id", "node", F.lit(1).alias("attempt"), status.alias("status"), *(F.lit(0).cast("long").alias(p) for p in PHASES), F.lit(0).cast("long").alias("total_ns"), F.lit("unknown").alias("worker"),
        *(F.col(n) if n in fields else null(n) for n in OUTCOME_FIELDS), seq.alias("seq"), null("finished_ns"), F.lit(origin).alias("origin"))


def attempts(records: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """All attempts: the outcomes, one for each node that only has a terminal record (its last one), and one
    ``upstream-failed`` for each (run_id, node) of the roster that has neither."""
    own = executed(records)
    done = outcomes(own)
    keys = done.select("run_id", "node").distinct()
    ends = widened(own).where("kind = 'node-terminal' AND node IS NOT NULL")
    last = ends.groupBy("run_id", "node").agg(F.max_by(F.struct("state", "seq", *TERMINAL_FIELDS), "seq").alias("t")).select("run_id", "node", "t.*")
    never = _without_attempt(last.join(keys, ["run_id", "node"], "left_anti"), F.coalesce("state", F.lit("upstream-failed")), done, "terminal", TERMINAL_FIELDS, F.col("seq"))
    out = done.unionByName(never)
    if roster is None:
        return out
    known = keys.unionByName(last.select("run_id", "node")).distinct()
    absent = roster.select("run_id", "node").distinct().join(known, ["run_id", "node"], "left_anti")
    return out.unionByName(_without_attempt(absent, F.lit("upstream-failed"), done, "roster", (), F.lit(None).cast("long")))


def outputs(records: DataFrame) -> DataFrame:
    """One row per output-produced record, none merged; the offset of the record where it names no other."""
    r = widened(executed(records)).where("kind = 'output-produced' AND node IS NOT NULL AND uri IS NOT NULL")
    return r.select("run_id", "node", F.coalesce("attempt", F.lit(1)).alias("attempt"), "uri", "content_hash", "size_bytes", F.col("output_kind").alias("kind"), F.coalesce("produced_at_offset_ns", "offset_ns").alias("produced_at_offset_ns"), F.coalesce("originating_run", "run_id").alias("originating_run"), "seq")


def submissions(records: DataFrame) -> DataFrame:
    """One row per submitted attempt: the first record's offset, each field as last given, and the state of the attempt's
    last outcome record, null if none came."""
    r = widened(executed(records)).where("node IS NOT NULL AND attempt IS NOT NULL")
    sent = r.where("kind = 'attempt-submitted'").groupBy("run_id", "node", "attempt").agg(
        F.min("seq").alias("seq"), F.min_by("offset_ns", "seq").alias("submitted_at_offset_ns"),
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in SUBMITTED_FIELDS),
    )
    ended = r.where("kind = 'attempt-outcome' AND status IS NOT NULL").groupBy("run_id", "node", "attempt").agg(F.max_by("status", "seq").alias("outcome_state"))
    return sent.join(ended, ["run_id", "node", "attempt"], "left").withColumn("completed", F.col("outcome_state").isNotNull())


def summaries(records: DataFrame) -> DataFrame:
    """One row per run that executed: elapsed time, critical path, peak residency, retained nodes, what zombies pinned."""
    r = widened(executed(records))
    ended = F.col("kind") == "attempt-outcome"
    base = r.groupBy("run_id").agg(
        F.max(F.coalesce("offset_ns", F.lit(0))).alias("total_elapsed_ns"), F.coalesce(F.max(F.when(ended, F.col("slot_residency"))), F.lit(0)).alias("peak_slot_residency"),
        F.coalesce(F.sum(F.when(F.col("kind") == "zombie-at-exit", F.col("pinned_capacity"))), F.lit(0)).alias("abandoned_pinned_capacity"),
    )
    flags = r.where(ended & F.col("node").isNotNull() & F.col("retained").isNotNull()).groupBy("run_id", "node").agg(F.max_by("retained", "seq").alias("on"))
    kept = flags.where("on").groupBy("run_id").agg(F.sort_array(F.collect_list("node")).alias("retained_values"))
    last = r.where(ended & F.col("attempt").isNotNull()).groupBy("run_id", "node", "attempt").agg(F.max_by("offset_ns", "seq").alias("ended_at"))
    pinned = r.where("kind = 'zombie-at-exit'").join(last, ["run_id", "node", "attempt"]).groupBy("run_id").agg(F.sum(rules.saturating_sub(F.col("offset_ns"), F.col("ended_at"))).alias("abandoned_pinned_time_ns"))
    out = base.join(critical_paths(records), "run_id", "left").join(kept, "run_id", "left").join(pinned, "run_id", "left")
    return out.select("run_id", "total_elapsed_ns", F.coalesce("critical_path_ns", F.lit(0)).alias("critical_path_ns"), "peak_slot_residency", F.coalesce("retained_values", F.array().cast("array<string>")).alias("retained_values"), F.coalesce("abandoned_pinned_time_ns", F.lit(0)).alias("abandoned_pinned_time_ns"), "abandoned_pinned_capacity")


def vertices(records: DataFrame) -> DataFrame:
    """(run_id, node, ready, ended, spent): what the critical path is made of. A terminal record sets the end, a later
    outcome can only move it on. One shuffle by run and node serves the anchors and the sums."""
    r = anchored(executed(records))
    of = lambda kind, value: F.when(F.col("kind") == kind, F.col(value))
    t_seq = F.max(of("node-terminal", "seq")).over(Window.partitionBy("run_id", "node"))
    r = r.withColumn("t_seq", t_seq)
    late = of("attempt-outcome", "offset_ns")
    out = r.groupBy("run_id", "node").agg(
        F.sum(of("attempt-outcome", "executing_ns")).alias("spent"),
        F.min(of("node-ready", "offset_ns")).alias("ready"),
        F.max_by("offset_ns", of("node-terminal", "seq")).alias("t_at"),
        F.max(F.when(F.col("t_seq").isNull() | (F.col("seq") > F.col("t_seq")), late)).alias("o_at"),
        F.bool_or(F.col("kind").isin("node-ready", "node-terminal", "attempt-outcome")).alias("told"),
    ).where("told")
    out = out.withColumn("ended", F.greatest("t_at", "o_at"))
    return out.select("run_id", "node", F.coalesce("ready", "ended", F.lit(0)).alias("ready"), "ended", F.coalesce("spent", F.lit(0)).alias("spent"))


def critical_paths(records: DataFrame) -> DataFrame:
    """(run_id, critical_path_ns): the longest chain of executing times in which each node had ended by the time the next
    was ready. Per run one array of its nodes by (ready, name), walked once; runs have a thousand nodes at most."""
    node = F.struct("ready", "node", "ended", "spent")
    walked = F.aggregate(
        F.array_sort(F.collect_list(node)),
        F.array().cast("array<struct<ended: bigint, path: bigint>>"),
        lambda seen, v: F.concat(seen, F.array(F.struct(v["ended"].alias("ended"), (v["spent"] + F.coalesce(F.array_max(F.transform(F.filter(seen, lambda u: u["ended"] <= v["ready"]), lambda u: u["path"])), F.lit(0))).alias("path")))),
        lambda seen: F.coalesce(F.array_max(F.transform(seen, lambda u: u["path"])), F.lit(0)),
    )
    return vertices(records).groupBy("run_id").agg(walked.alias("critical_path_ns"))


def as_object(**fields: Column) -> Column:
    """A struct with its fields in the order of their names, as canonical JSON has them."""
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))


#: Fields whose text is JSON itself.
NESTED = ("error", "cost_declared", "cost_measured", "parameters", "captured_environment")


def canonical_field(value: Column, name: str, kind: T.DataType) -> Column:
    """A field as canonical JSON has it: the names in it in order, and JSON text as what it says."""
    if name in NESTED:
        return F.try_parse_json(value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), as_object(**{f.name: canonical_field(value[f.name], f.name, f.dataType) for f in kind.fields}))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: canonical_field(x, "", kind.elementType))
    return value


def artifacts(records: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """One row per run: run_id, artifact (the whole fold as canonical JSON) and error. Without a run-started record there is
    no artifact and the error says so. A run that never executed has no attempts, outputs or summary. Attempts stand in
    stream order, those without a record of their own last by name; fields without a value are left out."""
    run = runs(records).join(widened(records).where("kind = 'run-finished'").groupBy("run_id").agg(F.min_by("errors", "seq").alias("errors")), "run_id", "left")
    t = attempts(records, roster)
    known = {f.name: canonical_field(F.col(f"header.{f.name}"), f.name, f.dataType) for f in run.schema["header"].dataType.fields}
    reference = {k: canonical_field(F.col(k), k, t.schema[k].dataType) for k in OUTCOME_FIELDS}
    spans = as_object(**{p.removesuffix("_ns").replace("_", "-"): F.col(p) for p in PHASES})
    one = as_object(node=F.col("node"), attempt=F.col("attempt"), status=F.col("status"), worker=F.col("worker"), phase_durations_ns=spans, **reference)
    tried = t.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("none"), "seq", "node", "attempt", F.to_json(one).alias("j")))), lambda x: x["j"]).alias("attempts"))
    out = as_object(**{k: F.col(k) for k in ("node", "attempt", "uri", "content_hash", "size_bytes", "kind", "produced_at_offset_ns", "originating_run")})
    made = outputs(records).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.to_json(out).alias("j")))), lambda x: x["j"]).alias("outputs"))
    s = summaries(records)
    total = s.select("run_id", F.to_json(as_object(**{c: F.col(c) for c in s.columns if c != "run_id"})).alias("summary"))
    whole = run.join(tried, "run_id", "left").join(made, "run_id", "left").join(total, "run_id", "left")
    header = F.to_json(as_object(overall_outcome=F.col("outcome"), errors=F.when(F.col("outcome").isin(*PRE_EXECUTION), F.col("errors")), **known))
    listed = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    doc = F.concat(F.lit('{"attempts":'), listed("attempts"), F.lit(',"header":'), header, F.lit(',"interrupted":'), F.col("interrupted").cast("string"), F.lit(',"outputs":'), listed("outputs"), F.lit(',"summary":'), F.coalesce("summary", F.lit("null")), F.lit("}"))
    return whole.select("run_id", F.when(F.col("has_header"), doc).alias("artifact"), F.when(~F.col("has_header"), "no run-started record").alias("error"))


#: Fields of the stream and of headers that differ between two runs of the same thing.
VOLATILE = ("wall", "run_id", "offset_ns", "captured_environment", "worker", "thread", "observed_name", "observed_uid", "observed_host")


def masked(records: DataFrame, fields: tuple[str, ...] = VOLATILE) -> DataFrame:
    """The records without what differs from run to run, in their headers too, so that two runs can be compared."""
    out = records.drop(*fields)
    inner = [f for f in fields if "header" in out.columns and f in out.schema["header"].dataType.names]
    return out.withColumn("header", F.col("header").dropFields(*inner)) if inner else out


def sequence_gaps(records: DataFrame) -> DataFrame:
    """Places where a run's seq does not go up by one."""
    before = F.lag("seq").over(Window.partitionBy("run_id").orderBy("seq"))
    return records.select("run_id", "seq", before.alias("before")).where(F.coalesce(F.col("seq") - F.col("before"), F.col("seq") + 1) != 1)
