"""Decision tables: trigger rules, run outcomes, exit codes, the resume gate, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runfold.schemas import state_class

# Exit codes of a run.
EXIT = {"success": 0, "run-failed": 1, "usage": 2, "assembly-failed": 3, "bootstrap-failed": 4, "cancelled": 5, "resume-refused": 6, "sink-failed": 7}


def classes(state: Column) -> dict[str, Column]:
    """For a group of upstream states: whether any, and whether all that are no success, are of a class."""
    c = state_class(state)
    return {f"{how}_{name}": agg(c == name) for name in ("success", "skip", "failure", "stop") for how, agg in (("any", F.bool_or), ("n", F.count_if))} | {"n": F.count(c)}


def decide(rule: Column, n: Column, success: Column, skip: Column, failure: Column, stop: Column) -> Column:
    """What becomes of a node whose upstreams are all terminal, from how many of them are of each class: ``run``, or the
    state it gets without running. Without upstreams every rule but any-failed is met."""
    other = n - success
    spread = F.when(other == 0, "run").when(other == skip, "upstream-skipped").when(other == stop, "cancelled").otherwise("upstream-failed")
    return F.when(rule == "all-terminal", "run").when(rule == "any-failed", F.when(failure > 0, "run").otherwise("skipped")).otherwise(spread)


def verdict(rule: str, upstream: list[str]) -> str:
    """The same for one node, from the classes of its upstreams."""
    if rule == "all-terminal":
        return "run"
    if rule == "any-failed":
        return "run" if "failure" in upstream else "skipped"
    rest = set(upstream) - {"success"}
    return "run" if not rest else {"skip": "upstream-skipped", "stop": "cancelled"}.get(next(iter(rest)), "upstream-failed") if len(rest) == 1 else "upstream-failed"


def run_outcome(n_failure: Column, n_stop: Column) -> Column:
    return F.when(n_failure > 0, "failed").when(n_stop > 0, "cancelled").otherwise("succeeded")


def exit_code(outcome: Column, n_own_failures: Column, sink_failed: Column | None = None) -> Column:
    """A run's exit code, the first that holds: it never got to run; nodes failed themselves (failed, timed-out; upstream
    failures do not count); the stream could not be written at the end; it was cancelled."""
    never = F.when(outcome == "assembly-failed", EXIT["assembly-failed"]).when(outcome == "bootstrap-failed", EXIT["bootstrap-failed"])
    lost = F.lit(False) if sink_failed is None else sink_failed
    return never.when(n_own_failures > 0, EXIT["run-failed"]).when(lost, EXIT["sink-failed"]).when(outcome == "cancelled", EXIT["cancelled"]).otherwise(EXIT["success"])


def resume_gate(prior: dict[str, Column], now: dict[str, Column]) -> Column:
    """Why a resume is refused, in this order, or whether it goes on: algorithm, tool version, structure; a changed policy
    only goes on the record."""
    digits = lambda c: F.lower(F.substring_index(c, ":", -1))
    return (F.when(~prior["algorithm"].eqNullSafe(now["algorithm"]), "refused: fingerprint algorithm")
        .when(~prior["tool"].eqNullSafe(now["tool"]), "refused: tool version")
        .when(~digits(prior["structural"]).eqNullSafe(digits(now["structural"])), "refused: structure")
        .when(~digits(prior["policy"]).eqNullSafe(digits(now["policy"])), "proceed: policy differs")
        .otherwise("proceed"))


def backoff_ms(n: Column, base: Column, factor: Column, cap: Column) -> Column:
    """The nominal wait before retry n (from 0): base * factor^n, cap at most. An overflow is the cap."""
    return F.least(base * F.pow(factor, n), cap)


def jittered_ms(nominal: Column, u: Column) -> Column:
    """Between nothing and the nominal wait, by u in [0, 1)."""
    return nominal * (1 - u)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def stable_name(name: Column) -> Column:
    """Whether a name is well formed: ASCII letters, digits, ``_``, ``-``, ``.`` and ``:``, one at least."""
    return name.rlike(r"^[A-Za-z0-9_.:-]+$")


def rfc3339(unix_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(unix_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def duration_ns(text: Column) -> Column:
    """``10`` and ``10s`` are seconds, ``10ms`` milliseconds; anything else is null."""
    n = F.regexp_extract(text, r"^(\d+)(ms|s)?$", 1)
    unit = F.regexp_extract(text, r"^(\d+)(ms|s)?$", 2)
    return F.when(n != "", n.cast("decimal(20,0)") * F.when(unit == "ms", 1_000_000).otherwise(1_000_000_000))


def duration_text(ns: Column) -> Column:
    """Nanoseconds as people read them: ``850ms``, ``12.5s``, ``3m 20s``, ``2h 5m``."""
    s = ns / 1e9
    whole = lambda x: F.floor(x).cast("string")
    return (F.when(s < 1, F.concat(whole(ns / 1e6), F.lit("ms")))
        .when(s < 60, F.concat(F.regexp_replace(F.format_number(F.floor(s * 10) / 10, 1), r"\.0$", ""), F.lit("s")))
        .when(s < 3600, F.concat(whole(s / 60), F.lit("m "), whole(s % 60), F.lit("s")))
        .otherwise(F.concat(whole(s / 3600), F.lit("h "), whole(s % 3600 / 60), F.lit("m"))))


def adoption(found: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """Whether something that runs already is the attempt that was submitted: the first refusal, or ``adopt``. Compared by
    run, node, attempt, structure, tool and image, in this order; what isn't told is taken for another."""
    out = F
    for name in ("run_id", "node", "attempt", "structural_fingerprint", "tool_version", "image_digest"):
        out = out.when(~F.coalesce(found[name] == wanted[name], F.lit(False)), f"refused: {name}")
    return out.otherwise("adopt")


def blob_reference(reference: Column) -> dict[str, Column]:
    """The parts of ``<scheme>+<backend>://<container>/<algorithm>/<hex>``."""
    pattern = r"^([a-z-]+)\+([a-z0-9]+)://([^/]+)/([a-z0-9]+)/([0-9a-f]+)$"
    return {name: F.nullif(F.regexp_extract(reference, pattern, i + 1), F.lit("")) for i, name in enumerate(("scheme", "backend", "container", "algorithm", "digest"))}
