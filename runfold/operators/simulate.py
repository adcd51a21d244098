"""Admission as a policy over recorded demands: who would have waited for which pool, and for how long. It models the
policy; Spark's own scheduler governs Spark's resources."""

from __future__ import annotations

import heapq
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runfold.schemas import POOLS as NAMES

#: Columns of the demands, one for each pool.
POOLS = [p.split("-")[0] for p in NAMES]


def admit(rows: pd.DataFrame, totals: dict[str, int], overtake: bool = True) -> pd.DataFrame:
    """One run: rows with node, ready, spent and a demand per pool. A node needs all its pools at once. Waiting nodes are
    admitted in order and stop at the first that doesn't fit; a node that just became ready is tried at once, past the
    queue, if ``overtake``. A node that asks for more than there is is refused."""
    free, queue, running, out = dict(totals), [], [], {}
    todo = sorted(rows.to_dict("records"), key=lambda r: (r["ready"], r["node"]))

    def fits(r: dict) -> bool:
        return all(r[p] <= free[p] for p in POOLS)

    def start(r: dict, now: int) -> None:
        for p in POOLS:
            free[p] -= r[p]
        heapq.heappush(running, (now + r["spent"], r["node"], r))
        out[r["node"]] = (now, now - r["ready"], "admitted")

    i = 0
    while i < len(todo) or running:
        now = min(([todo[i]["ready"]] if i < len(todo) else []) + ([running[0][0]] if running else []))
        while running and running[0][0] <= now:
            r = heapq.heappop(running)[2]
            for p in POOLS:
                free[p] += r[p]
        while queue and fits(queue[0]):
            start(queue.pop(0), now)
        while i < len(todo) and todo[i]["ready"] <= now:
            r, i = todo[i], i + 1
            if any(r[p] > totals[p] for p in POOLS):
                out[r["node"]] = (r["ready"], 0, "never fits")
            elif fits(r) and (overtake or not queue):
                start(r, now)
            else:
                queue.append(r)
    return pd.DataFrame([(n, *v) for n, v in out.items()], columns=["node", "admitted_ns", "waited_ns", "outcome"])


def admissions(demands: DataFrame, totals: dict[str, int], *, overtake: bool = True) -> DataFrame:
    """All runs: run_id, node, admitted_ns, waited_ns, outcome. A run has a thousand nodes at most and is one group."""
    full = {p: totals.get(p, 0) for p in POOLS}

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = admit(rows, full, overtake)
        got.insert(0, "run_id", key[0])
        return got

    return demands.groupBy("run_id").applyInPandas(one, "run_id string, node string, admitted_ns long, waited_ns long, outcome string")


def peak_residency(slots: DataFrame) -> DataFrame:
    """run_id and peak_bytes: the most that a run's outputs held at one time. slots: run_id, filled_ns, released_ns (null:
    to the end) and bytes; at one moment what is released goes before what is filled."""
    change = F.array(F.struct(F.col("filled_ns").alias("at"), F.col("bytes").alias("delta")), F.struct(F.col("released_ns").alias("at"), (-F.col("bytes")).alias("delta")))
    moves = slots.select("run_id", F.explode(change).alias("m")).select("run_id", "m.*").where("at IS NOT NULL")
    moves = moves.groupBy("run_id", "at", (F.col("delta") > 0).alias("fills")).agg(F.sum("delta").alias("delta"))
    held = F.sum("delta").over(Window.partitionBy("run_id").orderBy("at", "fills"))
    return moves.select("run_id", held.alias("held")).groupBy("run_id").agg(F.greatest(F.max("held"), F.lit(0)).alias("peak_bytes"))


class ReservedName(ValueError):
    """A metric's name is the engine's."""


def capped_metrics(metrics: dict[str, float], most: int = 128, most_bytes: int = 16 << 10, reserved: str = "run.") -> tuple[dict[str, float], int]:
    """Metrics by name until there are ``most`` or their names and values pass ``most_bytes``, and how many were left out;
    one that is too large is left out and smaller ones after it may still come. Reserved names are refused."""
    if bad := sorted(n for n in metrics if n.startswith(reserved)):
        raise ReservedName(", ".join(bad))
    out: dict[str, float] = {}
    used = 0
    for name, value in sorted(metrics.items()):
        size = len(name.encode()) + 8
        if len(out) < most and used + size <= most_bytes:
            out[name], used = value, used + size
    return out, len(metrics) - len(out)


#: Parts of the host that a run keeps its hands off.
HEADROOM = 0.2


def pool_sizes(memory_limits: list[int | None], cpu_limits: list[float | None], pins: dict[str, int] | None = None) -> dict[str, int]:
    """Sizes of the pools from the first limit that is known (container, older container interface, host): memory less
    headroom, a thread for each processor, one at least. Pinned sizes are taken as they are."""
    first = lambda limits, least: max(least, next((x for x in limits if x), least))
    memory, cpus = int(first(memory_limits, 1) * (1 - HEADROOM)), int(first(cpu_limits, 1))
    return {"memory": max(1, memory), "blocking": max(1, cpus), "compute": max(1, cpus), "remote": 0} | (pins or {})
