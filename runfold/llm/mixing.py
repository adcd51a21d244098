"""Mixing sources to target weights: iterative proportional fitting over token weights, then calibrated sampling.

Documents fall into cells by source, language and topic; categories without a target of their own fall into ``*``. A
document of a cell is kept with the cell's probability ``min(1, size * a * b * c)``, where a, b and c are the factors of
its source, language and topic. The factors are raked in turn until the expected tokens' shares by source, by language
and by topic are the targets. Since no probability is above 1, not every sample size allows every target: ``size`` is the
largest one, up to ``part`` of all tokens, at which all targets are met. Targets of categories without tokens are left
out and the others scaled up. Targets that no size meets (categories that only occur together, say) are named in
``Mixture.unmet``; the sample then is the closest that the raking reaches at ``part``.

A text is read once to measure it (tokens, topic); cells and draws need the measures only. Documents are drawn by a hash
of their key as text, of their text if the key is null, so a run can be repeated; rows that are equal in both are drawn
together. There are (source targets + 1) * (language targets + 1) * (topic targets + 1) cells at most, ``MOST_CELLS`` or
an error, whatever the input; only cells come to the driver.

Null categories count as ``*``; null or empty texts have no tokens and are kept with their cell's probability, which is
``size`` where the cell has no tokens at all. Very long texts are measured whole. Repeated rows are rows like others. An
empty table gives an empty result. Columns named ``_topic``, ``_tokens``, ``_u``, ``_p`` or ``_kept`` cannot be kept: an
error. Other columns, whatever their names, are carried along only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm._common import small_batches, texts

REST = "*"
MOST_CELLS = 100_000
AXES = ("source", "lang", "topic")
OWN = ("_topic", "_tokens", "_u", "_p", "_kept")

#: The query's and the pipeline's targets: shares of tokens, ``*`` for all other categories.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.05, REST: 0.95},
    "lang": {"en": 0.60, "fr": 0.15, "de": 0.15, "es": 0.10},
    "topic": {"links": 0.01, "figures": 0.015, REST: 0.975},
}
#: Of all tokens, the most that a sample holds.
PART = 0.8
#: Expected shares this near to their targets count as met.
WITHIN = 1e-4


def topic(text: str) -> str:
    """A coarse topic from the text alone: with links or addresses, with many figures (one of 200 characters), or neither."""
    if "://" in text or "@" in text:
        return "links"
    digits = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) - np.uint8(48)
    return "figures" if int((digits < 10).sum()) * 200 > len(text) else "prose"


def uniform(key: str | None, text: str, seed: int) -> float:
    """A number in [0, 1) from the key as text, or from the text if there is no key."""
    return (xxhash.xxh64_intdigest(text if key is None else key, seed + (key is None)) >> 11) / float(1 << 53)


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang"), seed: int = 3) -> DataFrame:
    """The ``keep`` columns with ``_topic``, ``_tokens`` (words between ASCII white space) and ``_u`` of every row."""
    if taken := set(OWN) & set(keep):
        raise ValueError(f"columns {sorted(taken)} are taken")
    small_batches(docs.sparkSession)
    names = [f"_{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches):
            made = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = t or ""
                made.append((topic(t), len(t.encode("utf-8", "surrogatepass").split()), uniform(k, t, seed)))
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *new], names=[*names, "_topic", "_tokens", "_u"])

    inner = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("body"), *(F.col(c).alias(n) for c, n in zip(keep, names)))
    own = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)]
    out = inner.mapInArrow(run, ", ".join([*own, "_topic string, _tokens long, _u double"]))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), "_topic", "_tokens", "_u")


@dataclass
class Mixture:
    """What was decided: for each axis its categories, each cell's probability, the sample's size as a part of all tokens,
    the expected shares, and the categories whose targets the sample misses, with the share they get."""

    names: dict[str, list[str]]
    p: np.ndarray
    size: float
    shares: dict[str, dict[str, float]]
    unmet: dict[tuple[str, str], float]


def sums_by(w: np.ndarray, axis: int) -> np.ndarray:
    return w.sum(axis=tuple(a for a in range(w.ndim) if a != axis))


def goals_of(actual: np.ndarray, targets: list[np.ndarray]) -> list[np.ndarray]:
    """Target shares of the categories that have tokens; what there is where no target has any."""
    out = []
    for axis, goal in enumerate(targets):
        have = sums_by(actual, axis)
        goal = np.where(have > 0, goal, 0.0)
        out.append(goal / goal.sum() if goal.sum() > 0 else have / have.sum())
    return out


def rake(actual: np.ndarray, goals: list[np.ndarray], size: float, rounds: int = 400, within: float = 1e-7) -> tuple[np.ndarray, float]:
    """Each cell's probability ``min(1, size * product of its factors)``, the factors scaled in turn until the expected
    tokens have the goals as shares of ``size`` of all; and by how much the worst share misses."""
    share = actual / actual.sum()
    factors = [np.ones_like(g) for g in goals]
    worst, p = np.inf, np.full_like(share, size)
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            have = sums_by(share * p, axis) / size
            worst = max(worst, float(np.abs(have - goal).max()))
            scale = np.divide(goal, have, out=np.ones_like(goal), where=have > 0)
            factors[axis] = np.minimum(factors[axis] * scale, 1e12)
            p = size * np.ones_like(share)
            for a, f in enumerate(factors):
                p = p * f.reshape([-1 if x == a else 1 for x in range(share.ndim)])
            p = np.minimum(1.0, p)
        if worst < within:
            break
    return p, worst


def calibrate(actual: np.ndarray, targets: list[np.ndarray], part: float) -> tuple[np.ndarray, float, list[np.ndarray], list[np.ndarray]]:
    """Probabilities, size, goals and expected shares: of the largest size up to ``part`` that meets all goals, found by
    halving; of ``part`` itself if none does."""
    goals = goals_of(actual, targets)
    p, worst = rake(actual, goals, part)
    size = part
    if worst > WITHIN:
        low, high, best = 0.0, part, None
        for _ in range(24):
            middle = (low + high) / 2
            tried, off = rake(actual, goals, middle)
            if off <= WITHIN:
                low, best = middle, tried
            else:
                high = middle
        if best is not None:
            p, size = best, low
    kept = actual * p
    return p, size, goals, [sums_by(kept, a) / max(kept.sum(), 1e-300) for a in range(actual.ndim)]


def cells(names: dict[str, list[str]], source: str, lang: str) -> dict:
    """For each axis the place of a row's category."""
    out = {}
    for axis, column in zip(AXES, (source, lang, "_topic")):
        known = [F.when(F.col(column) == F.lit(n), F.lit(i)) for i, n in enumerate(names[axis]) if n != REST]
        out[axis] = F.coalesce(*known, F.lit(names[axis].index(REST))).cast("int")
    return out


def plan(measured: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, *, part: float = PART, source: str = "source", lang: str = "lang") -> Mixture:
    """The mixture for the targets, from one aggregation of the measures."""
    names = {axis: [*dict.fromkeys([*targets.get(axis, {}), REST])] for axis in AXES}
    if np.prod([len(v) for v in names.values()]) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of targets")
    at = cells(names, source, lang)
    actual = np.zeros([len(names[axis]) for axis in AXES])
    for r in measured.groupBy(*(v.alias(k) for k, v in at.items())).agg(F.sum("_tokens").alias("n")).collect():  # a row for each cell
        actual[tuple(r[a] for a in AXES)] = r.n or 0
    if not actual.sum():
        return Mixture(names, np.full_like(actual, part), part, {}, {})
    wanted = [np.array([targets.get(axis, {}).get(n, 0.0) for n in names[axis]]) for axis in AXES]
    p, size, goals, got = calibrate(actual, wanted, part)
    p = np.where(actual > 0, p, size)
    shares = {axis: dict(zip(names[axis], map(float, got[i]))) for i, axis in enumerate(AXES)}
    unmet = {(axis, n): shares[axis][n] for i, axis in enumerate(AXES) for n, goal in zip(names[axis], goals[i]) if abs(shares[axis][n] - goal) > 2 * WITHIN}
    return Mixture(names, p, size, shares, unmet)


def draw(measured: DataFrame, mixture: Mixture, *, source: str = "source", lang: str = "lang") -> DataFrame:
    """The measured rows with ``_p`` (the probability of being kept) and ``_kept``."""
    at, shape = cells(mixture.names, source, lang), mixture.p.shape
    table = F.array(*(F.lit(float(x)) for x in mixture.p.ravel()))
    p = F.get(table, at["source"] * (shape[1] * shape[2]) + at["lang"] * shape[2] + at["topic"])
    return measured.withColumn("_p", p).withColumn("_kept", F.col("_u") < F.col("_p"))


__all__ = ["Mixture", "TARGETS", "draw", "measure", "plan"]
