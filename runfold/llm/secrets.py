"""Secret scans: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

The patterns give the base spans. In every other run of token characters first-order Markov models decide: one of
ordinary strings, and one for each kind of random string. They are trained from labelled samples. Random: the values
that the patterns find, and strings drawn from each alphabet that keys are written in. Ordinary: the words and
identifiers beside the values, the same words joined as paths, identifiers and camel case are, numbers, repeated
marks, and words made of syllables. Training reads about ``sample`` documents, however many there are; the scan reads every whole text.

The log-likelihood ratio of a random model to the ordinary one is added up along a run; the windows of at least
``SHORTEST`` characters with the greatest sums are taken, one after another, as long as a sum is ``LEAST`` nats or more
after each character has paid ``EACH`` nats. They are grown to the
ends of their letters and figures. So a secret is found inside a longer run too.

A null or empty text has no spans. Equal texts, and so repeated rows, have equal spans. Very long texts and runs are
scanned whole. Of equal windows the first is taken. Tables without any row give models of the drawn strings alone.
Columns to keep may have any names but ``base``, ``spans`` and ``redacted``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm._common import sampled, small_batches, texts

#: The patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A run that is long enough starts where the run starts, so these find what the patterns without a count find.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Samples of ordinary strings; longer ones could be the secrets that are looked for.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9_-]{6,19}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "random")
#: What a window's characters add up to at least, in nats, when each has paid so many; and the fewest of them.
LEAST, EACH, SHORTEST = 20.0, 1.0, 16
#: Alphabets of random strings.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "-_", LOWER + UPPER + DIGITS, UPPER + DIGITS, UPPER[:24] + "234567", LOWER + DIGITS, DIGITS + "abcdef", DIGITS + "ABCDEF")
#: Syllables of made-up ordinary words, for tables that have few of their own.
ONSETS = "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gl gr pl pr sc sh sl sp st tr th qu".split()
NUCLEI, CODAS = "a e i o u ai ea ee ia io ou".split(), ["", "", "n", "r", "s", "t", "l", "m", "c", "nd", "nt", "ng", "st", "z"]
#: Drawn strings of an alphabet and characters of each; words that are joined to one ordinary string.
DRAWN, DRAWN_LENGTH, JOINED = 4000, 40, 4
SAMPLE = 20_000
SYMBOLS = 128


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start of value, end of value), sorted."""
    out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def pairs_of(s: str) -> np.ndarray:
    """Codes of the character pairs, the start counting as character 0."""
    c = np.frombuffer(("\0" + s).encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) & 127
    return c[:-1] * SYMBOLS + c[1:]


def pair_counts(strings: list[str]) -> np.ndarray:
    """How often each character pair is in the strings, counted at once."""
    codes = pairs_of("\0".join(strings)) if strings else np.zeros(0, np.int64)
    return np.bincount(codes[codes % SYMBOLS != 0], minlength=SYMBOLS * SYMBOLS)


def taken(spans: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover; both ascend."""
    starts: list[int] = []
    ends: list[int] = []
    for s in spans:
        if ends and s[0] <= ends[-1]:
            ends[-1] = max(ends[-1], s[2])
        else:
            starts.append(s[0])
            ends.append(s[2])
    return starts, ends


def apart(stretches: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether no stretch meets start to end."""
    at = bisect_left(stretches[1], start + 1)  # the first that ends after the start
    return at == len(stretches[1]) or stretches[0][at] >= end


def ordinary_of(ws: list[str]) -> list[str]:
    """A text's words, and some of them joined as in paths, identifiers and camel case."""
    groups = [ws[i : i + JOINED] for i in range(0, len(ws) - JOINED + 1, 2 * JOINED)]
    styles = ("/".join, "_".join, "-".join, "=".join, "+".join, lambda g: "".join(w.capitalize() for w in g))
    return ws + [styles[i % len(styles)](g) for i, g in enumerate(groups)]


def sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character pairs: label 1 from values the patterns find, 0 from the words beside them."""
    counts = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
    for b in texts(batches):
        strings: tuple[list[str], list[str]] = ([], [])
        for text in b.column(0).to_pylist():
            if not text:
                continue
            spans = base_spans(text)
            strings[1].extend(text[s[3] : s[4]] for s in spans)
            cover = taken(spans)
            strings[0].extend(ordinary_of([m[0] for m in WORD.finditer(text) if not spans or apart(cover, m.start(), m.end())]))
        for label in (0, 1):
            counts[label] += pair_counts(strings[label])
    label, cell = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(counts[label, cell], pa.int64())], names=["label", "cell", "n"])


def drawn(seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of labelled strings that are made up: ordinary ones (numbers, repeated marks, words of syllables), and random ones by alphabet."""
    rng = np.random.default_rng(seed)
    ordinary = ["".join(rng.choice(list(DIGITS), int(n))) for n in rng.integers(6, 40, 400)] + [c * 40 for c in "+/_=-xX0" for _ in range(50)]
    syllables = ["".join(x) for x in zip(*(rng.choice(kind, 12 * DRAWN) for kind in (ONSETS, NUCLEI, CODAS)))]
    made_up = ["".join(syllables[i : i + 3]) for i in range(0, len(syllables), 3)]
    ordinary += ordinary_of(made_up) + [w.upper() for w in made_up[: DRAWN // 4]] + [w.capitalize() for w in made_up[:DRAWN]]
    return pair_counts(ordinary), [pair_counts(["".join(r) for r in rng.choice(list(a), (DRAWN, DRAWN_LENGTH))]) for a in ALPHABETS]


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, seed: int = 11) -> np.ndarray:
    """The log-likelihood ratio of each character pair for each kind of random string (kinds x pairs), from about
    ``sample`` documents chosen by a hash and from drawn strings."""
    small_batches(docs.sparkSession)
    rows = sampled(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), sample, "key", "text", seed=seed)
    got = rows.select("text").mapInArrow(sample_counts, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n")).collect()
    found = np.zeros((2, SYMBOLS * SYMBOLS))
    for r in got:  # two labels, 128 x 128 cells at most
        found[r.label][r.cell] = r.n
    usual, alphabets = drawn(seed)
    # a value of a pattern may be an ordinary word, so the values' model is drawn towards all alphabets
    return ratios([found[0] + usual, *alphabets, found[1] + sum(alphabets)])


def ratios(counts: list[np.ndarray]) -> np.ndarray:
    """log P(next | previous, random) - log P(next | previous, ordinary) for each random kind; the first counts are those
    of ordinary strings. Each backs off to the single characters."""
    logs = []
    for flat in counts:
        c = flat.reshape(SYMBOLS, SYMBOLS)
        single = c.sum(0) + 0.05
        single /= single.sum()
        logs.append(np.log((c + 20 * single) / (c.sum(1, keepdims=True) + 20)).ravel())
    return np.stack([x - logs[0] for x in logs[1:]])


def windows(gains: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Windows (start, end) of a run, where gains (kinds x characters) are what each character adds: the one with the
    greatest sum, then those to its left and right, as long as sum and length suffice."""
    out, todo = [], [(0, gains.shape[1])]
    while todo:
        a, b = todo.pop()
        if b - a < SHORTEST:
            continue
        total = np.concatenate([np.zeros((len(gains), 1)), np.cumsum(gains[:, a:b], axis=1)], axis=1)
        low = np.minimum.accumulate(total[:, : b - a + 1 - SHORTEST], axis=1)
        sums = total[:, SHORTEST:] - low
        kind, end = np.unravel_index(int(np.argmax(sums)), sums.shape)
        if sums[kind, end] < least:
            continue
        start = a + int(np.argmin(total[kind, : end + 1]))
        stop = a + int(end) + SHORTEST
        out.append((start, stop))
        todo += [(a, start), (stop, b)]
    return sorted(out)


def whole(run: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The windows grown to where their letters and figures end; those that meet are one."""
    out: list[tuple[int, int]] = []
    for a, b in found:
        while a and run[a - 1].isalnum():
            a -= 1
        while b < len(run) and run[b].isalnum():
            b += 1
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


def spans_of(text: str, ratio: np.ndarray, least: float = LEAST, each: float = EACH) -> tuple[list, list]:
    """The base spans, and all spans: those and the windows that the models take for random, in runs none of which meets
    a base span."""
    base = base_spans(text)
    found, cover = [], None
    for m in RUN.finditer(text):
        cover = cover or taken(base)
        if apart(cover, m.start(), m.end()):
            for a, b in whole(m[0], windows(ratio[:, pairs_of(m[0])] - each, least)):
                found.append((m.start() + a, 3, m.start() + b, m.start() + a, m.start() + b))
    return base, sorted(base + found) if found else base


def scan(docs: DataFrame, ratio: np.ndarray, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: str | None = None) -> DataFrame:
    """The ``keep`` columns with ``base`` and ``spans`` (arrays of kind, start, end in code points) of every row, and
    ``redacted``: the text with ``redact`` in place of each span (overlapping spans count as one), null without ``redact``."""
    small_batches(docs.sparkSession)
    inner = docs.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches):
            rest, cols = [b.column(i) for i in range(1, b.num_columns)], ([], [], [])
            for t in b.column(0).to_pylist():
                base, every = spans_of(t, ratio) if t else ([], [])
                for col, spans in zip(cols, (base, every)):
                    col.append([{"kind": KINDS[s[1]], "start": s[0], "end": s[2]} for s in spans])
                cols[2].append(blank(t, every, redact) if redact is not None else None)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cols[0], span), pa.array(cols[1], span), pa.array(cols[2], pa.string())], names=[*(f"_{i}" for i in range(len(rest))), "base", "spans", "redacted"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    schema = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + f", base {kind}, spans {kind}, redacted string"
    out = inner.mapInArrow(run, schema)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "base", "spans", "redacted")


def blank(text: str | None, spans: list, mark: str) -> str | None:
    if not spans:
        return text
    out, at, end = [], 0, 0
    for s in spans:
        if s[0] >= end:
            out += [text[at : s[0]], mark]
        end = at = max(end, s[2])
    return "".join([*out, text[at:]])


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of each base kind, the SHA-256 of the base spans and all spans as text."""
    def joined(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")

    return scanned.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


__all__ = ["base_spans", "digest", "scan", "spans_of", "train"]
