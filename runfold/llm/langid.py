"""Language ID by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance.

N-grams of one to three letters are counted inside words, each word standing between two borders; everything that is no
letter is a border. A profile is the ``size`` most frequent n-grams in order. The distance of a document to a language
is the sum, over the document's profile, of how far each n-gram is from its place in the language's profile, or the
profile's length if it is not there. The nearest language wins; equal distances go to the language with more training
text, then to the smaller name. The score is one less the distance as a part of the greatest possible one.

Training reads about ``sample`` labelled documents, however many there are, chosen by a hash in each language: all of a
language that has few, and equally many of the others. Prediction reads every whole text.
A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned. Equal texts, and so
repeated rows, get equal results; very long texts are read whole; an empty table gives an empty result. Columns to keep
may have any names but ``lang_pred`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.llm._common import small_batches, texts

SIZE, SAMPLE = 400, 20_000
#: Code of the border; a letter's code is its code point, which is larger.
EDGE = 1


@cache
def letters() -> np.ndarray:
    """For each code point, its code: the code point for letters, else the border."""
    return np.fromiter((i if chr(i).isalpha() else EDGE for i in range(0x110000)), dtype=np.uint32, count=0x110000)


def grams(text: str) -> np.ndarray:
    """The codes of all n-grams of one to three letters, borders included in those of two and three; empty without letters."""
    c = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = np.concatenate(([EDGE], c, [EDGE])).astype(np.int64)
    edge = c == EDGE
    keep = ~(edge[1:] & edge[:-1])
    c = np.concatenate((c[:1], c[1:][keep]))  # one border between words
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    edge = c == EDGE
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate((c[~edge], two, three[~edge[1:-1]]))


def profile(codes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent codes in order, ties by code."""
    if not len(codes):
        return codes
    u, n = np.unique(codes, return_counts=True)
    if len(u) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        k = n >= least
        u, n = u[k], n[k]
    return u[np.argsort(-n, kind="stable")][:size]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a part of the training texts."""
    for b in texts(batches):
        by: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if text and len(codes := grams(text)):
                by.setdefault(lang, []).append(codes)
        for lang, codes in by.items():
            u, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def rates(counts: dict[str, int], most: int) -> dict[str, float]:
    """The part of each language's documents to read, so that there are ``most``: all of those that have no more than an
    equal share of what the smaller ones leave, and that share of the others."""
    out, room = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        took = min(n, room / (len(counts) - k))
        out[lang], room = took / n, room - took
    return out


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = SIZE, seed: int = 7) -> list[tuple[str, np.ndarray]]:
    """Each language with its profile, the language with most text first. ``size`` n-grams
    for each language among about ``sample`` documents come to the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    part = rates({r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}, sample)
    if not part:
        return []
    limits = F.broadcast(docs.sparkSession.createDataFrame([(k, int((1 << 40) * r)) for k, r in part.items()], "lang string, below long"))
    chosen = rows.join(limits, "lang").where(F.pmod(F.xxhash64("key", "text", F.lit(seed)), F.lit(1 << 40)) < F.col("below")).select("text", "lang")
    counts = chosen.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    found: dict[str, list] = {}
    for r in best.orderBy("lang", "rank").collect():
        found.setdefault(r.lang, []).append((r.gram, r.n))
    order = sorted(found, key=lambda k: (-sum(n for _, n in found[k]) / part[k], k))
    return [(k, np.array([g for g, _ in found[k]], dtype=np.int64)) for k in order]


class Ranker:
    """The profiles laid out for one search: all their n-grams sorted, with the rank in each language."""

    def __init__(self, profiles: list[tuple[str, np.ndarray]]):
        self.langs = [k for k, _ in profiles]
        self.most = max((len(p) for _, p in profiles), default=1)
        self.codes = np.unique(np.concatenate([p for _, p in profiles])) if profiles else np.zeros(0, dtype=np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(profiles)), -1, dtype=np.int64)
        for j, (_, p) in enumerate(profiles):
            self.ranks[np.searchsorted(self.codes, p), j] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not len(p := profile(grams(text), self.most)):
            return "und", 0.0
        at = np.searchsorted(self.codes, p)
        at[at == len(self.codes)] = -1
        at[self.codes[at] != p] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, self.most, np.abs(ranks - np.arange(len(p))[:, None])).sum(0)
        j = int(np.argmin(far))
        return self.langs[j], float(1 - far[j] / (self.most * len(p)))


def predict(docs: DataFrame, profiles: list[tuple[str, np.ndarray]], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score`` of every row; only the text is looked at."""
    small_batches(docs.sparkSession)
    inner = docs.select(F.col(text).alias("_text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles)
        for b in texts(batches):
            got = [ranker.predict(t) for t in b.column(0).to_pylist()]
            rest = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*(f"_{i}" for i in range(len(rest))), "lang_pred", "score"])

    schema = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", lang_pred string, score double"
    return inner.mapInArrow(run, schema).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def held_out(key: str = "doc_id", mod: int = 4) -> Column:
    """Whether crc32 of the key as text leaves the remainder 2; a null key is held out of nothing."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == 2, F.lit(False))
