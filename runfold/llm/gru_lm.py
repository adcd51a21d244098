"""LM scoring: a gated recurrent language model with a class-factored output, trained and run in numpy.

P(token | before) = P(class | state) * P(token | class, state). The state is that of a gated recurrent unit that reads the
tokens before. The end token is a class of its own; the ``HEADS * SLOTS`` most frequent words fall into ``HEADS`` classes by
frequency, and within a class a word is chosen by a softmax over the state as well. All other words fall into classes by
their spelling (their last letters), in which a word has its share of add-one counts over all training tokens, whatever the
state, and one unknown word has the share of a count of 0; the unit reads such a word as its class. So every string has a
probability, and those of a class's known words and its unknown one add up to 1.

Counts cover all training tokens and are joined, not broadcast; only the ``HEAD`` most frequent tokens, and the classes'
totals, are sent to every task. The recurrent weights are trained by truncated backpropagation (windows of ``WINDOW``
tokens, the state carried over from window to window) on every training document, in parallel on parts of them. There
are ``ROUNDS`` rounds, each on its own parts, and the weights are averaged over a round's parts after it. A table of few
documents is one part, read again and again. Texts are cut into tokens once, and training and scoring read their ids.
Scoring reads every whole text, in windows, and carries the state across them.

A null or empty text is its end token alone. Very long texts are scored whole. Repeated rows are trained on and scored as
rows like others. Words of equal counts are ranked by their bytes. Without any training document nothing is known: the
base score is 0 and classes are equally likely. An empty table gives an empty result. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm._common import Tables, keep_freed, small_batches, texts, trim

#: Tokens that are sent to every task with their counts.
HEAD = 1 << 16
#: Bytes of text of which a task counts the tokens together.
COUNT_BYTES = 16 << 20
#: Classes of frequent words, words in each, and classes by spelling.
HEADS, SLOTS, SPELLED = 23, 64, 64
#: Ids of tokens: the end, frequent words by rank, classes by spelling; and the mark that a text begins with.
WORDS = HEADS * SLOTS
START = 1 + WORDS + SPELLED
CLASSES, HIDDEN = 1 + HEADS + SPELLED, 24
WINDOW, LANES = 32, 128
#: Rounds of training, and documents in a part. Fewer documents than make a part for each round are one part, which each
#: round reads whole, and again until it has seen LEAST_TOKENS, AGAIN times at most; below FEW_TOKENS in fewer lanes.
ROUNDS, PART_DOCS = 3, 3000
LEAST_TOKENS, FEW_TOKENS, AGAIN, RATE = 400_000, 1_000_000, 4, 0.02
SCORE_WINDOW, SCORE_LANES = 32, 512
#: Tokens of which a task holds the ids before it scores them together.
SCORE_TOKENS = 2_000_000
#: States whose softmaxes are worked out together: over classes (so that they stay in the cache) and within classes.
BLOCK, WITHIN = 1024, 8192
#: The end token. No word holds white space.
END = b"\n"


def spelled(word: bytes) -> int:
    """The id of a word that is none of the frequent ones: its class, by its last two bytes."""
    return 1 + WORDS + zlib.crc32(word[-2:]) % SPELLED


def spelled_column(word: Column) -> Column:
    tail = F.when(F.octet_length(word) > 2, F.substring(word, -2, 2)).otherwise(word)
    return (F.crc32(tail) % SPELLED + 1 + WORDS).cast("int")


def class_of(ids: np.ndarray) -> np.ndarray:
    """0 for the end, then the classes of frequent words, then those by spelling."""
    return np.where(ids == 0, 0, np.where(ids <= WORDS, (ids - 1) // SLOTS + 1, ids - WORDS + HEADS))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# ---- the recurrent unit -------------------------------------------------------------------------------------------


class Gru:
    """Weights in one flat vector: what each id adds to the three gates, recurrent weights, and the output weights of the
    classes and of the words within each class of frequent ones; an output's last weight is its bias."""

    shapes = (("e", (START + 1, 3 * HIDDEN)), ("u", (HIDDEN, 3 * HIDDEN)), ("o", (HIDDEN + 1, CLASSES)), ("w", (HEADS, HIDDEN + 1, SLOTS)))
    size = sum(int(np.prod(s)) for _, s in shapes)

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.shapes:
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, freq: np.ndarray, seed: int) -> np.ndarray:
        """Weights that give each id its share ``freq`` of the training tokens, whatever the state."""
        flat = np.random.default_rng(seed).normal(0, 0.1, cls.size).astype(np.float32)
        model = cls(flat)
        by_class = np.bincount(class_of(np.arange(START)), freq, CLASSES)
        model.o[-1] = np.log(by_class + 1e-6)
        model.w[:, -1] = np.log(freq[1 : 1 + WORDS].reshape(HEADS, SLOTS) + 1e-9)
        return flat

    def read(self, x: np.ndarray) -> np.ndarray:
        """What ids x (steps x lanes; START: a text's beginning) add to the gates: gates x steps x lanes x units."""
        gates = np.arange(3)[:, None, None]
        return self.e.reshape(-1, HIDDEN).take(3 * x[None] + gates, axis=0)

    def recurrent(self) -> np.ndarray:
        """The weights of each of the three gates by itself."""
        return np.ascontiguousarray(self.u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))

    @staticmethod
    def step(u: np.ndarray, e: np.ndarray, h: np.ndarray, out: np.ndarray, live: np.ndarray | None = None) -> None:
        """The next state (lanes x units; ``out``, not h itself) after reading e, in which the gates are left. Lanes that aren't live keep theirs.
        Each gate lies in one piece, so that no step goes through short rows."""
        zr, a = e[:2], e[2]
        z, r = zr
        for gate, weights in ((z, u[0]), (r, u[1])):
            gate += np.dot(h, weights, out=out)
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        if live is not None:
            z *= live[:, None]
        a += np.dot(r * h, u[2], out=out)
        np.tanh(a, out=a)
        np.subtract(a, h, out=out)
        out *= z
        out += h

    @staticmethod
    def log_chosen(p: np.ndarray, y: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
        """log of the softmax of each row of p at y, and sums; p becomes what is in proportion to all probabilities.
        wide: exponentials may leave the range of a float."""
        out = p[np.arange(len(y)), y]
        if wide and max(float(p.max(initial=0.0)), -float(p.min(initial=0.0))) > 60:
            top = p.max(1, keepdims=True)
            p -= top
            out -= top[:, 0]
        np.exp(p, out=p)
        total = p @ np.ones(p.shape[1], p.dtype)
        return out - np.log(total), total

    def wide(self) -> tuple[bool, bool]:
        """Whether an exponent over classes, or within them, could be beyond 60: a state is never beyond 1."""
        return tuple(float(np.abs(x).sum(-2).max()) > 60 for x in (self.o, self.w))

    @staticmethod
    def by_heads(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """The places of frequent words among the ids y, class after class; the words within their classes; and each class
        that occurs with its range of places."""
        head = (y - 1) // SLOTS
        head[(y < 1) | (y > WORDS)] = HEADS
        ends = np.cumsum(np.bincount(head, minlength=HEADS + 1)[:HEADS]).tolist()
        at = np.argsort(head.astype(np.uint8), kind="stable")[: ends[-1]]
        return at, (y[at] - 1) % SLOTS, [(k, slice(a, b)) for k, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]

    def within(self, own: np.ndarray, ranges: list[tuple[int, slice]]) -> np.ndarray:
        """Exponents of the words of each state's class, states in the order of by_heads."""
        p = np.empty((len(own), SLOTS), self.flat.dtype)
        for k, part in ranges:
            np.matmul(own[part], self.w[k], out=p[part])
        return p

    def log_p(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(id | state), rows of states that end in a 1."""
        out, cls, wide = np.empty(len(y), np.float64), class_of(y), self.wide()
        for at in range(0, len(y), BLOCK):
            out[at : at + BLOCK] = self.log_chosen(states[at : at + BLOCK] @ self.o, cls[at : at + BLOCK], wide[0])[0]
        for block in range(0, len(y), WITHIN):
            at, slot, ranges = self.by_heads(y[block : block + WITHIN])
            at += block
            out[at] += self.log_chosen(self.within(states[at], ranges), slot, wide[1])[0]
        return out

    def learn(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The gradient over one window (steps x lanes) that begins in state h, the state after it, and the loss."""
        n, (steps, lanes), kind = HIDDEN, x.shape, self.flat.dtype
        grad, wide, u = Gru(np.zeros_like(self.flat)), self.wide(), self.recurrent()
        e, hs = self.read(x), np.empty((steps + 1, lanes, n), kind)
        hs[0] = h
        on, full = live.astype(kind), live.all(1).tolist()
        for t in range(steps):
            self.step(u, e[:, t], hs[t], hs[t + 1], None if full[t] else on[t])
        states = np.ones((steps * lanes, n + 1), kind)
        states[:, :n] = hs[1:].reshape(-1, n)
        flat_y, share = y.ravel(), kind.type(1 / max(1, int(live.sum())))
        weight, cls = on.ravel() * share, class_of(flat_y)
        back, loss = np.empty((steps * lanes, n), kind), 0.0

        def slope(p: np.ndarray, chosen: np.ndarray, share: np.ndarray, wide: bool) -> np.ndarray:
            """The loss's slope by each exponent in p, in its place."""
            nonlocal loss
            logp, total = self.log_chosen(p, chosen, wide)
            loss -= float(logp @ share)
            p *= (share / total)[:, None]
            p[np.arange(len(chosen)), chosen] -= share
            return p

        for at in range(0, steps * lanes, BLOCK):
            part = slice(at, at + BLOCK)
            d = slope(states[part] @ self.o, cls[part], weight[part], wide[0])
            grad.o += states[part].T @ d
            np.matmul(d, self.o[:n].T, out=back[part])
        for block in range(0, steps * lanes, WITHIN):
            at, slot, ranges = self.by_heads(flat_y[block : block + WITHIN])
            at += block
            own, into = states[at], np.empty((len(at), n), kind)
            d = slope(self.within(own, ranges), slot, weight[at], wide[1])
            for k, part in ranges:
                grad.w[k] += own[part].T @ d[part]
                np.matmul(d[part], self.w[k, :n].T, out=into[part])
            back[at] += into
        back, before, (z, r, g) = back.reshape(steps, lanes, n), hs[:-1], e
        rest = 1 - z
        to_a, to_z, to_r = z * (1 - g * g), (g - before) * z * rest, before * r * (1 - r)
        gates, (dh, drh, more) = np.empty_like(e), np.zeros((3, lanes, n), kind)
        back_u = np.ascontiguousarray(u.transpose(0, 2, 1))
        for t in reversed(range(steps)):
            dz, dr, da = gates[:, t]
            dh += back[t]
            np.dot(np.multiply(dh, to_a[t], out=da), back_u[2], out=drh)
            np.multiply(dh, to_z[t], out=dz)
            np.multiply(drh, to_r[t], out=dr)
            dh *= rest[t]
            drh *= r[t]
            dh += drh
            dh += np.dot(dz, back_u[0], out=more)
            dh += np.dot(dr, back_u[1], out=more)
        for k, read in enumerate((before, before, r * before)):
            grad.u[:, k * n : (k + 1) * n] = read.reshape(-1, n).T @ gates[k].reshape(-1, n)
        flat_x = x.ravel().astype(np.uint16)
        order = np.argsort(flat_x, kind="stable")
        at = flat_x[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        rows = gates.reshape(-1, n).take(order[:, None] + np.arange(3) * (steps * lanes), axis=0).reshape(-1, 3 * n)
        grad.e[at[first]] = np.add.reduceat(rows, first, axis=0)
        return grad.flat, hs[-1], loss


class Adam:
    """Steps of a rate by running means of the gradient and its square; gradients longer than 1 are shortened. The means are
    kept without their factors of 0.1 and 0.01, and a stretch of weights at a time, which stays in the cache."""

    stretch = 1 << 14

    def __init__(self, size: int):
        self.m, self.v, self.steps = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> None:
        norm = float(np.sqrt(grad @ grad))
        self.steps += 1
        root = 0.1 / np.sqrt(1 - 0.99**self.steps)  # of the mean square, by the root of v
        least, by = np.float32(1e-6 / root), np.float32(rate * 0.1 / (1 - 0.9**self.steps) / root)
        for at in range(0, len(flat), self.stretch):
            part = slice(at, at + self.stretch)
            m, v, g = self.m[part], self.v[part], grad[part]
            if norm > 1:
                g *= np.float32(1 / norm)
            m *= np.float32(0.9)
            m += g
            v *= np.float32(0.99)
            g *= g
            v += g
            np.sqrt(v, out=g)
            g += least
            np.divide(m, g, out=g)
            g *= by
            flat[part] -= g


def joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all documents, one after another; where each begins, and at last their end; and what is read before each
    id (START before a document's first)."""
    ids = np.concatenate([*docs, np.zeros(0, np.int64)])
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs], dtype=np.int64)])
    read = np.concatenate([[START], ids[:-1]])[: len(ids)]
    read[begin[:-1]] = START
    return ids, begin, read


def fit(flat: np.ndarray, docs: list[np.ndarray], seed: int, rate: float) -> tuple[np.ndarray, int]:
    """Weights after reading the documents (arrays of ids), and their tokens. Lanes hold one document after another; a
    lane's state is carried from window to window and reset where a document begins. Few tokens are read several times,
    in fewer lanes. The rate falls to a tenth on the way."""
    model, rng = Gru(flat.astype(np.float32).copy()), np.random.default_rng(seed)
    tokens = sum(map(len, docs))
    times = max(1, min(AGAIN, round(LEAST_TOKENS / max(1, tokens))))
    most = LANES if tokens >= FEW_TOKENS else LANES // 4
    adam = Adam(len(model.flat))
    ids, begin, read = joined(docs)
    steps, seen = np.arange(WINDOW)[:, None], 0
    for _ in range(times):
        order, at = rng.permutation(len(docs)), 0
        long = np.argsort([-len(docs[i]) for i in order], kind="stable")[:most]  # first, so that none is left alone at the end
        order = np.concatenate([order[long], np.delete(order, long)])
        lanes = min(most, len(docs))
        place, end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)  # in ids, of each lane's document
        h = np.zeros((lanes, HIDDEN), np.float32)
        while True:
            free = np.flatnonzero(place >= end)
            new = order[at : at + len(free)]
            at += len(new)
            free, rest = free[: len(new)], free[len(new) :]
            place[free], end[free], h[free] = begin[new], begin[new + 1], 0
            if len(rest):  # lanes without a document are closed
                place, end, h = np.delete(place, rest), np.delete(end, rest), np.delete(h, rest, axis=0)
            if not len(place):
                break
            own = place + steps
            live = own < end
            own[~live] = 0
            x, y = np.where(live, read[own], START), np.where(live, ids[own], 0)
            place += WINDOW
            grad, h, _ = model.learn(x, y, live, h)
            adam.step(model.flat, grad, rate * max(0.1, 1 - seen / (times * tokens)))
            seen += int(live.sum())
    return model.flat, tokens


def log_likelihoods(model: Gru, docs: list[np.ndarray]) -> np.ndarray:
    """The sum of log10 P(id | state) over each document. Lanes hold one document after another, the longest first; a
    lane's state is carried from window to window until its document ends."""
    ids, begin, read = joined(docs)
    out, order, at = np.zeros(len(docs)), np.argsort(-np.diff(begin), kind="stable"), 0
    doc, place = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each lane
    h, u = np.zeros((0, HIDDEN), np.float32), model.recurrent()
    while True:
        busy = np.flatnonzero(place < begin[doc + 1])
        new = order[at : at + SCORE_LANES - len(busy)]
        at += len(new)
        doc, place = np.concatenate([doc[busy], new]), np.concatenate([place[busy], begin[new]])
        h = np.concatenate([h[busy], np.zeros((len(new), HIDDEN), np.float32)])
        if not len(doc):
            return out / np.log(10)
        end = begin[doc + 1]
        steps = min(SCORE_WINDOW, int((end - place).max()))
        own = place + np.arange(steps)[:, None]
        live = own < end
        own[~live] = 0
        place += steps
        hs, e = np.ones((steps, len(doc), HIDDEN + 1), np.float32), model.read(read[own])
        for t in range(steps):
            now = np.empty_like(h)
            model.step(u, e[:, t], h, now)
            hs[t, :, :HIDDEN] = h = now
        on = np.flatnonzero(live)
        some = hs.reshape(-1, HIDDEN + 1)
        logp = np.zeros(live.size)
        logp[on] = model.log_p(some if len(on) == live.size else some[on], ids[own.ravel()[on]])
        out[doc] += logp.reshape(live.shape).sum(0)


# ---- passes over the corpus ---------------------------------------------------------------------------------------


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, those of one text after another, as ``words`` has them; and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat = parts.flatten().cast(pa.binary())
    some = pc.not_equal(flat, b"").to_numpy(zero_copy_only=False)  # white space at an end cuts off an empty part
    before = np.concatenate([[0], np.cumsum(some)])
    return flat if some.all() else flat.filter(pa.array(some)), np.diff(before[parts.offsets.to_numpy()])


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a part of the training texts, the end token included."""
    held: list[pa.Array] = []
    size = 0

    def out() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])

    for b in texts(batches):
        flat, sizes = split(b.column(0))
        held += [flat, pa.array([END] * len(sizes), pa.binary())]
        size += b.nbytes
        if size > COUNT_BYTES:
            yield out()
            held.clear()
            size = 0
    yield out()


class Head:
    """The most frequent tokens by rank, with their counts. The end has id 0, the first WORDS others have ids by rank, the
    rest are classed by their spelling."""

    def __init__(self, ranked: list[tuple[bytes, int]]):
        self.words = pa.array([w for w, _ in ranked], pa.binary())
        self.ids = {END: 0} | {w: i + 1 for i, (w, _) in enumerate([r for r in ranked if r[0] != END][:WORDS])}
        self.logs = np.log10(np.array([n for _, n in ranked] + [0]) + 1.0)
        self.kind = np.array([self.ids.get(w, spelled(w)) for w, _ in ranked] + [0], dtype=np.int64)
        self.end = next((i for i, (w, _) in enumerate(ranked) if w == END), -1)

    def look_up(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of words among the most frequent tokens, -1 for others; and the ids of all."""
        at = pc.fill_null(pc.index_in(flat, self.words), -1).to_numpy().astype(np.int64)
        ids, rare = self.kind[at], np.flatnonzero(at < 0)
        ends = pc.binary_slice(flat.take(pa.array(rare)), -2).dictionary_encode()
        ids[rare] = np.array([spelled(w) for w in ends.dictionary.to_pylist()], np.int64)[ends.indices.to_numpy()]
        return at, ids


def train_part(sent, seed: int, rate: float):
    """One part's weights after a pass, as (place, weight * tokens) and the tokens at place -1."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        part = keys[0].as_py()
        keep_freed()
        docs = [np.frombuffer(x, np.uint16).astype(np.int64) for x in sorted(table["classes"].to_pylist())]
        flat, seen = fit(sent.value, docs, seed * 1000 + part, rate)
        trim()
        return pa.table({"at": pa.array(np.arange(-1, len(flat)), pa.int32()), "v": pa.array(np.concatenate([[seen], flat.astype(np.float64) * seen]), pa.float64())})

    return run


def dealt(n_docs: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of parts, and for each round the parts it learns from: those that leave a remainder by a divisor."""
    parts = round(n_docs / PART_DOCS)
    return (1, [(1, 0)] * ROUNDS) if parts < ROUNDS else (parts, [(ROUNDS, k) for k in range(ROUNDS)])


def train(docs: DataFrame, freq: np.ndarray, n_docs: int, *, seed: int = 17) -> np.ndarray:
    """Averaged weights after ROUNDS rounds over all rows of docs: a hash ``at`` of each document and its ``classes``."""
    spark = docs.sparkSession
    flat = Gru.start(freq, seed)
    parts, rounds = dealt(n_docs)
    lots = docs.select(F.pmod(F.xxhash64("at", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "classes")
    for k, (divisor, rest) in enumerate(rounds):
        now = spark.sparkContext.broadcast(flat)
        own = lots.where(F.col("part") % divisor == rest)
        got = own.groupBy("part").applyInArrow(train_part(now, seed + k, RATE / (1 + k)), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
        sums = {r["at"]: r["v"] for r in got}  # as many rows as weights
        if sums.get(-1):
            flat = np.array([sums[i] / sums[-1] for i in range(len(flat))], dtype=np.float32)
    return flat


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, as the contract of the query
    says; learned from the rows that aren't held out."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    tables = Tables(spark, "lm")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), held_out(key).alias("held"))
    training = rows.where("NOT held")
    counts = tables.keep(training.select("text").mapInArrow(count_tokens, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 16)  # counts by sixteenths of powers of two: a thousand steps at most
    cut, room = 1 << 20, HEAD
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.step):
        if r.words > room:
            break
        cut, room = r.step, room - r.words
    most = counts.where((step >= cut) | (F.col("word") == F.lit(END))).collect()  # HEAD words and the end at most
    ranked = sorted(((bytes(r.word), r.n) for r in most), key=lambda r: (-r[1], r[0]))
    head = Head(ranked)
    count = dict(ranked)
    single = [w for w in head.ids if w in count]
    by_class = counts.where(~F.col("word").isin(single)) if single else counts
    got = {r.c: (r.s, r.t) for r in by_class.groupBy(spelled_column(F.col("word")).alias("c")).agg(F.sum(F.col("n") + 1).alias("s"), F.sum("n").alias("t")).collect()}
    totals = np.array([0.0] * (1 + WORDS) + [float(got.get(c, (0, 0))[0] + 1) for c in range(1 + WORDS, START)])
    freq = np.array([count.get(w, 0) for w in head.ids] + [0] * (1 + WORDS - len(head.ids)) + [got.get(c, (0, 0))[1] for c in range(1 + WORDS, START)], dtype=np.float64)
    sent = spark.sparkContext.broadcast((head, np.log10(np.maximum(totals, 1.0))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_, logs = sent.value
        names = ["doc", "held", "at", "n_tokens", "known", "sums", "inside", "tail", "times", "classes"]
        for b in texts(batches):
            flat, counts_ = split(b.column(3))
            sizes, last = counts_ + 1, np.cumsum(counts_)
            first, n = last - counts_ + np.arange(len(last)), len(last)
            at, ids = head_.look_up(flat)
            rare = np.flatnonzero(at < 0)
            seldom = flat.take(pa.array(rare)).dictionary_encode()
            different = max(1, len(seldom.dictionary))
            tails, times = np.unique(np.searchsorted(last, rare, side="right") * different + seldom.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.searchsorted(tails // different, np.arange(n + 1)), pa.int32())
            at, ids = np.insert(at, last, head_.end), np.insert(ids, last, 0)
            common = head_.logs[at]
            inside = np.where(ids > WORDS, common, 0.0) - logs[ids]
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 2 * np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(ids.astype(np.uint16))])
            made = [pa.array(sizes), pa.array(np.add.reduceat(at >= 0, first, dtype=np.int64)), pa.array(np.add.reduceat(common, first)), pa.array(np.add.reduceat(inside, first))]
            made += [pa.ListArray.from_arrays(offsets, seldom.dictionary.take(pa.array(tails % different))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))), raw]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], names=names)

    kind = docs.schema[key].dataType.simpleString()
    # rows without an id are dealt to parts one by one, others by what they are
    at = F.when(F.col("doc").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc", "text"))
    coded = rows.select("doc", "held", at.alias("at"), "text").mapInArrow(encode, f"doc {kind}, held boolean, at long, n_tokens long, known long, sums double, inside double, tail array<binary>, times array<int>, classes binary")
    coded = tables.keep(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    flat = train(coded.where("NOT held"), freq / max(1.0, freq.sum()), count.get(END, 0))
    weights = spark.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        model = Gru(weights.value)
        waiting: list[pa.RecordBatch] = []
        classes: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            like = log_likelihoods(model, classes)
            at = 0
            for b in waiting:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(like[at : at + b.num_rows], pa.float64())], names=[*b.schema.names, "like"])
                at += b.num_rows
            for held_back in (waiting, classes):
                held_back.clear()

        size = 0
        for b in texts(batches):
            classes += [np.frombuffer(x, np.uint16).astype(np.int64) for x in b.column(b.num_columns - 1).to_pylist()]
            waiting.append(b.select(b.schema.names[:-1]))
            size += sum(map(len, classes[-b.num_rows :]))
            if size > SCORE_TOKENS:
                yield from out()
                size = 0
        if waiting:
            yield from out()
        trim()

    kept = ("row", "doc", "held", "n_tokens", "known", "sums", "inside")
    types = {"row": "long", "doc": kind, "held": "boolean", "n_tokens": "long", "known": "long", "sums": "double", "inside": "double"}
    scored = coded.select(*kept, "classes").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", like double")
    scored = tables.keep(scored, "scored")
    tail = coded.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    met = tail.join(counts.where(step < cut), "word").groupBy("row").agg(F.sum("times").alias("n"), F.sum(F.log10(F.col("n") + 1) * F.col("times")).alias("s"))
    out = scored.join(met, "row", "left")
    s, n = F.coalesce("s", F.lit(0.0)), F.coalesce("n", F.lit(0)).cast("long")
    return out.select(F.col("doc").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + n).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("sums") + s - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias("base_score"), (F.col("like") + F.col("inside") + s).alias("score"))
