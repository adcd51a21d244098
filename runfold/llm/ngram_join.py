"""N-gram Jaccard join: near-duplicate documents by their sets of word n-grams (shingles), exactly.

Documents with equal sets are one *class*. Two classes link when ``100 * intersection >= percent * union``. A set's
shingles stand in one global order, rare before frequent, then by hash. With n shingles, of which a partner must share
at least n - slack, a prefix is taken that is extended until no choice of ``slack`` lost shingles can hide all common
keys: rare shingles are indexed singly and two of them must agree, frequent ones are dealt into small groups by hash
and indexed by combinations of two (very frequent ones: three) of a group. A group of g shingles still shows
a common key after the loss of g - 2 (g - 3) of them, so the prefix holds as soon as the groups' g - 1 (g - 2) and the
single shingles but one add up to more than the slack.
Which shingles count as frequent only steers the work; any answer gives the same links.

Candidates are compared by parity bitmaps first: for each shingle one bit is flipped in a bitmap of 4 to 8 bits a
shingle, and as many bits differ as shingles at most, so a pair with more different bits than a link allows is none.
What remains is contracted into clusters. A cluster is cut into levels by the sizes of its sets, so that linked sets are
of one level or of two next to each other, and a level into blocks; each pair of blocks that may hold links is a group of
its own, where every pair of the right sizes is compared by bitmap and then by the sets themselves. So a passage that
glues many unlinked texts together costs comparisons within neighbouring sizes, in as many tasks as it has block pairs.
A group gives links enough to connect what is linked in it, never all pairs.

A document without words, or without text, has the empty set and no link. With fewer words than ``width``, the whole
sequence is its one shingle. Repeated rows of one document id are one document; null ids have no part in components
but keep their rows. The shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runfold.llm._common import Tables, WordHashes, gives_back, mix, small_batches, texts, words

#: A shingle of more sets than this is frequent; of 16 times as many, very frequent.
RARE = 16
#: Entries of the table of frequent shingles at most (8 bytes each): it is broadcast.
MOST_FREQUENT = 1 << 20
#: Keys of up to so many classes give their pairs; the classes of larger ones are put into one cluster.
SMALL = 16
#: Classes and bytes of sets in a block of a cluster's size level.
BLOCK_CLASSES, BLOCK_BYTES = 256, 8 << 20
ONE, PAIR = 0, 1
#: Bits of the filter of ids at most, as a power of two: 16 MB.
MOST_FILTER = 27
#: Shingles that a task counts at a time.
COUNTED = 2_000_000
#: Rows of an Arrow batch of counts, with the rest of the last shingle's run before they are counted.
COUNTS_BATCH = 1 << 17
#: Sets of fewer shingles are indexed singly, those that may link with one in both ways.
SHORT = 24


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    ws = words(text)
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    h = hashes.of(ws)
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(ws) if len(ws) < width else width, dtype=np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n] + np.uint64(i))
    return np.unique(out)


def key_of(own: np.ndarray) -> int:
    """A set's class, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def slack_of(n: int, percent: int) -> int:
    """How many of n shingles a linked set may lack at most."""
    return n - -(-n * percent // 100)


def differ(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The most shingles by which linked sets of a and b shingles differ: a + b - 2 * (least intersection)."""
    least = -(-(a + b) * percent // (100 + percent))
    return a + b - 2 * least


def bits_of(n: int) -> int:
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap: the bit of each shingle flipped once."""
    flips = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(maps: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (rows) brought down to ``bits``; the parity of each half counts."""
    while maps.shape[-1] * 64 > bits:
        half = maps.shape[-1] // 2
        maps = maps[..., :half] ^ maps[..., half:]
    return maps


def groups_of(level: int, percent: int) -> int:
    """Into how many groups the frequent shingles of sets of 2**level to 2**(level+1) are dealt: a third of the slack."""
    return max(1, slack_of(1 << level, percent) // 3)


def signatures(own: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A set's keys and whether each is of a single shingle. often: 0 rare, 1 frequent, 2 very frequent, by shingle."""
    n = len(own)
    low, top = -(-n * percent // 100), n * 100 // percent  # the sizes of sets that it may link with
    keys, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    if low == top:  # only an equal set
        return keys[0], kinds[0]
    need = slack_of(n, percent) + 1
    rare, rest = own[often == 0], own[often > 0]
    if low < SHORT:  # sets too small for combinations: a prefix of single shingles, of which one must agree
        keys.append(mix(np.concatenate([rare, rest])[:need]))
        kinds.append(np.full(min(n, need), PAIR, np.int32))
    if top < SHORT:
        return np.concatenate(keys), np.concatenate(kinds)
    single = rare[: need + 1]
    keys.append(single)
    kinds.append(np.full(len(single), ONE, np.int32))
    got = max(0, len(single) - 1)
    if got < need:
        k_rest = np.where(often[often > 0] > 1, 3, 2)
        for level in {max(n, SHORT).bit_length() - 1, top.bit_length() - 1}:
            m = groups_of(level, percent)
            lots = (mix(rest ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64) * 4 + k_rest
            members: dict[int, list[int]] = {}
            sure = got
            for s, g in zip(rest.tolist(), lots.tolist()):
                members.setdefault(g, []).append(s)
                sure += len(members[g]) >= g % 4
                if sure >= need:
                    break
            for size in (2, 3):
                some = [c for g, ms in members.items() if g % 4 == size for c in combinations(ms, size)]
                if some:
                    a = np.array(some, dtype=np.uint64)
                    x = np.full(len(a), (level << 8) + size, dtype=np.uint64)
                    for j in range(size):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + a[:, j])
                    keys.append(x)
                    kinds.append(np.full(len(x), PAIR, np.int32))
    return np.concatenate(keys), np.concatenate(kinds)


# ---- passes over the texts ----------------------------------------------------------------------------------------


def count_often(width: int, percent: int):
    """(shingle, sets) of a task: all shingles with hashes so low that prefixes of rare shingles reach them, so their sums
    are exact; and of the others those of two or more sets, of which what is frequent in all has some."""
    low = np.uint64(int(2**64 * min(0.99, 1.25 * (100 - percent) / 100 + 0.02)))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = WordHashes(), np.empty(COUNTED, np.uint64), 0, set()

        def out() -> Iterator[pa.RecordBatch]:
            held[:size].sort()
            at = 0
            while at < size:
                end = int(np.searchsorted(held[:size], held[min(at + COUNTS_BATCH, size) - 1], side="right"))
                a, at = held[at:end], end
                first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                n = np.diff(first, append=len(a))
                keep = (n > 1) | (a[first] < low)
                u, n = a[first[keep]], n[keep]
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["shingle", "n"])

        for b in texts(batches):
            for text in b.column(0).to_pylist():
                own = shingles(text, width, hashes)
                if len(own) and (key := key_of(own)) not in seen:
                    seen.add(key)
                    for at in range(0, len(own), COUNTED):
                        part = own[at : at + COUNTED]
                        if size + len(part) > COUNTED:
                            yield from out()
                            size, seen = 0, set()
                        held[size : size + len(part)] = part
                        size += len(part)
        yield from out()

    return run


def index_texts(width: int, percent: int, sent):
    """Rows of two kinds: documents (doc_id, class, n, bitmap) and keys (key, kind, class, n), keys once a class and task."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        often_s, often_k = sent.value
        for b in texts(batches):
            docs: list[tuple] = []
            keys, kinds, classes, sizes = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = shingles(text, width, hashes)
                if not len(own):
                    docs.append((doc, None, 0, None))
                    continue
                key = key_of(own)
                first = key not in seen
                docs.append((doc, key, len(own), bitmap(own, bits_of(len(own))).tobytes() if first else None))
                if not first:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                at = np.searchsorted(often_s, own)
                at[at == len(often_s)] = 0
                often = np.where(often_s[at] == own, often_k[at], 0) if len(often_s) else np.zeros(len(own), np.int8)
                k, kind = signatures(own, often, percent)
                keys.append(k)
                kinds.append(kind)
                classes.append(np.full(len(k), key, np.int64))
                sizes.append(np.full(len(k), len(own), np.int32))
            n = len(docs)
            flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (kinds, np.int32), (classes, np.int64), (sizes, np.int32))]
            m = len(flat[0])
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * n + [1] * m, pa.int32()),
                pa.concat_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array(flat[0].view(np.int64), pa.int64())]),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(flat[1], pa.int32())]),
                pa.concat_arrays([pa.array([d[1] for d in docs], pa.int64()), pa.array(flat[2], pa.int64())]),
                pa.concat_arrays([pa.array([d[2] for d in docs], pa.int32()), pa.array(flat[3], pa.int32())]),
                pa.concat_arrays([pa.array([d[3] for d in docs], pa.binary()), pa.nulls(m, pa.binary())]),
            ], names=["what", "id", "kind", "class", "n", "bits"])

    return run


def places(docs: np.ndarray, bits: int) -> np.ndarray:
    """Three bits of a filter for each id."""
    h = mix(docs.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(h >> np.uint64(k)) & np.uint64(bits - 1) for k in (0, 18, 36)]).astype(np.int64)


def filter_of(docs: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``doc`` as 64-bit words: 16 bits for each id, 2**MOST_FILTER bits at most. It only
    spares work; what passes it wrongly falls out of the join after it."""
    bits = 1 << min(MOST_FILTER, max(10, (16 * docs.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, dtype=bool)
        for b in batches:
            flags[places(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()] = True
        own = np.packbits(flags, bitorder="little").view(np.int64)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["at", "word"])

    out = np.zeros(bits // 64, dtype=np.int64)
    got = docs.select("doc").mapInArrow(build, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out[got["at"].to_numpy()] = got["word"].to_numpy()  # 2**MOST_FILTER bits at most
    return out


def sets_of(width: int, sent):
    """(class, doc, own): the whole sets of the rows whose id passes the filter."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words_ = WordHashes(), sent.value
        for b in texts(batches):
            at = places(b.column(0).to_numpy(zero_copy_only=False), len(words_) * 64)
            b = b.filter(pa.array((words_[at >> 6] >> (at & 63) & 1).all(0)))
            made = [shingles(t, width, hashes) for t in b.column(1).to_pylist()]
            full = [len(own) > 0 for own in made]
            out = pa.RecordBatch.from_arrays([pa.array([key_of(own) for own in made], pa.int64()), b.column(0), pa.array([own.tobytes() for own in made], pa.binary())], names=["class", "doc", "own"])
            yield out.filter(pa.array(full, pa.bool_()))

    return run


# ---- candidates ---------------------------------------------------------------------------------------------------


def runs_of(percent: int):
    """From rows sorted by key: pairs of the classes under small keys, and stars under larger ones (kind 2). A run that
    goes on is held as its first class and, up to SMALL, its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub, members, kind = None, None, [], 0
        out: list[tuple[int, int, int]] = []

        def close():
            if 1 < len(members) <= SMALL:
                ms = sorted(set(members))
                for i, (na, a) in enumerate(ms):
                    for nb, c in ms[i + 1 :]:
                        if nb * percent > na * 100:
                            break
                        if a != c:
                            out.append((min(a, c), max(a, c), kind))

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            key = cols[0]
            if not len(key):
                continue
            alone = np.ones(len(key), bool)
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[:-1] != key[1:]
            alone[0] = alone[-1] = False  # may go on in another batch
            for i in np.flatnonzero(~alone).tolist():
                if key[i] != now:
                    close()
                    now, members, kind, hub = key[i], [], int(cols[1][i]), int(cols[2][i])
                c = int(cols[2][i])
                if len(members) <= SMALL:
                    if (int(cols[3][i]), c) not in members:
                        members.append((int(cols[3][i]), c))
                    if len(members) == SMALL + 1:
                        out.extend((min(hub, m), max(hub, m), 2) for _, m in members if m != hub)
                elif c != hub:
                    out.append((min(hub, c), max(hub, c), 2))
            if len(out) > 100_000:
                yield edges(out)
                out = []
        close()
        yield edges(out)

    return run


def edges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    x = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0], pa.int64()), pa.array(x[:, 1], pa.int64()), pa.array(x[:, 2].astype(np.int32), pa.int32())], names=["a", "b", "kind"])


def likely(percent: int):
    """Pairs whose bitmaps do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nb = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            most, keep = differ(na.astype(np.int64), nb.astype(np.int64), percent), np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                bits = min(len(x), len(y)) * 64
                keep[i] = int(np.bitwise_count(fold(x, bits) ^ fold(y, bits)).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(c[keep], pa.int64())], names=["a", "b"])

    return run


# ---- components ---------------------------------------------------------------------------------------------------


def components(edges_: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches. Alternates two contractions (all larger
    neighbours to the least one; all smaller ones to the least one) until nothing changes; each step is a written table."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of a task replaced by as few that connect the same."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := root.get(x, x)) != x:
                root[x] = x = root.get(p, p)
            return x

        def out() -> pa.RecordBatch:
            pairs = [(find(x), x) for x in root]
            pairs = [p for p in pairs if p[0] != p[1]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = find(x), find(y)
                root.setdefault(x, x)
                root.setdefault(y, y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > 100_000:
                yield out()
                root.clear()
        yield out()

    now = tables.keep(edges_.select("a", "b").mapInArrow(forest, "a long, b long").where("a <> b").distinct(), f"{name}-0")
    mark = None
    for step in range(1, 200):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = tables.keep(small, f"{name}-{step}")
        tables_mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tables.drop(f"{name}-{step - 1}")
        now = new
        if tables_mark == mark:
            break
        mark = tables_mark
    found = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


# ---- verification -------------------------------------------------------------------------------------------------


class Sets:
    """Some classes of a cluster by ascending size, with their bitmaps."""

    def __init__(self, classes: list[int], sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), classes[i]))
        self.classes, self.sets = [classes[i] for i in order], [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.maps: dict[int, tuple[int, np.ndarray]] = {}

    def bitmaps(self, bits: int, low: int, high: int) -> np.ndarray:
        """Of the sets from low to high; they are of the sizes that one set may link with."""
        if bits not in self.maps:
            self.maps[bits] = (low, np.zeros((0, bits // 64), np.uint64))
        start, have = self.maps[bits]
        if low < start:
            start, have = low, np.zeros((0, bits // 64), np.uint64)
        if high > start + len(have):
            have = np.concatenate([have, *(bitmap(s, bits)[None] for s in self.sets[start + len(have) : high])])
        self.maps = {bits: (start, have)}
        return have[low - start : high - start]


def meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_of(left: Sets, right: Sets | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``left``, or between left and right."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = x = root.get(p, p)
        return x

    out, other = [], right or left
    for i, (c, s) in enumerate(zip(left.classes, left.sets)):
        n = len(s)
        low = int(np.searchsorted(other.n, -(-n * percent // 100))) if right else i + 1
        high = int(np.searchsorted(other.n, n * 100 // percent, side="right"))
        if high <= low:
            continue
        bits = bits_of(n)
        far = np.bitwise_count(other.bitmaps(bits, low, high) ^ bitmap(s, bits)).sum(1, dtype=np.int64)
        for j in np.flatnonzero(far <= differ(n, other.n[low:high], percent)).tolist():
            d = other.classes[low + j]
            if find(c) != find(d) and meets(s, other.sets[low + j], percent):
                x, y = find(c), find(d)
                root[max(x, y)] = min(x, y)
                out.append((min(c, d), max(c, d)))
    return out


def verify(percent: int):
    """From rows of a group (cluster and cell: two of its blocks, or one with itself): links that connect what is linked."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        sides: list[tuple[list, list]] = [([], []), ([], [])]
        for side, c, own in zip(table["side"].to_pylist(), table["class"].to_pylist(), table["own"].to_pylist()):
            sides[side][0].append(c)
            sides[side][1].append(np.frombuffer(own, np.uint64))
        left = Sets(*sides[0])
        cell = keys[1].as_py()
        alone = cell["low"] == cell["high"] and cell["i"] == cell["j"]
        found = links_of(left, None if alone else Sets(*sides[1]), percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def cells_of() -> Column:
    """The cells (two levels of a cluster, a block of each) that a set goes to, and the side on which it stands: with each
    block of its own level, of the one above (on the left) and of the one below (on the right)."""
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda low, high, i, j, side: F.struct(F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j")).alias("cell"), side.cast("int").alias("side"))
    level, block = F.col("level"), F.col("block")
    own = F.transform(up_to("parts"), lambda w: at(level, level, F.least(block, w), F.greatest(block, w), block > w))
    above = F.transform(up_to("above"), lambda w: at(level, level + 1, block, w, F.lit(0)))
    below = F.transform(up_to("below"), lambda w: at(level - 1, level, w, block, F.lit(1)))
    return F.concat(own, above, below)


def join(docs: DataFrame, *, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links and equal sets) of every row."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    tables = Tables(spark, "ngram")
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    # frequent shingles: a table of bounded size
    often = tables.keep(rows.select("text").mapInArrow(count_often(width, percent), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > rare), "often")
    most = rare
    while (n := often.where(F.col("n") > most).count()) > MOST_FREQUENT:
        most *= 2
    got = often.where(F.col("n") > most).toPandas() if n else None
    shingle = got["shingle"].to_numpy(np.int64).view(np.uint64) if n else np.zeros(0, np.uint64)
    order = np.argsort(shingle)
    level = (1 + (got["n"].to_numpy() > 16 * most)).astype(np.int8)[order] if n else np.zeros(0, np.int8)
    sent = spark.sparkContext.broadcast((shingle[order], level))

    made = rows.mapInArrow(index_texts(width, percent, sent), "what int, id long, kind int, class long, n int, bits binary")
    made = tables.keep(made, "index", "what")
    own = made.where("what = 0").select(F.col("id").alias("doc"), "class", "n", "bits")
    keyed = made.where("what = 1").select(F.col("id").alias("key"), "kind", "class", "n")

    # candidates
    sorted_ = keyed.repartition("key").sortWithinPartitions("key")
    pairs = tables.keep(sorted_.mapInArrow(runs_of(percent), "a long, b long, kind int").groupBy("a", "b").agg(F.count("*").alias("hits"), F.max("kind").alias("kind")), "pairs")
    tables.drop("index/what=1")
    maps = own.where("bits IS NOT NULL").groupBy("class").agg(F.min("n").alias("n"), F.min("bits").alias("bits"))
    weak = pairs.where("kind = 1 OR (kind = 0 AND hits > 1)").select("a", "b")
    ends = [maps.select(F.col("class").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"bits{e}")) for e in "ab"]
    near = weak.join(ends[0], "a").join(ends[1], "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(likely(percent), "a long, b long")
    near = tables.keep(near, "likely")  # else each task would hold two Python workers, one for this and one for the forest
    cluster = tables.keep(components(near.unionByName(pairs.where("kind = 2").select("a", "b")), tables, "near"), "clusters")
    tables.drop("often", "pairs", "likely")

    # whole sets of the classes in clusters, once each, by the text of the class's first document
    firsts = own.where("class IS NOT NULL").groupBy("class").agg(F.min("doc").alias("doc"), F.min("n").alias("n"))
    wanted = firsts.join(cluster.select(F.col("node").alias("class"), "root"), "class")
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n")
    wanted = wanted.withColumn("level", level)
    sized = wanted.groupBy("root", "level").agg(F.count("*").alias("classes"), (F.sum("n") * 8).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sized = tables.keep(sized.select("root", "level", parts.alias("parts")), "sized")
    for name, off in (("parts", 0), ("below", 1), ("above", -1)):  # those of the level, and of the ones next to it
        wanted = wanted.join(sized.select("root", (F.col("level") + off).alias("level"), F.col("parts").alias(name)), ["root", "level"], "left")
    wanted = tables.keep(wanted.where("doc IS NOT NULL").withColumn("block", F.pmod(F.xxhash64("class"), "parts").cast("int")).drop("n"), "wanted")
    sieve = spark.sparkContext.broadcast(filter_of(wanted))
    sets = rows.where("doc IS NOT NULL").mapInArrow(sets_of(width, sieve), "class long, doc long, own binary").join(wanted, ["class", "doc"])
    placed = sets.select("root", "class", "own", F.explode(cells_of()).alias("at")).select("root", "class", "own", "at.cell", "at.side")
    links = placed.groupBy("root", "cell").applyInArrow(verify(percent), "a long, b long")
    links = tables.keep(links, "links")
    tables.drop("clusters", "wanted", "sized")
    joined = components(links, tables, "linked")
    tables.drop("links")

    # every class's component, by its smallest document
    home = firsts.join(joined.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = home.groupBy("root").agg(F.min("doc").alias("component"))
    label = home.join(least, "root").select("class", "component")
    out = own.select("doc", "class", "n").join(label, "class", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce(F.when(F.col("doc").isNotNull(), F.col("component")), F.col("doc")).alias("component_id"))
