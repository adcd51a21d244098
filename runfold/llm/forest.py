"""Approximate nearest neighbours by a hash-prefix forest.

A vector less the centre is cut by a pool of ``pool`` hyperplanes, orthogonal to each other as far as the dimensions go.
A tree takes ``depth`` planes of the pool in an order of its own, so a vector's hash in a tree is a string of ``depth``
bits. A tree is the sorted array of its hash strings: vectors that share a prefix stand together, so a query finds its
longest matches by binary search (the descent). The trees are then ascended together, one bit of prefix at a time, until
their ranges hold ``share`` times as many entries as there are rows. Rows in those ranges are ordered by how many bits
of the whole pool they share with the query, and the first of them, 16 * sqrt(N) + 200 of N rows, are ranked by exact
distance in double precision. So the part of the rows that is scored falls as the table grows.

The index is made once: the rows are dealt by a hash of their vectors into chunks of bounded size, each with the sorted
order of its trees, and written to the shared folder. As chunks are alike, each is ascended by itself. Queries go in
blocks of ``BLOCK`` against all chunks; the driver holds one block. The centre is the mean of at most ``FIT`` rows chosen
by a hash of their ids; every row is indexed. Of rows with equal vectors the ``k + 1`` smallest ids are indexed: ties go
to the smaller id, so no other can be in a result.

Vectors that are null, zero, or hold null or non-finite components, and null ids, take no part; vectors of another
length than a query's are no candidates of it. Equal distances go to the smaller id. An id with several different vectors
is as near as its nearest one, as a candidate and as a query, and stands once in a result. Repeated rows are one. An
empty table, or one without usable vectors, gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runfold.llm._common import Tables, small_batches

TREES, DEPTH, POOL, SHARE, SEED = 192, 24, 512, 0.6, 9
#: Rows of a chunk, bytes of its vectors, queries of a block and rows from which the centre is fitted, at most.
CHUNK, CHUNK_BYTES, BLOCK, FIT = 8192, 16 << 20, 1 << 16, 4096


def scored_rows(rows: int) -> float:
    """How many rows of a table a query scores by exact distance, in all chunks together."""
    return 16 * rows**0.5 + 200


class Planes:
    """The pool of hyperplanes for vectors of one length, and the planes of each tree."""

    def __init__(self, width: int, trees: int, depth: int, pool: int, seed: int, center: np.ndarray | None):
        rng = np.random.default_rng([seed, width])
        blocks = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-pool // width))] if width <= pool else [np.linalg.qr(rng.normal(size=(width, pool)))[0]]
        self.planes = np.concatenate(blocks, axis=1)[:, :pool]
        self.trees = np.stack([rng.permutation(pool)[:depth] for _ in range(trees)])
        self.center = np.zeros(width) if center is None else center
        self.depth = depth

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Rows x pool."""
        return (x - self.center) @ self.planes > 0

    def codes(self, bits: np.ndarray) -> np.ndarray:
        """Hash strings as integers, first bit highest: trees x rows."""
        columns = np.ascontiguousarray(bits.T).astype(np.int32)
        out = np.zeros((len(self.trees), len(bits)), np.int32)
        for d in range(self.depth):
            out <<= 1
            out |= columns[self.trees[:, d]]
        return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    out = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(out, ((0, 0), (0, -out.shape[1] % 8)))).view(np.uint64)


class Chunk:
    """Some of the index: ids, vectors, their bits, and the sorted hash strings of each tree with the rows' order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, planes: Planes, order: np.ndarray | None = None):
        self.ids, self.x, self.depth = ids, x, planes.depth
        bits = planes.bits(x)
        self.words, codes = packed(bits), planes.codes(bits)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.uint16) if order is None else order
        self.sorted = np.take_along_axis(codes, self.order.astype(np.int64), axis=1)

    def ranges(self, q: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries stand that share ``level`` bits with the queries' codes (trees x queries)."""
        free = (self.depth - np.broadcast_to(level, q.shape[1])).astype(np.int64)
        low = q.astype(np.int64) >> free << free
        high = low + (np.int64(1) << free)
        return tuple(np.stack([np.searchsorted(s, v.astype(np.int32)) for s, v in zip(self.sorted, side)]) for side in (low, high))

    def ascend(self, q: np.ndarray, entries: float) -> tuple[np.ndarray, np.ndarray]:
        """The ranges at each query's longest prefix at which they hold so many entries over all trees."""
        low, high = np.zeros(q.shape[1], np.int64), np.full(q.shape[1], self.depth)
        while (low < high).any():  # the levels between which each query's lies are halved
            middle = (low + high + 1) // 2
            a, b = self.ranges(q, middle)
            enough = (b - a).sum(0) >= entries
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return self.ranges(q, low)

    def nearest(self, ids: np.ndarray, x: np.ndarray, words: np.ndarray, codes: np.ndarray, k: int, share: float, part: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, and the ids and distances of the ``k`` nearest of the chunk's rows that it scores;
        ``part``: the rows it scores as a part of the chunk's, 2 * k at least."""
        low, high = self.ascend(codes, share * len(self.ids))
        most, seen = max(2 * k, int(np.ceil(part * len(self.ids)))), np.zeros(len(self.ids), bool)
        for j in range(len(ids)):
            seen[:] = False
            for t in range(len(self.order)):
                seen[self.order[t, low[t, j] : high[t, j]]] = True
            at = np.flatnonzero(seen & (self.ids != ids[j]))
            if len(at) > most:
                apart = np.bitwise_count(self.words[at] ^ words[j]).sum(1, dtype=np.int64)
                at = at[np.argpartition(apart, most)[:most]]
            diff = self.x[at] - x[j]
            far = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            own = self.ids[at]
            order = np.lexsort((own, far))
            first = np.sort(np.unique(own[order], return_index=True)[1])[:k]  # an id once
            yield j, own[order[first]], far[order[first]]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector (array of doubles) of the different rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors the places that have it, and the vectors."""
    start = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.diff(start)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield at, flat[start[at][:, None] + np.arange(width)]


class Forest:
    """An index in the shared folder: one row for each chunk."""

    def __init__(self, df: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, depth: int = DEPTH, pool: int = POOL, share: float = SHARE, seed: int = SEED):
        spark = df.sparkSession
        small_batches(spark)
        self.k, self.share, self.tables, rows = k, share, Tables(spark, "forest"), usable(df, key, vector)
        centers: dict[int, list] = {}
        for r in rows.orderBy(F.xxhash64("id"), "id").limit(FIT).collect():  # FIT rows at most
            centers.setdefault(len(r.v), []).append(r.v)
        means = {width: np.mean(np.array(vs, dtype=np.float64), axis=0) for width, vs in centers.items()}
        self.planes = lambda width: Planes(width, trees, depth, pool, seed, means.get(width))
        planes = self.planes
        same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
        few = rows.withColumn("_place", F.dense_rank().over(same)).where(F.col("_place") <= k + 1).select("id", "v").distinct()

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}

            def out(width: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                order = Chunk(ids, x, planes(width)).order
                narrow = x.astype(np.float32)
                x = narrow if (narrow == x).all() else x
                return pa.RecordBatch.from_pydict({"width": pa.array([width], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "trees": pa.array([order.tobytes()], pa.binary())})

            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for at, x in vectors(b.column(1)):
                    width = x.shape[1]
                    most = max(64, min(CHUNK, CHUNK_BYTES // (8 * width)))
                    mine = held.setdefault(width, [[], [], 0])
                    mine[0].append(ids[at])
                    mine[1].append(x)
                    mine[2] += len(at)
                    if mine[2] >= most:
                        i, v = np.concatenate(mine[0]), np.concatenate(mine[1])
                        whole = len(i) // most * most
                        for a in range(0, whole, most):
                            yield out(width, i[a : a + most], v[a : a + most])
                        held[width] = [[i[whole:]], [v[whole:]], len(i) - whole]
            for width, (ids, x, n) in held.items():
                if n:
                    yield out(width, np.concatenate(ids), np.concatenate(x))

        self.chunks = self.tables.keep(few.mapInArrow(build, "width int, ids binary, x binary, trees binary"), "index")
        self.rows = (self.chunks.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // 8

    def search(self, queries: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, vec_id and score (distance) of the nearest rows found for each query id, other than those of
        the same id."""
        spark = queries.sparkSession
        asked = usable(queries, key, vector).distinct()
        n = asked.count()
        blocks = max(1, -(-n // BLOCK))
        asked = self.tables.keep(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries", "block")
        found = None
        for block in range(blocks if n and self.rows else 0):  # a block of queries at a time, against the index as it lies
            got = self._block(asked.where(F.col("block") == block).select("id", "v").toArrow())
            got = self.tables.keep(got, f"found-{block}") if blocks > 1 else got
            found = got if found is None else found.unionByName(got)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return found

    def _block(self, rows: pa.Table) -> DataFrame:
        sent_ids = rows.column("id").to_numpy()
        by_width = {x.shape[1]: (sent_ids[at], x) for at, x in vectors(rows.column("v").combine_chunks())} if len(sent_ids) else {}
        sent = self.chunks.sparkSession.sparkContext.broadcast(by_width)
        k, share, planes, part = self.k, self.share, self.planes, scored_rows(self.rows) / max(1, self.rows)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query's nearest among the task's chunks."""
            asked: dict[int, tuple] = {}
            tops: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                for r in b.to_pylist():
                    width = r["width"]
                    if width not in sent.value:
                        continue
                    if width not in asked:
                        own = planes(width)
                        ids, x = sent.value[width]
                        bits = own.bits(x)
                        asked[width] = (own, ids, x, packed(bits), own.codes(bits))
                    own, ids, x, words, codes = asked[width]
                    n = len(r["ids"]) // 8
                    kind = np.float32 if len(r["x"]) == 4 * n * width else np.float64
                    chunk = Chunk(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"], kind).reshape(n, width).astype(np.float64), own, np.frombuffer(r["trees"], np.uint16).reshape(-1, n))
                    for j, i, far in chunk.nearest(ids, x, words, codes, k, share, part):
                        old = tops.get((width, j))
                        if old is not None:
                            i, far = np.concatenate([old[0], i]), np.concatenate([old[1], far])
                            at = np.lexsort((i, far))
                            at = at[np.sort(np.unique(i[at], return_index=True)[1])[:k]]
                            i, far = i[at], far[at]
                        tops[width, j] = i, far
            if tops:
                asker = np.concatenate([np.full(len(i), sent.value[w][0][j]) for (w, j), (i, _) in tops.items()])
                yield pa.RecordBatch.from_arrays([pa.array(asker, pa.int64()), pa.array(np.concatenate([i for i, _ in tops.values()]), pa.int64()), pa.array(np.concatenate([f for _, f in tops.values()]), pa.float64())], names=["query_id", "vec_id", "score"])

        each = self.chunks.mapInArrow(look, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(df: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """The ``k`` nearest rows of ``df`` found for each query id, by an index made for it; ``settings``: those of Forest."""
    return Forest(df, k, key=key, vector=vector, **settings).search(queries, key=key, vector=vector)


__all__ = ["Forest", "search"]
