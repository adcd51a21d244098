"""Document fingerprints: SimHash over weighted terms, and permuted block tables for all near fingerprints.

A text's terms are its words: A-Z lower-cased, cut at ASCII white space. Each occurrence of a term votes with the term's
weight on each of 64 bits by the bits of its hash; a bit of the fingerprint is 1 if the votes for 1 outweigh those for
0. A term weighs the square of its letters, 64 at most, so that short function words have little say. Everything is
DataFrame operations: the votes are two-lane sums in 64-bit integers, which hold any text that fits in a string cell.

``within`` finds, for each different fingerprint, all others within a Hamming radius: of 64 bits cut into blocks, any two
within the radius agree on all blocks but ``radius``; for each choice of the blocks that agree there is a table whose keys
are those blocks permuted to the front. The number of blocks grows with the number of fingerprints, so that keys stay
selective. The fingerprints under one key are compared in pairs of blocks of ``TOGETHER``, each pair of blocks in a row of
its own, so no key is one task's; no pair of fingerprints is a row unless it is asked for. A pair that agrees in several
tables counts in the first of them only. Where many different texts are near each other, the comparisons grow with the
square of their number.

A null text counts as empty; a text without words has the fingerprint of zeros. Equal texts have equal fingerprints.
Very long texts are voted on whole. The next document is the one with the next larger id; rows without an id come first
and rows with equal ids one after another, by their texts' hash. An empty table gives an empty result. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfold.llm._common import Tables

BITS, LANES = 64, 32
#: Bytes of the texts in a bucket, about, and rows at most; buckets are made up to a number that the driver can hold the
#: bounds of, beyond which they grow (a bucket is sorted by its task and may spill).
BUCKET_BYTES, BUCKET_ROWS, MOST_BUCKETS = 16 << 20, 4000, 1 << 15
#: Bits that may differ between near fingerprints; fingerprints under one key that are compared in one row.
RADIUS, TOGETHER = 3, 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")


def weight(term: Column) -> Column:
    n = F.least(F.length(term), F.lit(8))
    return (n * n).cast("long")


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each of ``keys`` with ``fingerprint`` (long). If the rows are dealt by some of the keys already, no
    exchange is needed."""
    lane = F.lit(1 | 1 << LANES).cast("long")
    each = df.select(*keys, F.explode(terms(F.col(text))).alias("_term"))
    each = each.select(*keys, F.xxhash64("_term").alias("_h"), weight(F.col("_term")).alias("_w"))
    sums = each.groupBy(*keys).agg(F.sum("_w").alias("_all"), *(F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(lane) * F.col("_w")).alias(f"_v{k}") for k in range(LANES)))
    low = F.lit((1 << LANES) - 1).cast("long")
    bit = None
    for k in range(LANES):
        v = F.col(f"_v{k}")
        for b, votes in ((k, v.bitwiseAND(low)), (k + LANES, F.shiftrightunsigned(v, LANES))):
            one = F.when(votes * 2 > F.col("_all"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            bit = one if bit is None else bit.bitwiseOR(one)
    return sums.select(*keys, bit.alias("fingerprint"))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def buckets_of(docs: DataFrame, key: str, rows: int | None) -> tuple[list[int], list[int | None]]:
    """Bounds of buckets of about ``rows`` rows by ``key`` (bucket i: from bound i on), and each bucket's least key.
    Without ``rows``, of as many as make BUCKET_BYTES on the average."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = rows or max(1, min(BUCKET_ROWS, int(BUCKET_BYTES * n / max(1, size))))
    want = max(1, min(MOST_BUCKETS, -(-n // rows)))
    bounds: list[int] = []
    if want > 1:
        got = docs.agg(F.percentile_approx(key, [i / want for i in range(1, want)], 50 * want)).first()[0] or []
        bounds = sorted(set(got))
    heads = {r.b: r.least for r in docs.groupBy(bucket(F.col(key), bounds).alias("b")).agg(F.min(key).alias("least")).collect()}
    return bounds, [heads.get(i) for i in range(len(bounds) + 1)] if heads else []


def bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by binary search; a null key is in the first bucket."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*(F.lit(b).cast("long") for b in bounds))
    at = F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), at, lambda acc, s: F.when((acc + s <= len(bounds)) & (F.get(table, acc + s - 1) <= key), acc + s).otherwise(acc)) if steps else at


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rows: int | None = None) -> DataFrame:
    """bucket, key, text, ``order`` columns and ``next`` (the next row's text by ascending key; after the last the
    first's). Rows are dealt once, by buckets of the key; the first row of each bucket is dealt to the bucket before
    as well, as its last, with ``ghost`` set. Null keys come first; rows with equal keys come by their text's hash."""
    narrow = docs.select(F.col(key).cast("long").alias("key"), F.octet_length(text).alias("size"))
    bounds, heads = buckets_of(narrow, "key", rows)
    full = [i for i, h in enumerate(heads) if h is not None or i == 0] if heads else []
    nulls = narrow.where("key IS NULL").limit(1).count() if heads else 0
    if 0 in full and heads[0] is None and not nulls:
        full.remove(0)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    rows_ = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows_ = rows_.withColumn("_b", bucket(F.col("key"), bounds))
    table = F.array(*(F.lit(before.get(i, 0)) for i in range(len(heads)))) if heads else F.array(F.lit(0))
    least = F.array(*(F.lit(h).cast("long") for h in heads)) if heads else F.array(F.lit(None).cast("long"))
    head_key = F.when(F.lit(bool(nulls)) & (F.col("_b") == 0), F.lit(None).cast("long")).otherwise(F.get(least, F.col("_b")))
    home = F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("ghost"))
    homes = F.when(F.col("key").eqNullSafe(head_key), F.array(home, F.struct(F.get(table, F.col("_b")).alias("bucket"), F.lit(1).alias("ghost")))).otherwise(F.array(home))
    dealt = rows_.select("key", "text", F.explode(homes).alias("_home")).select(F.col("_home.bucket").alias("bucket"), F.col("_home.ghost").alias("ghost"), "key", F.xxhash64("text").alias("tie"), "text")
    return dealt.withColumn("next", F.lead("text").over(order_of()))


def order_of():
    return Window.partitionBy("bucket").orderBy("ghost", F.col("key").asc_nulls_first(), "tie")


def edited(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The query's table: every text's fingerprint, that of the text with its last half replaced by the beginning of the
    next document's, how near they and the next document's fingerprint are, and ``n_near``: how many other fingerprints
    the table has within the radius."""
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edit", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    rows = rows.withColumn("place", F.row_number().over(order_of()))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edit").alias("body")))
    info = F.struct("key", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"))
    both = rows.select("bucket", "ghost", "place", info.alias("info"), F.explode(kinds).alias("_k"))
    both = both.select("bucket", "ghost", "place", "info", "_k.kind", "_k.body")
    marked = fingerprints(both, ["bucket", "ghost", "place", "info", "kind"], "body")
    pair = marked.groupBy("bucket", "ghost", "place", "info").agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edit"))
    pair = pair.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where("ghost = 0")
    pair = Tables(docs.sparkSession, "simhash").keep(pair.select("info.key", "info.n_chars", "info.edited_sha256", "own", "edit", "after"), "marked")
    counts = within(pair, radius=radius, column="own").groupBy("f").agg(F.sum(F.size("others")).cast("long").alias("n_near")).where("n_near > 0")
    out = pair.join(counts, pair["own"] == counts["f"], "left")
    return out.select(F.col("key").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def block_tables(n: int, radius: int) -> list[tuple[int, list[int]]]:
    """For each table the mask of the blocks that agree, and the masks of the blocks that must differ if no table before
    it has the pair: those before the last one that agrees. More fingerprints, more blocks and longer keys."""
    blocks = next((m for m in range(radius + 1, 17) if (m - radius) * (BITS // m) >= math.log2(max(2, n))), 16)
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    mask = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [(sum(mask[k] for k in kept), [mask[k] for k in range(kept[-1]) if k not in kept]) for kept in combinations(range(blocks), blocks - radius)]


def within(marked: DataFrame, *, radius: int = RADIUS, column: str = "fingerprint", together: int = TOGETHER) -> DataFrame:
    """f (a fingerprint) and others (fingerprints at most ``radius`` bits from it): for each of the different values of
    the column one row for each place where it has been compared, and each other in one of its rows only."""
    found = Tables(marked.sparkSession, "near").keep(marked.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct(), "found")
    tables = block_tables(found.count(), radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(signed(mask)).alias("key")) for t, (mask, _) in enumerate(tables)))
    keyed = found.select("f", F.explode(keys).alias("k")).select("f", "k.t", "k.key")
    parts = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / together).cast("int").alias("parts"))
    dealt = keyed.join(parts, ["t", "key"]).withColumn("block", F.pmod(F.xxhash64("f"), "parts").cast("int"))
    placed = dealt.select("t", "key", "f", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    placed = placed.select("t", "key", "f", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    side = [F.collect_list(F.when(F.col("block") == F.col(c), F.col("f"))) for c in "ij"]
    cells = placed.groupBy("t", "key", "i", "j").agg(side[0].alias("left"), side[1].alias("right"))
    gaps = F.get(F.array(*(F.array(*map(signed, g)).cast("array<long>") for _, g in tables)), F.col("t"))

    def near(x: Column, others: str) -> Column:
        return F.filter(others, lambda y: (F.bit_count(x.bitwiseXOR(y)) <= radius) & (x != y) & F.forall("gaps", lambda g: x.bitwiseXOR(y).bitwiseAND(g) != 0))

    def met(own: str, others: str) -> Column:
        return F.transform(own, lambda x: F.struct(x.alias("f"), near(x, others).alias("others")))

    each = F.when(F.col("i") == F.col("j"), met("left", "left")).otherwise(F.concat(met("left", "right"), met("right", "left")))
    return cells.withColumn("gaps", gaps).select(F.explode(each).alias("e")).select("e.f", "e.others").where(F.size("others") > 0)


def near(marked: DataFrame, *, radius: int = RADIUS, column: str = "fingerprint") -> DataFrame:
    """All pairs (a < b) of different fingerprints at most ``radius`` bits apart, with ``distance``."""
    pairs = within(marked, radius=radius, column=column).select(F.col("f").alias("a"), F.explode("others").alias("b")).where("a < b")
    return pairs.withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
