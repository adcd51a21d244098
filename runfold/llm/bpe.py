"""BPE encoding and decoding by tree concatenation: halves of a long text encoded for themselves, and joined exactly.

A text of more than ``leaf`` characters is halved, anywhere, until its parts have at most ``leaf``; the parts are encoded
for themselves and joined again up the tree. At each join a window around it is looked at, which grows until it has on
either side a place where both the part's ids and the whole's must have a boundary: before white space that follows
something else, where the pre-tokenizer cuts whatever stands around (or the text's beginning or end). What lies between
the two places is encoded again and replaces the parts' ids between them. Where such a stretch is long because nothing
in it is white space, it is cut by the pre-tokenizer's own pattern, and a single pre-token longer than a leaf is a unit of
merging without any cut: its halves are joined in the same way, by windows of ids that are encoded again and grow until
their first and their last id are what they were. That is exact: a sequence of BPE tokens is the encoding of its text if
and only if each neighbouring pair is the encoding of its own text.

A text of more than ``split`` characters is more than one task's work: its parts are rows of their own, encoded wherever
there is room, and come together once for the joins. Special tokens in a text are cut out first; they end parts.

The fast encoder takes the same vocabulary as ranks; ``tests/llm`` hold it against the other library. A null or empty text
has no ids. Text that is no valid Unicode is encoded with replacement characters, as both libraries do. Repeated rows are
encoded one by one, with equal results; an empty table gives an empty result. Columns to keep may have any names but those
that are made.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfold.llm._common import small_batches, texts, tokenizer_path

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a part, and of a text whose parts are rows of their own.
LEAF, SPLIT = 2048, 1 << 16


def byte_of_char() -> dict[str, int]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and number the others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE read from a tokenizers file."""

    def __init__(self, path: str, leaf: int = LEAF):
        import tiktoken

        spec, back = json.load(open(path, encoding="utf-8")), byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in k): i for k, i in spec["model"]["vocab"].items() if k not in self.special}
        self.leaf = leaf
        self.fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.one = tiktoken.Encoding("one_piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def encode(self, text: str | None) -> list[int]:
        return self.count(text)[0]

    def count(self, text: str | None) -> tuple[list[int], int]:
        """A text's ids and how many joins they took."""
        if not text:
            return [], 0
        if len(text) <= self.leaf:
            return self.fast.encode(text, allowed_special="all", disallowed_special=()), 0
        ids: list[int] = []
        joins = 0
        for special, section in self.sections(text):
            if special:
                ids.append(self.special[section])
            else:
                cuts = self.cuts(section)
                ids += self.concatenate(section, cuts, [self.fast.encode_ordinary(section[a:b]) for a, b in zip(cuts, cuts[1:])])
                joins += len(cuts) - 2
        return ids, joins

    def sections(self, text: str) -> Iterator[tuple[bool, str]]:
        """The special tokens in a text (True) and what lies between them."""
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:]

    def cuts(self, text: str) -> list[int]:
        """Where the parts of a text begin and end: it is halved until no part is longer than a leaf."""
        n = 1
        while len(text) > n * self.leaf:
            n *= 2
        return [len(text) * i // n for i in range(n + 1)]

    def concatenate(self, text: str, cuts: list[int], parts: list[list[int]]) -> list[int]:
        """A text's ids from those of its parts, joined in pairs up the tree."""
        while len(parts) > 1:
            parts = [self.join(text, *cuts[i : i + 3], *parts[i : i + 2]) for i in range(0, len(parts), 2)]
            cuts = cuts[::2]
        return parts[0]

    def join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The ids of text[start:end] from those of its parts before and after the middle."""
        w = 16
        while True:
            a, b = max(start, middle - w), min(end, middle + w)
            cuts = [m.start() for m in CERTAIN.finditer(text, a, b) if a < m.start() < b]
            low = start if a == start else next((c for c in reversed(cuts) if c < middle), None)
            high = end if b == end else next((c for c in cuts if c > middle), None)
            if low is not None and high is not None:
                break
            w *= 2
        i = self.ids_of(reversed(left), len(text[low:middle].encode("utf-8", "replace")))
        j = self.ids_of(right, len(text[middle:high].encode("utf-8", "replace")))
        return left[: len(left) - i] + self.stretch(text[low:high]) + right[j:]

    def ids_of(self, ids: Iterable[int], size: int) -> int:
        """How many of the ids make up so many bytes; they end there, as there is a certain cut."""
        n = 0
        for i in ids:
            if size <= 0:
                break
            size -= len(self.bytes[i])
            n += 1
        if size:
            raise AssertionError("parts do not agree at a certain cut")
        return n

    def stretch(self, text: str) -> list[int]:
        """Ids of what lies between two certain cuts."""
        if len(text) <= self.leaf:
            return self.fast.encode_ordinary(text)
        return [i for p in self.cut.finditer(text) for i in (self.unsplit(p[0]) if len(p[0]) > self.leaf else self.one.encode_ordinary(p[0]))]

    def unsplit(self, piece: str) -> list[int]:
        """Ids of one pre-token: halves down to leaves, joined upward."""
        cuts = self.cuts(piece)
        parts = [self.one.encode_ordinary(piece[a:b]) for a, b in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            parts = [self.agree(a, b) for a, b in zip(parts[::2], parts[1::2])]
        return parts[0]

    def agree(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of a stretch without a cut from those of its halves."""
        w = 4
        while True:
            a, b = left[max(0, len(left) - w) :], right[:w]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            w *= 2
            try:
                new = self.one.encode_ordinary(b"".join(self.bytes[i] for i in a + b).decode())
            except UnicodeDecodeError:  # the window begins or ends inside a character
                continue
            if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]) and (whole_left or whole_right or len(new) > 1):
                return left[: len(left) - len(a)] + new + right[len(b) :]

    def decode(self, ids: list[int]) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", "replace")


#: Before white space that follows something else, the pre-tokenizer cuts, whatever stands around.
CERTAIN = regex.compile(r"(?<=\S)(?=\s)")


@cache
def bpe(path: str, leaf: int = LEAF) -> Bpe:
    return Bpe(path, leaf)


def _rows(df: DataFrame, column: str, keep: tuple[str, ...], made: list[pa.Field], schema: str, path: str, leaf: int, split: int | None, each) -> DataFrame:
    """The ``keep`` columns with what ``each`` (model, list of ids and joins) gives for the rows of ``column``; texts of
    more than ``split`` characters are encoded in parts that are rows of their own."""
    small_batches(df.sparkSession)
    names = [f"_{i}" for i in range(len(keep))]
    own = [f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keep, names)]
    inner = df.select(F.col(column).alias("_in"), *(F.col(c).alias(n) for c, n in zip(keep, names)))
    out_names = [*names, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path, leaf)
        for b in texts(batches, 128):
            values = b.column(0).to_pylist()
            new = each(model, values if split is None else map(model.count, values))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(v, f.type) for v, f in zip(new, made))], names=out_names)

    result = ", ".join([*own, schema])
    if split is None:
        out = inner.mapInArrow(run, result)
    else:
        length = F.coalesce(F.length("_in"), F.lit(0))
        out = inner.where(length <= split).mapInArrow(run, result)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of (row, kept columns, section, special, place, cuts, part); places ascend, cuts stand in a section's first."""
            model = bpe(path, leaf)
            for b in texts(batches, 1):
                place, text = 0, b.column(1)[0].as_py()
                for k, (special, section) in enumerate(model.sections(text)):
                    cuts = [0, len(section)] if special else model.cuts(section)
                    # a row of the parts' own holds many leaves, so that rows are few
                    step = max(1, split // 4 // model.leaf)
                    for i in range(0, len(cuts) - 1, step):
                        piece = cuts[i : i + step + 1]
                        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array([k], pa.int32()), pa.array([special]), pa.array([place], pa.int32()), pa.array([[c - piece[0] for c in piece]], pa.list_(pa.int32())), pa.array([section[piece[0] : piece[-1]]], pa.string())], names=["row", *names, "section", "special", "place", "cuts", "part"])
                        place += 1

        def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = bpe(path, leaf)
            for b in texts(batches, 16):
                ids = [[[model.special[t]]] if special else [model.fast.encode_ordinary(t[x:y]) for x, y in zip(cuts, cuts[1:])] for special, cuts, t in zip(*(b.column(c).to_pylist() for c in ("special", "cuts", "part")))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.list_(pa.int32())))], names=[*b.schema.names, "ids"])

        def together(keys: tuple, table: pa.Table) -> pa.Table:
            """One text's ids from those of its parts."""
            model, table = bpe(path, leaf), table.sort_by("place")
            sections: dict[int, list] = {}
            for k, special, cuts, t, ids in zip(*(table.column(c).to_pylist() for c in ("section", "special", "cuts", "part", "ids"))):
                s = sections.setdefault(k, [special, "", [0], []])
                s[2] += [len(s[1]) + c for c in cuts[1:]]
                s[1] += t
                s[3] += ids
            ids = [i for special, t, cuts, parts in sections.values() for i in (parts[0] if special else model.concatenate(t, cuts, parts))]
            new = each(model, [(ids, sum(len(s[2]) - 2 for s in sections.values()))])
            return pa.Table.from_arrays([*(table.column(n).slice(0, 1) for n in names), *(pa.array(v, f.type) for v, f in zip(new, made))], names=out_names)

        typed = ", ".join(["row long", *own, "section int, special boolean, place int, cuts array<int>, part string"])
        long = inner.where(length > split).select(F.monotonically_increasing_id().alias("row"), "_in", *names)
        parts = long.mapInArrow(part, typed).repartition("row", "place").mapInArrow(encode_parts, typed + ", ids array<array<int>>")
        out = out.unionByName(parts.groupBy("row").applyInArrow(together, result))
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *(f.name for f in made))


def encode(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, leaf: int = LEAF, split: int = SPLIT) -> DataFrame:
    """The ``keep`` columns with ``ids`` of every row's whole text."""
    made = [pa.field("ids", pa.list_(pa.int32()))]
    return _rows(docs, text, keep, made, "ids array<int>", path or tokenizer_path(), leaf, split, lambda model, got: [[ids for ids, _ in got]])


def decode(encoded: DataFrame, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The ``keep`` columns with ``decoded``, the text of every row's ids."""
    made = [pa.field("decoded", pa.string())]
    return _rows(encoded, ids, keep, made, "decoded string", path or tokenizer_path(), LEAF, None, lambda model, got: [[model.decode(x or []) for x in got]])


def round_trip(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, leaf: int = LEAF, split: int = SPLIT) -> DataFrame:
    """Encodes every row's whole text and decodes the ids again, in one pass: the ``keep`` columns with ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` (of the decoded text) and
    ``n_joins``, how many joins of parts gave the ids."""
    made = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()), pa.field("n_joins", pa.int32())]

    def each(model: Bpe, got: Iterable[tuple[list[int], int]]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for ids, joins in got:
            back = model.decode(ids).encode("utf-8", "surrogatepass")
            for o, v in zip(out, (len(ids), sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha256(back).hexdigest(), joins)):
                o.append(v)
        return out

    return _rows(docs, text, keep, made, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_joins int", path or tokenizer_path(), leaf, split, each)


__all__ = ["Bpe", "bpe", "decode", "encode", "round_trip"]
