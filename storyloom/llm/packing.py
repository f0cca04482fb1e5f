"""Best-fit-decreasing packing of token sequences.

Documents are tokenised once and cut into full windows and one rest. Rests are placed by decreasing length, each in the
tightest open window that holds it; a segment tree indexed by remaining capacity finds that window. As lengths are
integers up to the window, all rests of one length are placed together: the driver sees at most `window` counts, plans
runs of windows instead of single ones, and the plan (a bounded table) tells each rest its place by its rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from storyloom.llm.storage import ID, TEXT, stored
from storyloom.llm.textkit import release

#: GPT-2's split pattern (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Capacities:
    """A segment tree over capacities 0..top: which of them some open window has left."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = [False] * (2 * self.size)

    def put(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of need or more that is there."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for counts[length] pieces of each length: (length, first rank, pieces, first window, offset), each run
    putting its pieces at one offset of consecutive windows; and the number of windows.

    The windows are those that best fit decreasing fills when it places one piece after another.
    """
    open_: dict[int, list[tuple[int, int]]] = {}
    tree, runs, made = Capacities(window), [], 0

    def leave(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    def fill(length: int, rank: int, first: int, n: int, capacity: int, each: int) -> int:
        """Puts `each` pieces into each of n windows that have `capacity` left; returns the next rank."""
        for k in range(each if n else 0):
            runs.append((length, rank, n, first, window - capacity + k * length))
            rank += n
        leave(capacity - each * length, first, n)
        return rank

    for length in sorted((x for x in counts if 0 < x <= window), reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, made, -(-(total - rank) // (window // length))
                made += n
            else:
                first, n = open_[capacity].pop()
                if not open_[capacity]:
                    tree.put(capacity, False)
            each = capacity // length
            whole = min(n, (total - rank) // each)
            rank = fill(length, rank, first, whole, capacity, each)
            if whole < n and (rest := min(total - rank, each)):
                rank = fill(length, rank, first + whole, 1, capacity, rest)
                whole += 1
            leave(capacity, first + whole, n - whole)
    return runs, made


def pieces(rows: DataFrame, ranks_path: str, window: int = 1024, end_id: int = 0, exact_path: str | None = None) -> DataFrame:
    """For rows (_id, _text): _id, start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, salt (the
    piece's number in its task, which tells equal rows apart).

    ranks_path: the vocabulary in tiktoken's form, which gives the same ids several times faster; exact_path: the same
    vocabulary in tokenizers' form, for texts that hold special tokens or that the fast path refuses.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast, exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), None
        made = 0
        for batch in batches:
            release()
            out: list[list] = [[] for _ in range(6)]
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = None
                if exact_path is None or "<|" not in text:
                    try:
                        ids = fast.encode_ordinary(text)
                    except (ValueError, RuntimeError):  # the fast library refuses some texts
                        if exact_path is None:
                            raise
                if ids is None:
                    if exact is None:
                        from tokenizers import Tokenizer

                        exact = Tokenizer.from_file(exact_path)
                    ids = exact.encode(text, add_special_tokens=False).ids
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                for at in range(0, len(ids), window):
                    part = raw[4 * at : 4 * (at + window)]
                    for column, x in zip(out, (own, at, len(part) // 4, zlib.crc32(part), len(ids), made), strict=True):
                        column.append(x)
                    made += 1
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], names)
                    out = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), *(pa.array(x, pa.int64()) for x in out[1:])], names)

    names = [ID, "start", "length", "ids_crc32", "doc_tokens", "salt"]
    rows = rows.select(ID, TEXT)
    return rows.mapInArrow(cut, f"{ID} {rows.schema[ID].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:]))


def ranked(parts: DataFrame, rows_per_group: int = 4096) -> DataFrame:
    """parts with rank: its place among those of equal length. Each length is dealt into hash groups of about
    rows_per_group rows, so that a frequent length does not meet in one task."""
    groups = max(1, parts.count() // rows_per_group)
    dealt = parts.withColumn("g", F.pmod(F.xxhash64(ID, "start", "salt"), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy("length", "g").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))).select("length", "g", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "g").orderBy(ID, "start", "salt")
    return dealt.withColumn("i", F.row_number().over(inside) - 1).join(before, ["length", "g"]).withColumn("rank", F.col("before") + F.col("i")).drop("g", "i", "before")


def pack(docs: DataFrame, ranks_path: str, exact_path: str | None = None, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: _id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then end_id; null and empty texts are the end alone; very long texts are cut into full
    windows and a rest. Sequences are gapless from offset 0. Null and repeated ids and equal rows are packed like all others,
    each row apart; pieces of equal length go by a hash of their keys. An empty table gives no rows. Only the two named
    columns are read.
    """
    rows = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT))
    parts = stored(pieces(rows, ranks_path, window, end_id, exact_path), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, made = plan({k: n for k, n in counts.items() if k < window}, window)
    runs = sorted([*runs, (window, 0, counts.get(window, 0), made, 0)])
    table = np.array(runs, np.int64)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            cols = [batch.column(batch.schema.get_field_index(c)) for c in out]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], [*out, "sequence_id", "offset"])

    out = [ID, "start", "length", "ids_crc32", "doc_tokens"]
    kinds = [parts.schema[c] for c in out] + [S.StructField(c, S.LongType()) for c in ("sequence_id", "offset")]
    return ranked(parts).mapInArrow(place, S.StructType(kinds))
