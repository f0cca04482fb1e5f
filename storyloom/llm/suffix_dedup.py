"""Suffix-array deduplication over bytes: every 200-byte string that starts in two places goes, wherever it starts.

1. Each 200-byte window chooses a winnowed anchor of 32 bytes; equal windows choose equal anchors at equal places. Windows
   whose anchor occurs once in all texts start nowhere else and are left out: that is pruning alone.
2. What is left is a set of regions, each an anchor with all bytes of the windows that chose it. Equal regions are
   combined into one with a count before any text moves.
3. Regions are dealt by anchor into shards of bounded size. In each shard the suffixes are sorted by the difference-cover
   algorithm (difference_cover.py), and adjacent prefixes are compared; a start is repeated if its neighbour agrees on 200
   bytes or its region occurs more than once. Equal windows have equal anchors, so no repeat crosses shards.
4. An anchor with more distinct regions than a shard should hold (a hot passage with many different neighbourhoods) is
   dealt by window instead: its windows are grouped by two 64-bit hashes in the cluster, which needs no bound.
5. The verdicts go back to all occurrences of a region, and a text's covered bytes are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import textkit as T
from storyloom.llm.anchors import owned
from storyloom.llm.difference_cover import repeated
from storyloom.llm.storage import RID, TEXT, keyed, stored, with_ids


#: Bytes of a step over byte windows, which need about 100 bytes of memory for each.
STEP = 1 << 19


def _anchors(data: np.ndarray, bounds: np.ndarray, gram: int, length: int) -> list[np.ndarray]:
    """owned() for texts of bytes, with a hash of each region; a long text goes in steps."""
    if len(bounds) > 2 or len(data) <= 2 * STEP:
        steps = [(0, len(data))]
    else:
        steps = [(a, min(len(data), a + STEP + length - 1)) for a in range(0, len(data) - length + 1, STEP)]
    out = []
    for a, b in steps:
        h, at, first, last = owned(T.byte_windows(data[a:b], gram), bounds if len(steps) == 1 else np.array([0, b - a]), gram, length)
        out.append([h, T.span_hashes(data[a:b], first, last + length) ^ T.mix((at - first).astype(T.U)), first + a, last + 1 - first])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def seeds(rows: DataFrame, gram: int, length: int) -> DataFrame:
    """For rows (_rid, _text): _rid, n_bytes, whole_sha256 and the anchors as parallel lists."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            for i, j in T.slices(s, e, STEP):
                sizes = e[i:j] - s[i:j]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                data = raw[s[i] : e[j - 1]] if int(e[j - 1] - s[i]) == int(bounds[-1]) else np.concatenate([raw[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)])
                h, c, first, size = _anchors(data, bounds, gram, length)
                cut = np.searchsorted(first, bounds).astype(np.int32)
                base = np.repeat(bounds[:-1], np.diff(cut))
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (h.view(np.int64), c.view(np.int64), (first - base).astype(np.int32), size.astype(np.int32))]
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(sha), *lists], names)

    names = [RID, "n_bytes", "whole_sha256", "anchor", "context", "first", "size"]
    return rows.select(RID, TEXT).mapInArrow(find, f"{RID} long, n_bytes long, whole_sha256 string, anchor array<long>, context array<long>, first array<int>, size array<int>")


def regions(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """For rows (_rid, _text, of[struct(anchor, context, n, first, size)]): a row for each region, with its bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, _, _ = T.text_bytes(batch.column(1))
            lists = batch.column(2)
            of = lists.flatten()
            anchor, context, n, first, size = (of.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            at = np.repeat(s, lists.value_lengths().to_numpy()) + first
            for i in range(0, len(anchor), 20_000):
                k = slice(i, i + 20_000)
                parts = [raw[a : a + m + length - 1].tobytes() for a, m in zip(at[k].tolist(), size[k].tolist(), strict=True)]
                shard = (T.mix(anchor[k].view(T.U)) % T.U(shards)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(anchor[k]), pa.array(context[k]), pa.array(n[k]), pa.array(parts, pa.binary())], ["shard", "anchor", "context", "n", "bytes"])

    return rows.mapInArrow(cut, "shard long, anchor long, context long, n long, bytes binary")


def _runs(hit: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """For each region the runs of its starts that hit, as a list first, end, first, end, ..."""
    flag = np.zeros(len(hit) + len(bounds), np.int8)
    base = bounds[:-1] + np.arange(1, len(bounds))
    at = np.arange(len(hit)) + np.repeat(np.arange(1, len(bounds)), np.diff(bounds))
    flag[at] = hit
    edge = np.flatnonzero(np.diff(flag)) + 1
    region = np.searchsorted(base, edge[0::2], "right") - 1
    cut = np.searchsorted(region, np.arange(len(bounds))) * 2
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((edge - np.repeat(base[region], 2)).astype(np.int32)))


def sort_shard(table: pa.Table, length: int) -> pa.Table:
    """The repeated starts of the regions of one shard: anchor, context, runs."""
    table = table.combine_chunks()
    raw, s, e, _ = T.text_bytes(table["bytes"])
    size = e - s
    begin = np.cumsum(size + 1) - size
    text = np.zeros(int((size + 1).sum()) + 1, np.uint8)
    for a, b, d in zip(s.tolist(), e.tolist(), begin.tolist(), strict=True):
        text[d : d + b - a] = raw[a:b] + 1
    owned_ = size - length + 1
    bounds = np.concatenate([[0], np.cumsum(owned_)])
    starts = np.repeat(begin - bounds[:-1], owned_) + np.arange(int(bounds[-1]))
    hit = repeated(text, starts, length) | np.repeat(table["n"].to_numpy() > 1, owned_)
    return pa.table({"anchor": table["anchor"], "context": table["context"], "runs": _runs(hit, bounds)})


def _by_window(parts: DataFrame, length: int) -> DataFrame:
    """The verdicts of sort_shard() for regions of crowded anchors, by grouped counts of windows."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(4))
            for i, j in T.slices(s, e, 1 << 18):
                size = e[i:j] - s[i:j]
                data = np.concatenate([raw[a:b] for a, b in zip(s[i:j], e[i:j], strict=True)])
                begin, n = np.cumsum(size) - size, size - length + 1
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(begin, n) + k
                one, two = T.span_hashes(data, at, at + length), T.span_hashes(data ^ np.uint8(0x55), at, at + length)
                again = lambda c: pa.array(np.repeat(batch.column(c).slice(i, j - i).to_numpy(), n))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([again(1), again(2), again(3), pa.array(k.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["anchor", "context", "n", "k", "one", "two"])

    rows = stored(parts.select("shard", "anchor", "context", "n", "bytes").mapInArrow(hashes, "anchor long, context long, n long, k int, one long, two long"), "windows")
    twice = rows.groupBy("one", "two").agg(F.sum("n").alias("m")).filter("m > 1").select("one", "two")
    twice = stored(twice, "twice")
    hit = rows.join(twice, ["one", "two"], "left_semi")
    return hit.groupBy("anchor", "context").agg(F.flatten(F.collect_list(F.array("k", F.col("k") + 1))).alias("runs"))


def removed(rows: DataFrame, length: int) -> DataFrame:
    """For rows (_rid, _text, first[], runs[][]): _rid, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            gone, spans, sha = [], [], []
            for i in range(batch.num_rows):
                first, lists = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values
                flat = lists.flatten().to_numpy() + np.repeat(first, lists.value_lengths().to_numpy())
                data = raw[s[i] : e[i]]
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, flat[0::2], 1)
                np.add.at(depth, flat[1::2] + length - 1, -1)
                out = np.cumsum(depth)[:-1] > 0
                gone.append(int(out.sum()))
                spans.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
                sha.append(hashlib.sha256(data[~out].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], [RID, "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"{RID} long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, shard_bytes: int = 500_000, crowded: int = 8000) -> DataFrame:
    """One row per row of docs: _rid, _id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `length` bytes over it starts anywhere else too, the same text included. Null texts are
    empty; very long texts are read in steps and cut into regions; null and repeated ids are rows of their own, so a repeated
    row is removed whole if it has `length` bytes, and no occurrence is preferred; an empty table gives no rows; only the two
    named columns are read. crowded: anchors with more distinct regions are dealt by window; that
    many regions are up to 3 MB, which the sort takes in about 200 MB of memory.
    """
    rows = keyed(docs, id_col, text_col)
    found = stored(seeds(rows, gram, length), "seeds")
    places = found.select(RID, F.explode(F.arrays_zip("anchor", "context", "first", "size")).alias("x")).select(RID, "x.*")
    known = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    known = stored(known, "known")  # a plain exchange on both sides lets the join split a hot anchor
    shared = stored(places.join(known, "anchor"), "shared")
    classes = stored(shared.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(RID, "first", "size")).alias("lead")), "classes")
    hot = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > crowded)
    leads = classes.select(F.col(f"lead.{RID}").alias(RID), F.struct("anchor", "context", "n", F.col("lead.first").alias("first"), F.col("lead.size").alias("size")).alias("x"))
    leads = leads.groupBy(RID).agg(F.collect_list("x").alias("of"))
    total = classes.agg(F.sum(F.col("lead.size") + length)).first()[0] or 0
    parts = stored(regions(rows.select(RID, TEXT).join(leads, RID).select(RID, TEXT, "of"), length, 1 + total // shard_bytes), "regions")
    hot = stored(hot, "crowded")
    few, many = parts, None
    if not hot.isEmpty():
        few, many = parts.join(hot, "anchor", "left_anti"), parts.join(hot, "anchor", "left_semi")
    verdicts = few.groupBy("shard").applyInArrow(lambda t: sort_shard(t, length), "anchor long, context long, runs array<int>")
    if many is not None:
        verdicts = verdicts.unionByName(_by_window(many, length))
    verdicts = stored(verdicts.filter(F.size("runs") > 0), "verdicts")
    spans = shared.select(RID, "anchor", "context", "first").join(verdicts, ["anchor", "context"]).groupBy(RID).agg(F.collect_list("first").alias("first"), F.collect_list("runs").alias("runs"))
    cut = removed(rows.select(RID, TEXT).join(spans, RID).select(RID, TEXT, "first", "runs"), length)
    out = found.select(RID, "n_bytes", "whole_sha256").join(cut, RID, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return with_ids(out.select(RID, "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")), rows)
