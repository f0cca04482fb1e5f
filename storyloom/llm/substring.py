"""Substring deduplication over words by seed and extend.

1. Seeds: each window of 50 words chooses one winnowed anchor (ten words). Windows of equal words choose equal anchors at
   equal places, so only texts that share an anchor can share a window. An anchor's neighbourhood is all words of the
   windows that chose it.
2. Join: anchors that one text alone has are dropped by one grouped pass. Occurrences with equal neighbourhoods are one
   class (64-bit hashes of anchor and neighbourhood); all but its first text match the first one in full.
3. Extend: the first occurrences of an anchor's classes are joined with one representative, the one of the smallest text,
   and each match is extended to the left and to the right, word by word, as far as both agree. Windows inside the match
   are repeats. A window that reaches beyond the match on one side can only be shared with occurrences that leave the
   representative at the same place with the same next word: these are the groups of the next round, which get a
   representative of their own. So occurrences are never paired with each other, and no match is missed.
4. The union of a text's matches are its maximal repeats of 50 words or more, which are removed.

Each round lengthens what the members of a group share by a word at least and drops its representative, so there are
2 * (window - gram) + 2 rounds at most. An anchor that a third of all texts hold is one key of grouped minima and of a
join with one row for each key; its occurrences are never gathered.
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
from storyloom.llm.storage import RID, TEXT, keyed, stored, with_ids

def _lists(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def seeds(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """For rows (_rid, _text): _rid, n_words, whole_sha256 (all words) and the anchors as parallel lists: hashes of anchor
    and neighbourhood, the anchor's place, first and last window."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            for i, j in T.slices(s, e, T.SLICE // 2):
                w = T.words(raw, s[i:j], e[i:j])
                hashes, at, first, last = owned(T.windows(w.hashes, gram), w.bounds, gram, window)
                context = T.span_keys(w.hashes, first, last + window) ^ T.mix((at - first).astype(T.U))
                bounds = np.searchsorted(at, w.bounds)
                base = w.bounds[np.searchsorted(w.bounds, at, "right") - 1]
                sha = [hashlib.sha256(b" ".join(raw[x:y].tobytes().split())).hexdigest() for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array(np.diff(w.bounds), pa.int64()), pa.array(sha), _lists(hashes.view(np.int64), bounds), _lists(context.view(np.int64), bounds),
                    *(_lists(x - base, bounds, pa.int32()) for x in (at, first, last)),
                ], names)

    names = [RID, "n_words", "whole_sha256", "anchor", "context", "at", "first", "last"]
    return rows.select(RID, TEXT).mapInArrow(find, f"{RID} long, n_words long, whole_sha256 string, anchor array<long>, context array<long>, at array<int>, first array<int>, last array<int>")


#: A node: an occurrence in a group, and which of its windows are open: those that begin lo..hi words before the anchor.
NODE = f"{RID} long, at int, lo int, hi int, left binary, mid binary, right binary"


def neighbourhoods(rows: DataFrame, gram: int, window: int) -> DataFrame:
    """For rows (_rid, _text, of[struct(anchor, at, first, last)]): a node for each, grouped by anchor. left: the words
    before the anchor, the nearest first; a blank follows each word of left and right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            out: list[list] = [[] for _ in names]
            for rid, x, y, of in zip(batch.column(0).to_pylist(), s.tolist(), e.tolist(), batch.column(2), strict=True):
                words = raw[x:y].tobytes().split()
                for o in of.as_py():
                    at, first, last = o["at"], o["first"], o["last"]
                    left = b"".join([w + b" " for w in words[first:at][::-1]])
                    right = b"".join([w + b" " for w in words[at + gram : last + window]])
                    for column, v in zip(out, (o["anchor"], rid, at, at - last, at - first, left, b" ".join(words[at : at + gram]), right), strict=True):
                        column.append(v)
                if len(out[0]) >= 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    names = ["g", RID, "at", "lo", "hi", "left", "mid", "right"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return rows.mapInArrow(run, f"g long, {NODE}")


def common(x: bytes, y: bytes) -> tuple[int, bytes]:
    """How many words x and y have in common from their beginnings, and the next word of x (empty at its end)."""
    if x == y:
        return x.count(b" "), b""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    p = ((differ & -differ).bit_length() - 1) // 8 if differ else n
    begin = x.rfind(b" ", 0, p) + 1
    end = x.find(b" ", begin)
    return x.count(b" ", 0, begin), x[begin : end if end >= 0 else len(x)]


def extend(node: tuple, to: tuple, reach: int, window: int) -> list[tuple]:
    """What the match of a node (g, rid, at, lo, hi, left, mid, right) with its representative (rid, at, left, mid, right)
    gives: nodes of the next round, and spans (None, rid, a, b, ...)."""
    g, rid, at, lo, hi, left, mid, right = node
    if to[:2] == (rid, at):
        return []
    key = lambda *parts: int.from_bytes(hashlib.blake2b(repr((g, *parts)).encode(), digest_size=8).digest(), "little", signed=True)
    if mid != to[3]:
        return [(key("mid", mid), rid, at, lo, hi, left, mid, right)]
    l, before = common(left, to[2])
    r, behind = common(right, to[4])
    out = []
    a, b = max(lo, reach - r), min(hi, l)
    if a <= b and to[0] < rid:
        out.append((None, rid, at - b, at - a + window, 0, None, None, None))
    if max(lo, l + 1) <= hi:
        out.append((key("left", l, before), rid, at, max(lo, l + 1), hi, left, mid, right))
    if lo <= (top := min(hi, l, reach - 1 - r)):
        out.append((key("right", r, behind), rid, at, lo, top, left, mid, right))
    return out


def one_round(nodes: DataFrame, reach: int, window: int) -> DataFrame:
    """Joins each node with the representative of its group, the occurrence in the smallest text, and extends."""
    # Of several places in the smallest text (as in a run of one word) any will do; a drawn one halves the others' lengths.
    place = F.struct(RID, F.xxhash64("at").alias("drawn"), "at", "left", "mid", "right")
    reps = nodes.groupBy("g").agg(F.min(place).alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", *(f"to.{c}" for c in (RID, "at", "left", "mid", "right")))
    reps = stored(reps, "representatives")
    joined = nodes.join(reps.toDF("g", *(f"to_{c}" for c in reps.columns[1:])), "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for row in zip(*columns, strict=True):
                out += extend(row[:8], row[8:], reach, window)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["g", RID, "at", "lo", "hi", "left", "mid", "right"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    x = joined.select(*names, *(f"to_{c}" for c in (RID, "at", "left", "mid", "right")))
    return stored(x.mapInArrow(run, f"g long, {NODE}"), "extended")


def removed(rows: DataFrame) -> DataFrame:
    """For rows (_rid, _text, a[], b[]), in which words a..b-1 go: _rid, n_removed and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            gone, sha = [], []
            for k in range(batch.num_rows):
                words = raw[s[k] : e[k]].tobytes().split()
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, batch.column(2)[k].as_py(), 1)
                np.add.at(depth, batch.column(3)[k].as_py(), -1)
                keep = np.cumsum(depth)[:-1] == 0
                gone.append(len(words) - int(keep.sum()))
                sha.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], [RID, "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, f"{RID} long, n_removed long, kept_sha256 string")


def repeats(rows: DataFrame, found: DataFrame, gram: int, window: int) -> DataFrame:
    """_rid, a, b: word spans of rows that a row with a smaller key has too; found: the stored seeds()."""
    places = found.select(RID, F.explode(F.arrays_zip("anchor", "context", "at", "first", "last")).alias("x")).select(RID, "x.*")
    known = places.groupBy("anchor").agg(F.min(RID).alias("low"), F.max(RID).alias("high"), F.min("context").alias("c1"), F.max("context").alias("c2")).filter("low < high")
    known = stored(known.select("anchor", "low", (F.col("c1") == F.col("c2")).alias("alone")), "known")  # joins of plain exchanges can split a hot key
    shared = stored(places.join(known, "anchor"), "shared")
    several = shared.filter("not alone")
    classes = stored(several.groupBy("anchor", "context").agg(F.min(F.struct(RID, "at", "first", "last")).alias("lead")), "classes")
    copies = several.join(classes.select("anchor", "context", F.col(f"lead.{RID}").alias("leader")), ["anchor", "context"]).filter(F.col(RID) > F.col("leader"))
    whole = shared.filter(F.col("alone") & (F.col(RID) > F.col("low"))).select(RID, "first", "last").unionByName(copies.select(RID, "first", "last"))
    spans = [whole.select(RID, F.col("first").alias("a"), (F.col("last") + window).alias("b"))]
    leads = classes.groupBy(F.col(f"lead.{RID}").alias(RID)).agg(F.collect_list(F.struct("anchor", "lead.at", "lead.first", "lead.last")).alias("of"))
    nodes = stored(neighbourhoods(rows.select(RID, TEXT).join(leads, RID).select(RID, TEXT, "of"), gram, window), "nodes")
    while not nodes.isEmpty():
        done = one_round(nodes, window - gram, window)
        spans.append(done.filter("g is null").select(RID, F.col("at").alias("a"), F.col("lo").alias("b")))
        nodes = done.filter("g is not null")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10) -> DataFrame:
    """One row per row of docs: _rid, _id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    A word goes if it lies in a window of `window` words that a row with a smaller id has too. Null and empty texts have
    no words; very long texts are read whole. Null ids rank first and repeated ids are rows of their own, in the order of a
    hash of their texts; of equal rows the first keeps its words; an empty table gives no rows; only the two named columns
    are read.
    """
    rows = keyed(docs, id_col, text_col)
    found = stored(seeds(rows, gram, window), "seeds")
    spans = stored(repeats(rows, found, gram, window).groupBy(RID).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")), "spans")
    cut = removed(rows.select(RID, TEXT).join(spans, RID).select(RID, TEXT, "a", "b"))
    out = found.select(RID, "n_words", "whole_sha256").join(cut, RID, "left")
    return with_ids(out.select(RID, "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")), rows)
