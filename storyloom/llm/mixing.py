"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken target / source_size times on average. The whole part is taken outright; the
fractions are rounded by duels: two documents meet, mass moves from one to the other at random so that expectations
hold, and one of them becomes whole. Documents meet in order of size, so that a duel changes the source's words little.
Leaves of a bounded number of documents run first; what remains of each leaf (one document with a fraction) meets the
remains of its neighbours in the next level of a reduction tree, until each source has one, which is rounded by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm import textkit as T
from storyloom.llm.storage import ID, RID, TEXT, keyed, stored, with_own

EPS = 1e-9


def word_counts(rows: DataFrame) -> DataFrame:
    """For rows (_rid, _id, _text, source): _rid, _id, source, size."""
    kind = rows.schema[ID].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(3))
            n = [np.diff(T.words(raw, s[i:j], e[i:j], hashed=False).bounds) for i, j in T.slices(s, e)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(n) if n else [], pa.int64())], [RID, ID, "source", "size"])

    return rows.select(RID, ID, "source", TEXT).mapInArrow(count, f"{RID} long, {ID} {kind}, source string, size long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target for a table with source and size.

    Sources in code point order, null last, have the weights in turn and share total_share of all sizes; none gets more
    than `most` times its size, and the excess is shared again by weight. The fixed point of that is a water level: each
    target is the smaller of its limit and level times weight. Sorted by limit / weight, the sources at their limit come
    first, so the level is found in one pass over the (small, aggregated) table of sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    x = by.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    x = x.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    all_ = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("level", (F.sum("source_size").over(all_) * total_share - F.coalesce(F.sum("limit").over(rising), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(rising), F.lit(0.0))))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "k", "level"))).over(all_)
    x = x.withColumn("level", first["level"])
    return x.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least("limit", F.col("level") * F.col("w")), "limit")).alias("target"))


def chance(seed: int, *ids: int) -> float:
    """A number in [0, 1) that depends on its arguments alone."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *ids)).encode(), digest_size=7).digest(), "big") / 2**56


def duel(p: float, q: float, u: float) -> tuple[float, float]:
    """The masses of two fractions after they met: one is whole, and both keep their expectations."""
    s = p + q
    if s < 1:
        return (s, 0.0) if u * s < p else (0.0, s)
    return (1.0, s - 1) if u * (2 - s) < 1 - q else (s - 1, 1.0)


def rounds(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    """All duels of one leaf in order of size; column p becomes 0 or 1 for all rows but one at most."""
    pdf = pdf.sort_values(["size", "h", RID], kind="stable").reset_index(drop=True)
    rid, p = pdf[RID].tolist(), pdf["p"].tolist()
    held = None
    for i in range(len(p)):
        if p[i] <= EPS or p[i] >= 1 - EPS:
            p[i] = float(p[i] > 0.5)
        elif held is None:
            held = i
        else:
            a, b = duel(p[held], p[i], chance(seed, rid[held], rid[i]))
            p[held], p[i] = a, b
            if EPS < a < 1 - EPS:
                p[i] = float(b > 0.5)
            else:
                p[held] = float(a > 0.5)
                held = i if EPS < b < 1 - EPS else None
                p[i] = b if held is not None else float(b > 0.5)
    pdf["p"] = p
    return pdf


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, leaf_rows: int = 4096, fan_in: int = 64, seed: int = 7) -> DataFrame:
    """One row per row of docs: _rid, _id, source, size, source_size, target, copies, taken (copies * size).

    Null text has size 0; null is a source of its own, after all others; a source without words has target 0; very long
    texts are counted whole. Rows may repeat and ids may be null, each row is a document of its own; documents of equal size
    meet in the order of a hash of their keys; an empty table gives no rows. The draw depends on the ids and the seed alone
    (where ids repeat, also on the texts). Only the three named columns are read.
    """
    kept = keyed(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).cast("string").alias("source")), "_i", "_t", ("source",))
    return mix_rows(kept, weights, total_share, most, leaf_rows, fan_in, seed)


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with each row as often as the mix takes it, with its columns, whatever their names; rows without words are
    drawn like all others."""
    rows, back = with_own(docs, id_col, text_col, (F.col(source_col).cast("string").alias("source"),))
    taken = mix_rows(rows, **how).filter("copies > 0").select(RID, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.join(taken, RID).select(*back)


def mix_rows(kept: DataFrame, weights=(5, 2, 1), total_share=1.5, most=2.0, leaf_rows=4096, fan_in=64, seed=7) -> DataFrame:
    sizes = stored(word_counts(kept), "sizes")
    goal = stored(targets(sizes, weights, total_share, most), "targets")
    x = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    x = x.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    x = x.withColumn("whole", F.floor(F.col("ratio") + EPS)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    x = x.withColumn("h", F.xxhash64(F.lit(seed), RID)).withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("long"))
    leaves = x.groupBy("source", "class").agg(F.greatest(F.lit(1), F.count(F.lit(1)) / leaf_rows).cast("long").alias("n"))
    order = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    cond = x["source"].eqNullSafe(leaves["source"]) & (x["class"] == leaves["class"])
    x = x.join(leaves, cond).drop(leaves["source"]).drop(leaves["class"])
    x = x.withColumn("leaf", F.col("first") + F.pmod("h", "n")).select(RID, ID, "source", "size", "source_size", "target", "whole", "p", "h", "leaf")
    fields = x.schema
    out, level = [], x
    while True:
        level = stored(level.groupBy("source", "leaf").applyInPandas(lambda pdf: rounds(pdf, seed), fields), "duels")
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        out.append(level.filter(~open_))
        level = level.filter(open_)
        if (level.agg(F.max("leaf")).first()[0] or 0) == 0:
            last = F.pmod(F.xxhash64(F.lit(seed + 1), RID), F.lit(1 << 30)) / F.lit(float(1 << 30))
            out.append(level.withColumn("p", (last < F.col("p")).cast("double")))
            break
        level = level.withColumn("leaf", F.expr(f"leaf div {fan_in}"))
    done = out[0]
    for y in out[1:]:
        done = done.unionByName(y)
    return done.select(RID, ID, "source", "size", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
