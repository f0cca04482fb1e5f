"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of `block_bytes` bytes. The distinct blocks are sorted into integer names; then adjacent
names are paired and the sorted distinct pairs are named in turn, until each document has one name. Documents of equal
length have as many blocks, so (length, name) is an identity without collisions.

Scale: a block's bytes move once, already combined on the map side, so a block that a third of all rows hold moves once
for each map task. The sort key of a block is its 64-bit hash; where one hash has several contents, the contents decide
(`_contents`), which is checked on every run. All later levels move integers, half as many each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.storage import ID, RID, TEXT, kept_rows, keyed, same_key, stored


def _sorted_names(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    """An integer for each distinct row, in sorted order (increasing, not dense)."""
    return stored(keys.select(*cols).distinct().orderBy(*cols).withColumn(name, F.monotonically_increasing_id()), "names")


def _block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def identities(rows: DataFrame, block_bytes: int = 4096, block_hash=_block_hash) -> DataFrame:
    """For rows (_rid, _text): _rid, n_bytes, name; two texts are equal if and only if n_bytes and name are."""
    raw = F.coalesce(F.col(TEXT), F.lit("")).cast("binary")
    blocks = (
        rows.select(RID, raw.alias("raw"))
        .withColumn("n_bytes", F.octet_length("raw").cast("long"))
        .select(RID, "n_bytes", "raw", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((n_bytes - 1) div {block_bytes} as int)")))).alias("pos"))
        .select(RID, "n_bytes", "pos", F.expr(f"substring(raw, pos * {block_bytes} + 1, {block_bytes})").alias("block"))
        .withColumn("h", block_hash(F.col("block")))
    )
    contents = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"))
    hashes = stored(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")), "blocks")
    if hashes.filter("contents > 1").isEmpty():
        names = _sorted_names(hashes, ["h"], "name")
        level = blocks.select(RID, "n_bytes", "pos", "h").join(names, "h")
    else:
        names = _sorted_names(contents, ["h", "block"], "name")
        level = blocks.join(names, ["h", "block"])
    level = stored(level.select(RID, "n_bytes", "pos", "name"), "level")
    most = level.agg(F.max("pos")).first()[0] or 0
    done, width = [], 1
    while True:
        single = F.col("n_bytes") <= block_bytes * width
        done.append(level.filter(single).select(RID, "n_bytes", "name"))
        if most < width:
            break
        pairs = (
            level.filter(~single)
            .groupBy(RID, "n_bytes", F.expr("pos div 2").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = stored(pairs, "pairs")
        level = stored(pairs.join(_sorted_names(pairs, ["a", "b"], "name"), ["a", "b"]).select(RID, "n_bytes", "pos", "name"), "level")
        width *= 2
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096, block_hash=_block_hash) -> DataFrame:
    """One row per row of docs: _rid, _id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group; very long texts are cut into blocks like others. Of equal texts
    the row with the largest id stays; of repeated ids one row stays; null ids rank below all others. An empty table gives no rows. Only the two named columns
    are read, so other columns may have any name.
    """
    return decide(keyed(docs, id_col, text_col), block_bytes, block_hash)


def decide(rows: DataFrame, block_bytes: int = 4096, block_hash=_block_hash) -> DataFrame:
    named = stored(identities(rows, block_bytes, block_hash), "identities")
    groups = named.groupBy("n_bytes", "name").agg(F.max(RID).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups, "groups")  # joins of plain exchanges can split a hot key
    ruled = named.join(groups, ["n_bytes", "name"]).select(RID, "keep", "group_size")
    digests = rows.select(RID, ID, F.sha2(F.coalesce(F.col(TEXT), F.lit("")).cast("binary"), 256).alias("text_sha256"))
    out = digests.join(ruled, RID)
    if same_key(rows):
        out = out.withColumn("keep_id", F.col("keep"))
    else:
        out = out.join(digests.select(F.col(RID).alias("keep"), F.col(ID).alias("keep_id")), "keep")
    return out.select(RID, ID, "keep_id", "group_size", (F.col(RID) == F.col("keep")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one of equal texts, with its columns, whatever their names; null and empty texts are equal."""
    return kept_rows(docs, lambda rows: decide(rows).filter("kept").select(RID), id_col, text_col)
