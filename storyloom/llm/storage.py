"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (tests on one machine), a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_storyloom_dir", None) or tempfile.mkdtemp(prefix="storyloom-")
        spark._storyloom_dir = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Column names of keyed().
RID, ID, TEXT = "_rid", "_id", "_text"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (_rid long, _id, _text, extra...) in which _rid is unique and in the order of the ids, null ids first.

    Whole, unique, integer ids are the key themselves. With null, repeated or other ids the rows are sorted once and
    numbered; the numbered table is stored, so the key cannot change when a task is run again.
    """
    rows = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT), *extra)
    if rows.schema[ID].dataType.typeName() in ("long", "integer", "short", "byte"):
        n, m, there = rows.agg(F.count(F.lit(1)), F.countDistinct(ID), F.count(ID)).first()
        if n == m == there:
            return rows.select(F.col(ID).cast("long").alias(RID, metadata={OWN_KEY: True}), ID, TEXT, *extra)
    rest = [F.xxhash64(TEXT), *extra]
    return stored(rows.orderBy(ID, *rest).select(F.monotonically_increasing_id().alias(RID), ID, TEXT, *extra), "keyed")


#: Marks a _rid that is the id itself.
OWN_KEY = "own_key"


def same_key(rows: DataFrame) -> bool:
    """Whether keyed() made the ids themselves the key."""
    return bool(rows.schema[RID].metadata.get(OWN_KEY))


def with_ids(out: DataFrame, rows: DataFrame) -> DataFrame:
    """out with the _id of each _rid."""
    if same_key(rows):
        return out.withColumn(ID, F.col(RID).cast(rows.schema[ID].dataType))
    return out.join(rows.select(RID, ID), RID)


def with_own(docs: DataFrame, id_col: str, text_col: str, extra: tuple = ()) -> tuple[DataFrame, list]:
    """keyed() rows that hold all columns of docs in one struct, whatever their names, and the columns to select back."""
    own = [c for c in docs.columns if c not in (id_col, text_col)]
    plain = docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_t"), F.struct(F.lit(0).alias("_0"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own))).alias("_own"), *extra)
    rows = keyed(plain, "_i", "_t", ("_own", *(plain.columns[3:])))
    back = {id_col: F.col(ID).alias(id_col), text_col: F.col(TEXT).alias(text_col)} | {c: F.col(f"_own.c{k}").alias(c) for k, c in enumerate(own)}
    return rows, [back[c] for c in docs.columns]


def kept_rows(docs: DataFrame, choose, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, with its columns, whose _rid is in choose(rows)."""
    rows, back = with_own(docs, id_col, text_col)
    return rows.join(choose(rows), RID, "left_semi").select(*back)
