"""Tables in the folder that all executors share: steps that cut lineage, named tables, and running values over blocks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(spark, "_storyloom_tables", None) or tempfile.mkdtemp(prefix="storyloom-")
        spark._storyloom_tables = found
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scope(df: DataFrame) -> list[str]:
    """What tells chapters apart: the book, where the rows name one, and the chapter."""
    return [c for c in ("book", "chapter") if c in df.columns]


def blocked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `block`: ranges of rows in the order of (by, order), of about equal size. Stored, as blocks are drawn anew
    each time they are computed."""
    return stored(df.repartitionByRange(*by, *order).withColumn("block", F.spark_partition_id()), "blocks")


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """df with running sums and last values that are not null, up to and with each row, in each group `by`.

    A window over a whole group would be one task. Here windows run inside blocks, and one row a block carries what came
    before it.
    """
    x = blocked(df.select("*", *(c.alias(f"_v_{n}") for n, c in (sums | lasts).items())), by, order)
    inside = Window.partitionBy(*by, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    ends = x.groupBy(*by, "block").agg(F.min(at).alias("_at"), *(F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums), *(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_b_{n}") for n in lasts))
    before = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums] + [F.last(f"_b_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts]
    carried = stored(ends.select(*by, "block", *carry), "carried")
    for n in sums:
        x = x.withColumn(n, F.sum(f"_v_{n}").over(inside))
    for n in lasts:
        x = x.withColumn(n, F.last(f"_v_{n}", ignorenulls=True).over(inside))
    x = x.join(carried, [*by, "block"])
    out = [c for c in df.columns if c not in sums and c not in lasts]
    return x.select(*out, *((F.col(n) + F.col(f"_b_{n}")).alias(n) for n in sums), *(F.coalesce(n, f"_b_{n}").alias(n) for n in lasts))


class Workspace:
    """Named tables in one folder. A table is replaced as a whole: its new rows are written to a folder of their own, and
    a pointer is renamed over the old one last, so a reader sees the old rows or the new ones, whenever a writer fails."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p, jvm

    def _current(self, name: str) -> str | None:
        fs, p, _ = self._fs(f"{self.root}/{name}/_pointers")
        if not fs.exists(p):
            return None
        found = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return found[-1].split(".", 1)[1] if found else None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table; one that is not there or whose rows cannot be read is empty if a schema is given."""
        at = self._current(name)
        if at is None:
            if schema is None:
                raise LookupError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{at}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replaces the table; df may be computed from its old rows."""
        made = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{made}")
        fs, folder, jvm = self._fs(f"{self.root}/{name}/_pointers")
        fs.mkdirs(folder)
        number = max([int(s.getPath().getName().split(".", 1)[0]) for s in fs.listStatus(folder)], default=0) + 1
        if not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_pointers/{number:012d}.{made}")):
            raise RuntimeError(f"another writer replaced {name}")
        return self.read(name)

    def put(self, name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        """Replaces the rows of the keys that df has, and keeps all others."""
        if not self.exists(name):
            return self.write(name, df)
        old = self.read(name)
        return self.write(name, old.join(df.select(*keys).distinct(), keys, "left_anti").unionByName(df, allowMissingColumns=True))


def scan_json(spark: SparkSession, paths: str, schema: str) -> DataFrame:
    """State kept as JSON files: (file, state); a file that does not parse has a null state, which counts as none."""
    x = spark.read.option("wholetext", True).text(paths)
    return x.select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("state"))
