"""Running counts over a folder that grows: each micro-batch leaves its partial counts, and readers add them up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def follow(spark: SparkSession, path: str, schema: StructType, by: list[str], out: str) -> None:
    """Counts the rows of files that came since the last call, by the columns `by`. path: a folder that grows, or one file
    of a folder, which then alone is read. A batch that is run again after a failure overwrites its own partial result, so
    every row counts once; state lives in `out` alone."""

    def save(batch: DataFrame, number: int) -> None:
        batch.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    pattern, place = ("*.parquet", path) if folder else (p.getName(), p.getParent().toString())
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(place)
    rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def totals(spark: SparkSession, by: list[str], out: str) -> DataFrame:
    """(by, n): the counts of all batches so far."""
    return spark.read.parquet(f"{out}/parts").groupBy(*by).agg(F.sum("n").alias("n"))
