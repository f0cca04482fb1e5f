"""Bounded samples of labelled rows, and models fitted on them in one task of an executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.textkit import release


def labelled(docs: DataFrame, labels: DataFrame | None, label_col: str, train, most: int, id_col: str = "doc_id", text_col: str = "text", text_bytes: int = 1 << 16) -> DataFrame:
    """(i, t, y): up to `most` rows of id, whole text and label, drawn by a hash of the id from the rows for which `train`
    holds. Of the rows drawn, those with texts of over `text_bytes` bytes are not learned from, so a sample has most *
    text_bytes bytes at most.

    labels: a table with the id and the label, or None if docs holds the label. The ids are drawn first; the bounded
    list of them is then joined with docs, so a text moves only if it was drawn.
    """
    table = (docs if labels is None else labels).select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    table = table.filter(train(F.col("i")) & F.col("y").isNotNull() & F.col("i").isNotNull()).groupBy("i").agg(F.max("y").alias("y"))
    n, hash_ = table.count(), F.xxhash64("i")
    # Rows whose hash is far beyond the sample's last cannot be drawn, so they are not sorted.
    share = min(1.0, (most + 10 * most**0.5 + 100) / max(1, n))
    drawn = table.filter(hash_ <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)).orderBy(hash_, "i").limit(most)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).filter(F.octet_length("t") <= text_bytes)
    return rows.join(F.broadcast(drawn), "i").groupBy("i").agg(F.first("t").alias("t"), F.first("y").alias("y"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, object]]], object]):
    """fit(rows), rows being the pairs of text and label of a bounded sample in the order of their ids.

    It runs in one task, as the sample is bounded; only the model comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        rows.sort(key=lambda r: r[0])
        model = cloudpickle.dumps(fit([(t, y) for _, t, y in rows]))
        del rows
        release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    made = sample.select("i", "t", "y").repartition(1).mapInArrow(run, "model binary").collect()
    return cloudpickle.loads(bytes(made[0][0])) if made else fit([])
