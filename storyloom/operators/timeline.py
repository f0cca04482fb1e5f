"""Pauses, durations and offsets. Time is counted in whole samples, so sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG, Config
from storyloom.tables import scope


def pauses(segments: DataFrame, config: Config = CONFIG) -> DataFrame:
    """([book,] chapter, idx, paragraph, type, speaker, ...) with pause_ms before each segment."""
    w = Window.partitionBy(*scope(segments)).orderBy("idx")
    changed = (F.lag("speaker").over(w) != F.col("speaker")) | (F.lag("type").over(w) != F.col("type"))
    pause = F.when(F.lag("idx").over(w).isNull(), config.pause_chapter_ms).when(F.lag("paragraph").over(w) != F.col("paragraph"), config.pause_paragraph_ms).when(changed, config.pause_speaker_ms).otherwise(config.pause_same_ms)
    return segments.withColumn("pause_ms", pause)


def fake_samples(text: str = "text", rate: int = CONFIG.sample_rate):
    """The stand-in voice: a quarter second and 30 ms a character, 8 s at most."""
    return F.floor(F.least(F.lit(8.0), F.lit(0.25) + F.lit(0.03) * F.length(text)) * rate).cast("long")


def offsets(segments: DataFrame, config: Config = CONFIG) -> DataFrame:
    """pauses() with samples of each segment and end, the running end offset in samples of its chapter."""
    w = Window.partitionBy(*scope(segments)).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    x = pauses(segments, config).withColumn("samples", fake_samples(rate=config.sample_rate))
    return x.withColumn("end_sample", F.sum(F.col("pause_ms") * (config.sample_rate // 1000) + F.col("samples")).over(w))


def chapter_marks(chapters: DataFrame) -> DataFrame:
    """(book, chapter, duration in s) with start_ms and end_ms; milliseconds round half to even."""
    w = Window.partitionBy("book").orderBy("chapter").rowsBetween(Window.unboundedPreceding, 0)
    ms = F.bround(F.col("duration") * 1000).cast("long")
    x = chapters.withColumn("ms", ms).withColumn("end_ms", F.sum("ms").over(w))
    return x.withColumn("start_ms", F.col("end_ms") - F.col("ms")).drop("ms")
