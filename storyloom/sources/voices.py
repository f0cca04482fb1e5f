"""The voice library: JSON rows to voices, with the reasons why others are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG
from storyloom.functions.text import coerce, sha256_parts

VOICE = "struct<id:string,name:string,source:string,gender:string,age_group:string,style:array<string>,languages:array<string>,roles:array<string>,reference_audio:string,reference_text:string,builtin_speaker:string,license:string,notes:string>"
AGES = ("child", "teen", "young_adult", "adult", "elderly")


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content): the JSON files of a library's metadata folder."""
    x = spark.read.option("wholetext", True).text(f"{folder}/metadata/*.json")
    return x.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content"))


def parse_library(files: DataFrame) -> DataFrame:
    """(file, content) to voices with file, pos and error: each file is an object or a list of them. An error is unreadable
    JSON, a missing id, a source without what it needs, or an id that an earlier file or row has; else it is null."""
    listed = F.when(F.ltrim("content").startswith("["), F.col("content")).otherwise(F.concat(F.lit("["), "content", F.lit("]")))
    x = files.select("file", F.posexplode_outer(F.from_json(listed, f"array<{VOICE}>")).alias("pos", "v")).select("file", F.coalesce("pos", F.lit(0)).alias("pos"), "v.*")
    need = F.when(F.col("source") == "builtin", F.col("builtin_speaker")).otherwise(F.col("reference_audio"))
    bad = F.when(F.col("id").isNull(), "unreadable").when(~F.col("source").isin("reference", "builtin"), "unknown source").when(F.coalesce(need, F.lit("")) == "", "incomplete source")
    x = x.withColumn("bad", bad)
    place = F.row_number().over(Window.partitionBy("id", F.col("bad").isNull()).orderBy("file", "pos"))
    x = x.withColumn("error", F.coalesce("bad", F.when(place > 1, "duplicate id"))).drop("bad")
    x = x.withColumn("gender", coerce(F.col("gender"), ("male", "female"))).withColumn("age_group", coerce(F.coalesce("age_group", F.lit("adult")), AGES))
    return x.withColumn("roles", F.coalesce("roles", F.array(F.lit("character"))))


def with_availability(voices: DataFrame, digests: DataFrame, builtin: bool = True) -> DataFrame:
    """voices with available and fingerprint. digests (path, sha256) lists the library's audio files; a path that leaves
    the library is not available."""
    x = voices.join(digests.select(F.col("path").alias("reference_audio"), F.col("sha256").alias("digest")), "reference_audio", "left")
    escapes = F.col("reference_audio").rlike(r"^/|(^|/)\.\.(/|$)")
    own = F.col("source") == "builtin"
    x = x.withColumn("available", F.when(own, F.lit(builtin)).otherwise(F.col("digest").isNotNull() & ~escapes))
    return x.withColumn("fingerprint", fingerprint(own)).drop("digest")


def fingerprint(own: Column) -> Column:
    """16 hex digits of what shapes a voice's sound."""
    digest = F.when(own, "").otherwise(F.coalesce("digest", F.lit("missing")))
    return F.substring(sha256_parts(F.col("id"), F.col("source"), F.col("reference_text"), F.col("builtin_speaker"), digest), 1, 16)


def add_voice(voices: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """The library with new voices; an id that is taken is an error unless it may be overwritten."""
    if not overwrite and not voices.join(new.select("id"), "id", "left_semi").isEmpty():
        raise ValueError("a voice with this id is in the library")
    return voices.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def require(voices: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (voice_id, ...) with its voices; an id that the library lacks is an error."""
    lost = wanted.select(F.col("voice_id").alias("id")).distinct().join(voices.select("id"), "id", "left_anti").limit(5).collect()
    if lost:
        raise LookupError(f"voices not in the library: {sorted(r['id'] for r in lost)}; the narrator is {CONFIG.narrator_voice}")
    return wanted.join(voices.withColumnRenamed("id", "voice_id"), "voice_id")
