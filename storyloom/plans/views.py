"""Views of the tables as books, scripts and registries, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.tables import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chapter, paragraph, text): conversations as chapters; users and assistants speak, the system narrates."""
    text = F.btrim(F.regexp_replace("text", r"\s+", " "))
    said = F.concat(F.lit("— "), text, F.lit(", — said "), F.col("role"), F.lit("."))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("paragraph"), F.when(F.col("role") == "system", text).otherwise(said).alias("text"))


SCRIPT = r"""
script AS (
  SELECT conv_id AS chapter, turn AS paragraph, CASE WHEN role = 'system' THEN t ELSE '— ' || t || ', — said ' || role || '.' END AS text
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)),
parts AS (
  SELECT chapter, paragraph, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS part, dash FROM (
    SELECT chapter, paragraph, dash, string_split(regexp_replace(CASE WHEN dash THEN regexp_replace(text, '^—\s*', '') ELSE text END, '([,.!?…:;»”"])\s+[—–]\s+', '\1' || chr(30), 'g'), chr(30)) AS p
    FROM (SELECT *, starts_with(text, '—') AS dash FROM script))),
spans AS (
  SELECT chapter, paragraph, part, CASE WHEN dash AND part % 2 = 0 THEN 'dialogue' ELSE 'narration' END AS hint, trim(t) AS text
  FROM parts WHERE trim(t) <> ''),
numbered AS (SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY paragraph, part) - 1 AS idx, paragraph, hint, text FROM spans)
"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script's spans, uncut (so that SQL can express them)."""
    from storyloom.operators.segment import segment

    return segment(script(spark, sf_dir), 1 << 30)


def speaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script's segments with type and speaker from the remarks."""
    from storyloom.operators.attribution import apply_tags, tag_speakers

    x = stored(spans(spark, sf_dir), "spans")
    return apply_tags(x, tag_speakers(x, cast_list(spark)))


def cast_list(spark: SparkSession) -> DataFrame:
    rows = [("c_user", "User", ["Asker"]), ("c_assistant", "Assistant", ["Helper"])]
    return spark.createDataFrame(rows, "id string, name string, aliases array<string>")


SPEAKING = SCRIPT + """,
speaking AS (
  SELECT n.*, CASE WHEN hint = 'dialogue' THEN 'dialogue' ELSE 'narration' END AS type,
         CASE WHEN hint <> 'dialogue' THEN 'narrator' ELSE coalesce(tag, 'unknown') END AS speaker
  FROM numbered n LEFT JOIN (
    SELECT chapter, paragraph, CASE WHEN text LIKE 'said user%' THEN 'c_user' WHEN text LIKE 'said assistant%' THEN 'c_assistant' END AS tag
    FROM spans WHERE part = 1 AND hint = 'narration') t USING (chapter, paragraph))
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, chapter, paragraph, text): sources as books, documents as chapters, lines as paragraphs."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text")).filter(F.col("text").rlike(r"\S"))


LINES = r"""
lines AS (
  SELECT source AS book, doc_id AS chapter, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS paragraph
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)),
kept AS (SELECT * FROM lines WHERE regexp_matches(text, '\S'))
"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, paragraph, text): documents of a source in order, each behind a heading, each fifth behind a part too."""
    docs = table(spark, sf_dir, "documents")
    base = F.col("doc_id") * 4
    n = F.col("doc_id") % 100
    rows = F.array(
        F.struct(base.alias("paragraph"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Part "), (n + 1).cast("string"))).alias("text")),
        F.struct((base + 1).alias("paragraph"), F.when(F.col("doc_id") % 3 == 0, (n + 1).cast("string")).otherwise(F.concat(F.lit("Chapter "), (n + 1).cast("string"))).alias("text")),
        F.struct((base + 2).alias("paragraph"), F.btrim(F.regexp_replace("text", r"\s+", " ")).alias("text")),
    )
    return docs.select(F.col("source").alias("book"), F.explode(rows).alias("r")).select("book", "r.paragraph", "r.text").filter("text is not null")
