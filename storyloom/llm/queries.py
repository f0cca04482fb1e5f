"""The queries of the ten operators, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import exact_dedup, language, minhash, mixing, packing, quality_model, quality_rules, substring, suffix_dedup, toxicity

FAST_TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EXACT_TOKENS = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _fold(parts: int, held: int):
    """Whether an id is held out: crc32 of the id as text, modulo `parts`, is `held`."""
    return lambda i: F.coalesce(F.pmod(F.crc32(i.cast("string")), F.lit(parts)) == held, F.lit(False))


def _id(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(F.col("_id").alias("doc_id"), *columns)


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _documents(spark, sf_dir), _fold(4, 2)
    model = language.train(docs, held_out=held)
    return _id(language.identify(docs, model), held(F.col("_id")).alias("held_out"), "lang_pred", "score")


def op2_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(exact_dedup.exact_duplicates(_documents(spark, sf_dir)), "keep_id", "group_size", "kept", "text_sha256")


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(suffix_dedup.remove_repeats(_documents(spark, sf_dir), length=200), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(quality_rules.quality_rules(_documents(spark, sf_dir)), *quality_rules.COUNTS, "base_failed", "kept")


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(mixing.mix(_documents(spark, sf_dir)), "size", "source_size", "target", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_documents(spark, sf_dir), FAST_TOKENS, EXACT_TOKENS, window=1024, end_id=0)
    return _id(out, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _documents(spark, sf_dir), _fold(3, 1)
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", held)
    return _id(quality_model.score(docs, model), held(F.col("_id")).alias("held_out"), "score", "predicted")


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(substring.remove_repeats(_documents(spark, sf_dir), window=50), "n_words", "n_removed", "kept_sha256")


def op9_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _documents(spark, sf_dir), _fold(5, 0)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", held)
    return _id(toxicity.score(docs, model), held(F.col("_id")).alias("held_out"), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(minhash.near_duplicates(_documents(spark, sf_dir), shingle=4, similarity=0.8), "n_shingles", "component_id", (F.col("_id") == F.col("component_id")).alias("kept"))


QUERIES = {f.__name__: f for f in (op1_crf_language, op2_block_naming, op3_suffix_array, op4_rule_cascade, op5_pivotal_mix, op6_best_fit_packing, op7_nbsvm_quality, op8_seed_extend, op9_toxic_grammar, op10_minhash)}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op2_block_naming": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op3_suffix_array": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substring(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 199)) AS i FROM d WHERE length(h) >= 400)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
mark AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, r),
part AS (
  SELECT span.doc_id, r, substring(h, CAST(2 * coalesce(lag(b) OVER o, 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(lag(b) OVER o, 0)) AS BIGINT)) AS s
  FROM span JOIN d ON d.doc_id = span.doc_id WINDOW o AS (PARTITION BY span.doc_id ORDER BY r)),
rest AS (SELECT doc_id, string_agg(s, '' ORDER BY r) AS s FROM part GROUP BY doc_id),
total AS (SELECT doc_id, count(*) AS n, sum(b - a) AS bytes, max(b) AS last FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(s, '') || substring(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN rest ON rest.doc_id = d.doc_id LEFT JOIN total ON total.doc_id = d.doc_id""",
    "op4_rule_cascade": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
tri AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, (VALUES (0), (1), (2)) v(k)),
reps AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
pairs AS (SELECT doc_id, x || ' ' || lead(x) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM pairs WHERE g IS NOT NULL GROUP BY doc_id, g) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered,
         coalesce(top.n, 0) AS n_top
  FROM d LEFT JOIN reps ON reps.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = d.doc_id),
failed AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > word_chars) AND NOT (2 * n_dup_lines > n_lines)
       AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words) AND NOT (20 * n_distinct < n_words)
       AND NOT (2 * n_lettered < n_words) AND NOT (5 * n_top > n_words - 1) AS kept
FROM failed""",
    "op8_seed_extend": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
keys AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM win),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM keys) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
kept AS (SELECT words.doc_id, words.i, words.x FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL),
joined AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS s FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN joined ON joined.doc_id = d.doc_id""",
    "op10_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, twoway.y FROM reach JOIN twoway ON twoway.x = reach.y),
low AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT low.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, low.doc_id = component_id AS kept
FROM low LEFT JOIN n ON n.doc_id = low.doc_id""",
}
