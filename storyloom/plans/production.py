"""Queries of page lines, labels, consolidation, voices and assembly, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import names as N
from storyloom.operators import assembly, attribution, casting, chapters, labels, plan, registry, timeline
from storyloom.plans import views as V
from storyloom.plans.queries import _PEOPLE, _TIMED, _people, query, voices
from storyloom.sources import voices as library
from storyloom.streaming import counts
from storyloom.tables import shared_dir

_PAGE_LINES = r"""
l AS (SELECT doc_id AS book, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
pl AS (SELECT book, pos // 20 AS page, pos, t AS text, CASE WHEN pos % 11 = 10 THEN 18.0 ELSE 12.0 END AS size,
  CASE WHEN pos % 7 = 6 THEN 30.0 ELSE 10.0 END AS x0, CASE WHEN pos % 7 = 6 THEN 30.0 ELSE 10.0 END + least(length(t), 90) * 5.0 AS x1 FROM l)
"""


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books of pages of 20 lines; each eleventh line is large, each seventh is indented."""
    x = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    x = x.withColumn("page", F.expr("pos div 20")).withColumn("size", F.when(F.col("pos") % 11 == 10, 18.0).otherwise(12.0)).withColumn("x0", F.when(F.col("pos") % 7 == 6, 30.0).otherwise(10.0))
    return x.withColumn("x1", F.col("x0") + F.least(F.length("text"), F.lit(90)) * 5.0)


@query("WITH " + _PAGE_LINES + r""",
w AS (SELECT book, size, sum(length(text)) AS chars, min(pos) AS first FROM pl GROUP BY book, size),
b AS (SELECT book, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chars DESC, first) AS k FROM w) WHERE k = 1),
g AS (SELECT pl.*, abs(size - body) > 0.6 AS odd, min(CASE WHEN abs(size - body) <= 0.6 THEN x0 END) OVER p AS lft, max(CASE WHEN abs(size - body) <= 0.6 THEN x1 END) OVER p AS rgt
  FROM pl JOIN b ON b.book = pl.book WINDOW p AS (PARTITION BY pl.book, page)),
s AS (SELECT *, coalesce(x1 < rgt - greatest(25.0, (rgt - lft) * 0.08), false) AS short, coalesce(x0 > lft + 8, false) AS indented,
  length(text) <= 90 AND regexp_matches(text, '(?i)^\s*(?:(?:chapter|part|book)\s+[0-9]{1,3}\.?(?:\s*[.:—–-]\s*.{1,80})?|(?:prologue|epilogue|preface|afterword)(?:\s*[.:—–-]\s*.{1,60})?|[ivxlcdm]{1,7}\.?|[0-9]{1,3}\.?)\s*$') AS head FROM g),
o AS (SELECT *, odd OR coalesce(lag(odd) OVER q, true) OR regexp_matches(text, '^\s*[—–-]\s') OR indented OR (short AND head) OR lag(short AND (head OR regexp_matches(text, '[.!?…:;»"”)]$'))) OVER q AS opens FROM s WINDOW q AS (PARTITION BY book ORDER BY page, pos)),
n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY book ORDER BY page, pos) AS paragraph FROM o),
j AS (SELECT book, CAST(paragraph AS BIGINT) AS paragraph, min(page) AS page, string_agg(text, chr(31) ORDER BY page, pos) AS t FROM n GROUP BY book, paragraph)
SELECT * FROM (SELECT book, paragraph, page, trim(translate(regexp_replace(t, '([\p{L}\p{N}\p{M}_])-\x1f', '\1', 'g'), chr(31), ' '), ' ') AS text FROM j) WHERE text <> ''""")
def pdf_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with geometry to paragraphs."""
    return chapters.line_paragraphs(_page_lines(spark, sf_dir)).select("book", "paragraph", "page", "text")


_MARGIN_LINES = r"""
d AS (SELECT source AS book, doc_id AS page, list_concat([CASE WHEN doc_id % 2 = 0 THEN 'Source ' ELSE 'SOURCE ' END || source || ' ' || doc_id], string_split(text, chr(10)),
  [CASE doc_id % 10 WHEN 0 THEN '- ' || doc_id % 1000 || ' -' WHEN 1 THEN '- ' || (10000 + doc_id) || ' -' ELSE 'End' END]) AS s FROM documents WHERE text IS NOT NULL),
ml AS (SELECT *, CASE WHEN pos = 0 THEN page % 3 <> 0 WHEN pos = n - 1 THEN page % 7 <> 0 ELSE pos = 1 END AS in_margin FROM (SELECT book, page, len(s) AS n, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS pos FROM d))
"""


def _margin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as books and documents as pages, each behind a header and before a page number, a larger number or 'End';
    the first line of text is in the margin too, some headers and ends are not."""
    n = F.col("doc_id")
    head = F.concat(F.when(n % 2 == 0, "Source ").otherwise("SOURCE "), "source", F.lit(" "), n.cast("string"))
    number = lambda c: F.concat(F.lit("- "), c.cast("string"), F.lit(" -"))
    foot = F.when(n % 10 == 0, number(n % 1000)).when(n % 10 == 1, number(n + 10000)).otherwise("End")
    s = F.concat(F.array(head), F.split("text", "\n"), F.array(foot))
    x = V.table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("source").alias("book"), n.alias("page"), F.size(s).alias("n"), F.posexplode(s).alias("pos", "text"))
    edge = F.when(F.col("pos") == 0, F.col("page") % 3 != 0).when(F.col("pos") == F.col("n") - 1, F.col("page") % 7 != 0).otherwise(F.col("pos") == 1)
    return x.withColumn("in_margin", edge).drop("n")


@query("WITH " + _MARGIN_LINES + r""",
p AS (SELECT book, count(DISTINCT page) AS pages FROM ml GROUP BY book),
k AS (SELECT *, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS header FROM ml),
h AS (SELECT k.book, header FROM k JOIN p ON p.book = k.book WHERE in_margin GROUP BY k.book, header, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.3::DOUBLE)))
SELECT k.book, page, pos, text FROM k LEFT JOIN h ON h.book = k.book AND h.header = k.header WHERE NOT (in_margin AND (h.book IS NOT NULL OR regexp_matches(text, '^\s*[-–—]?\s*[0-9]{1,4}\s*[-–—]?\s*$')))""")
def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lines without running headers and page numbers."""
    return chapters.drop_margins(_margin_lines(spark, sf_dir)).select("book", "page", "pos", "text")


@query("WITH " + V.SCRIPT + ", u AS (SELECT *, CASE WHEN chapter % 3 = 0 THEN 'Scene ' || chapter ELSE '' END AS title FROM script) SELECT chapter, CAST(paragraph + CASE WHEN title <> '' THEN 1 ELSE 0 END AS BIGINT) AS paragraph, text FROM u UNION ALL SELECT DISTINCT chapter, CAST(0 AS BIGINT), title FROM u WHERE title <> ''")
def titled_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles read first."""
    x = V.script(spark, sf_dir)
    title = F.when(F.col("chapter") % 3 == 0, F.concat(F.lit("Scene "), F.col("chapter").cast("string"))).otherwise("")
    return chapters.with_titles(x.select("chapter").distinct().withColumn("title", title), x)


@query("SELECT r_regionkey AS chapter, r_name FROM region WHERE r_regionkey IN (0, 2, 3, 4)")
def selected_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: a selection of chapters."""
    return chapters.selected(V.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("chapter"), "r_name"), "0,2-4")


@query(r"""WITH t AS (SELECT source AS book, doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)),
c AS (SELECT *, trim(regexp_replace(translate(text, chr(160) || chr(173) || chr(8203) || chr(65279), ' '), '[\s\x0b\x{1c}-\x{1f}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS x FROM t)
SELECT book, dense_rank() OVER (PARTITION BY book ORDER BY doc_id) AS chapter, book AS title, row_number() OVER (PARTITION BY book, doc_id ORDER BY pos) - 1 AS paragraph, x AS text FROM c WHERE x <> ''""")
def finalized_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and renumbered chapters."""
    docs = V.table(spark, sf_dir, "documents")
    return chapters.finalize(docs.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.lit("").alias("title"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text")))


@query("SELECT doc_id, count(*) AS lines, count(*) FILTER (NOT regexp_matches(l, '\\S')) AS blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines and blank lines."""
    x = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("l").rlike(r"\S")).alias("blank"))


@query(r"""WITH s AS (SELECT page_id, trim(regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .') AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'file' ELSE substring(CASE WHEN regexp_matches(CASE WHEN contains(s, '.') THEN regexp_extract(s, '^(.*)\.[^.]*$', 1) ELSE s END, '(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$') THEN '_' || s ELSE s END, 1, 120) END AS file FROM s""")
def safe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that are safe everywhere."""
    return V.table(spark, sf_dir, "pages").select("page_id", N.sanitize_filename(F.col("url")).alias("file"))


@query("WITH t AS (SELECT doc_id, text, string_split(source || ' ' || lang || ' language', ' ') AS w FROM documents), k AS (SELECT doc_id, w, list_filter(w, lambda x: contains(lower(text), substring(lower(x), 1, greatest(4, length(x) - 2)))) AS k FROM t) SELECT doc_id, array_to_string(CASE WHEN len(k) = 0 THEN w ELSE k END, ' ') AS name FROM k")
def grounded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names that the text holds."""
    name = F.concat_ws(" ", "source", "lang", F.lit("language"))
    return V.table(spark, sf_dir, "documents").select("doc_id", N.ground_name(name, F.array().cast("array<string>"), F.col("text"))["name"].alias("name"))


@query("WITH " + V.SCRIPT + ", p AS (SELECT chapter, paragraph, string_agg('[' || idx || ':' || hint || '] ' || text, ' ' ORDER BY idx) AS line FROM numbered GROUP BY chapter, paragraph) SELECT chapter, string_agg(line, chr(10) ORDER BY paragraph) AS prompt FROM p GROUP BY chapter")
def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages to label, a paragraph a line."""
    return labels.requests(V.spans(spark, sf_dir), ["chapter"])


_RAW = "CASE conv_id % 4 WHEN 0 THEN '<think>{\"no\": 1}</think>' || b WHEN 1 THEN '```json' || chr(10) || b || chr(10) || '```' WHEN 2 THEN 'Here: ' || b || ' done' ELSE 'no object' END"
_BODY = """'{"segments": [{"id": ' || turn || ', "type": "Speech", "speaker": " ' || role || '", "emotion": "Furious"}, {"id": ' || turn || ', "type": "x"},]}'"""


@query("SELECT conv_id, turn AS id, 0 AS pos, 'dialogue' AS type, '' AS cue, role AS speaker, 'angry' AS emotion FROM conversations WHERE conv_id % 4 <> 3")
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model to labels; answers without an object give none, of equal ids the first counts."""
    raw = V.table(spark, sf_dir, "conversations").withColumn("b", F.expr(_BODY.replace("\\", "\\\\"))).withColumn("raw", F.expr(_RAW.replace("chr(10)", "char(10)")))
    return labels.labels(labels.parsed(raw, ["conv_id", "turn"]), ["conv_id", "turn"]).drop("turn")


@query("WITH " + V.SCRIPT + ", a AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY chapter ORDER BY idx), '') AS n FROM numbered) SELECT chapter, idx, hint AS type, CASE WHEN hint <> 'dialogue' THEN 'narrator' WHEN regexp_matches(n, '(?i)\\buser\\b') THEN 'c_user' WHEN regexp_matches(n, '(?i)\\bassistant\\b') THEN 'c_assistant' ELSE 'unknown' END AS speaker FROM a")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline labeler."""
    people = spark.createDataFrame([(0, "c_user", "User"), (1, "c_assistant", "Assistant")], "ord int, id string, name string")
    return labels.rule_labels(V.spans(spark, sf_dir), people, ["chapter", "idx"]).select("chapter", "idx", "type", "speaker")


@query("WITH s AS (SELECT c_custkey, c_nationkey % 5 AS k FROM customer) SELECT c_custkey, CASE k WHEN 0 THEN 'narrator' WHEN 1 THEN 'c_user' WHEN 2 THEN 'c_assistant' WHEN 3 THEN 'c_user' ELSE 'unknown' END AS speaker FROM s")
def resolved_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a model to characters."""
    said = F.element_at(F.array(*(F.lit(x) for x in (" Narrator", "C user", "Helper!", "old", "nobody"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    x = V.table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).alias("book"), said.alias("speaker"))
    people = V.cast_list(spark).withColumn("book", F.lit(1))
    merged = spark.createDataFrame([(1, "old", "c_user")], "book int, old string, new string")
    return labels.resolve_speakers(x, people, registry.unique_aliases(people), merged).select("c_custkey", "speaker")


_VOICED = V.SPEAKING + ", v AS (SELECT chapter, idx, type, speaker, CASE WHEN type = 'narration' THEN 'narrator_01' WHEN speaker = 'c_user' THEN 'male_adult' WHEN speaker = 'c_assistant' THEN 'female_adult' ELSE 'narrator_01' END AS voice_id FROM speaking)"


@query("WITH " + _VOICED + " SELECT chapter, idx, voice_id FROM v")
def segment_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A voice for each segment."""
    people = spark.createDataFrame([(1, "c_user", "male_adult"), (1, "c_assistant", "female_adult")], "book int, id string, voice_id string")
    x = V.speaking(spark, sf_dir).withColumn("book", F.lit(1))
    known = library.require(voices(spark), people).select("book", "id", "voice_id")
    return casting.resolve_voices(x, known).select("chapter", "idx", "voice_id")


@query("WITH " + _VOICED + " SELECT voice_id, count(*) AS segments, min(chapter) AS first_chapter FROM v GROUP BY voice_id")
def voice_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how much each voice reads."""
    return segment_voices(spark, sf_dir).groupBy("voice_id").agg(F.count(F.lit(1)).alias("segments"), F.min("chapter").alias("first_chapter"))


@query()
def consolidated_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs, taken as verdicts, merged by the rules."""
    p = _people(spark, sf_dir)
    people = p.select("book", F.col("id").cast("string").alias("id"), "name", "gender", "lines", (F.col("id") % 9).alias("first_chapter"), F.lit(None).cast("string").alias("voice_id"), F.lit(False).alias("locked"))
    pairs = registry.duplicate_candidates(p).withColumn("ord", F.col("a") * 1000 + F.col("b"))
    return registry.consolidate(people, pairs)[0]


_WORDS = r"list_distinct(string_split(trim(regexp_replace(lower(x), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '))"


@query("WITH " + _PEOPLE + ", q AS (SELECT book, id, " + _WORDS.replace("x)", "name || ' ' || id)", 1) + " AS t FROM people), a AS (SELECT DISTINCT book, name, " + _WORDS.replace("x)", "name)", 1) + " AS t FROM people), h AS (SELECT a.book, a.name, q.id FROM a JOIN q ON q.book = a.book AND list_has_all(q.t, a.t) AND len(q.t) > len(a.t) WHERE len(list_filter(a.t, lambda y: length(y) >= 4)) > 0) SELECT book, name, min(id) AS id FROM h GROUP BY book, name HAVING count(DISTINCT id) = 1")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names that one longer name contains."""
    p = _people(spark, sf_dir)
    return registry.contained_names(p.withColumn("name", F.concat_ws(" ", "name", F.col("id").cast("string"))), p.select("book", "name").distinct())


_ASSEMBLED = _TIMED + """,
m AS (SELECT chapter, idx, pause_ms, samples, substring(sha256('seg-v1' || chr(31) || text || chr(31) || speaker), 1, 24) AS key, CASE WHEN idx % 4 = 3 THEN 44100 ELSE 24000 END AS rate FROM paused),
r AS (SELECT chapter, rate, count(*) AS n, min(idx) AS met FROM m GROUP BY chapter, rate),
rates AS (SELECT chapter, CAST(rate AS BIGINT) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY n DESC, met) AS k FROM r) WHERE k = 1)
"""


def _manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = timeline.offsets(V.speaking(spark, sf_dir))
    rate = F.when(F.col("idx") % 4 == 3, 44100).otherwise(24000).cast("long")
    return x, x.select("chapter", "idx", plan.segment_key(F.col("text"), F.col("speaker")).alias("key"), "samples", rate.alias("rate"))


@query("WITH " + _ASSEMBLED + ", b AS (SELECT chapter, CAST(sum(pause_ms + CAST(round_even(samples * 1000 / rate, 0) AS BIGINT)) + 600 AS BIGINT) AS duration_ms, substring(sha256('asm-v1' || chr(31) || 'm4a' || chr(31) || '96k' || chr(31) || '44100' || chr(31) || 'True' || chr(31) || chr(31) || chr(31) || string_agg(idx || ':' || key || ':' || pause_ms, chr(31) ORDER BY idx)), 1, 24) AS key FROM m GROUP BY chapter) SELECT chapter, rate, CAST((SELECT sum(n) - max(n) FROM r WHERE r.chapter = b.chapter) AS BIGINT) AS resampled, duration_ms, key FROM b JOIN rates USING (chapter)")
def assembled_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, durations and keys of chapter files."""
    return assembly.assemble(*_manifest(spark, sf_dir))


@query("WITH " + _ASSEMBLED + "SELECT DISTINCT CAST(pause_ms AS BIGINT) AS ms, rates.rate, 'tmp/silence/silence_' || pause_ms || 'ms_' || rates.rate || '.wav' AS path FROM m JOIN rates USING (chapter) WHERE pause_ms > 0")
def silent_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the silent clips that are needed."""
    segments, manifest = _manifest(spark, sf_dir)
    return assembly.silences(segments, assembly.assemble(segments, manifest))


@query("WITH " + V.SPEAKING + "SELECT chapter, count(*) AS n, min(idx) AS first FROM speaking WHERE idx % 6 = 5 GROUP BY chapter")
def missing_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that assembly still lacks."""
    segments, manifest = _manifest(spark, sf_dir)
    return assembly.missing(segments, manifest.filter("idx % 6 <> 5"))


@query("WITH " + V.SPEAKING + "SELECT chapter, 'ffconcat version 1.0' || chr(10) || string_agg('file ''' || printf('audio/chapter_%03d/segment_%04d.wav', chapter, idx + 1) || '''', chr(10) ORDER BY idx) || chr(10) AS list FROM speaking GROUP BY chapter")
def concat_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenation lists of chapters."""
    return assembly.concat_lists(V.spans(spark, sf_dir).withColumn("path", assembly.segment_file(F.col("chapter"), F.col("idx"))))


@query("SELECT DISTINCT conv_id AS chapter, '-f concat -safe 0 -i ' || printf('tmp/chapter_%03d.ffconcat', conv_id) || ' -vn -ac 1 -af loudnorm=I=-18:TP=-1.5:LRA=11 -ar 44100 -c:a aac -b:a 96k -metadata title=Scene -metadata album=Book -metadata track=' || conv_id || ' -metadata genre=Audiobook -movflags +faststart ' || printf('audio/chapter_%03d.m4a', conv_id) AS command FROM conversations")
def chapter_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines of chapter files."""
    x = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter")).distinct()
    return x.select("chapter", F.array_join(assembly.chapter_command(F.col("chapter"), F.lit("Scene"), F.lit("Book")), " ").alias("command"))


@query("WITH s AS (SELECT source AS book, count(*) AS total, count(l.doc_id) AS done FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source) SELECT *, total = done AS complete FROM s")
def complete_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: books of which every chapter is done."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"))
    return assembly.complete_books(docs, V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter")))


@query()
def book_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON summary of each book and its chapters."""
    docs = V.table(spark, sf_dir, "documents")
    return assembly.metadata_rows(docs.groupBy(F.col("source").alias("book")).agg(F.count(F.lit(1)).alias("chapter_count")), docs.select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), F.col("n_chars").alias("char_count")))


@query("WITH " + V.SCRIPT + "SELECT chapter, substring(sha256(string_agg(text, chr(31) ORDER BY paragraph)), 1, 16) AS source_hash FROM script WHERE chapter % 5 IN (1, 2, 3, 4) GROUP BY chapter")
def chapters_to_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters without a valid script: changed, from rules, of an old prompt, or none."""
    hashes = plan.chapter_hash(V.script(spark, sf_dir))
    k = F.col("chapter") % 5
    scripts = hashes.filter(k < 4).select("chapter", F.when(k == 1, "changed").otherwise(F.col("source_hash")).alias("source_hash"), F.when(k == 2, "heuristic").otherwise("llm").alias("method"), F.when(k == 3, "chunk-v1").otherwise("chunk-v2").alias("prompt_version"))
    return plan.to_analyze(hashes, scripts, "llm", "chunk-v2")


@query("WITH " + V.SCRIPT + "SELECT chapter, 1 AS chunk, sha256('chunk-v2' || chr(31) || 'm' || chr(31) || string_agg(idx || ':' || hint || ':' || text, chr(31) ORDER BY idx)) AS key FROM numbered WHERE chapter % 2 = 1 GROUP BY chapter")
def stale_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose analysis is not cached."""
    keys = plan.chunk_keys(V.spans(spark, sf_dir).withColumn("chunk", F.lit(1)), "chunk-v2", "m")
    return plan.stale_chunks(keys, keys.filter("chapter % 2 = 0"))


@query("WITH v AS (SELECT 'f' || p_partkey AS file, 'v' || p_partkey // 2 AS id, CASE p_partkey % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'builtin' ELSE 'odd' END AS source, CASE WHEN p_partkey % 5 > 0 THEN 'audio/' || p_partkey || '.wav' END AS audio FROM part), e AS (SELECT *, CASE WHEN source = 'odd' THEN 'unknown source' WHEN source = 'reference' AND audio IS NULL THEN 'incomplete source' END AS bad FROM v), n AS (SELECT *, row_number() OVER (PARTITION BY id, bad IS NULL ORDER BY file) AS k FROM e) SELECT file, id, coalesce(bad, CASE WHEN k > 1 THEN 'duplicate id' END) AS error, source = 'builtin' OR coalesce(audio LIKE '%7.wav', false) AS available, substring(sha256(id || chr(31) || source || chr(31) || chr(31) || CASE WHEN source = 'odd' THEN '' ELSE 'Speaker' END || chr(31) || CASE WHEN source = 'builtin' THEN '' WHEN audio LIKE '%7.wav' THEN sha256(audio) ELSE 'missing' END), 1, 16) AS fingerprint FROM n")
def voice_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voices of a library, with errors, availability and fingerprints."""
    k = F.col("p_partkey")
    source = F.when(k % 3 == 0, "reference").when(k % 3 == 1, "builtin").otherwise("odd")
    audio = F.when(k % 5 > 0, F.concat(F.lit("audio/"), k.cast("string"), F.lit(".wav")))
    speaker = F.when(source != "odd", "Speaker")
    p = V.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), audio.alias("audio"), F.to_json(F.struct(F.concat(F.lit("v"), F.expr("p_partkey div 2").cast("string")).alias("id"), source.alias("source"), audio.alias("reference_audio"), speaker.alias("builtin_speaker"))).alias("content"))
    files = p.filter("audio like '%7.wav'").select(F.col("audio").alias("path"), F.sha2("audio", 256).alias("sha256"))
    return library.with_availability(library.parse_library(p.select("file", "content")), files).select("file", "id", "error", "available", "fingerprint")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 as a stream: counts over a folder that grows."""
    out = f"{shared_dir(spark)}/streamed_counts_{uuid.uuid4().hex}"
    counts.follow(spark, f"{sf_dir}/events.parquet", V.table(spark, sf_dir, "events").schema, ["event_type"], out)
    return counts.totals(spark, ["event_type"], out)


@query("WITH " + V.SPEAKING + "SELECT chapter, idx, type, speaker FROM (SELECT n.chapter, n.idx, CASE WHEN n.idx % 3 = 0 THEN 'dialogue' ELSE n.hint END AS type, CASE WHEN n.idx % 3 = 0 THEN 'c_label' WHEN n.hint = 'dialogue' THEN 'unknown' ELSE 'narrator' END AS speaker FROM numbered n)")
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by id, with the rule's label where one is missing."""
    x = V.spans(spark, sf_dir)
    given = x.filter("idx % 3 = 0").select("chapter", "idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).withColumn("type", F.when(F.col("pos") == 0, "dialogue").otherwise("narration")).withColumn("speaker", F.when(F.col("pos") == 0, "c_label").otherwise("late"))
    return attribution.join_labels(x, given, ["chapter", "idx"]).select("chapter", "idx", "type", "speaker")


@query(r"""WITH d AS (SELECT source AS book, doc_id + 1 AS page, string_split(text, chr(10)) AS s FROM documents),
p AS (SELECT book, page, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS pos FROM d),
t AS (SELECT book, page, CASE WHEN page % 14 = 0 THEN '  ' || s[1] ELSE 'Mark ' || page END AS title, row_number() OVER (PARTITION BY book ORDER BY page) AS k,
  coalesce(lead(page) OVER (PARTITION BY book ORDER BY page), 2147483647) AS e, count(*) OVER (PARTITION BY book) AS n FROM d WHERE page % 7 = 0),
r AS (SELECT book, k, title, page AS a, e FROM t WHERE n >= 2 UNION ALL SELECT book, 0, 'Front matter', -1, page FROM t WHERE n >= 2 AND k = 1),
x AS (SELECT p.*, k, title, row_number() OVER (PARTITION BY p.book, k ORDER BY page, pos) AS o, count(*) OVER (PARTITION BY p.book, k) AS n, sum(length(text)) OVER (PARTITION BY p.book, k) AS chars
  FROM p JOIN r ON r.book = p.book AND page >= a AND page < e),
y AS (SELECT * FROM x WHERE NOT (k > 0 AND o = 1 AND lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(title, '\s+', ' ', 'g')))) AND (k > 0 OR chars > 200))
SELECT book, dense_rank() OVER (PARTITION BY book ORDER BY k) AS chapter, title, page, pos, text FROM y""")
def bookmarked_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of two levels to chapters, with front matter and without repeated titles."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("source").alias("book"), (F.col("doc_id") + 1).alias("page"), F.split("text", "\n").alias("s"))
    title = F.when(F.col("page") % 14 == 0, F.concat(F.lit("  "), F.col("s")[0])).otherwise(F.concat(F.lit("Mark "), F.col("page").cast("string")))
    level = F.when(F.col("page") % 7 == 0, 1).otherwise(2)
    marks = docs.filter("page % 7 = 0 OR page % 5 = 0").select("book", F.col("page").alias("ord"), level.alias("level"), "page", title.alias("title"))
    return chapters.bookmarked_paragraphs(docs.select("book", "page", F.posexplode("s").alias("pos", "text")), marks)
