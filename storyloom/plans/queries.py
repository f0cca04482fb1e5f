"""Queries of the script engine, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import attribution, casting, chapters, plan, registry, segment, timeline
from storyloom.plans import views as V
from storyloom.sources import books
from storyloom.tables import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_TIMED = V.SPEAKING + """,
paused AS (
  SELECT *, CASE WHEN lag(idx) OVER w IS NULL THEN 800 WHEN lag(paragraph) OVER w <> paragraph THEN 600
              WHEN lag(speaker) OVER w <> speaker OR lag(type) OVER w <> type THEN 350 ELSE 150 END AS pause_ms,
         CAST(floor(least(8.0::DOUBLE, 0.25::DOUBLE + 0.03::DOUBLE * length(text)) * 24000) AS BIGINT) AS samples
  FROM speaking WINDOW w AS (PARTITION BY chapter ORDER BY idx))
"""


@query("WITH " + _TIMED + "SELECT chapter, idx, paragraph, type, speaker, text, pause_ms, samples, CAST(sum(pause_ms * 24 + samples) OVER (PARTITION BY chapter ORDER BY idx) AS BIGINT) AS end_sample FROM paused")
def segment_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script to timed, attributed segments."""
    return timeline.offsets(V.speaking(spark, sf_dir)).select("chapter", "idx", "paragraph", "type", "speaker", "text", "pause_ms", "samples", "end_sample")


@query("WITH " + V.SPEAKING + "SELECT speaker, count(*) AS lines, min(chapter) AS first_chapter FROM speaking WHERE type = 'dialogue' AND speaker NOT IN ('narrator', 'unknown') GROUP BY speaker")
def speaker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of each character over all scripts."""
    return registry.line_counts(V.speaking(spark, sf_dir))


@query("WITH " + _TIMED + ", d AS (SELECT chapter % 10 AS book, chapter, sum(pause_ms * 24 + samples) AS n FROM paused GROUP BY chapter), m AS (SELECT *, CAST(round_even(n / 24, 0) AS BIGINT) AS ms FROM d) SELECT book, chapter, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM m WINDOW w AS (PARTITION BY book ORDER BY chapter)")
def chapter_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative marks of chapters."""
    x = timeline.offsets(V.speaking(spark, sf_dir)).groupBy("chapter").agg((F.sum(F.col("pause_ms") * 24 + F.col("samples")) / 24000).alias("duration"))
    return timeline.chapter_marks(x.withColumn("book", F.col("chapter") % 10)).select("book", "chapter", "start_ms", "end_ms")


_CHUNKS = r""",
g AS (SELECT chapter, paragraph, sum(length(text)) AS size, bool_and(hint = 'narration') AS plain, row_number() OVER (PARTITION BY chapter ORDER BY paragraph) AS k FROM spans GROUP BY chapter, paragraph),
f AS (
  SELECT chapter, paragraph, k, 1 AS chunk, CAST(size AS BIGINT) AS held, plain AND size >= SOFT AS done FROM g WHERE k = 1
  UNION ALL
  SELECT g.chapter, g.paragraph, g.k, n.chunk, CAST(CASE WHEN n.fresh THEN g.size ELSE f.held + g.size END AS BIGINT), g.plain AND CASE WHEN n.fresh THEN g.size ELSE f.held + g.size END >= SOFT
  FROM f JOIN g ON g.chapter = f.chapter AND g.k = f.k + 1, LATERAL (SELECT f.done OR f.held + g.size > MOST AS fresh, f.chunk + CASE WHEN f.done OR f.held + g.size > MOST THEN 1 ELSE 0 END AS chunk) n)
"""


def _chunks(most: int) -> str:
    return _CHUNKS.replace("SOFT", str(int(most * 0.7))).replace("MOST", str(most))


@query("WITH RECURSIVE " + V.SCRIPT + _chunks(600) + "SELECT chapter, paragraph, chunk FROM f")
def chunk_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue-aware chunks of 600 characters."""
    return segment.chunk(V.spans(spark, sf_dir), 600)


@query("WITH RECURSIVE " + V.SCRIPT + _chunks(4000) + "SELECT chapter, paragraph, chunk FROM f")
def default_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: chunks of the default size."""
    return segment.chunk(V.spans(spark, sf_dir))


@query("WITH RECURSIVE " + V.SCRIPT + _chunks(600) + ", c AS (SELECT chapter, chunk, min(paragraph) AS first FROM f GROUP BY chapter, chunk) SELECT c.chapter, chunk, coalesce(string_agg(s.text, chr(10) ORDER BY s.paragraph), '') AS context FROM c LEFT JOIN script s ON s.chapter = c.chapter AND s.paragraph >= first - 3 AND s.paragraph < first GROUP BY c.chapter, chunk")
def chunk_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs before each chunk."""
    x = segment.chunk_context(segment.chunk(V.spans(spark, sf_dir), 600), V.script(spark, sf_dir))
    return x.withColumn("context", F.array_join("context", "\n"))


@query("WITH RECURSIVE " + V.SPEAKING + _chunks(600) + """,
l AS (SELECT f.chapter, chunk, speaker, max(idx) AS heard FROM speaking s JOIN f ON f.chapter = s.chapter AND f.paragraph = s.paragraph WHERE type = 'dialogue' AND speaker <> 'unknown' GROUP BY f.chapter, chunk, speaker),
c AS (SELECT DISTINCT chapter, chunk FROM f),
b AS (SELECT c.chapter, c.chunk, l.speaker, max(l.heard) AS heard FROM c JOIN l ON l.chapter = c.chapter AND l.chunk < c.chunk GROUP BY c.chapter, c.chunk, l.speaker),
t AS (SELECT chapter, chunk, string_agg(speaker, ',' ORDER BY heard) AS speakers FROM (SELECT *, row_number() OVER (PARTITION BY chapter, chunk ORDER BY heard DESC) AS k FROM b) WHERE k <= 4 GROUP BY chapter, chunk)
SELECT c.chapter, c.chunk, coalesce(speakers, '') AS speakers FROM c LEFT JOIN t ON t.chapter = c.chapter AND t.chunk = c.chunk""")
def recent_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four speakers last heard before each chunk."""
    x = stored(V.speaking(spark, sf_dir), "speaking")
    return attribution.recent_speakers(x.join(segment.chunk(x, 600), ["chapter", "paragraph"])).withColumn("speakers", F.array_join("speakers", ","))


@query()
def book_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents as spans of at most 400 characters."""
    x = V.lines(spark, sf_dir).select("chapter", "paragraph", X.clean_paragraph(F.col("text")).alias("text"))
    return segment.segment(x)


@query("WITH " + V.LINES + "SELECT book, count(DISTINCT chapter) AS chapters, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars FROM kept GROUP BY book")
def book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, paragraphs and characters of each book."""
    return V.lines(spark, sf_dir).groupBy("book").agg(F.countDistinct("chapter").alias("chapters"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query("WITH RECURSIVE " + V.LINES + """,
g AS (SELECT book, chapter * 100000 + paragraph AS paragraph, length(text) AS size, row_number() OVER (PARTITION BY book ORDER BY chapter, paragraph) AS k FROM kept),
f AS (SELECT book, paragraph, k, 1 AS part, size AS held FROM g WHERE k = 1
  UNION ALL SELECT g.book, g.paragraph, g.k, CASE WHEN f.held + g.size > 20000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.held + g.size > 20000 THEN g.size ELSE f.held + g.size END
  FROM f JOIN g ON g.book = f.book AND g.k = f.k + 1)
SELECT book, paragraph, part FROM f""")
def packed_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books without headings cut into parts of 20000 characters."""
    x = V.lines(spark, sf_dir).select("book", (F.col("chapter") * 100000 + F.col("paragraph")).alias("paragraph"), "text")
    return segment.pack_chapters(x)


_HEADED = r"""
raw AS (
  SELECT source AS book, doc_id * 4 AS paragraph, CASE WHEN doc_id % 5 = 0 THEN 'Part ' || (doc_id % 100 + 1) END AS text FROM documents
  UNION ALL SELECT source, doc_id * 4 + 1, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 100 + 1 AS VARCHAR) ELSE 'Chapter ' || (doc_id % 100 + 1) END FROM documents
  UNION ALL SELECT source, doc_id * 4 + 2, trim(regexp_replace(text, '\s+', ' ', 'g')) FROM documents),
p AS (SELECT *, length(text) <= 90 AND regexp_matches(text, '""" + X.HEADING.replace("(?iu)", "(?i)") + r"""') AS head FROM raw WHERE text <> ''),
w AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER o AS part,
  last_value(CASE WHEN head AND regexp_matches(text, '""" + X.MAJOR.replace("(?iuU)", "(?i)") + r"""') THEN text END IGNORE NULLS) OVER o AS major FROM p WINDOW o AS (PARTITION BY book ORDER BY paragraph)),
h AS (SELECT book, part, CASE WHEN text = major OR major IS NULL THEN CASE WHEN text = major THEN text ELSE name END ELSE major || '. ' || name END AS title
  FROM (SELECT *, CASE WHEN regexp_matches(text, '""" + X.BARE_NUMBER.replace("(?iu)", "(?i)") + r"""') THEN 'Chapter ' || regexp_extract(text, '""" + X.BARE_NUMBER.replace("(?iu)", "(?i)") + r"""', 1) ELSE text END AS name FROM w WHERE head)),
b AS (SELECT *, sum(length(text)) OVER (PARTITION BY book, part) AS chars FROM w WHERE NOT head),
k AS (SELECT *, dense_rank() OVER (PARTITION BY book ORDER BY part) AS chapter FROM b WHERE part > 0 OR chars > 200)
"""


@query("WITH " + _HEADED + "SELECT k.book, chapter, coalesce(title, 'Chapter ' || chapter) AS title, title IS NOT NULL AS has_title, paragraph, text FROM k LEFT JOIN h ON h.book = k.book AND h.part = k.part")
def heading_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings to titled, numbered chapters."""
    return chapters.heading_chapters(V.headed(spark, sf_dir))


@query("SELECT source AS book, doc_id AS page, title, chapter FROM documents d JOIN (SELECT source AS s, doc_id AS a, lead(doc_id, 1, 2147483647) OVER (PARTITION BY source ORDER BY doc_id) AS b, 'Mark ' || doc_id AS title, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE doc_id % 7 = 0 AND doc_id > 0) m ON d.source = m.s AND doc_id >= a AND doc_id < b WHERE n >= 2")
def bookmark_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in the ranges of bookmarks."""
    pages = V.table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"))
    marks = pages.filter(F.col("page") % 7 == 0).withColumn("title", F.concat(F.lit("Mark "), F.col("page").cast("string")))
    return chapters.bookmark_chapters(pages, marks).select("book", "page", "title", "chapter")


@query("WITH " + V.LINES + ", k AS (SELECT book, chapter AS page, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS header FROM kept), p AS (SELECT book, count(DISTINCT page) AS pages FROM k GROUP BY book) SELECT k.book, header, count(DISTINCT page) AS n FROM k JOIN p ON p.book = k.book GROUP BY k.book, header, pages HAVING count(DISTINCT page) >= greatest(2, floor(pages * 0.02))")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines that repeat on many pages."""
    return chapters.repeated_margins(V.lines(spark, sf_dir).select("book", F.col("chapter").alias("page"), "text"), 0.02, 2)


@query("WITH m AS (SELECT d.source AS key, d.doc_id AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL), g AS (SELECT key, n, n - row_number() OVER (PARTITION BY key ORDER BY n) AS g FROM m), r AS (SELECT key, min(n) AS a, max(n) AS b FROM g GROUP BY key, g) SELECT key, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS runs FROM r GROUP BY key")
def unlabelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without labels, in compact form."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("n"))
    return chapters.runs(docs.join(V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("n")), "n", "left_anti").select("key", "n"))


@query("SELECT d.source, count(*) AS total, count(l.doc_id) AS labelled, CAST(count(*) - count(l.doc_id) AS DOUBLE) / count(*) AS missing_ratio, count(*) - count(l.doc_id) > 0.2 * count(*) AS refused FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each source lack a label, and whether that is too many."""
    x = V.table(spark, sf_dir, "documents").select("doc_id", "source").join(V.table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    g = x.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("labelled"))
    missing = F.col("total") - F.col("labelled")
    return g.select("source", "total", "labelled", (missing / F.col("total")).alias("missing_ratio"), (missing > F.col("total") * 0.2).alias("refused"))


@query("SELECT doc_id, CASE WHEN c + l = 0 THEN '' WHEN c >= l THEN 'ru' ELSE 'en' END AS language FROM (SELECT doc_id, length(substring(text, 1, 20000)) - length(regexp_replace(substring(text, 1, 20000), '[Ѐ-ӿ]', '', 'g')) AS c, length(substring(text, 1, 20000)) - length(regexp_replace(substring(text, 1, 20000), '[A-Za-z]', '', 'g')) AS l FROM documents)")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyrillic or Latin; by the operator's definition from the first 20000 characters."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1")
def import_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content once."""
    return plan.import_books(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("WITH " + V.SCRIPT + "SELECT chapter, substring(sha256(string_agg(text, chr(31) ORDER BY paragraph)), 1, 16) AS source_hash FROM script GROUP BY chapter")
def chapter_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys of chapters."""
    return plan.chapter_hash(V.script(spark, sf_dir))


_KEYED = V.SPEAKING + """,
keyed AS (SELECT chapter, idx, substring(sha256('seg-v1' || chr(31) || text || chr(31) || speaker), 1, 24) AS key FROM speaking),
manifest AS (SELECT chapter, idx - CASE WHEN idx > 4 THEN 1 ELSE 0 END AS idx, key FROM keyed WHERE idx % 5 <> 4)
"""


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments, and the manifest of an earlier state: each fifth is missing and the later ones stand one place lower."""
    x = V.speaking(spark, sf_dir).select("chapter", "idx", plan.segment_key(F.col("text"), F.col("speaker")).alias("key"))
    old = x.filter("idx % 5 <> 4").select("chapter", (F.col("idx") - F.when(F.col("idx") > 4, 1).otherwise(0)).alias("idx"), "key")
    return x, old


@query("WITH " + _KEYED + "SELECT k.chapter, k.idx, k.key, r.idx AS reuse_from FROM keyed k LEFT JOIN (SELECT chapter, key, max(idx) AS idx FROM manifest GROUP BY chapter, key) r ON r.chapter = k.chapter AND r.key = k.key WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.chapter = k.chapter AND m.idx = k.idx AND m.key = k.key)")
def synthesis_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to render, and what can be copied."""
    return plan.synthesis_plan(*_keyed(spark, sf_dir)).select("chapter", "idx", "key", "reuse_from")


@query("WITH " + _KEYED + "SELECT k.chapter, count(*) AS total, count(m.key) AS cached, count(*) - count(m.key) AS pending FROM keyed k LEFT JOIN manifest m ON m.chapter = k.chapter AND m.idx = k.idx AND m.key = k.key GROUP BY k.chapter")
def cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached and pending segments of each chapter."""
    return plan.cache_status(*_keyed(spark, sf_dir))


_PEOPLE = "people AS (SELECT p_brand AS book, p_partkey AS id, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender, p_size AS lines FROM part)"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    gender = F.when(F.col("p_size") % 3 == 0, "male").when(F.col("p_size") % 3 == 1, "female").otherwise("unknown")
    return V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), gender.alias("gender"), F.col("p_size").alias("lines"))


@query("WITH " + _PEOPLE + r", s AS (SELECT DISTINCT book, id, gender, substring(t, 1, 5) AS stem FROM (SELECT book, id, gender, unnest(regexp_extract_all(lower(name), '[а-яёa-z]{5,}')) AS t FROM people)), p AS (SELECT a.book, a.id AS a, b.id AS b, count(*) AS score FROM s a JOIN s b ON a.book = b.book AND a.stem = b.stem AND a.id < b.id AND (a.gender = b.gender OR a.gender = 'unknown' OR b.gender = 'unknown') GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT book, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY score DESC, a, b) AS k FROM p) WHERE k <= 25")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share name stems, the best 25 of each book."""
    return registry.duplicate_candidates(_people(spark, sf_dir))


@query("WITH " + _PEOPLE + "SELECT book, id, name, lines, rank FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY lines DESC, id) AS rank FROM people) WHERE rank <= 40")
def known_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 40 characters of each book."""
    return registry.top_characters(_people(spark, sf_dir)).select("book", "id", "name", "lines", "rank")


@query("WITH " + _PEOPLE + r", n AS (SELECT book, id, trim(regexp_replace(lower(name), '[^\p{L}\p{N}_]+', ' ', 'g')) AS alias FROM people) SELECT book, alias, min(id) AS id FROM n GROUP BY book, alias HAVING count(DISTINCT id) = 1")
def unique_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one character bears."""
    return registry.unique_aliases(_people(spark, sf_dir).withColumn("aliases", F.lit(None).cast("array<string>")))


@query("WITH RECURSIVE m AS (SELECT DISTINCT user_id AS old, user_id // 2 AS new FROM events WHERE user_id > 0), f(old, new) AS (SELECT old, new FROM m UNION ALL SELECT f.old, m.new FROM f JOIN m ON m.old = f.new) SELECT old, min(new) AS new FROM f GROUP BY old")
def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of merged ids, followed to their ends."""
    users = V.table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id > 0")
    return registry.canonical(users.select(F.col("user_id").alias("old"), F.expr("user_id div 2").alias("new")))


@query()
def observed_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry fold over observations, book by book."""
    p = _people(spark, sf_dir)
    return registry.observe(p.select("book", F.col("id").alias("ord"), X.slug(F.split("name", " ")[0]).alias("id"), "name", "gender"))


@query()
def voice_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy casting of each book's characters."""
    ages = F.element_at(F.array(*(F.lit(a) for a in casting.AGES)), (F.col("lines") % 5 + 1).cast("int"))
    people = _people(spark, sf_dir).withColumn("age", ages).withColumn("first_chapter", F.lit(1))
    return casting.cast(people, voices(spark))


def voices(spark: SparkSession) -> DataFrame:
    rows = [(f"{g}_{a}", g, a, ["character"], True) for g in ("male", "female") for a in casting.AGES] + [("narrator_01", "unknown", "adult", ["narrator", "character"], True)]
    return spark.createDataFrame(rows, "id string, gender string, age_group string, roles array<string>, available boolean")


@query("SELECT user_id, event_id, ts, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest rows of each group."""
    return plan.latest(V.table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "event_type", "rank")


@query("SELECT coalesce(c.c_custkey, n.k) AS c_custkey, coalesce(n.name, c.c_name) AS c_name, coalesce(n.bal, c.c_acctbal) AS c_acctbal FROM customer c FULL OUTER JOIN (SELECT c_custkey + 10 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END AS name, c_acctbal + 1 AS bal FROM customer) n ON n.k = c.c_custkey")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that keeps old values where the patch has none."""
    c = V.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    patch = c.select((F.col("c_custkey") + 10).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return plan.upsert(c, patch, ["c_custkey"])


@query("SELECT event_id, CASE WHEN event_type IN ('running', 'pending') THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type IN ('running', 'pending') THEN 'interrupted' END AS error FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'pending' ELSE 'done' END AS event_type FROM events)")
def recovered_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted jobs become failed ones."""
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "pending").otherwise("done")
    return plan.recover(V.table(spark, sf_dir, "events").select("event_id", status.alias("status"), F.lit(None).cast("string").alias("error")))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1), '(?is)<(nav|script|style)\b.*?</(nav|script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
m AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)<(div|h1|p)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), '(?i)</(?:div|h1|p)>', chr(3), 'g'), chr(1)) AS s FROM b),
q AS (SELECT page_id, unnest(s[2:]) AS x, generate_subscripts(s[2:], 1) AS k FROM m),
r AS (SELECT page_id, k, split_part(x, chr(2), 1) = 'h1' AS head, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(split_part(split_part(x, chr(2), 2), chr(3), 1), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM q),
w AS (SELECT *, count(*) FILTER (head) OVER o AS sec, last_value(CASE WHEN head THEN t END IGNORE NULLS) OVER o AS title FROM r WHERE t <> '' WINDOW o AS (PARTITION BY page_id ORDER BY k))
SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS section, coalesce(title, '') AS title, row_number() OVER (PARTITION BY page_id, sec ORDER BY k) - 1 AS paragraph, t AS text FROM w WHERE NOT head""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages cut at headings."""
    return books.page_sections(V.table(spark, sf_dir, "pages"))


@query(r"SELECT c_custkey, rtrim(substring(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_'), 1, 48), '_') AS slug, sha256(concat_ws(chr(31), c_name, coalesce(c_mktsegment, ''))) AS digest FROM customer")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and digests."""
    return V.table(spark, sf_dir, "customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug"), X.sha256_parts(F.col("c_name"), F.col("c_mktsegment")).alias("digest"))
