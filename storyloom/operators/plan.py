"""Incremental work: content keys, caches, reuse, idempotent imports. Rows are told apart by book and chapter; where rows
name no book, by chapter alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG
from storyloom.functions.text import sha256_parts, slug
from storyloom.tables import scope


def segment_key(*parts: Column) -> Column:
    """24 hex digits of what shapes a segment's sound: text, voice fingerprint, model, language, emotion."""
    return F.substring(sha256_parts(F.lit("seg-v1"), *parts), 1, 24)


def synthesis_plan(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """([book,] chapter, idx, key) against the manifest ([book,] chapter, idx, key): segments that are not rendered, with
    reuse_from, the index of the last manifest entry of the chapter that has the same key. in_order() sorts them."""
    keys = scope(segments)
    pending = segments.join(manifest.select(*keys, "idx", "key"), [*keys, "idx", "key"], "left_anti")
    have = manifest.groupBy(*keys, "key").agg(F.max("idx").alias("reuse_from"))
    return pending.join(have, [*keys, "key"], "left")


def in_order(plan: DataFrame) -> DataFrame:
    """A plan with place, from 0 in each book: what can be copied first, then by model (so that each is loaded once),
    chapter and index. Places are counted per model and chapter, so no book is sorted in one task."""
    keys = scope(plan)
    book = [c for c in keys if c == "book"]
    x = plan if "model" in plan.columns else plan.withColumn("model", F.lit(""))
    x = x.withColumn("_late", F.col("reuse_from").isNull().cast("int"))
    group = ["_late", "model", "chapter"]
    sizes = x.groupBy(*book, *group).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*book).orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*book, *group, before.alias("before"))
    place = F.row_number().over(Window.partitionBy(*book, *group).orderBy("idx")) - 1
    return x.withColumn("_k", place).join(sizes, [*book, *group]).withColumn("place", F.col("before") + F.col("_k")).select(*plan.columns, "place")


def cache_status(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """([book,] chapter, total, cached, pending)."""
    keys = scope(segments)
    x = segments.join(manifest.select(*keys, "idx", "key", F.lit(True).alias("hit")), [*keys, "idx", "key"], "left")
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("cached"), F.count_if(F.col("hit").isNull()).alias("pending"))


def rendered(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest after segments were rendered: their entries replace those of the same place."""
    keys = [*scope(done), "idx"]
    return manifest.join(done.select(*keys), keys, "left_anti").unionByName(done.select(*manifest.columns))


def import_books(files: DataFrame) -> DataFrame:
    """(id, content) to the first row of each content, with its digest: importing the same bytes again adds nothing."""
    x = files.withColumn("sha256", F.sha2("content", 256))
    return x.groupBy("sha256").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def book_id(title: Column, digest: Column) -> Column:
    return F.concat(slug(title, 40, "book"), F.lit("-"), F.substring(digest, 1, 8))


def to_import(files: DataFrame, books: DataFrame, parser_version: int = CONFIG.parser_version) -> DataFrame:
    """files (path, sha256, ...) against stored books (id, source_sha256, parser_version): the first file of each content
    that is new, or that an older parser read, with `known`, the id of the book that it is. Files already read by the
    current parser are left out."""
    first = files.withColumn("_k", F.row_number().over(Window.partitionBy("sha256").orderBy("path"))).filter("_k = 1").drop("_k")
    old = books.groupBy(F.col("source_sha256").alias("sha256")).agg(F.max_by("id", "parser_version").alias("known"), F.max("parser_version").alias("_v"))
    return first.join(old, "sha256", "left").filter(F.col("_v").isNull() | (F.col("_v") != parser_version)).drop("_v")


def imported(ready: DataFrame, parsed: DataFrame) -> DataFrame:
    """to_import() rows with `book` (their parser's name for them) and parsed books (book, title, ...) to book rows: a known
    content keeps its id, another gets one of its title and digest."""
    x = ready.join(parsed, "book")
    return x.withColumn("id", F.coalesce("known", book_id(F.col("title"), F.col("sha256")))).withColumnRenamed("sha256", "source_sha256").drop("known", "content")


def upsert_chapters(old: DataFrame, new: DataFrame, state: list[str]) -> DataFrame:
    """The chapters (book, idx, ...) after a book was read again: those of the books in `new` are as there, with the state
    columns of the old rows of the same place; chapters past the new ones go; other books stay."""
    kept = old.join(new.select("book").distinct(), "book", "left_anti")
    x = new.join(old.select("book", "idx", *(F.col(c).alias(f"_old_{c}") for c in state)), ["book", "idx"], "left")
    done = x.select(*(F.coalesce(f"_old_{c}", c).alias(c) if c in state and c in new.columns else (F.col(f"_old_{c}").alias(c) if c in state else F.col(c)) for c in old.columns))
    return kept.select(*old.columns).unionByName(done)


def chapter_hash(paragraphs: DataFrame) -> DataFrame:
    """([book,] chapter, source_hash): 16 hex digits of the digest of a chapter's paragraphs in order."""
    keys = scope(paragraphs)
    lists = paragraphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("x"))
    return lists.select(*keys, F.substring(F.sha2(F.array_join(F.transform("x", lambda p: p["text"]), "\x1f"), 256), 1, 16).alias("source_hash"))


def source_hash(paragraphs: DataFrame, most: int = CONFIG.segment_max_chars) -> DataFrame:
    """chapter_hash() that also changes with the longest segment, by which a stored script is told to be of its source."""
    keys = scope(paragraphs)
    lists = paragraphs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("x"))
    whole = F.array_join(F.transform("x", lambda p: p["text"]), "\n")
    return lists.select(*keys, F.substring(sha256_parts(whole, F.lit(str(most))), 1, 16).alias("source_hash"))


def upsert(table: DataFrame, patch: DataFrame, keys: list[str], allowed: list[str] | None = None) -> DataFrame:
    """table with the rows of patch: new keys are added, and columns of patch that are not null replace old values.
    allowed: the columns that a patch may change; another one is an error."""
    given = [c for c in patch.columns if c not in keys]
    wrong = [c for c in given if c not in table.columns or (allowed is not None and c not in allowed)]
    if wrong:
        raise ValueError(f"columns that cannot be changed: {wrong}")
    p = patch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in given))
    x = table.join(p, keys, "full_outer")
    return x.select(*keys, *((F.coalesce(f"_new_{c}", c) if c in given else F.col(c)).alias(c) for c in table.columns if c not in keys))


def latest(rows: DataFrame, by: list[str], at: str, tie: str, most: int = 10) -> DataFrame:
    """The `most` latest rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie)))).filter(F.col("rank") <= most)


def recover(jobs: DataFrame) -> DataFrame:
    """Jobs that a restart found running or pending, as failed ones that can be resumed."""
    broken = F.col("status").isin("running", "pending")
    return jobs.withColumn("error", F.when(broken, "interrupted").otherwise(F.col("error"))).withColumn("status", F.when(broken, "failed").otherwise(F.col("status")))


def decoded_jobs(rows: DataFrame) -> DataFrame:
    """Stored jobs with their options (JSON text) as a struct, and times as timestamps; texts that do not parse are the
    defaults."""
    options = F.from_json("options", "struct<mode:string,chapters:array<int>,force_llm:boolean,build_m4b:boolean>")
    full = F.struct(F.coalesce(options["mode"], F.lit("cast")).alias("mode"), options["chapters"].alias("chapters"), F.coalesce(options["force_llm"], F.lit(False)).alias("force_llm"), F.coalesce(options["build_m4b"], F.lit(True)).alias("build_m4b"))
    x = rows.withColumn("options", full)
    for c in ("created_at", "updated_at"):
        if c in rows.columns and rows.schema[c].dataType.typeName() == "string":
            x = x.withColumn(c, F.try_to_timestamp(c))
    return x


def stamped(rows: DataFrame) -> DataFrame:
    """rows with updated_at, the time of the query, and created_at where it is missing."""
    now = F.current_timestamp()
    return rows.withColumn("updated_at", now).withColumn("created_at", F.coalesce("created_at", now) if "created_at" in rows.columns else now)


def analysis_method(mode: str, force_llm: bool = False) -> str:
    """A cast needs a model's labels; a single narrator does not, unless they are asked for."""
    return "llm" if mode == "cast" or force_llm else "heuristic"


def valid_scripts(scripts: DataFrame, hashes: DataFrame, method: str, prompt_version: str) -> DataFrame:
    """Stored scripts ([book,] chapter, source_hash, method, prompt_version) that still serve: the source is unchanged, a
    model's labels are of the current prompt, and rules do not stand in where a model is asked for."""
    keys = scope(scripts)
    current = scripts.join(hashes.select(*keys, "source_hash"), [*keys, "source_hash"], "left_semi")
    by_model = F.col("method") == "llm"
    return current.filter(F.when(by_model, F.col("prompt_version") == prompt_version).otherwise(F.lit(method != "llm")))


def to_analyze(hashes: DataFrame, scripts: DataFrame, method: str, prompt_version: str) -> DataFrame:
    """The chapters without a valid script."""
    keys = scope(hashes)
    return hashes.join(valid_scripts(scripts, hashes, method, prompt_version).select(*keys), keys, "left_anti")


def chunk_keys(spans: DataFrame, prompt_version: str, model: str) -> DataFrame:
    """([book,] chapter, chunk, idx, hint, text) to ([book,] chapter, chunk, key): the digest of prompt, model and spans in
    order."""
    keys = scope(spans)
    item = F.concat(F.col("idx").cast("string"), F.lit(":"), "hint", F.lit(":"), "text")
    x = spans.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("t")))).alias("x"))
    return x.select(*keys, "chunk", sha256_parts(F.lit(prompt_version), F.lit(model), F.array_join(F.transform("x", lambda s: s["t"]), "\x1f")).alias("key"))


def stale_chunks(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose analysis is not cached under the same key."""
    by = [*scope(keys), "chunk", "key"]
    return keys.join(cache.select(*by), by, "left_anti")
