"""The engine: from book files to a plan of audio, one incremental step after the other over stored tables.

Each step writes whole tables of a Workspace; a step that finds nothing new to do writes nothing. Books are worked on side
by side. Within a run, a model is asked for the chapters in waves (the first pending chapter of every book, then the
second, ...), so its prompts know the characters of the chapters before.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG, Config
from storyloom.functions.names import ground_name
from storyloom.functions.text import language_name, seed_of
from storyloom.operators import assembly, attribution, casting, labels, plan, registry, segment, timeline
from storyloom.operators.chapters import selected, with_titles
from storyloom.sources import books as sources
from storyloom.tables import Workspace, stored

BOOKS = "id string, title string, author string, language string, source_format string, source_path string, source_sha256 string, parser_version int, chapter_count long, char_count long, created_at timestamp"
CHAPTERS = "book string, idx int, title string, has_title boolean, char_count long, analysis_status string, analysis_method string, synthesis_status string, audio_path string, duration_sec double, error string"
STATE = ["analysis_status", "analysis_method", "synthesis_status", "audio_path", "duration_sec", "error"]
PARAGRAPHS = "book string, chapter int, paragraph long, text string"
SCRIPTS = "book string, chapter int, source_hash string, method string, prompt_version string"
SEGMENTS = "book string, chapter int, idx int, paragraph long, hint string, text string, type string, speaker string, emotion string"
CACHE = "book string, chapter int, chunk int, key string, body string"
MANIFEST = "book string, chapter int, idx int, key string, voice_id string, samples long, rate long"
ASSEMBLED = "book string, chapter int, rate long, resampled long, duration_ms long, key string"
JOBS = "id string, book string, kind string, mode string, chapters string, force_llm boolean, build_m4b boolean, status string, stage string, progress_done long, progress_total long, message string, error string, created_at timestamp, updated_at timestamp"
PEOPLE = f"book string, {registry.PERSON}"
MERGED = "book string, old string, new string"


class Reporter(Protocol):
    """Hears how far a job is."""

    def stage(self, stage: str, total: int) -> None: ...

    def advance(self, done: int, total: int, message: str = "") -> None: ...


class Silent:
    def stage(self, stage: str, total: int) -> None:
        pass

    def advance(self, done: int, total: int, message: str = "") -> None:
        pass


class Backend(Protocol):
    """Speaks segments; made once a task on the executors."""

    def model_tag(self, voice_id: str) -> str: ...

    def synthesize(self, text: str, voice_id: str, language: str, instruction: str, seed: int) -> tuple[int, int]:
        """The number of samples made, and their rate."""
        ...

    def close(self) -> None: ...


class FakeBackend:
    """A stand-in without speech: as long as the text would take."""

    rate = CONFIG.sample_rate

    def model_tag(self, voice_id: str) -> str:
        return "fake-tone"

    def synthesize(self, text: str, voice_id: str, language: str, instruction: str, seed: int) -> tuple[int, int]:
        return int(min(8.0, 0.25 + 0.03 * len(text)) * self.rate), self.rate

    def close(self) -> None:
        pass


#: Makers of backends by the name that the settings have.
BACKENDS: dict[str, Callable[[], Backend]] = {"fake": FakeBackend}


def backend(name: str) -> Callable[[], Backend]:
    if name not in BACKENDS:
        raise ValueError(f"no such voice backend: {name}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


class RuleLabeler:
    """Answers prompts by rule: dialogue is spoken by the character whose name or alias stands in the next span."""

    def __init__(self, people: list[dict], same: frozenset[frozenset[str]] = frozenset()):
        self.people, self.same = people, same

    def _names(self, c: dict) -> list[str]:
        return [c["name"], *(c.get("aliases") or [])]

    def analyze_chunk(self, prompt: str) -> str:
        passage = prompt.split("PASSAGE TO LABEL", 1)[-1]
        marks = list(re.finditer(r"\[(\d+):(dialogue|narration)\] ", passage))
        texts = [passage[m.end() : n.start() if n else len(passage)] for m, n in zip(marks, [*marks[1:], None], strict=True)]
        out, heard = [], set()
        for k, m in enumerate(marks):
            after = texts[k + 1] if k + 1 < len(texts) else ""
            speaker = next((c["id"] for c in self.people if any(re.search(rf"\b{re.escape(n)}\b", after, re.I) for n in self._names(c))), "unknown") if m[2] == "dialogue" else "narrator"
            heard.add(speaker)
            out.append({"id": int(m[1]), "type": m[2], "cue": "", "speaker": speaker, "emotion": "neutral"})
        whole = " ".join(texts).casefold()
        seen = [c for c in self.people if c["id"] in heard or any(n.casefold() in whole for n in self._names(c))]
        return json.dumps({"characters": seen, "segments": out}, ensure_ascii=False)

    def same_person(self, prompt: str) -> str:
        return json.dumps({"answers": []})

    def health(self) -> bool:
        return True

    def close(self) -> None:
        pass


class Engine:
    def __init__(self, spark: SparkSession, root: str, voices: DataFrame, config: Config = CONFIG, labeler: Callable[[], labels.Labeler] | None = None, reporter: Reporter | None = None):
        self.spark, self.tables, self.voices, self.config, self.labeler, self.reporter = spark, Workspace(spark, root), voices, config, labeler, reporter or Silent()

    # ---- import
    def import_files(self, paths: list[str]) -> DataFrame:
        """Registers books; the same content is the same book, and is read again only if its parser was older. Returns the
        rows that were read now."""
        files = sources.read_files(self.spark, paths)
        known = self.tables.read("books", BOOKS)
        ready = stored(plan.to_import(files, known, self.config.parser_version), "to_import")
        kinds = {r["k"]: r["n"] for r in ready.groupBy(F.coalesce(sources.book_format(F.col("path")), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
        if "pdf" in kinds:
            raise ValueError("books of pages come as lines: use sources.pages.page_books()")
        made = []
        if kinds.pop("txt", 0):
            made.append(sources.text_books(ready.filter(F.lower("path").endswith(".txt"))))
        if kinds:
            made.append(sources.structured_books(ready.filter(~F.lower("path").endswith(".txt"))))
        if not made:
            return known.limit(0)
        parsed, chapters = made[0]
        for b, c in made[1:]:
            parsed, chapters = parsed.unionByName(b), chapters.unionByName(c)
        return self.register(ready.withColumn("book", F.col("path")), parsed, chapters)

    def register(self, files: DataFrame, parsed: DataFrame, chapters: DataFrame) -> DataFrame:
        """Stores finished books (of any source) with files (book, path, sha256, known)."""
        known = self.tables.read("books", BOOKS)
        rows = plan.imported(files, parsed).withColumnRenamed("path", "source_path")
        rows = stored(rows.join(known.select("id", "created_at"), "id", "left").withColumn("created_at", F.coalesce("created_at", F.current_timestamp())), "imported")
        names = [c.split()[0] for c in BOOKS.split(", ")]
        ids = rows.select("book", F.col("id").alias("_id"))
        text = stored(chapters.join(ids, "book").drop("book").withColumnRenamed("_id", "book"), "chapters")
        parts = text.groupBy("book", F.col("chapter").cast("int").alias("idx")).agg(F.first("title").alias("title"), F.first("has_title").alias("has_title"), F.sum(F.length("text")).alias("char_count"))
        blank = {"analysis_status": "pending", "analysis_method": "", "synthesis_status": "pending", "audio_path": "", "error": ""}
        parts = parts.select("*", *(F.lit(v).alias(c) for c, v in blank.items()), F.lit(0.0).alias("duration_sec"))
        self.tables.write("chapters", plan.upsert_chapters(self.tables.read("chapters", CHAPTERS), parts, STATE))
        self.tables.put("paragraphs", text.select("book", F.col("chapter").cast("int").alias("chapter"), F.col("paragraph").cast("long").alias("paragraph"), "text"), ["book"])
        new = rows.select(*names)
        self.tables.put("books", new, ["id"])
        return self.tables.read("books").join(new.select("id"), "id", "left_semi")

    def inspect(self, paths: list[str]) -> DataFrame:
        """(book, chapter, title, paragraphs, chars, begins) of files, without storing them."""
        files = sources.read_files(self.spark, paths)
        text, other = files.filter(F.lower("path").endswith(".txt")), files.filter(~F.lower("path").endswith(".txt"))
        found = [make(x)[1] for make, x in ((sources.text_books, text), (sources.structured_books, other)) if not x.isEmpty()]
        chapters = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        return chapters.groupBy("book", "chapter").agg(F.first("title").alias("title"), F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"), F.substring(F.min_by("text", "paragraph"), 1, 60).alias("begins"))

    # ---- analysis
    def _paragraphs(self, book: str | None, spec: str | None) -> DataFrame:
        parts = self.tables.read("chapters", CHAPTERS).withColumnRenamed("idx", "chapter")
        if book is not None:
            parts = parts.filter(F.col("book") == book)
        parts = selected(parts.select("book", "chapter", "title", "has_title"), spec)
        text = self.tables.read("paragraphs", PARAGRAPHS).join(parts.select("book", "chapter"), ["book", "chapter"], "left_semi")
        return with_titles(parts, text)

    def analyze(self, book: str | None = None, chapters: str | None = None, method: str = "heuristic") -> int:
        """Writes scripts for the chapters that have no valid one; returns how many."""
        text = stored(self._paragraphs(book, chapters), "to_read")
        hashes = plan.source_hash(text, self.config.segment_max_chars)
        todo = stored(plan.to_analyze(hashes, self.tables.read("scripts", SCRIPTS), method, self.config.prompt_version), "to_analyze")
        total = todo.count()
        self.reporter.stage("analysis", total)
        if total:
            spans = stored(segment.segment(text.join(todo.select("book", "chapter"), ["book", "chapter"], "left_semi"), self.config.segment_max_chars), "spans")
            if method == "llm":
                self._ask(todo, spans, text)
            else:
                speaks = F.col("hint") == "dialogue"
                self._keep(todo, spans.withColumn("type", F.col("hint")).withColumn("speaker", F.when(speaks, "unknown").otherwise("narrator")).withColumn("emotion", F.lit("neutral")), method)
        self._recount()
        return total

    def _keep(self, todo: DataFrame, script: DataFrame, method: str) -> None:
        rows = script.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SEGMENTS.split(", ")))
        self.tables.put("segments", rows, ["book", "chapter"])
        version = self.config.prompt_version if method == "llm" else ""
        self.tables.put("scripts", todo.select("book", "chapter", "source_hash", F.lit(method).alias("method"), F.lit(version).alias("prompt_version")), ["book", "chapter"])
        done = todo.select("book", F.col("chapter").alias("idx"), F.lit("done").alias("analysis_status"), F.lit(method).alias("analysis_method"), F.lit("").alias("error"))
        self.tables.write("chapters", plan.upsert(self.tables.read("chapters", CHAPTERS), done, ["book", "idx"], STATE))

    def _ask(self, todo: DataFrame, spans: DataFrame, text: DataFrame) -> None:
        if self.labeler is None or not self.labeler().health():
            raise labels.LabelError("labels of a model are asked for, but no model answers")
        waves = stored(todo.withColumn("wave", F.row_number().over(Window.partitionBy("book").orderBy("chapter"))), "waves")
        for wave in range(1, (waves.agg(F.max("wave")).first()[0] or 0) + 1):
            now = waves.filter(F.col("wave") == wave).drop("wave")
            self._wave(now, spans.join(now.select("book", "chapter"), ["book", "chapter"], "left_semi"), text)
            self.reporter.advance(wave, wave, f"wave {wave}")

    def _wave(self, todo: DataFrame, spans: DataFrame, text: DataFrame) -> None:
        place, key = ["book", "chapter"], ["book", "chapter", "chunk"]
        dealt = stored(spans.join(segment.chunk(spans, self.config.chunk_max_chars), [*place, "paragraph"]), "dealt")
        people = stored(self.tables.read("characters", PEOPLE), "people")
        context = segment.chunk_context(dealt.select(*key, "paragraph").distinct(), text, self.config.chunk_context_paragraphs)
        keys = plan.chunk_keys(dealt, self.config.prompt_version, self.config.model)
        cache = self.tables.read("chunk_cache", CACHE)
        stale = stored(plan.stale_chunks(keys, cache), "stale")
        if not stale.isEmpty():
            titles = self.tables.read("chapters", CHAPTERS).select("book", F.col("idx").alias("chapter"), F.col("title").alias("chapter_title")).join(self.tables.read("books", BOOKS).select(F.col("id").alias("book"), F.col("title").alias("book_title"), "language"), "book")
            known = registry.cards(registry.top_characters(people), 5, 160)
            recent = dealt.select(*key).distinct().withColumn("speakers", F.array().cast("array<string>"))
            asked = dealt.join(stale.select(*key), key, "left_semi")
            ids = asked.groupBy(*key).agg(F.array_sort(F.collect_list("idx")).alias("ids"))
            wanted = labels.prompts(labels.requests(asked, key), titles, known, recent, context).join(ids, key)
            raw = labels.run_labeler(wanted, key, self.labeler, self.config.model_retries, strict=True)
            self.tables.put("chunk_cache", labels.parsed(raw, key).join(stale, key).select(*key, "key", "body"), key)
        answers = stored(self.tables.read("chunk_cache").join(keys, [*key, "key"], "left_semi"), "answers")
        passage = dealt.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), " ").alias("passage"))
        reported = labels.characters(answers, key).join(passage, key).join(context, key, "left")
        whole = F.concat(F.col("passage"), F.lit(" "), F.array_join(F.coalesce("context", F.array().cast("array<string>")), " "))
        good = ground_name(F.col("name"), F.col("aliases"), whole)
        reported = stored(reported.withColumn("good", good).withColumn("name", F.col("good.name")).withColumn("aliases", F.col("good.aliases")).drop("good", "passage", "context"), "reported")
        order = F.row_number().over(Window.partitionBy("book").orderBy("chapter", "chunk", "pos"))
        cast, matches = registry.observe_all(reported.withColumn("ord", order), people)
        chunk_ids = matches.join(reported.withColumn("ord", order).select("book", "ord", "chapter", "chunk"), ["book", "ord"]).select(*key, "id", "character")
        merged = registry.canonical(self.tables.read("merged", MERGED))
        found = labels.labels(answers, key, dealt)
        said = labels.resolve_speakers(found, cast, registry.unique_aliases(cast), merged, chunk_ids)
        said = said.select(*place, F.col("id").cast("int").alias("idx"), "type", F.when(F.col("type") == "narration", "narrator").otherwise(F.col("speaker")).alias("speaker"), "emotion", "pos")
        script = attribution.join_labels(dealt.drop("chunk"), said, [*place, "idx"]).withColumn("emotion", F.coalesce("emotion", F.lit("neutral")))
        script = stored(attribution.apply_tags(script, attribution.tag_speakers(script, cast)), "tagged")
        cast, script = self._consolidate(todo, cast, script)
        self.tables.write("characters", self._counted(cast, script))
        self._keep(todo, script, "llm")

    def _counted(self, cast: DataFrame, script: DataFrame) -> DataFrame:
        """The cast with the lines of this script added, for the order of the next prompts; _recount() makes them exact."""
        lines = registry.line_counts(script).select("book", F.col("speaker").alias("id"), F.col("lines").alias("more"))
        return cast.join(lines, ["book", "id"], "left").withColumn("lines", F.col("lines") + F.coalesce("more", F.lit(0))).drop("more").select("book", *registry.FIELDS)

    def _consolidate(self, todo: DataFrame, cast: DataFrame, script: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Asks for duplicates among characters of which one is first seen in these chapters, and merges them."""
        now = todo.groupBy("book").agg(F.max("chapter").alias("now"))
        pairs = registry.duplicate_candidates(cast.join(now, "book").withColumn("is_new", F.col("first_chapter") == F.col("now")))
        pairs = stored(pairs.withColumn("pair", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("score"), "a", "b")) - 1), "pairs")
        if pairs.isEmpty():
            return cast, script
        asked = labels.duplicate_prompts(pairs, registry.cards(cast))
        make = self.labeler

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            labeler = make()
            try:
                for b in batches:
                    yield b[["book"]].assign(raw=[labeler.same_person(p) for p in b["prompt"]])
            finally:
                labeler.close()

        said = labels.verdicts(labels.parsed(asked.mapInPandas(answer, "book string, raw string"), ["book"]), ["book"])
        same = pairs.join(said.filter("same_person").select("book", "pair"), ["book", "pair"]).select("book", F.col("pair").alias("ord"), "a", "b")
        left, gone = registry.consolidate(cast, same)
        if gone.isEmpty():
            return cast, script
        self.tables.write("merged", registry.canonical(self.tables.read("merged", MERGED).unionByName(gone)))
        return left, stored(registry.rewrite_speakers(script, registry.canonical(gone)), "rewritten")

    def _recount(self) -> None:
        """Lines of all stored scripts, so that a chapter that was read again does not count twice."""
        if not self.tables.exists("characters"):
            return
        people = self.tables.read("characters")
        lines = registry.line_counts(self.tables.read("segments", SEGMENTS), registry.canonical(self.tables.read("merged", MERGED)))
        new = people.drop("lines").join(lines.select("book", F.col("speaker").alias("id"), "lines"), ["book", "id"], "left").withColumn("lines", F.coalesce("lines", F.lit(0)).cast("long")).select("book", *registry.FIELDS)
        if not new.exceptAll(people.select("book", *registry.FIELDS)).isEmpty():
            self.tables.write("characters", new)

    # ---- casting, synthesis, assembly
    def cast(self, book: str | None = None) -> int:
        """Voices for characters that have none; returns how many."""
        people = stored(self.tables.read("characters", PEOPLE), "people")
        mine = people if book is None else people.filter(F.col("book") == book)
        new = mine.filter("voice_id is null or voice_id = ''").count()
        if new:
            chosen = casting.cast(mine, self.voices, self.config.narrator_voice).withColumnRenamed("voice_id", "chosen")
            x = people.join(chosen, ["book", "id"], "left").withColumn("voice_id", F.coalesce("chosen", "voice_id")).drop("chosen")
            self.tables.write("characters", x.select("book", *registry.FIELDS))
        return new

    def _voiced(self, book: str | None, chapters: str | None, mode: str) -> DataFrame:
        parts = selected(self.tables.read("chapters", CHAPTERS).withColumnRenamed("idx", "chapter").filter(F.lit(book is None) | (F.col("book") == (book or ""))).select("book", "chapter"), chapters)
        x = self.tables.read("segments", SEGMENTS).join(parts, ["book", "chapter"], "left_semi")
        merged = registry.canonical(self.tables.read("merged", MERGED))
        x = casting.resolve_voices(x, self.tables.read("characters", PEOPLE).select("book", "id", "voice_id"), self.config.narrator_voice, self.config.unknown_voice, merged, mode)
        lost = x.select("voice_id").distinct().join(self.voices.select(F.col("id").alias("voice_id")), "voice_id", "left_anti").orderBy("voice_id").limit(5).collect()
        if lost:
            raise LookupError(f"voices not in the library: {[r['voice_id'] for r in lost]}")
        print_ = F.coalesce("fingerprint", F.lit("")) if "fingerprint" in self.voices.columns else F.lit("")
        x = x.join(self.voices.select(F.col("id").alias("voice_id"), print_.alias("fingerprint")), "voice_id")
        language = F.lit(self.config.tts_language) if self.config.tts_language.lower() not in ("", "auto") else language_name(F.col("code"))
        x = x.join(self.tables.read("books", BOOKS).select(F.col("id").alias("book"), F.col("language").alias("code")), "book").withColumn("language", language)
        tag = backend(self.config.tts_backend)().model_tag("")
        emotion = F.col("emotion") if self.config.tts_use_instruct else F.lit("")
        return x.withColumn("model", F.lit(tag)).withColumn("key", plan.segment_key(F.col("text"), F.col("fingerprint"), F.lit(tag), F.col("language"), emotion))

    def synthesis_plan(self, book: str | None = None, chapters: str | None = None, mode: str = "cast") -> DataFrame:
        """What is left to render, in order: copies of sound that is there first."""
        return plan.in_order(plan.synthesis_plan(self._voiced(book, chapters, mode), self.tables.read("manifest", MANIFEST)))

    def synthesize(self, book: str | None = None, chapters: str | None = None, mode: str = "cast") -> tuple[int, int]:
        """Renders what the plan lacks; returns how many segments were rendered and how many copied. In the mode that has
        no sound to keep, a copy takes over the entry of the manifest."""
        todo = stored(self.synthesis_plan(book, chapters, mode), "plan")
        manifest = self.tables.read("manifest", MANIFEST)
        new, copied = todo.filter("reuse_from is null"), todo.filter("reuse_from is not null")
        n, m = new.count(), copied.count()
        self.reporter.stage("synthesis", n + m)
        if n + m:
            make = backend(self.config.tts_backend)
            x = new.select("book", "chapter", "idx", "key", "voice_id", "text", "language", seed_of(F.col("key")).alias("seed"))

            def speak(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                made = make()
                try:
                    for b in batches:
                        clips = [made.synthesize(r.text, r.voice_id, r.language, "", r.seed) for r in b.itertuples()]
                        yield b[["book", "chapter", "idx", "key", "voice_id"]].assign(samples=[c[0] for c in clips], rate=[c[1] for c in clips])
                finally:
                    made.close()

            have = manifest.select("book", "chapter", F.col("idx").alias("reuse_from"), "samples", "rate")
            done = x.mapInPandas(speak, MANIFEST).unionByName(copied.join(have, ["book", "chapter", "reuse_from"]).select("book", "chapter", "idx", "key", "voice_id", "samples", "rate"))
            self.tables.write("manifest", plan.rendered(manifest, stored(done, "rendered")))
            state = todo.select("book", F.col("chapter").alias("idx"), F.lit("done").alias("synthesis_status")).distinct()
            self.tables.write("chapters", plan.upsert(self.tables.read("chapters", CHAPTERS), state, ["book", "idx"], STATE))
        return n, m

    def assemble(self, book: str | None = None, chapters: str | None = None) -> tuple[int, DataFrame]:
        """Chapter files that are missing or not current: how many, and (book, chapter, command) of all that were asked
        for; segments without sound are an error."""
        parts = selected(self.tables.read("chapters", CHAPTERS).withColumnRenamed("idx", "chapter").filter(F.lit(book is None) | (F.col("book") == (book or ""))), chapters)
        x = self.tables.read("segments", SEGMENTS).join(parts.select("book", "chapter"), ["book", "chapter"], "left_semi")
        manifest = self.tables.read("manifest", MANIFEST)
        lost = assembly.missing(x, manifest).orderBy("book", "chapter").first()
        if lost:
            raise ValueError(f"chapter {lost['chapter']} of {lost['book']}: {lost['n']} segments have no audio yet, the first is {lost['first']}")
        about = self.tables.read("books", BOOKS).select(F.col("id").alias("book"), F.col("title").alias("book_title"), "author")
        titles = parts.select("book", "chapter", "title").join(about, "book")
        whole = stored(assembly.assemble(timeline.pauses(x, self.config), manifest, self.config, titles), "assembled")
        state = self.tables.read("assembled", ASSEMBLED)
        todo = stored(assembly.to_assemble(whole, state), "to_assemble")
        n = todo.count()
        self.reporter.stage("assembly", n)
        if n:
            self.tables.put("assembled", todo.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in ASSEMBLED.split(", "))), ["book", "chapter"])
            path = F.concat(assembly.chapter_dir(F.col("chapter")), F.lit(f".{self.config.audio_format}"))
            done = todo.select("book", F.col("chapter").alias("idx"), path.alias("audio_path"), F.round(F.col("duration_ms") / 1000, 2).alias("duration_sec"))
            self.tables.write("chapters", plan.upsert(self.tables.read("chapters", CHAPTERS), done, ["book", "idx"], STATE))
        c = self.config
        command = assembly.chapter_command(F.col("chapter"), F.col("title"), F.col("book_title"), None, c.audio_format, c.audio_bitrate, c.audio_sample_rate, c.audio_loudnorm)
        return n, todo.join(titles, ["book", "chapter"]).select("book", "chapter", command.alias("command"))

    def book_files(self, book: str | None = None) -> DataFrame:
        """(book, command, metadata) of the books of which each chapter is assembled: one file with chapter marks."""
        parts = self.tables.read("chapters", CHAPTERS).withColumnRenamed("idx", "chapter")
        parts = parts if book is None else parts.filter(F.col("book") == book)
        done = self.tables.read("assembled", ASSEMBLED)
        whole = assembly.complete_books(parts, done).filter("complete").select("book")
        about = self.tables.read("books", BOOKS).select(F.col("id").alias("book"), F.col("title").alias("book_title"), "author")
        marks = timeline.chapter_marks(done.join(whole, "book", "left_semi").select("book", "chapter", (F.col("duration_ms") / 1000).alias("duration")))
        x = assembly.metadata_file(marks.join(parts.select("book", "chapter", "title"), ["book", "chapter"]).join(about, "book"))
        return x.select("book", assembly.m4b_command(F.col("book"), self.config.audio_format, self.config.audio_bitrate).alias("command"), "metadata")

    # ---- jobs
    def create_job(self, book: str, kind: str = "generate", mode: str = "cast", chapters: str | None = None, force_llm: bool = False, build_m4b: bool = True) -> str:
        if self.tables.read("books", BOOKS).filter(F.col("id") == book).isEmpty():
            raise LookupError(f"book {book}")
        job = uuid.uuid4().hex[:12]
        row = self.spark.createDataFrame([(job, book, kind, mode, chapters or "", force_llm, build_m4b, "pending", "queued", 0, 0, "", "")], ", ".join(JOBS.split(", ")[:-2]))
        self.tables.put("jobs", plan.stamped(row), ["id"])
        return job

    def _job(self, job: str, **changes: object) -> None:
        patch = self.spark.createDataFrame([(job, *changes.values())], "id string, " + ", ".join(f"{k} {'long' if k.startswith('progress') else 'string'}" for k in changes)).withColumn("updated_at", F.current_timestamp())
        self.tables.write("jobs", plan.upsert(self.tables.read("jobs", JOBS), patch, ["id"], ["status", "stage", "progress_done", "progress_total", "message", "error", "updated_at"]))

    def run(self, job: str) -> dict[str, int]:
        """Runs or resumes a job: analysis, casting, synthesis and assembly, each doing only what is not done. Returns how
        much each did. A failure is kept with the job."""
        row = self.tables.read("jobs", JOBS).filter(F.col("id") == job).first()
        if row is None:
            raise LookupError(f"job {job}")
        self._job(job, status="running", error="", message="")
        try:
            did = self._run(row)
        except Exception as e:
            self._job(job, status="failed", error=f"{type(e).__name__}: {e}"[:2000])
            raise
        self._job(job, status="done", stage="finished", message="done")
        return did

    def _run(self, row) -> dict[str, int]:
        book, spec, mode = row["book"], row["chapters"] or None, row["mode"]
        method = plan.analysis_method(mode, row["force_llm"])
        did = {"analyzed": self.analyze(book, spec, method)}
        did["cast"] = self.cast(book) if mode == "cast" else 0
        if row["kind"] == "analyze":
            return did
        self._job(row["id"], stage="synthesis")
        did["rendered"], did["copied"] = self.synthesize(book, spec, mode)
        self._job(row["id"], stage="assembly")
        did["assembled"], _ = self.assemble(book, spec)
        did["books"] = self.book_files(book).count() if row["build_m4b"] else 0
        return did

    def generate(self, book: str, **options: object) -> dict[str, int]:
        return self.run(self.create_job(book, "generate", **options))

    def resume(self, job: str) -> dict[str, int]:
        return self.run(job)

    def recover(self) -> None:
        """After a restart: jobs that were running count as failed and can be resumed."""
        if self.tables.exists("jobs"):
            self.tables.write("jobs", plan.recover(self.tables.read("jobs")))
