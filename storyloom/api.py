"""What a client asks for: books, chapters, scripts, characters, jobs and voices, as DataFrames over stored tables, and
the calls that change them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.engine import BOOKS, CHAPTERS, JOBS, MERGED, PEOPLE, SEGMENTS, Engine
from storyloom.functions.names import sanitize_filename
from storyloom.operators import plan, registry
from storyloom.operators.labels import LabelError


class NotFound(LookupError):
    """No such book, chapter, job or character."""


@dataclass(frozen=True)
class Store:
    """books (id, title, created_at, ...), chapters (book, idx, ...), segments (book, chapter, idx, ...), characters
    (book, id, lines, voice_id, locked, ...), jobs (id, book, created_at, status, ...), voices (id, available, ...)."""

    books: DataFrame
    chapters: DataFrame
    segments: DataFrame
    characters: DataFrame
    jobs: DataFrame
    voices: DataFrame

    def health(self) -> int:
        """The number of voices that can be used."""
        return self.voices.filter("available").count()

    def list_books(self) -> DataFrame:
        return self.books.orderBy(F.desc("created_at"), "id")

    def book(self, book: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The book, its chapters in order and its ten latest jobs."""
        row = _some(self.books.filter(F.col("id") == book), f"book {book}")
        return row, self.list_chapters(book), plan.latest(self.jobs.filter(F.col("book") == book), ["book"], "created_at", "id").drop("rank")

    def list_chapters(self, book: str) -> DataFrame:
        return self.chapters.filter(F.col("book") == book).orderBy("idx")

    def script(self, book: str, chapter: int) -> DataFrame:
        rows = self.segments.filter((F.col("book") == book) & (F.col("chapter") == chapter))
        return _some(rows, f"script of chapter {chapter} of {book}").orderBy("idx")

    def list_characters(self, book: str) -> DataFrame:
        """By lines, most first; equals by id."""
        return self.characters.filter(F.col("book") == book).orderBy(F.desc("lines"), "id")

    def job(self, job: str) -> DataFrame:
        return _some(self.jobs.filter(F.col("id") == job), f"job {job}")

    def pin_voice(self, book: str, character: str, voice: str, merged: DataFrame) -> DataFrame:
        """All characters with one voice pinned; merged (book, old, new) leads to the character that is left."""
        _some(self.voices.filter(F.col("id") == voice), f"voice {voice}")
        hop = merged.filter((F.col("book") == book) & (F.col("old") == character)).select("new").first()
        target = hop["new"] if hop else character
        _some(self.characters.filter((F.col("book") == book) & (F.col("id") == target)), f"character {character}")
        pins = self.characters.sparkSession.createDataFrame([(book, target, voice)], "book string, id string, voice_id string")
        return registry.pin_voice(self.characters, pins)


def error_code(error: Exception) -> int:
    """The status that a server answers an error with: 404 for what is not there, 400 for what cannot be done, else 500."""
    if isinstance(error, (LookupError, FileNotFoundError)):
        return 404
    return 400 if isinstance(error, (ValueError, LabelError)) else 500


class Service:
    """The calls of a client on an Engine; all that they read comes from its tables, so a call sees what is stored now."""

    def __init__(self, engine: Engine):
        self.engine = engine

    @property
    def store(self) -> Store:
        read = self.engine.tables.read
        people = read("characters", PEOPLE)
        return Store(read("books", BOOKS), read("chapters", CHAPTERS), read("segments", SEGMENTS), people, read("jobs", JOBS), self.engine.voices)

    # ---- books
    def upload(self, name: str, content: bytes) -> DataFrame:
        """Stores a file under a safe name beside the tables and registers it; a file over the limit is refused."""
        limit = self.engine.config.max_upload_mb << 20
        if len(content) > limit:
            raise ValueError(f"the file is larger than {self.engine.config.max_upload_mb} MB")
        spark = self.engine.spark
        safe = spark.createDataFrame([(name,)], "n string").select(sanitize_filename(F.col("n"))).first()[0]
        digest = spark.createDataFrame([(bytearray(content),)], "c binary").select(F.sha2("c", 256)).first()[0]
        path = f"{self.engine.tables.root}/source/{digest[:16]}/{safe}"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            out = fs.create(p, True)
            for at in range(0, len(content), 1 << 20):
                out.write(bytearray(content[at : at + (1 << 20)]))
            out.close()
        return self.add_books([path])

    def add_books(self, paths: list[str]) -> DataFrame:
        """Registers files; the books that they are, whether read now or known before."""
        from storyloom.sources.books import read_files

        self.engine.import_files(paths)
        digests = read_files(self.engine.spark, paths).select(F.col("sha256").alias("source_sha256")).distinct()
        return self.engine.tables.read("books", BOOKS).join(digests, "source_sha256", "left_semi")

    def find_book(self, reference: str) -> str:
        """The id that a reference means: a file (which is registered) or an id."""
        p = self.engine.spark._jvm.org.apache.hadoop.fs.Path(reference)
        try:
            there = p.getFileSystem(self.engine.spark._jsc.hadoopConfiguration()).exists(p)
        except Exception as e:  # a reference that is no path at all
            if "Py4J" not in type(e).__name__:
                raise
            there = False
        if there:
            return self.add_books([reference]).first()["id"]
        _some(self.store.books.filter(F.col("id") == reference), f"{reference}: neither a file nor a book")
        return reference

    def inspect(self, path: str) -> DataFrame:
        """Chapters of a file, in order, with paragraphs, characters and how each begins; nothing is stored."""
        return self.engine.inspect([path]).orderBy("chapter")

    def book(self, book: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The book, its chapters in order, each with has_audio, and its ten latest jobs."""
        row, parts, jobs = self.store.book(book)
        done = self.engine.tables.read("assembled", "book string, chapter int").filter(F.col("book") == book).select(F.col("chapter").alias("idx"), F.lit(True).alias("_done"))
        return row, parts.join(done, "idx", "left").withColumn("has_audio", F.coalesce("_done", F.lit(False))).drop("_done").orderBy("idx"), jobs

    # ---- work
    def analyze(self, book: str, method: str = "llm", chapters: str | None = None) -> tuple[str, dict[str, int]]:
        """An analysis: the job and what it did."""
        job = self.engine.create_job(book, "analyze", "simple" if method == "heuristic" else "cast", chapters)
        return job, self.engine.run(job)

    def generate(self, book: str, mode: str = "cast", chapters: str | None = None, force_llm: bool = False, build_m4b: bool = True) -> tuple[str, dict[str, int]]:
        job = self.engine.create_job(book, "generate", mode, chapters, force_llm, build_m4b)
        return job, self.engine.run(job)

    def resume(self, job: str) -> dict[str, int]:
        """Runs a job again that failed or was interrupted; what is done is not done again."""
        self.store.job(job)
        return self.engine.run(job)

    def status(self, book: str | None = None) -> DataFrame:
        """(kind, id, state, detail): all books by their last change, or one book's chapters and its ten latest jobs."""
        if book is None:
            return self.store.list_books().select(F.lit("book").alias("kind"), "id", F.col("title").alias("state"), F.col("chapter_count").cast("string").alias("detail"))
        _, parts, jobs = self.book(book)
        rows = parts.select(F.lit("chapter").alias("kind"), F.col("idx").cast("string").alias("id"), F.col("analysis_status").alias("state"), F.concat_ws(" ", "analysis_method", "synthesis_status", F.when(F.col("has_audio"), "audio")).alias("detail"))
        return rows.unionByName(jobs.select(F.lit("job").alias("kind"), "id", F.col("status").alias("state"), F.concat_ws(" ", "stage", "error").alias("detail")))

    # ---- characters and voices
    def characters(self, book: str, assign: dict[str, str] | None = None) -> DataFrame:
        """A book's characters by lines; assign pins voices to characters first."""
        _some(self.store.books.filter(F.col("id") == book), f"book {book}")
        for character, voice in (assign or {}).items():
            merged = registry.canonical(self.engine.tables.read("merged", MERGED))
            self.engine.tables.write("characters", self.store.pin_voice(book, character, voice, merged).select("book", *registry.FIELDS))
        return self.store.list_characters(book)

    def voices(self) -> DataFrame:
        return self.engine.voices.orderBy("id")

    def add_voice(self, new: DataFrame, overwrite: bool = False) -> DataFrame:
        """The library with a new voice, from now on the engine's."""
        from storyloom.sources.voices import add_voice

        self.engine.voices = add_voice(self.engine.voices, new, overwrite)
        return self.voices()


def _some(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise NotFound(what)
    return rows
