"""From rendered segments to chapter files, as plans: rates, durations, keys, lists and command lines. Nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.config import CONFIG, Config
from storyloom.functions.names import escape_metadata, quote_path
from storyloom.functions.text import sha256_parts
from storyloom.tables import scope


def chapter_dir(chapter: Column) -> Column:
    return F.format_string("audio/chapter_%03d", chapter)


def segment_file(chapter: Column, idx: Column) -> Column:
    """Files of segments count from one."""
    return F.concat(chapter_dir(chapter), F.format_string("/segment_%04d.wav", (idx + 1).cast("long")))


def missing(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """([book,] chapter, n, first): segments that have no audio yet, by chapter."""
    keys = scope(segments)
    x = segments.join(manifest.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))


def assemble(segments: DataFrame, manifest: DataFrame, config: Config = CONFIG, titles: DataFrame | None = None) -> DataFrame:
    """([book,] chapter, idx, pause_ms) with the manifest ([book,] chapter, idx, key, samples, rate) to ([book,] chapter,
    rate, resampled, duration_ms, key): the most frequent rate, of equals the one met first; pauses, clips and a closing
    pause in milliseconds. The key changes with any clip, pause, setting of the output (format, bit rate, sample rate,
    loudness) and, from titles ([book,] chapter, book_title, title), with the titles that are written into the file."""
    keys = scope(segments)
    x = segments.select(*keys, "idx", "pause_ms").join(manifest.select(*keys, "idx", "key", "samples", "rate"), [*keys, "idx"])
    rates = x.groupBy(*keys, "rate").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("at"))
    rates = rates.groupBy(*keys).agg(F.max_by("rate", F.struct("n", -F.col("at"))).alias("rate"), (F.sum("n") - F.max("n")).alias("resampled"))
    item = F.format_string("%d:%s:%d", F.col("idx").cast("long"), F.col("key"), F.col("pause_ms").cast("long"))
    ms = F.sum(F.col("pause_ms") + F.bround(F.col("samples") * 1000 / F.col("rate")).cast("long")) + config.pause_paragraph_ms
    body = x.groupBy(*keys).agg(ms.alias("duration_ms"), F.array_sort(F.collect_list(F.struct("idx", item.alias("t")))).alias("x"))
    listed = F.array_join(F.transform("x", lambda s: s["t"]), "\x1f")
    named = [F.lit(""), F.lit("")]
    if titles is not None:
        body = body.join(titles.select(*keys, "book_title", "title"), keys, "left")
        named = [F.col("book_title"), F.col("title")]
    shape = (config.audio_format, config.audio_bitrate, config.audio_sample_rate, config.audio_loudnorm)
    key = F.substring(sha256_parts(F.lit("asm-v1"), *(F.lit(str(v)) for v in shape), *named, listed), 1, 24)
    return body.join(rates, keys).select(*keys, "rate", "resampled", "duration_ms", key.alias("key"))


def to_assemble(assembled: DataFrame, state: DataFrame) -> DataFrame:
    """assemble() rows whose file is not there under the same key; state: ([book,] chapter, key) of files written."""
    keys = [*scope(assembled), "key"]
    return assembled.join(state.select(*keys), keys, "left_anti")


def silences(segments: DataFrame, rates: DataFrame) -> DataFrame:
    """(ms, rate, path): the silent clips that the chapters need, each once."""
    keys = scope(segments)
    x = segments.join(rates.select(*keys, "rate"), keys).filter("pause_ms > 0").select(F.col("pause_ms").cast("long").alias("ms"), "rate").distinct()
    return x.withColumn("path", F.format_string("tmp/silence/silence_%dms_%d.wav", F.col("ms"), F.col("rate").cast("long")))


def concat_lists(segments: DataFrame, keys: list[str] = ["chapter"]) -> DataFrame:  # noqa: B006
    """(chapter, idx, path) to (chapter, list): the text of a concatenation list."""
    x = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", quote_path(F.col("path")).alias("t")))).alias("x"))
    return x.select(*keys, F.concat(F.lit("ffconcat version 1.0\n"), F.array_join(F.transform("x", lambda s: s["t"]), "\n"), F.lit("\n")).alias("list"))


def metadata_file(marks: DataFrame) -> DataFrame:
    """(book, chapter, title, start_ms, end_ms[, book_title, author]) to (book, metadata): the text of a chapter metadata
    file."""
    entry = F.concat_ws("\n", F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), F.concat(F.lit("START="), F.col("start_ms").cast("string")), F.concat(F.lit("END="), F.col("end_ms").cast("string")), F.concat(F.lit("title="), escape_metadata(F.col("title"))))
    named = F.col("book_title") if "book_title" in marks.columns else F.col("book").cast("string")
    author = F.col("author") if "author" in marks.columns else F.lit("")
    x = marks.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", entry.alias("t")))).alias("x"), F.first(named).alias("title"), F.first(author).alias("author"))
    title, by = escape_metadata(F.col("title")), F.when(F.col("author") != "", F.concat(F.lit("\nartist="), escape_metadata(F.col("author")))).otherwise("")
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), title, F.lit("\nalbum="), title, by, F.lit("\ngenre=Audiobook\n"))
    return x.select("book", F.concat(head, F.array_join(F.transform("x", lambda s: s["t"]), "\n"), F.lit("\n")).alias("metadata"))


def _codec(fmt: str, bitrate: str) -> list[str]:
    return ["-c:a", {"mp3": "libmp3lame", "m4a": "aac", "m4b": "aac"}[fmt], "-b:a", bitrate]


def _argv(*parts: str | Column) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def chapter_command(chapter: Column, title: Column, album: Column, artist: Column | None = None, fmt: str = "m4a", bitrate: str = "96k", rate: int = 44_100, loudnorm: bool = True) -> Column:
    """Arguments that encode one chapter from its concatenation list."""
    level = ["-af", "loudnorm=I=-18:TP=-1.5:LRA=11"] if loudnorm else []
    start = ["-f", "concat", "-safe", "0", "-i", F.format_string("tmp/chapter_%03d.ffconcat", chapter), "-vn", "-ac", "1", *level, "-ar", str(rate), *_codec(fmt, bitrate)]
    tags = ["-metadata", F.concat(F.lit("title="), title), "-metadata", F.concat(F.lit("album="), album), "-metadata", F.concat(F.lit("track="), chapter.cast("string")), "-metadata", "genre=Audiobook"]
    if artist is not None:
        tags += ["-metadata", F.concat(F.lit("artist="), artist)]
    fast = ["-movflags", "+faststart"] if fmt == "m4a" else []
    return _argv(*start, *tags, *fast, F.concat(chapter_dir(chapter), F.lit(f".{fmt}")))


def m4b_command(book: Column, source_fmt: str = "m4a", bitrate: str = "96k") -> Column:
    """Arguments that join a book's chapter files into one with chapter marks; AAC is copied, other sound is encoded anew."""
    codec = ["-c:a", "copy"] if source_fmt == "m4a" else _codec("m4b", bitrate)
    lists = ["-f", "concat", "-safe", "0", "-i", "tmp/book.ffconcat", "-f", "ffmetadata", "-i", "tmp/book.ffmetadata"]
    return _argv(*lists, "-map", "0:a", "-map_metadata", "1", "-map_chapters", "1", *codec, "-movflags", "+faststart", "-f", "mp4", F.concat(book, F.lit(".m4b")))


def wav_files(clips: DataFrame) -> DataFrame:
    """(path, samples array<short>, rate) to (path, content): mono WAV files of 16 bits, header and all."""
    n = F.size("samples") * 2
    word = lambda c, size: F.concat(*(F.substring(F.unhex(F.lpad(F.hex(c.cast("long")), 2 * size, "0")), size - k, 1) for k in range(size)))
    raw = lambda s: F.lit(s).cast("binary")
    head = F.concat(raw("RIFF"), word(n + 36, 4), raw("WAVEfmt "), word(F.lit(16), 4), word(F.lit(1), 2), word(F.lit(1), 2), word(F.col("rate"), 4), word(F.col("rate") * 2, 4), word(F.lit(2), 2), word(F.lit(16), 2), raw("data"), word(n, 4))
    hexed = F.array_join(F.transform("samples", lambda s: F.concat(F.substring(F.lpad(F.hex(s.cast("int").bitwiseAND(0xFFFF)), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(s.cast("int").bitwiseAND(0xFFFF)), 4, "0"), 1, 2))), "")
    return clips.select("path", F.concat(head, F.unhex(hexed)).alias("content"))


def silence_command(ms: Column, rate: Column, path: Column) -> Column:
    return _argv("-f", "lavfi", "-i", F.concat(F.lit("anullsrc=r="), rate.cast("string"), F.lit(":cl=mono")), "-t", F.format_string("%.3f", ms / 1000), "-c:a", "pcm_s16le", path)


def resample_command(source: Column, path: Column, rate: Column) -> Column:
    return _argv("-i", source, "-ac", "1", "-ar", rate.cast("string"), "-c:a", "pcm_s16le", path)


def complete_books(chapters: DataFrame, assembled: DataFrame) -> DataFrame:
    """(book, total, done, complete): a book is complete once each of its chapters is assembled."""
    keys = [c for c in ("book", "chapter") if c in assembled.columns]
    x = chapters.select("book", "chapter").distinct().join(assembled.select(*keys, F.lit(1).alias("hit")).distinct(), keys, "left")
    return x.groupBy("book").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("done")).withColumn("complete", F.col("total") == F.col("done"))


def metadata_rows(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, metadata): each book with its chapters in order, as JSON."""
    fields = [c for c in chapters.columns if c not in ("book", "chapter")]
    x = chapters.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", *fields))).alias("chapters"))
    return books.join(x, "book", "left").select("book", F.to_json(F.struct(F.struct(*(F.col(c) for c in books.columns)).alias("book"), F.coalesce("chapters", F.array().cast(x.schema["chapters"].dataType)).alias("chapters"))).alias("metadata"))
