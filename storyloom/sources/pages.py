"""Books that come as lines of laid-out pages. No PDF library is at hand, so the source is a table of lines; pages without
a text layer can be read by a function that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import clean_paragraph
from storyloom.operators.chapters import bookmarked_paragraphs, finalized_books, heading_chapters, line_paragraphs, runs
from storyloom.tables import stored

# The share of a page's height at its top and bottom that is margin; a page with fewer characters is an image.
MARGIN_ZONE = 0.1
LEAST_CHARS = 25


def with_margins(lines: DataFrame) -> DataFrame:
    """(book, page, pos, text, size, x0, x1, y0, y1, height) cleaned, with in_margin; empty lines go, and a soft hyphen at
    a line's end counts as a hyphen."""
    text = clean_paragraph(F.regexp_replace(F.rtrim("text"), "­$", "-"))
    edge = (F.col("y1") < F.col("height") * MARGIN_ZONE) | (F.col("y0") > F.col("height") * (1 - MARGIN_ZONE))
    return lines.withColumn("text", text).filter("text <> ''").withColumn("in_margin", edge).drop("y0", "y1", "height")


def image_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, page) of the pages (book, page, images) that hold images and fewer than 25 characters of text."""
    chars = lines.groupBy("book", "page").agg(F.sum(F.length("text")).alias("chars"))
    return pages.join(chars, ["book", "page"], "left").filter((F.col("images") > 0) & (F.coalesce("chars", F.lit(0)) < LEAST_CHARS)).select("book", "page")


def read_images(pages: DataFrame, read: Callable[[bytes], str]) -> DataFrame:
    """(book, page, image) to (book, page, pos, text): the paragraphs that `read` finds in each page's image. It runs on
    the executors, a page at a time; blank lines part paragraphs."""
    kind = pages.schema["book"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.book, r.page, k, " ".join(x.split())) for r in b.itertuples() for k, x in enumerate(read(bytes(r.image)).split("\n\n")) if x.strip()]
            yield pd.DataFrame(rows, columns=["book", "page", "pos", "text"])

    return pages.select("book", "page", "image").mapInPandas(run, f"book {kind}, page int, pos int, text string")


def page_paragraphs(lines: DataFrame, pages: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """(book, paragraph, page, text) of with_margins() lines, without running headers, and of the paragraphs that were read
    from images (read_images()) in place of their pages' lines. pages (book, page, images) lists all pages."""
    counts = pages.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    if read is None:
        return line_paragraphs(lines, counts)
    seen = read.select("book", "page").distinct()
    kept = lines.join(seen, ["book", "page"], "left_anti").withColumn("ocr", F.lit(False))
    extra = read.select("book", "page", "pos", "text", F.lit(False).alias("in_margin"), F.lit(True).alias("ocr"))
    return line_paragraphs(kept.unionByName(extra, allowMissingColumns=True), counts)


def page_books(lines: DataFrame, pages: DataFrame, marks: DataFrame, about: DataFrame, read: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Finished books and chapters, and warnings (book, warning). Bookmarks (book, ord, level, page, title) make chapters
    where a book has two or more of the top level, headings do elsewhere. about: (book, title, author, encrypted); a book
    that asks for a password is an error."""
    locked = about.filter("encrypted").select("book").limit(5).collect()
    if locked:
        raise ValueError(f"password needed: {', '.join(str(r['book']) for r in locked)}")
    ready = with_margins(lines)
    paragraphs = stored(page_paragraphs(ready, pages, read), "page_paragraphs")
    marked = bookmarked_paragraphs(paragraphs.select("book", "page", F.col("paragraph").alias("pos"), "text"), marks)
    marked = stored(marked.select("book", F.col("chapter").cast("long").alias("chapter"), "title", F.col("pos").cast("long").alias("paragraph"), "text"), "marked")
    rest = paragraphs.join(marked.select("book").distinct(), "book", "left_anti").select("book", "paragraph", "text")
    headed = heading_chapters(rest).select("book", F.col("chapter").cast("long").alias("chapter"), "title", F.col("paragraph").cast("long").alias("paragraph"), "text")
    lost = image_pages(ready, pages)
    if read is not None:
        lost = lost.join(read.select("book", "page").distinct(), ["book", "page"], "left_anti")
    listed = runs(lost.select(F.col("book").alias("key"), (F.col("page") + 1).alias("n")))
    warnings = listed.select(F.col("key").alias("book"), F.concat(F.lit("pages without text: "), "runs").alias("warning"))
    books = about.select("book", "title", "author", F.lit("").alias("language"), F.lit("pdf").alias("source_format"))
    return (*finalized_books(books, marked.unionByName(headed)), warnings)
