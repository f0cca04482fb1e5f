"""Headings, bookmarks and runs: where chapters begin and end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG
from storyloom.functions.text import BARE_NUMBER, MAJOR, casefold, clean_paragraph, detect_language, is_heading
from storyloom.operators.segment import pack_chapters
from storyloom.tables import running, scope, stored

# Second halves that keep the hyphen at a line's end, first halves that keep it before "то", page numbers.
PARTICLES = ("нибудь", "либо", "таки", "ка", "де", "с")
PRONOUNS = (
    "что", "кто", "как", "где", "когда", "куда", "откуда", "какой", "какая", "какое", "какие", "каким", "какую", "чей", "чья", "чьи", "почему", "зачем", "отчего",
    "чего", "кого", "кому", "чем", "ком", "сколько", "это", "тот", "та",
)
PAGE_NUMBER = r"(?U)^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"


# What a bare number is a chapter of, by language.
CHAPTER_WORD = {"ru": "Глава", "en": "Chapter"}


def heading_chapters(paragraphs: DataFrame, front_chars: int = 200, default_title: str = "Chapter", most: int = CONFIG.fallback_chapter_chars) -> DataFrame:
    """(book, paragraph, text) to (book, chapter, title, has_title, paragraph, text) of cleaned paragraphs.

    A heading opens a chapter; a major heading (part, book) prefixes the titles after it, and a bare number gets the word
    for chapter in the book's language (of its first 200 paragraphs). Chapters without text go, and so does a short
    beginning without heading. A book without headings is cut by size. A chapter without title is named by its number.
    """
    x = paragraphs.select("book", "paragraph", clean_paragraph(F.col("text")).alias("text")).filter("text <> ''")
    text = F.col("text")
    x = stored(x.withColumn("head", is_heading(text)), "paragraphs")
    headed = x.groupBy("book").agg(F.bool_or("head").alias("headed"))
    ranked = x.withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy("paragraph"))).filter("k <= 200")
    sample = ranked.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), " ").alias("sample"))
    word = F.when(detect_language(F.col("sample")) == "ru", CHAPTER_WORD["ru"]).otherwise(CHAPTER_WORD["en"])
    books = stored(headed.join(sample.select("book", word.alias("word")), "book"), "headed")
    with_heads = x.join(books.filter("headed"), "book")
    heads = with_heads.filter("head").withColumn("part", F.row_number().over(Window.partitionBy("book").orderBy("paragraph")))
    major = F.last(F.when(text.rlike(MAJOR), text), ignorenulls=True).over(Window.partitionBy("book").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, 0))
    name = F.when(text.rlike(BARE_NUMBER), F.concat(F.col("word"), F.lit(" "), F.regexp_extract(text, BARE_NUMBER, 1))).otherwise(text)
    heads = heads.withColumn("major", major).select("book", "part", F.when(text.rlike(MAJOR) | F.col("major").isNull(), F.when(text.rlike(MAJOR), text).otherwise(name)).otherwise(F.concat(F.col("major"), F.lit(". "), name)).alias("title"))
    body = running(with_heads.select("book", "paragraph", "text", "head"), ["book"], ["paragraph"], {"part": F.col("head").cast("int")}, {}).filter("not head")
    sizes = stored(body.groupBy("book", "part").agg(F.sum(F.length("text")).alias("chars")).filter((F.col("part") > 0) | (F.col("chars") > front_chars)), "parts")
    number = F.row_number().over(Window.partitionBy("book").orderBy("part"))
    named = sizes.select("book", "part", number.alias("chapter")).join(heads, ["book", "part"], "left")
    out = body.join(named, ["book", "part"]).select("book", "chapter", "title", "paragraph", "text")
    plain = x.join(books.filter("not headed"), "book", "left_semi").select("book", "paragraph", "text")
    cut = pack_chapters(plain, most).select("book", "paragraph", F.col("part").alias("chapter"))
    out = out.unionByName(plain.join(cut, ["book", "paragraph"]).select("book", "chapter", F.lit(None).cast("string").alias("title"), "paragraph", "text"))
    generated = F.concat(F.lit(f"{default_title} "), F.col("chapter").cast("string"))
    return out.select("book", "chapter", F.coalesce("title", generated).alias("title"), F.col("title").isNotNull().alias("has_title"), "paragraph", "text")


def bookmark_chapters(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(book, page, ...) with the mark (book, page, title) whose range holds the page; a book needs two marks. Pages and
    marks are read in one order, so a page takes the last mark at or before it."""
    order = Window.partitionBy("book").orderBy("page")
    tops = marks.filter("page > 0").groupBy("book", "page").agg(F.min("title").alias("title"))
    tops = tops.withColumn("chapter", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("book"))).filter("n >= 2").drop("n")
    both = pages.withColumn("_mark", F.lit(None).cast("struct<title:string,chapter:int>")).withColumn("_own", F.lit(1))
    both = both.unionByName(tops.select("book", "page", F.struct("title", "chapter").alias("_mark"), F.lit(0).alias("_own")), allowMissingColumns=True)
    x = running(both, ["book"], ["page", "_own"], {}, {"_last": F.col("_mark")})
    return x.filter("_own = 1 and _last is not null").select(*pages.columns, "_last.title", "_last.chapter")


def runs(numbers: DataFrame) -> DataFrame:
    """(key, n) to (key, runs): whole numbers in compact form, as 1-3, 5."""
    island = numbers.distinct().withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy("key").orderBy("n")))
    spans = island.groupBy("key", "g").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("x"))
    return listed.select("key", F.array_join(F.transform("x", lambda s: s["t"]), ", ").alias("runs"))


def repeated_margins(lines: DataFrame, share: float = 0.3, least: int = 3, pages: DataFrame | None = None) -> DataFrame:
    """(book, page, text) of margin lines: the keys (digits as #, lower case) that stand on so many pages that they are
    running headers, with their page counts. pages (book, pages) counts all pages of a book, not only those with lines."""
    key = F.regexp_replace(F.lower("text"), "[0-9]+", "#")
    if pages is None:
        pages = lines.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    keys = lines.select("book", "page", key.alias("header")).groupBy("book", "header").agg(F.countDistinct("page").alias("n"))
    return keys.join(pages, "book").filter(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("book", "header", "n")


def drop_margins(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book, page, text, in_margin, ...) without the margin lines that are page numbers or repeated_margins(). Keys fold
    case and take digits of all scripts as #. pages: as there; without it the pages that have lines count."""
    columns = lines.columns
    margin = F.coalesce(F.col("in_margin"), F.lit(False))
    if pages is None:
        pages = lines.groupBy("book").agg(F.countDistinct("page").alias("pages"))
    edge = lines.filter(margin).withColumn("header", casefold(F.regexp_replace("text", r"\p{Nd}+", "#")))
    heads = repeated_margins(edge.select("book", "page", F.col("header").alias("text")), pages=pages).select("book", "header")
    kept = edge.filter(~F.coalesce(F.col("text").rlike(PAGE_NUMBER), F.lit(False))).join(heads, ["book", "header"], "left_anti")
    return lines.filter(~margin).unionByName(kept.select(*columns))


def body_sizes(lines: DataFrame) -> DataFrame:
    """(book, size, pos, text): the font size with most characters in each book, the first seen of equals."""
    w = lines.groupBy("book", "size").agg(F.sum(F.length("text")).alias("chars"), F.min("pos").alias("first"))
    return w.groupBy("book").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body_size"))


def page_lines(lines: DataFrame) -> DataFrame:
    """(book, page, pos, text, size, x0, x1) with body_size, and against the body lines of its page whether a line is
    short (ends 25 units or 8 % of the width before the right edge) or indented (starts 8 units behind the left one)."""
    page = Window.partitionBy("book", "page")
    x = lines.join(body_sizes(lines), "book")
    body = F.abs(F.col("size") - F.col("body_size")) <= 0.6
    x = x.withColumn("left", F.min(F.when(body, F.col("x0"))).over(page)).withColumn("right", F.max(F.when(body, F.col("x1"))).over(page))
    slack = F.greatest(F.lit(25.0), (F.col("right") - F.col("left")) * 0.08)
    short, indented = F.col("x1") < F.col("right") - slack, F.col("x0") > F.col("left") + 8
    return x.withColumn("short", F.coalesce(short, F.lit(False))).withColumn("indented", F.coalesce(indented, F.lit(False))).drop("left", "right")


def join_lines(joined: Column) -> Column:
    """Lines joined by U+001F as one text: a hyphen at a line's end goes, unless the next word is a particle."""
    gap = r"[^\w\s\x1f]*"
    kept = F.regexp_replace(joined, rf"(?iuU)(\w-)\x1f(?={gap}(?:{'|'.join(PARTICLES)}){gap}(?:[\s\x1f]|$))", "$1")
    kept = F.regexp_replace(kept, rf"(?iuU)\b((?:{'|'.join(PRONOUNS)})-)\x1f(?={gap}то{gap}(?:[\s\x1f]|$))", "$1")
    return F.btrim(F.translate(F.regexp_replace(kept, r"(?U)(\w)-\x1f", "$1"), "\x1f", " "))


def line_paragraphs(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book, page, pos, text, size, x0, x1) to (book, paragraph, page, text), across pages. A line opens a paragraph if
    it or the line before is not of the body's size, if it starts a dialogue or is indented, if the line before is short
    and ends a sentence or is a heading, or if it is short and a heading. The page is that of the first line. Lines with
    in_margin lose page numbers and running headers first; `pages` as in drop_margins(). Rows with a true `ocr` are whole
    paragraphs, which nothing is joined to."""
    if "in_margin" in lines.columns:
        lines = drop_margins(lines, pages)
    order = Window.partitionBy("book").orderBy("page", "pos")
    text = F.col("text")
    whole = F.coalesce(F.col("ocr"), F.lit(False)) if "ocr" in lines.columns else F.lit(False)
    x = page_lines(lines.filter(~whole)).withColumn("odd", F.abs(F.col("size") - F.col("body_size")) > 0.6).withColumn("closed", F.col("short") & (text.rlike(r'[.!?…:;»"”)]$') | is_heading(text)))
    x = x.select("book", "page", "pos", "text", "odd", "closed", "short", "indented")
    if "ocr" in lines.columns:
        yes, no = F.lit(True), F.lit(False)
        x = x.unionByName(lines.filter(whole).select("book", "page", "pos", "text", yes.alias("odd"), yes.alias("closed"), no.alias("short"), no.alias("indented")))
    before = lambda c: F.lag(c, 1, True).over(order)
    opens = F.col("odd") | before("odd") | text.rlike(r"(?U)^\s*[—–-]\s") | F.col("indented") | before("closed") | (F.col("short") & is_heading(text))
    x = x.withColumn("paragraph", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lists = x.groupBy("book", "paragraph").agg(F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("page", "pos", "text"))).alias("x"))
    out = lists.select("book", "paragraph", "page", join_lines(F.array_join(F.transform("x", lambda s: F.translate(s["text"], "\x1f", " ")), "\x1f")).alias("text"))
    return out.filter("text <> ''")


def finalize(chapters: DataFrame) -> DataFrame:
    """(book, chapter, title, paragraph, text) cleaned: empty paragraphs and chapters go, both are numbered anew (from 0
    and 1), a chapter without title takes the book's name."""
    x = chapters.withColumn("text", clean_paragraph(F.col("text"))).filter("text <> ''")
    title = F.coalesce(F.nullif(F.btrim("title"), F.lit("")), F.col("book").cast("string"))
    there = x.select("book", F.col("chapter").alias("old")).distinct().withColumn("number", F.row_number().over(Window.partitionBy("book").orderBy("old")))
    x = x.join(there, (x["book"].eqNullSafe(there["book"])) & (x["chapter"] == there["old"])).drop(there["book"])
    place = F.row_number().over(Window.partitionBy("book", "chapter").orderBy("paragraph")) - 1
    own = ["has_title"] if "has_title" in chapters.columns else []
    return x.withColumn("place", place).select("book", F.col("number").alias("chapter"), title.alias("title"), *own, F.col("place").alias("paragraph"), "text")


def finalized_books(books: DataFrame, chapters: DataFrame, parser_version: int = CONFIG.parser_version) -> tuple[DataFrame, DataFrame]:
    """books (book, title, author, language, source_format) and their chapters to finished books and chapters.

    A title that is blank becomes the book's name, a language that is missing is told from the first 50 paragraphs of the
    first three chapters. A book of which no text is left is an error that names it.
    """
    out = stored(finalize(chapters), "chapters")
    lost = books.join(out.select("book").distinct(), "book", "left_anti").select("book").orderBy("book").limit(5).collect()
    if lost:
        raise ValueError(f"no readable text found: {', '.join(str(r['book']) for r in lost)}")
    sample = out.filter("chapter <= 3 and paragraph < 50").groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "paragraph", "text"))), lambda s: s["text"]), " ").alias("sample"))
    counts = out.groupBy("book").agg(F.countDistinct("chapter").alias("chapter_count"), F.sum(F.length("text")).alias("char_count"))
    given = lambda c: F.nullif(F.btrim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    x = books.join(sample, "book").join(counts, "book")
    done = x.select("book", F.coalesce(given("title"), F.col("book")).alias("title"), F.btrim(F.coalesce("author", F.lit(""))).alias("author"), F.coalesce(given("language"), detect_language(F.col("sample"))).alias("language"), "source_format", F.lit(parser_version).alias("parser_version"), "chapter_count", "char_count")
    return done, out


def with_titles(chapters: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraphs ([book,] chapter, paragraph, text) with the titles of chapters ([book,] chapter, title[, has_title]) read
    first, as paragraph 0; titles that were made up for a chapter (has_title is false) are not read."""
    keys = scope(paragraphs)
    own = F.col("has_title") if "has_title" in chapters.columns else F.lit(True)
    titled = chapters.filter(own & (F.col("title") != "")).select(*keys, F.lit(0).cast("long").alias("paragraph"), F.col("title").alias("text"))
    moved = paragraphs.join(titled.select(*keys, F.lit(1).alias("by")), keys, "left")
    return moved.select(*keys, (F.col("paragraph") + F.coalesce("by", F.lit(0))).cast("long").alias("paragraph"), "text").unionByName(titled)


def selection(spec: str | None) -> list[tuple[int, int]]:
    """Ranges of a selection like 1,3,5-7; none or an empty one selects everything."""
    parts = [p.strip() for p in (spec or "").split(",") if p.strip()]
    return [(int(a), int(b or a)) for a, _, b in (p.partition("-") for p in parts)]


#: Chapters that one range of a selection may name.
MOST = 100_000


def selected(chapters: DataFrame, spec: str | None) -> DataFrame:
    """The chapters of a selection; a number without a chapter is an error, which names the first ones."""
    ranges = selection(spec)
    if not ranges:
        return chapters
    inside = reduce(lambda x, y: x | y, (F.col("chapter").between(a, b) for a, b in ranges if a <= b), F.lit(False))
    chosen = chapters.filter(inside)
    there = {r["chapter"] for r in chosen.select("chapter").distinct().orderBy("chapter").limit(1 + sum(max(0, b - a + 1) for a, b in ranges if b - a < MOST)).collect()} if all(b - a < MOST for a, b in ranges) else None
    wanted = sorted({n for a, b in ranges for n in range(a, b + 1)}) if there is not None else []
    if there is None:
        raise ValueError(f"a range holds over {MOST} chapters: {spec}")
    if unknown := [n for n in wanted if n not in there][:5]:
        raise ValueError(f"no such chapters: {unknown}")
    return chosen


def bookmarked_paragraphs(paragraphs: DataFrame, marks: DataFrame, front_chars: int = 200) -> DataFrame:
    """(book, page, pos, text) and bookmarks (book, ord, level, page, title) to (book, chapter, title, page, pos, text).

    Only the top level of a book's bookmarks counts, and a book needs two. A chapter runs from its mark's page to the
    next mark's, and holds one page at least, so two marks on a page both get it. A first paragraph that repeats the title
    goes; what stands before the first mark is a chapter if it is longer than `front_chars`; chapters without text go.
    """
    book = Window.partitionBy("book")
    top = marks.withColumn("top", F.min("level").over(book)).filter((F.col("level") == F.col("top")) & (F.col("page") > 0))
    top = top.withColumn("n", F.count(F.lit(1)).over(book)).filter("n >= 2")
    order = book.orderBy("ord")
    top = top.withColumn("k", F.row_number().over(order)).withColumn("end", F.greatest(F.coalesce(F.lead("page").over(order), F.lit(2**31 - 1)), F.col("page") + 1))
    front = top.filter("k = 1").select("book", F.lit(0).alias("k"), F.lit("Front matter").alias("title"), F.lit(-1).cast("long").alias("start"), F.col("page").cast("long").alias("end"))
    ranges = top.select("book", "k", "title", F.col("page").cast("long").alias("start"), F.col("end").cast("long").alias("end")).unionByName(front)
    # Ranges meet pages in bins of 64 pages, so a page is compared with the marks near it only.
    ends = paragraphs.groupBy("book").agg(F.max("page").alias("most"))
    ranges = ranges.join(ends, "book").withColumn("end", F.least("end", F.col("most") + 1)).filter("start < end")
    binned = ranges.withColumn("bin", F.explode(F.sequence(F.expr("greatest(start, 0) div 64"), F.expr("(end - 1) div 64")))).drop("most")
    sites = paragraphs.select("book", "page").distinct().withColumn("bin", F.expr("page div 64")).join(binned, ["book", "bin"]).filter("page >= start and page < end")
    x = paragraphs.select("book", "page", "pos", "text").join(sites.select("book", "page", "k", "title"), ["book", "page"])
    same = lambda c: F.lower(clean_paragraph(F.col(c)))
    first = F.struct("page", "pos", (same("text") == same("title")).alias("same"))
    whole = x.groupBy("book", "k", "title").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    cut = F.col("first.same") & (F.col("k") > 0)
    whole = whole.withColumn("cut", cut).filter((F.col("n") > F.col("cut").cast("int")) & ((F.col("k") > 0) | (F.col("chars") > front_chars)))
    named = whole.select("book", "k", F.row_number().over(book.orderBy("k")).alias("chapter"), F.when(F.col("cut"), F.struct("first.page", "first.pos")).alias("gone"))
    out = x.join(named, ["book", "k"]).filter(F.col("gone").isNull() | (F.struct("page", "pos") != F.col("gone")))
    return out.select("book", "chapter", "title", "page", "pos", "text")
