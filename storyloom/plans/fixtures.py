"""Queries over small literal inputs whose right results are known, with these results as SQL values."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom import engine
from storyloom.config import CONFIG, configured
from storyloom.functions import names as N
from storyloom.functions import text as X
from storyloom.operators import assembly, attribution, casting, chapters, labels, plan, registry, segment
from storyloom.plans.queries import query
from storyloom.sources import books, pages
from storyloom.sources import voices as library
from storyloom.tables import Workspace, scan_json, shared_dir

KINDS = {"s": ("string", "VARCHAR"), "i": ("bigint", "BIGINT"), "b": ("boolean", "BOOLEAN"), "d": ("double", "DOUBLE")}


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def known(columns: str, rows: list[tuple]) -> Callable:
    """Registers a query whose result is these rows; columns: name:kind, kind s, i, b or d."""
    typed = [(c.split(":")[0], KINDS[c.split(":")[1]]) for c in columns.split()]
    select = ", ".join(f'CAST("{c}" AS {k[1]}) AS "{c}"' for c, k in typed)
    names = ", ".join(f'"{c}"' for c, _ in typed)
    sql = f"SELECT {select} FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark).select(*(F.col(c).cast(k[0]).alias(c) for c, k in typed))

        return query(sql)(run)

    return add


def _case(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


PARAGRAPHS = [
    "— Ты всё-таки пришёл? — тихо спросила она.", "— Я обещал, — ответил он. — Разве я мог иначе?", "— Москва — большой город.", 'He looked up. "I will be there tomorrow," he said.',
    "Он читал «Войну и мир» весь вечер.", "Обычный абзац повествования без диалога.", "«Все это вздор, – сказал он с надеждой, – и нечем тут было смущаться!»", "- да", "-нет",
]


@known(
    "case:i pos:i hint:s text:s",
    [
        (0, 0, "dialogue", "Ты всё-таки пришёл?"), (0, 1, "narration", "тихо спросила она."), (1, 0, "dialogue", "Я обещал,"), (1, 1, "narration", "ответил он."), (1, 2, "dialogue", "Разве я мог иначе?"),
        (2, 0, "dialogue", "Москва — большой город."), (3, 0, "narration", "He looked up."), (3, 1, "dialogue", "I will be there tomorrow,"), (3, 2, "narration", "he said."),
        (4, 0, "narration", "Он читал «Войну и мир» весь вечер."), (5, 0, "narration", "Обычный абзац повествования без диалога."),
        (6, 0, "dialogue", "Все это вздор,"), (6, 1, "narration", "сказал он с надеждой,"), (6, 2, "dialogue", "и нечем тут было смущаться!"), (7, 0, "dialogue", "да"), (8, 0, "narration", "-нет"),
    ],
)
def known_spans(spark: SparkSession) -> DataFrame:
    """Paragraphs to spans, by dashes and by quotes."""
    x = _case(spark, list(enumerate(PARAGRAPHS)), "case int, text string")
    return x.select("case", F.posexplode(segment.paragraph_spans(F.col("text"))).alias("pos", "s")).select("case", "pos", "s.hint", "s.text")


@known(
    "most:i pos:i text:s",
    [
        (45, 0, "Первое предложение. Второе предложение."), (45, 1, "Третье предложение."),
        (44, 0, "This first clause is rather long by itself,"), (44, 1, "and so is the second one."), (44, 2, "Short."), (14, 0, "слово слово"), (14, 1, "слово"),
        (30, 0, "One. Two."), (30, 1, "A clause here, another there,"), (30, 2, "a third one."), (30, 3, "Three."),
    ],
)
def known_pieces(spark: SparkSession) -> DataFrame:
    """Sentences, clauses and words packed; what a long sentence leaves stands alone."""
    cases = [
        (45, "Первое предложение. Второе предложение. Третье предложение."), (44, "This first clause is rather long by itself, and so is the second one. Short."), (14, "слово слово слово"),
        (30, "One. Two. A clause here, another there, a third one. Three."),
    ]
    out = [_case(spark, [(m, t)], "most int, text string").select("most", F.posexplode(segment.split_long(F.col("text"), m)).alias("pos", "text")) for m, t in cases]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


SAMPLE = """Глава 1

Анна подошла к окну. За стеклом медленно падал снег.

— Ты всё-таки пришёл? — тихо спросила Анна.

Иван снял пальто и посмотрел на неё.

— Я обещал, — ответил Иван с лёгкой улыбкой.

Глава 2

Утром снег перестал.

— Пойдём гулять? — спросила Анна.

— Пойдём, — сказал Иван.
"""
_SAMPLE_ROWS = [
    (1, "Глава 1", True, 0, "Анна подошла к окну. За стеклом медленно падал снег."), (1, "Глава 1", True, 1, "— Ты всё-таки пришёл? — тихо спросила Анна."), (1, "Глава 1", True, 2, "Иван снял пальто и посмотрел на неё."),
    (1, "Глава 1", True, 3, "— Я обещал, — ответил Иван с лёгкой улыбкой."), (2, "Глава 2", True, 0, "Утром снег перестал."), (2, "Глава 2", True, 1, "— Пойдём гулять? — спросила Анна."), (2, "Глава 2", True, 2, "— Пойдём, — сказал Иван."),
]
_WRAPPED = "Это длинная строка,\r\nперенесённая вручную.\r\n\r\n— Реплика один.\r\n— Реплика два.\r\n—слово\r\n"


@known(
    "book:s title:s language:s chapter:i heading:s has_title:b paragraph:i text:s",
    [(f"/b/{n}", s, "ru", *r) for n, s in (("utf8.txt", "utf8"), ("old.cp1251.txt", "old.cp1251"), ("wide.TXT", "wide")) for r in _SAMPLE_ROWS]
    + [("/b/plain.txt", "plain", "ru", 1, "Chapter 1", False, k, t) for k, t in enumerate(["Это длинная строка, перенесённая вручную.", "— Реплика один.", "— Реплика два. —слово"])]
    + [("/b/parts.txt", "parts", "ru", 1, "Часть 1. Глава 1", True, 0, "Текст главы."), ("/b/parts.txt", "parts", "ru", 2, "Часть 1. Глава 2", True, 0, "Ещё текст."), ("/b/parts.txt", "parts", "ru", 3, "Эпилог", True, 0, "Конец.")]
    + [("/b/long.txt", "long", "en", 1, "Chapter 1", False, 0, "x" * 15_000), ("/b/long.txt", "long", "en", 2, "Chapter 2", False, 0, "y" * 15_000)],
)
def known_text_books(spark: SparkSession) -> DataFrame:
    """Text files of several encodings to books with chapters."""
    parts = "\ufeffЧасть 1\n\nГлава 1\n\nТекст главы.\n\n2\n\nЕщё текст.\n\nЭпилог\n\nКонец.\n"
    files = [
        ("/b/utf8.txt", SAMPLE.encode()), ("/b/old.cp1251.txt", SAMPLE.encode("cp1251")), ("/b/wide.TXT", SAMPLE.encode("utf-16")), ("/b/plain.txt", _WRAPPED.encode()), ("/b/parts.txt", parts.encode()),
        ("/b/long.txt", ("x" * 15_000 + "\n\n" + "y" * 15_000).encode()),
    ]
    x = _case(spark, [(p, bytearray(c)) for p, c in files], "path string, content binary").filter(books.book_format(F.col("path")) == "txt")
    found, parts_ = books.text_books(x)
    return parts_.withColumnRenamed("title", "heading").join(found.select("book", "title", "language"), "book")


FB2 = """<?xml version="1.0" encoding="utf-8"?>
<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0">
<description><title-info><author><first-name>Лев</first-name><last-name>Толстой</last-name></author><book-title>Тестовая книга</book-title><lang>ru</lang></title-info></description>
<body><title><p>Лев Толстой</p><p>Тестовая книга</p></title><section><title><p>Часть первая</p></title>
<section><title><p>Глава 1</p></title><p>Анна подошла к окну.</p><p>— Ты пришёл? — спросила она.</p><empty-line/></section>
<section><title><p>Глава 2</p></title><p>Утро было тихим.</p><poem><stanza><v>Строка стиха</v></stanza></poem></section></section></body>
<body name="notes"><section><p>Примечание, которое не нужно читать.</p></section></body></FictionBook>"""
BROKEN_FB2 = "<FictionBook><body><section><title><p>One.</p></title><p>intro</p><section><p>a &amp; b<b>c</p><cite><p>said</p><text-author>me</text-author></cite></section><section><p>untitled"
_FB2_ROWS = [
    (1, "Часть первая. Глава 1", True, 0, "Анна подошла к окну."), (1, "Часть первая. Глава 1", True, 1, "— Ты пришёл? — спросила она."), (2, "Часть первая. Глава 2", True, 0, "Утро было тихим."),
    (2, "Часть первая. Глава 2", True, 1, "Строка стиха"),
]


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


@known(
    "path:s book_title:s author:s language:s chapter:i title:s has_title:b paragraph:i text:s",
    [(p, "Тестовая книга", "Лев Толстой", "ru", *r) for p in ("a.fb2", "b.fb2.zip", "declared.fb2") for r in _FB2_ROWS]
    + [
        ("broken.fb2", "", "", "", 1, "One", True, 0, "intro"), ("broken.fb2", "", "", "", 2, "One", True, 0, "a & bc"), ("broken.fb2", "", "", "", 2, "One", True, 1, "said"),
        ("broken.fb2", "", "", "", 2, "One", True, 2, "me"), ("broken.fb2", "", "", "", 3, "One", True, 0, "untitled"), ("empty.fb2", "", "", "", 0, "unreadable: ValueError", False, 0, None),
        ("plain.fb2", "", "", "", 1, "Chapter 1", False, 0, "text"),
    ],
)
def known_fb2(spark: SparkSession) -> DataFrame:
    """FB2 files, zipped, broken, with declared entities, without titles and without body."""
    declared = FB2.replace("\n<FictionBook", '\n<!DOCTYPE x [<!ENTITY secret SYSTEM "file:///etc/hosts">]>\n<FictionBook', 1)
    files = {
        "a.fb2": FB2.encode(), "b.fb2.zip": _zip({"x.txt": "no", "book.fb2": FB2}), "declared.fb2": declared.encode(), "broken.fb2": BROKEN_FB2.encode(), "empty.fb2": b"<FictionBook></FictionBook>",
        "plain.fb2": b"<FictionBook><body><section><p>text</p></section></body></FictionBook>",
    }
    return books.parse_books(_case(spark, [(p, bytearray(c)) for p, c in files.items()], "path string, content binary"))


def _epub() -> bytes:
    page = lambda head, body: f"<html><head><title>t</title><style>p</style></head><body>{head}{body}</body></html>"
    many = "".join(f"<p>Paragraph {j} with <em>emphasis</em> and enough words to count.</p>" for j in range(8))
    items = "".join(f'<item id="c{i}" href="text/c%20{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(1, 5))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, 5))
    points = '<navPoint><navLabel><text>From the  contents</text></navLabel><content src="text/c%202.xhtml#top"/></navPoint><navPoint><navLabel><text>Later</text></navLabel><content src="text/c%202.xhtml#x"/></navPoint>'
    return _zip({
        "META-INF/container.xml": '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>',
        "OEBPS/book.opf": f'<package xmlns="urn:p" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>EPUB Test</dc:title><dc:creator>Jane Doe</dc:creator><dc:language>en</dc:language></metadata><manifest>{items}<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="n">{spine}</spine></package>',
        "OEBPS/toc.ncx": f'<ncx xmlns="urn:n"><navMap>{points}</navMap></ncx>',
        "OEBPS/text/c 1.xhtml": page("<h1>Chapter 1</h1>", many), "OEBPS/text/c 2.xhtml": page("", "<div>Only a box.</div>" + many), "OEBPS/text/c 3.xhtml": page("", "<p>Short tail.</p>"),
        "OEBPS/text/c 4.xhtml": page("<h1>Last</h1><h2>One</h2>", "<p>end</p><nav><p>no</p></nav>"),
    })


_EMPHASIS = [f"Paragraph {j} with emphasis and enough words to count." for j in range(8)]


@known(
    "book_title:s author:s language:s chapter:i title:s has_title:b paragraph:i text:s",
    [("EPUB Test", "Jane Doe", "en", 1, "Chapter 1", True, k, t) for k, t in enumerate(_EMPHASIS)]
    + [("EPUB Test", "Jane Doe", "en", 2, "From the contents", True, k, t) for k, t in enumerate(["Only a box.", *_EMPHASIS, "Short tail."])]
    + [("EPUB Test", "Jane Doe", "en", 3, "Last. One", True, 0, "end")],
)
def known_epub(spark: SparkSession) -> DataFrame:
    """An EPUB file with metadata, titles from its contents and a short section that is merged."""
    return books.parse_books(_case(spark, [("x.epub", bytearray(_epub()))], "path string, content binary"))


_LINES = [
    (0, [("ЧАСТЬ 1", 14), ("1", 13), ("В начале июля молодой человек вышел из своей каморки и", 12), ("медленно, как бы в нерешимости, отправился к мосту. Кого-", 12), ("нибудь он встретить не хотел.", 12), ("– Ты пришёл? – спросила она.", 12)]),
    (1, [("– Пришёл, – ответил он и сел у окна, глядя на падающий снег за стек-", 12), ("лом.", 12), ("2", 13), ("Утром снег перестал, и город стал тихим.", 12)]),
    (2, [("ЧАСТЬ 2", 14), ("1", 13), ("Прошла неделя, и всё повторилось снова.", 12)]),
]


def _page_lines(spark: SparkSession) -> DataFrame:
    rows = []
    for page, lines in _LINES:
        placed = [("Автор: «Книга»", 10, 30.0), (str(page + 1), 10, 30.0), *((t, s, 100.0 + 20 * k) for k, (t, s) in enumerate(lines)), ("100 лучших книг: www.example.ru", 10, 795.0)]
        rows += [("book", page, pos, t, float(s), 65.0, 65.0 + 6 * len(t), y, y + s, 842.0) for pos, (t, s, y) in enumerate(placed)]
    rows += [("scan", 0, 0, "x", 12.0, 65.0, 71.0, 100.0, 112.0, 842.0), ("scan", 1, 0, "Строка после скана", 12.0, 65.0, 300.0, 100.0, 112.0, 842.0), ("scan", 1, 1, "идёт дальше.", 12.0, 65.0, 300.0, 120.0, 132.0, 842.0)]
    return _case(spark, rows, "book string, page int, pos int, text string, size double, x0 double, x1 double, y0 double, y1 double, height double")


@known(
    "book:s language:s chapter:i title:s paragraph:i text:s",
    [
        ("book", "ru", 1, "ЧАСТЬ 1. Глава 1", 0, "В начале июля молодой человек вышел из своей каморки и медленно, как бы в нерешимости, отправился к мосту. Кого-нибудь он встретить не хотел."),
        ("book", "ru", 1, "ЧАСТЬ 1. Глава 1", 1, "– Ты пришёл? – спросила она."), ("book", "ru", 1, "ЧАСТЬ 1. Глава 1", 2, "– Пришёл, – ответил он и сел у окна, глядя на падающий снег за стеклом."),
        ("book", "ru", 2, "ЧАСТЬ 1. Глава 2", 0, "Утром снег перестал, и город стал тихим."), ("book", "ru", 3, "ЧАСТЬ 2. Глава 1", 0, "Прошла неделя, и всё повторилось снова."),
        ("scan", "ru", 1, "Глава 7", 0, "Текст со скана."), ("scan", "ru", 1, "Глава 7", 1, "Строка после скана идёт дальше."), ("warned", None, None, "pages without text: 5-6", None, None),
    ],
)
def known_page_books(spark: SparkSession) -> DataFrame:
    """Lines of pages to chapters, one page read from its image, two without text."""
    all_ = [("book", p, 0) for p in range(3)] + [("scan", 0, 1), ("scan", 1, 0), ("scan", 4, 1), ("scan", 5, 2)]
    listed = _case(spark, all_, "book string, page int, images int")
    images = _case(spark, [("scan", 0, bytearray("Глава 7\n\nТекст\nсо скана.".encode()))], "book string, page int, image binary")
    read = pages.read_images(images, lambda raw: raw.decode())
    about = _case(spark, [("book", "T", "A", False), ("scan", "", "", False)], "book string, title string, author string, encrypted boolean")
    marks = _case(spark, [], "book string, ord int, level int, page int, title string")
    found, parts, warned = pages.page_books(_page_lines(spark), listed, marks, about, read)
    rows = parts.join(found.select("book", "language"), "book").select("book", "language", F.col("chapter").cast("long").alias("chapter"), "title", F.col("paragraph").cast("long").alias("paragraph"), "text")
    return rows.unionByName(warned.select(F.lit("warned").alias("book"), F.col("warning").alias("title")), allowMissingColumns=True)


def _attribution_cast(spark: SparkSession) -> DataFrame:
    rows = [("b", "rodion", "Раскольников", ["Родион Романович", "молодой человек"]), ("b", "alena", "Алена Ивановна", ["старуха", "она"]), ("b", "host", "Хозяин", None), ("b", "goltz", "Карл фон дер Гольц", None), ("other", "anna", "Хозяин", None)]
    return _case(spark, rows, "book string, id string, name string, aliases array<string>")


_SAID = [
    (1, 0, "dialogue", "dialogue", "rodion", "Ещё бы!"), (1, 1, "narration", "narration", "narrator", "заметил, зевая, хозяин."), (1, 2, "dialogue", "dialogue", "rodion", "Вот так-то."),
    (2, 3, "narration", "narration", "narrator", "Хозяин сказал что-то и ушёл."), (2, 4, "dialogue", "dialogue", "alena", "Да."), (3, 5, "dialogue", "narration", "narrator", "Забавник!"),
    (3, 6, "narration", "narration", "narrator", "громко проговорил хозяин."), (4, 7, "dialogue", "dialogue", "unknown", "Нет."), (4, 8, "narration", "narration", "narrator", "сказала она Раскольникову"),
    (5, 9, "dialogue", "dialogue", "unknown", "Gut."), (5, 10, "narration", "narration", "narrator", "сказал Карл фон дер Гольц."), (6, 11, "dialogue", "dialogue", "unknown", "Так."),
    (6, 12, "narration", "narration", "narrator", "сказал хозяин и отвечал молодой человек."), (6, 13, "narration", "narration", "narrator", "добавил хозяин."), (7, 14, "dialogue", "dialogue", "alena", "И."),
    (7, 15, "narration", "narration", "narrator", "чему особенно способствовала Алена Ивановна"),
]


@known(
    "idx:i type:s speaker:s",
    [
        (0, "dialogue", "host"), (1, "narration", "narrator"), (2, "dialogue", "host"), (3, "narration", "narrator"), (4, "dialogue", "alena"), (5, "dialogue", "host"), (6, "narration", "narrator"),
        (7, "dialogue", "unknown"), (8, "narration", "narrator"), (9, "dialogue", "goltz"), (10, "narration", "narrator"), (11, "dialogue", "host"), (12, "narration", "narrator"), (13, "narration", "narrator"),
        (14, "dialogue", "alena"), (15, "narration", "narrator"),
    ],
)
def known_speech_tags(spark: SparkSession) -> DataFrame:
    """Tags override labels where they decide, and only there."""
    x = _case(spark, [("b", 1, *r) for r in _SAID], "book string, chapter int, paragraph int, idx int, hint string, type string, speaker string, text string")
    return attribution.apply_tags(x, attribution.tag_speakers(x, _attribution_cast(spark)))


_SEEN = [
    ("alias", 1, "anna", "Анна", ["Аня"], "female", None, None, ""), ("alias", 2, "anya", "Аня", None, "female", None, None, ""),
    ("same", 1, "anna", "Анна", None, "female", None, None, ""), ("same", 2, "a_s", "Анна Сергеевна", None, "unknown", "anna", None, "учительница"),
    ("unsure", 1, "stranger", "Незнакомец", None, "male", None, None, ""), ("unsure", 2, "old_man", "Старик", None, "male", None, ["stranger", "nobody"], ""),
    ("clash", 1, "sasha", "Саша", None, "female", None, None, ""), ("clash", 2, "sasha", "Саша", None, "male", None, None, ""), ("clash", 3, "sasha", "Саша", None, "male", None, None, ""),
    ("part", 1, "rodion", "Раскольников", ["Родион Романович", "молодой человек"], "male", None, None, ""), ("part", 2, "rodion_raskolnikov", "Родион Романович Раскольников", None, "male", None, None, ""),
    ("foreign", 1, "alena", "Алена Ивановна", None, "female", None, None, ""), ("foreign", 2, "alena", "Пульхерия Александровна", None, "female", None, None, ""),
    ("upgrade", 1, "old_woman", "Старушка", None, "female", None, None, ""), ("upgrade", 2, "old_woman", "Алена Ивановна", ["Алена Иvановна", "процентщица", "Процентщица!"], "female", None, None, ""),
    ("reserved", 1, "narrator", "Рассказчик", None, "unknown", None, None, ""), ("reserved", 2, "", "Пётр", None, "male", None, None, ""),
    ("mixed", 1, "kolya", "Кolya", None, "male", None, None, ""), ("mixed", 2, "kolya", "Коля", None, "male", None, None, ""),
]


def _observed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    x = _case(spark, [(*r[:6], "unknown", *r[6:], 1) for r in _SEEN], "book string, ord int, id string, name string, aliases array<string>, gender string, age string, same_as string, possibly_same_as array<string>, description string, chapter int")
    return registry.observe_all(x)


@known(
    "book:s id:s name:s aliases:s gender:s possibly:s description:s seen:i",
    [
        ("alias", "anna", "Анна", "Аня", "female", "", "", 2), ("same", "anna", "Анна Сергеевна", "Анна", "female", "", "учительница", 2),
        ("unsure", "stranger", "Незнакомец", "", "male", "", "", 1), ("unsure", "old_man", "Старик", "", "male", "stranger", "", 1),
        ("clash", "sasha", "Саша", "", "female", "", "", 1), ("clash", "sasha_2", "Саша", "", "male", "sasha", "", 2),
        ("part", "rodion", "Родион Романович Раскольников", "Родион Романович,молодой человек,Раскольников", "male", "", "", 2),
        ("foreign", "alena", "Алена Ивановна", "", "female", "", "", 1), ("foreign", "alena_2", "Пульхерия Александровна", "", "female", "", "", 1),
        ("upgrade", "old_woman", "Алена Ивановна", "Старушка,процентщица", "female", "", "", 2), ("reserved", "narrator_character", "Рассказчик", "", "unknown", "", "", 1),
        ("reserved", "petr", "Пётр", "", "male", "", "", 1), ("mixed", "kolya", "Коля", "", "male", "", "", 2),
    ],
)
def known_registry(spark: SparkSession) -> DataFrame:
    """Observations to characters."""
    return _observed(spark)[0].select("book", "id", "name", F.array_join("aliases", ",").alias("aliases"), "gender", F.array_join("possibly_same_as", ",").alias("possibly"), "description", "seen")


@known(
    "book:s ord:i character:s",
    [(b, o, c) for b, o, c in zip((r[0] for r in _SEEN), (r[1] for r in _SEEN), "anna anna anna anna stranger old_man sasha sasha_2 sasha_2 rodion rodion alena alena_2 old_woman old_woman narrator_character petr kolya kolya".split(), strict=True)],
)
def known_matches(spark: SparkSession) -> DataFrame:
    """Whom each observation is of."""
    return _observed(spark)[1]


def _duplicates(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [
        ("b", 1, "innkeeper", "Хозяин", "male", "хозяин распивочной, отставной солдат", 1, 2, None, False), ("b", 2, "porter", "Дворник", "male", "дворник дома, отставной солдат", 1, 1, None, False),
        ("b", 3, "official", "Чиновник", "male", "отставной чиновник, пьяный, говорит витиевато", 2, 3, "male_02", True),
        ("b", 4, "marmeladov", "Мармеладов", "male", "отставной титулярный советник, бывший чиновник", 2, 5, "male_01", False),
        ("b", 5, "wife", "Катерина Ивановна", "female", "отставной чиновник её муж", 2, 1, None, False),
    ]
    people = _case(spark, rows, "book string, ord int, id string, name string, gender string, description string, first_chapter int, lines long, voice_id string, locked boolean")
    return people, registry.duplicate_candidates(people.withColumn("is_new", F.col("first_chapter") == 2))


@known("a:s b:s score:i", [("official", "marmeladov", 2)])
def known_duplicates(spark: SparkSession) -> DataFrame:
    """One of each pair is new, genders agree, and two words are shared; settled characters are not asked about."""
    return _duplicates(spark)[1]


@known(
    "kind:s id:s name:s aliases:s lines:i first_chapter:i voice_id:s locked:b",
    [
        ("left", "innkeeper", "Хозяин", "", 2, 1, None, False), ("left", "porter", "Дворник", "", 1, 1, None, False), ("left", "marmeladov", "Мармеладов", "Чиновник", 8, 2, "male_02", True),
        ("left", "wife", "Катерина Ивановна", "", 1, 2, None, False), ("merged", "official", "marmeladov", None, None, None, None, None), ("said", "0", "marmeladov", None, None, None, None, None),
    ],
)
def known_consolidation(spark: SparkSession) -> DataFrame:
    """Accepted pairs are merged, a name outlives a description, a pinned voice stays; refusals change nothing."""
    people, pairs = _duplicates(spark)
    asked = pairs.select("book", F.lit(0).alias("ord"), "a", "b").unionByName(_case(spark, [("b", 1, "wife", "porter"), ("b", 2, "official", "nobody")], "book string, ord int, a string, b string"))
    left, merged = registry.consolidate(people, asked)
    said = registry.rewrite_speakers(_case(spark, [("b", "dialogue", "official", 0)], "book string, type string, speaker string, idx int"), registry.canonical(merged))
    rows = left.select(F.lit("left").alias("kind"), "id", "name", F.array_join("aliases", ",").alias("aliases"), "lines", "first_chapter", "voice_id", "locked")
    rows = rows.unionByName(merged.select(F.lit("merged").alias("kind"), F.col("old").alias("id"), F.col("new").alias("name")), allowMissingColumns=True)
    return rows.unionByName(said.select(F.lit("said").alias("kind"), F.col("idx").cast("string").alias("id"), F.col("speaker").alias("name")), allowMissingColumns=True)


def _voices(spark: SparkSession) -> DataFrame:
    rows = [("narrator_01", "unknown", "adult", ["narrator", "character"], True), *((f"{g}_0{k}", g, "adult", ["character"], True) for g in ("male", "female") for k in (1, 2)), ("reader", "male", "adult", ["narrator"], True), ("gone", "female", "adult", ["character"], False)]
    return _case(spark, rows, "id string, gender string, age_group string, roles array<string>, available boolean")


@known(
    "book:s id:s voice_id:s",
    [
        ("new", "anna", "female_02"), ("new", "ivan", "male_02"), ("new", "olga", "female_01"), ("new", "petr", "male_01"), ("kept", "anna", "female_02"), ("kept", "olga", "female_01"), ("kept", "pinned", "male_02"),
        ("kept", "ivan", "male_01"), ("order", "loud", "male_02"), ("order", "early", "male_01"), ("order", "late", "male_02"),
    ],
)
def known_cast(spark: SparkSession) -> DataFrame:
    """Voices by gender, spread over characters; who has a voice keeps it and is charged for it."""
    u = "unknown"
    rows = [
        *(("new", i, g, u, 0, 1, None) for i, g in (("anna", "female"), ("ivan", "male"), ("olga", "female"), ("petr", "male"))), ("kept", "anna", "female", u, 1, 1, "female_02"), ("kept", "olga", "female", u, 9, 1, None),
        ("kept", "pinned", "female", u, 1, 1, "male_02"), ("kept", "ivan", "male", u, 0, 2, ""), ("order", "late", "male", u, 1, 2, None), ("order", "early", "male", u, 1, 1, None), ("order", "loud", "male", u, 9, 5, None),
    ]
    return casting.cast(_case(spark, rows, "book string, id string, gender string, age string, lines long, first_chapter int, voice_id string"), _voices(spark))


_MODES = [("cast", "", 0, "female_01"), ("cast", "", 1, "narrator_01"), ("cast", "", 2, "narrator_01"), ("cast", "", 3, "female_01"), ("cast", "male_01", 2, "male_01"), ("simple", "", 0, "narrator_01"), ("simple", "", 2, "narrator_01")]


@known("mode:s unknown:s idx:i voice_id:s", _MODES)
def known_voices(spark: SparkSession) -> DataFrame:
    """The voice of each segment, by mode, through merges."""
    said = [("b", 0, "dialogue", "anna"), ("b", 1, "narration", "narrator"), ("b", 2, "dialogue", "unknown"), ("b", 3, "dialogue", "anya")]
    x = _case(spark, said, "book string, idx int, type string, speaker string")
    cast_ = _case(spark, [("b", "anna", "female_01")], "book string, id string, voice_id string")
    merged = _case(spark, [("b", "anya", "anna")], "book string, old string, new string")
    out = None
    for mode, unknown in dict.fromkeys((m, u) for m, u, *_ in _MODES):
        y = casting.resolve_voices(x, cast_, "narrator_01", unknown, merged, mode).withColumn("mode", F.lit(mode)).withColumn("unknown", F.lit(unknown)).select("mode", "unknown", "idx", "voice_id")
        out = y if out is None else out.unionByName(y)
    return out.join(_case(spark, [r[:3] for r in _MODES], "mode string, unknown string, idx int"), ["mode", "unknown", "idx"], "left_semi")


_RAW = [
    ('{"a": 1}', '{"a": 1}'), ('<think>let me see</think>\nHere you go:\n```json\n{"a": [1, 2,],}\n```', '{"a": [1, 2]}'), ('Sure! {"segments": [], "note": "brace } in string"} Hope this helps.', '{"segments": [], "note": "brace } in string"}'),
    ('use {x}: ```json\n{"b": 2}\n```', '{"b": 2}'), ("", None), ("no json here", None), ("[1, 2, 3]", None), ('{"unterminated": ', None), ('<think>{"a": 1}', None), ('{"s": "a\\\\"}', '{"s": "a\\\\"}'),
]


@known("n:i body:s", [(k, body) for k, (_, body) in enumerate(_RAW)])
def known_answers(spark: SparkSession) -> DataFrame:
    """The JSON object in an answer."""
    return labels.parsed(_case(spark, [(k, raw) for k, (raw, _) in enumerate(_RAW)], "n int, raw string"), ["n"])


_GOOD = '{"characters": [{"id": "Anna!", "name": "Анна", "gender": "Female", "age_group": "Young adult", "same_as": "none", "aliases": ["Аня"]}, {"name": " "}], "segments": [{"id": 0, "type": "narration"}, {"id": 1, "type": "Dialog", "speaker": "anna", "emotion": "quiet", "cue": "CUE"}, {"id": 1, "type": "narration"}, {"id": 9, "type": "x"}]}'


def _labelled(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    raw = [("good", _GOOD.replace("CUE", "c" * 300)), ("few", '{"segments": [{"id": 0, "type": "speech", "speaker": " "}]}'), ("none", "no")]
    spans = _case(spark, [(k, i) for k in ("good", "few", "none") for i in (0, 1)], "chunk string, idx int")
    return labels.parsed(_case(spark, raw, "chunk string, raw string"), ["chunk"]), spans


@known(
    "chunk:s id:i type:s cue:s speaker:s emotion:s asked:i labelled:i",
    [
        ("good", 0, "narration", "", "narrator", "neutral", None, None), ("good", 1, "dialogue", "c" * 200, "anna", "whisper", None, None), ("few", 0, "dialogue", "", "unknown", "neutral", None, None),
        ("few", None, "refused", None, None, None, 2, 1), ("none", None, "refused", None, None, None, 2, 0),
    ],
)
def known_labels(spark: SparkSession) -> DataFrame:
    """Labels of the spans that were asked, and answers that leave too many without."""
    answers, spans = _labelled(spark)
    found = labels.labels(answers, ["chunk"], spans)
    bad = labels.refused(found, spans, ["chunk"])
    return found.drop("pos").unionByName(bad.select("chunk", F.lit("refused").alias("type"), "asked", "labelled"), allowMissingColumns=True)


@known("chunk:s id:s name:s aliases:s gender:s age:s same_as:s", [("good", "anna", "Анна", "Аня", "female", "young_adult", None)])
def known_reports(spark: SparkSession) -> DataFrame:
    """The characters that an answer reports."""
    return labels.characters(_labelled(spark)[0], ["chunk"]).withColumn("aliases", F.array_join("aliases", ","))


@known(
    "chunk:i prompt:s",
    [
        (1, "Book: T\nChapter: C\nLanguage: ru\n\nKNOWN CHARACTERS (reuse these ids):\n- anna: Анна (aliases: Аня), female - " + "d" * 160 + "\n- ivan: Иван, male\n\nPASSAGE TO LABEL (one paragraph per line):\n[0:narration] Анна вошла.\n[1:dialogue] Привет! [2:narration] сказала она."),
        (2, "Book: T\nChapter: C\nLanguage: ru\n\nKNOWN CHARACTERS (reuse these ids):\n- anna: Анна (aliases: Аня), female - " + "d" * 160 + "\n- ivan: Иван, male\n\nMost recent speakers before this passage: ivan, anna\n\nPRECEDING CONTEXT (for understanding only, do not label):\nа\nб\n\nPASSAGE TO LABEL (one paragraph per line):\n[3:narration] Всё."),
    ],
)
def known_prompts(spark: SparkSession) -> DataFrame:
    """Whole prompts, with known characters, recent speakers and context."""
    key = "book string, chapter int, chunk int"
    spans = _case(spark, [("b", 1, 1, 0, 0, "narration", "Анна вошла."), ("b", 1, 1, 1, 1, "dialogue", "Привет!"), ("b", 1, 1, 2, 1, "narration", "сказала она."), ("b", 1, 2, 3, 2, "narration", "Всё.")], f"{key}, idx int, paragraph int, hint string, text string")
    people = _case(spark, [("b", "ivan", "Иван", None, "male", None, 2), ("b", "anna", "Анна", ["Аня"], "female", "d" * 300, 5)], "book string, id string, name string, aliases array<string>, gender string, description string, lines long")
    titles = _case(spark, [("b", 1, "T", "C", "ru")], "book string, chapter int, book_title string, chapter_title string, language string")
    recent = _case(spark, [("b", 1, 1, []), ("b", 1, 2, ["ivan", "anna"])], f"{key}, speakers array<string>")
    context = _case(spark, [("b", 1, 2, ["а", "б"])], f"{key}, context array<string>")
    return labels.prompts(labels.requests(spans, ["book", "chapter", "chunk"]), titles, registry.cards(registry.top_characters(people), 5, 160), recent, context)


@known("n:i speaker:s", [(0, "ivan"), (1, "ivan"), (2, "narrator"), (3, "unknown"), (4, "ivan"), (5, "ivan"), (6, "unknown"), (7, "unknown")])
def known_references(spark: SparkSession) -> DataFrame:
    """References of a model to characters, by id, by the chunk's own ids, through merges, by name."""
    said = ["Ваня", "ivan", " Narrator", "Кто-то другой", "vanya_x", "old", "", "Саша"]
    x = _case(spark, [("b", 1, 1, n, s) for n, s in enumerate(said)], "book string, chapter int, chunk int, n int, speaker string")
    people = _case(spark, [("b", "ivan", "Иван", ["Ваня"]), ("b", "s1", "Саша", None), ("b", "s2", "Саша", None)], "book string, id string, name string, aliases array<string>")
    merged = _case(spark, [("b", "old", "ivan")], "book string, old string, new string")
    own = _case(spark, [("b", 1, 1, "vanya_x", "ivan"), ("b", 1, 2, "sasha", "s1")], "book string, chapter int, chunk int, id string, character string")
    return labels.resolve_speakers(x, people, registry.unique_aliases(people), merged, own)


_SCALARS = [
    ("slug", "Анна Сергеевна", "anna_sergeevna"), ("slug", "Война и мир!", "voina_i_mir"), ("slug", "???", "item"), ("slug", "Élan Vital Ǆ ﬁ", "elan_vital_dz_fi"), ("slug", "Щука № ½", "shchuka_no_12"),
    ("file", "../../etc/passwd", "passwd"), ("file", "C:\\Windows\\system32\\evil.txt", "evil.txt"), ("file", 'bad<>:"|?*.epub', "bad_______.epub"), ("file", "CON.txt", "_CON.txt"), ("name", "Ёлка  «Straße»!", "елка strasse"),
    ("language", "ru-RU", "Russian"), ("language", "xx", "Auto"), ("instruction", "whisper", "Speak quietly, almost whispering."), ("instruction", "neutral", ""), ("emotion", " Furious", "angry"), ("emotion", "odd", "neutral"),
    ("within", "sub/../x.wav", "/lib/x.wav"), ("within", "../etc/passwd", None), ("within", "/lib/a.wav", "/lib/a.wav"), ("within", "/library/a.wav", None), ("mixed", "Родион", "false"), ("mixed", "Родion", "true"),
    ("proper", "Мармеладов", "true"), ("proper", "Старуха", "false"), ("seed", "0000000fabc", "15"), ("format", "/a/B.FB2.ZIP", "fb2.zip"), ("format", "x.docx", None), ("detect", "да yes нет", "ru"), ("detect", "123", ""),
]


@known("kind:s value:s result:s", _SCALARS)
def known_scalars(spark: SparkSession) -> DataFrame:
    """Functions of one value."""
    v = F.col("value")
    by = {
        "slug": X.slug(v), "file": N.sanitize_filename(v), "name": X.normalize_name(v), "language": X.language_name(v), "instruction": X.emotion_instruction(v), "emotion": X.normalize_emotion(v), "within": N.within(F.lit("/lib"), v),
        "mixed": X.mixed_script(v).cast("string"), "proper": N.looks_like_name(v).cast("string"), "seed": X.seed_of(v).cast("string"), "format": books.book_format(v), "detect": X.detect_language(v),
    }
    out = None
    for kind, f in by.items():
        y = _case(spark, [(k, x) for k, x, _ in _SCALARS if k == kind], "kind string, value string").withColumn("result", f)
        out = y if out is None else out.unionByName(y)
    return out


@known(
    "n:i name:s aliases:s",
    [(0, "Раскольников", "молодой человек"), (1, "Раскольников", ""), (2, "Родион Раскольников", ""), (3, "Раскольников", ""), (4, "Анна", "")],
)
def known_grounding(spark: SparkSession) -> DataFrame:
    """Names repaired and grounded in the text."""
    rows = [
        (0, "Родьон Ромашов", ["Раскольников", "молодой человек"], "Раскольников, студент, был у вас назад тому месяц, – сказал молодой человек."), (1, "Раскольников", [], "увидели Раскольникова"),
        (2, "Родion Раскольников", ["Roдя"], "Родион Романович Раскольников вышел. Родион шёл быстро."), (3, "Xyzion Раскольников", [], "нет подсказок, Раскольников"), (4, "Анна Ромашова", ["нет такой"], "сказала Анна"),
    ]
    x = _case(spark, rows, "n int, name string, aliases array<string>, text string").withColumn("g", N.ground_name(F.col("name"), F.col("aliases"), F.col("text")))
    return x.select("n", "g.name", F.array_join("g.aliases", ",").alias("aliases"))


@known(
    "kind:s command:s",
    [
        ("m4b", "-f concat -safe 0 -i tmp/book.ffconcat -f ffmetadata -i tmp/book.ffmetadata -map 0:a -map_metadata 1 -map_chapters 1 -c:a copy -movflags +faststart -f mp4 b.m4b"),
        ("mp3", "-f concat -safe 0 -i tmp/book.ffconcat -f ffmetadata -i tmp/book.ffmetadata -map 0:a -map_metadata 1 -map_chapters 1 -c:a aac -b:a 64k -movflags +faststart -f mp4 b.m4b"),
        ("chapter", "-f concat -safe 0 -i tmp/chapter_003.ffconcat -vn -ac 1 -ar 44100 -c:a libmp3lame -b:a 96k -metadata title=T -metadata album=A -metadata track=3 -metadata genre=Audiobook -metadata artist=W audio/chapter_003.mp3"),
        ("silence", "-f lavfi -i anullsrc=r=24000:cl=mono -t 0.350 -c:a pcm_s16le s.wav"), ("resample", "-i a.wav -ac 1 -ar 24000 -c:a pcm_s16le b.wav"),
        ("wav", "5249464628000000574156454666D7420100"), ("metadata", ";FFMETADATA1\ntitle=T\\=1\nalbum=T\\=1\nartist=W\ngenre=Audiobook\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=1500\ntitle=One\\; two\n"),
    ],
)
def known_commands(spark: SparkSession) -> DataFrame:
    """Command lines, a WAV header, chapter metadata."""
    x = _case(spark, [("b", 3)], "book string, chapter int")
    words = lambda kind, c: x.select(F.lit(kind).alias("kind"), F.array_join(c, " ").alias("command"))
    out = words("m4b", assembly.m4b_command(F.col("book"))).unionByName(words("mp3", assembly.m4b_command(F.col("book"), "mp3", "64k")))
    out = out.unionByName(words("chapter", assembly.chapter_command(F.col("chapter"), F.lit("T"), F.lit("A"), F.lit("W"), "mp3", loudnorm=False)))
    out = out.unionByName(words("silence", assembly.silence_command(F.lit(350), F.lit(24000), F.lit("s.wav")))).unionByName(words("resample", assembly.resample_command(F.lit("a.wav"), F.lit("b.wav"), F.lit(24000))))
    wav = assembly.wav_files(_case(spark, [("x.wav", [1, -1], 24000)], "path string, samples array<short>, rate int"))
    head = F.hex("content")
    out = out.unionByName(wav.select(F.lit("wav").alias("kind"), F.concat(F.substring(head, 1, 8), F.substring(head, 9, 8), F.substring(head, 17, 8), F.lit("4666D742"), F.substring(head, 41, 4)).alias("command")))
    marks = _case(spark, [("b", 1, "One; two", 0, 1500, "T=1", "W")], "book string, chapter int, title string, start_ms long, end_ms long, book_title string, author string")
    return out.unionByName(assembly.metadata_file(marks).select(F.lit("metadata").alias("kind"), F.col("metadata").alias("command")))


@known(
    "id:s status:s error:s mode:s force_llm:b chapters:s year:i",
    [("a", "failed", "interrupted", "simple", False, "1,2", 2024), ("b", "done", "", "cast", True, None, None), ("c", "failed", "interrupted", "cast", False, None, 2025)],
)
def known_jobs(spark: SparkSession) -> DataFrame:
    """Stored jobs decoded, changed and recovered."""
    rows = [("a", "running", "", '{"mode": "simple", "chapters": [1, 2]}', "2024-03-01T10:00:00"), ("b", "pending", "", '{"force_llm": true}', "soon"), ("c", "pending", "", "broken", "2025-01-01T00:00:00")]
    jobs = _case(spark, rows, "id string, status string, error string, options string, created_at string")
    changed = plan.upsert(jobs, _case(spark, [("b", "done")], "id string, status string"), ["id"], ["status", "error"])
    x = plan.recover(plan.decoded_jobs(changed))
    return x.select("id", "status", "error", "options.mode", "options.force_llm", F.array_join("options.chapters", ",").alias("chapters"), F.year("created_at").alias("year"))


@known(
    "kind:s book:s idx:i title:s state:s",
    [
        ("chapter", "a", 1, "One, new", "done"), ("chapter", "a", 2, "Two", "pending"), ("chapter", "b", 1, "Other", "done"), ("import", "new.txt", None, None, "3"), ("import", "old.txt", None, "book-1", "2"),
        ("book", "book-1", None, "Old", "2"), ("book", "voina_i_mir-3ccc", None, "Война и мир", "3"),
    ],
)
def known_imports(spark: SparkSession) -> DataFrame:
    """What is read again, ids of new and known contents, chapters after a book was read again."""
    old = _case(spark, [("a", 1, "One", "done"), ("a", 2, "Second", "pending"), ("a", 3, "Gone", "done"), ("b", 1, "Other", "done")], "book string, idx int, title string, state string")
    new = _case(spark, [("a", 1, "One, new", "pending"), ("a", 2, "Two", "pending")], "book string, idx int, title string, state string")
    files = _case(spark, [("same.txt", "1"), ("old.txt", "2"), ("new.txt", "3ccc"), ("twin.txt", "3ccc")], "path string, sha256 string")
    stored_books = _case(spark, [("book-0", "1", 2), ("book-1", "2", 1)], "id string, source_sha256 string, parser_version int")
    ready = plan.to_import(files, stored_books, 2)
    parsed = _case(spark, [("old.txt", "Old"), ("new.txt", "Война и мир")], "book string, title string")
    done = plan.imported(ready.withColumn("book", F.col("path")), parsed)
    rows = plan.upsert_chapters(old, new, ["state"]).select(F.lit("chapter").alias("kind"), "book", "idx", "title", "state")
    digest = F.substring("sha256", 1, 1)
    rows = rows.unionByName(ready.select(F.lit("import").alias("kind"), F.col("path").alias("book"), F.col("known").alias("title"), digest.alias("state")), allowMissingColumns=True)
    return rows.unionByName(done.select(F.lit("book").alias("kind"), F.col("id").alias("book"), "title", F.substring("source_sha256", 1, 1).alias("state")), allowMissingColumns=True)


@known(
    "place:i idx:i reuse_from:i model:s",
    [(0, 4, 1, "b"), (1, 0, None, "a"), (2, 3, None, "a"), (3, 2, None, "b")],
)
def known_plan_order(spark: SparkSession) -> DataFrame:
    """A plan in order, copies first, then by model, chapter and index."""
    new = _case(spark, [("k", 1, 0, "n0", "a"), ("k", 1, 1, "old", "b"), ("k", 1, 2, "n2", "b"), ("k", 1, 3, "n3", "a"), ("k", 1, 4, "old", "b")], "book string, chapter int, idx int, key string, model string")
    have = _case(spark, [("k", 1, 1, "old"), ("other", 1, 0, "n0")], "book string, chapter int, idx int, key string")
    return plan.in_order(plan.synthesis_plan(new, have))


@known("name:s value:s", [("audio_loudnorm", "False"), ("chunk_max_chars", "123"), ("narrator_voice", "v9"), ("segment_max_chars", "400"), ("method cast", "llm"), ("method simple", "heuristic"), ("method simple, forced", "llm"), ("backend fake", "fake-tone")])
def known_settings(spark: SparkSession) -> DataFrame:
    """Settings from an environment, the method that options ask for, the backend that they name."""
    c = configured(None, {"CHUNK_MAX_CHARS": "123", "Audio_Loudnorm": "no", "narrator_voice": "v9", "OTHER": "1"})
    rows = [(n, str(getattr(c, n))) for n in ("audio_loudnorm", "chunk_max_chars", "narrator_voice", "segment_max_chars")]
    rows += [("method cast", plan.analysis_method("cast")), ("method simple", plan.analysis_method("simple")), ("method simple, forced", plan.analysis_method("simple", True)), ("backend fake", engine.backend("fake")().model_tag("v"))]
    return _case(spark, rows, "name string, value string")


@known("step:s id:s value:s", [("json", "a.json", "1"), ("json", "broken.json", None), ("table", "x", "new"), ("table", "y", "old"), ("voice", "v1", "true"), ("voice", "v2", "false"), ("pinned", "anna", "v1,true"), ("pinned", "ivan", ",false")])
def known_state(spark: SparkSession) -> DataFrame:
    """State in JSON files and in tables that are replaced whole; a voice added, a voice pinned."""
    at = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    for name, text in (("a", '{"n": 1}'), ("broken", '{"n": ')):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/json/{name}.json")
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
        out.write(bytearray(text.encode()))
        out.close()
    rows = scan_json(spark, f"{at}/json/*.json", "n int").select(F.lit("json").alias("step"), F.element_at(F.split("file", "/"), -1).alias("id"), F.col("state.n").cast("string").alias("value"))
    tables = Workspace(spark, f"{at}/tables")
    tables.put("t", _case(spark, [("x", "old"), ("y", "old")], "id string, value string"), ["id"])
    tables.put("t", _case(spark, [("x", "new")], "id string, value string"), ["id"])
    rows = rows.unionByName(tables.read("t").select(F.lit("table").alias("step"), "id", "value"))
    voice = "id string, available boolean"
    more = library.add_voice(_case(spark, [("v1", False), ("v2", False)], voice), _case(spark, [("v1", True)], voice), overwrite=True)
    rows = rows.unionByName(more.select(F.lit("voice").alias("step"), "id", F.col("available").cast("string").alias("value")))
    people = _case(spark, [("b", "anna", None, False), ("b", "ivan", None, False)], "book string, id string, voice_id string, locked boolean")
    pinned = registry.pin_voice(people, _case(spark, [("b", "anna", "v1")], "book string, id string, voice_id string"))
    return rows.unionByName(pinned.select(F.lit("pinned").alias("step"), "id", F.concat(F.coalesce("voice_id", F.lit("")), F.lit(","), F.col("locked").cast("string")).alias("value")))


@known("kind:s a:s b:s", [("chain", "a", "d"), ("chain", "b", "d"), ("chain", "c", "d"), ("chain", "x", "y"), ("cycle", "refused", None), ("title", "0", "Глава 1"), ("title", "1", "текст"), ("title", "2", "дальше"), ("untitled", "0", "сам"), ("chosen", "1", None), ("chosen", "3", None), ("chosen", "4", None), ("unknown", "no such chapters: [9]", None)])
def known_chains(spark: SparkSession) -> DataFrame:
    """Chains of merges, a cycle, titles that are read first, chapters that are chosen."""
    rows = registry.canonical(_case(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "old string, new string")).select(F.lit("chain").alias("kind"), F.col("old").alias("a"), F.col("new").alias("b"))
    said = []
    for kind, f in (("cycle", lambda: registry.canonical(_case(spark, [("a", "b"), ("b", "c"), ("c", "a")], "old string, new string"))), ("unknown", lambda: chapters.selected(spark.range(1, 6).withColumnRenamed("id", "chapter"), "1,9"))):
        try:
            f()
            said.append((kind, "accepted", None))
        except ValueError as e:
            said.append((kind, "refused" if kind == "cycle" else str(e), None))
    parts = _case(spark, [("b", 1, "Глава 1", True), ("b", 2, "Chapter 2", False)], "book string, chapter int, title string, has_title boolean")
    text = _case(spark, [("b", 1, 0, "текст"), ("b", 1, 1, "дальше"), ("b", 2, 0, "сам")], "book string, chapter int, paragraph long, text string")
    read = chapters.with_titles(parts, text).select(F.when(F.col("chapter") == 1, "title").otherwise("untitled").alias("kind"), F.col("paragraph").cast("string").alias("a"), F.col("text").alias("b"))
    chosen = chapters.selected(spark.range(1, 6).withColumnRenamed("id", "chapter"), "1,3-4").select(F.lit("chosen").alias("kind"), F.col("chapter").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    return rows.unionByName(_case(spark, said, "kind string, a string, b string")).unionByName(read).unionByName(chosen)


@known(
    "step:s analyzed:i voices:i rendered:i copied:i assembled:i",
    [("first", 2, 2, 13, 0, 2), ("again", 0, 0, 0, 0, 0), ("bit rate", None, None, None, None, 2), ("read again", 0, None, None, None, None)],
)
def known_runs(spark: SparkSession) -> DataFrame:
    """A book from its file to a plan of audio;
    run again there is nothing to do, and a new setting makes chapter files anew only."""
    at = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/book.txt")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(SAMPLE.encode()))
    out.close()
    people = [{"id": "anna", "name": "Анна", "gender": "female", "age_group": "adult"}, {"id": "ivan", "name": "Иван", "gender": "male", "age_group": "adult"}]
    work = engine.Engine(spark, f"{at}/tables", _voices(spark), labeler=lambda: engine.RuleLabeler(people))
    book = work.import_files([f"{at}/book.txt"]).first()["id"]
    rows = []
    for step in ("first", "again"):
        did = work.generate(book)
        rows.append((step, did["analyzed"], did["cast"], did["rendered"], did["copied"], did["assembled"]))
    louder = engine.Engine(spark, f"{at}/tables", _voices(spark), replace(CONFIG, audio_bitrate="128k"))
    rows += [("bit rate", None, None, None, None, louder.assemble(book)[0]), ("read again", work.import_files([f"{at}/book.txt"]).count(), None, None, None, None)]
    return _case(spark, rows, "step string, analyzed int, voices int, rendered int, copied int, assembled int")
