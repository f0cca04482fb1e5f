"""The script engine against literal rows and against SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators import casting, chapters, plan, registry, segment
from storyloom.plans import fixtures, production  # noqa: F401  (register their queries)
from storyloom.plans.queries import ORACLES, QUERIES
from storyloom.sources import books
from storyloom.tables import Workspace, running

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted("|".join(norm(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cur.fetchall())
    assert sorted("|".join(norm(v) for _, v in sorted(r.asDict().items())) for r in got.collect()) == want


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_spans(spark):
    got = one(spark, segment.paragraph_spans, "— Привет, — сказала Анна. — Как дела?")
    assert [tuple(s) for s in got] == [("dialogue", "Привет,"), ("narration", "сказала Анна."), ("dialogue", "Как дела?")]
    got = one(spark, segment.paragraph_spans, "Он сказал: «Я приду к вам завтра», и ушёл.")
    assert [s["hint"] for s in got] == ["narration", "dialogue", "narration"] and got[1]["text"] == "Я приду к вам завтра"
    assert [tuple(s) for s in one(spark, segment.paragraph_spans, "Корабль «Надежда» ушёл.")] == [("narration", "Корабль «Надежда» ушёл.")]


def test_split_long(spark):
    text = "One two three. " * 40
    parts = one(spark, lambda c: segment.split_long(F.btrim(c), 100), text)
    assert all(len(p) <= 100 for p in parts) and " ".join(parts) == text.strip()
    assert one(spark, lambda c: segment.split_long(c, 10), "abcdefghijklmnop qrs") == ["abcdefghijklmnop", "qrs"]


@pytest.mark.parametrize(("name", "want"), [("Анна Каренина", "anna_karenina"), ("Щука!", "shchuka"), ("Élan vital", "elan_vital"), ("---", "item")])
def test_slug(spark, name, want):
    assert one(spark, X.slug, name) == want


def test_emotions(spark):
    assert [one(spark, X.normalize_emotion, v) for v in ("Furious", " calm ", "", None, "odd")] == ["angry", "calm", "neutral", "neutral", "neutral"]


@pytest.mark.parametrize(("line", "want"), [("Глава 1", True), ("Chapter IV. The Storm", True), ("Пролог", True), ("XII", True), ("Он вошёл.", False), ("chapter " + "x" * 100, False)])
def test_headings(spark, line, want):
    assert one(spark, X.is_heading, line) is want


def test_chapters(spark):
    lines = ["x" * 250, "Part One", "Chapter 1", "first", "2", "second", "Chapter 3"]
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(lines)], "book string, paragraph int, text string")
    got = [(r["chapter"], r["title"], r["text"][:6]) for r in chapters.heading_chapters(df).orderBy("paragraph").collect()]
    assert got == [(1, "Chapter 1", "xxxxxx"), (2, "Part One. Chapter 1", "first"), (3, "Part One. Chapter 2", "second")]


def test_fold(spark):
    rows = [("b", 1, "anna", "Anna", "female"), ("b", 2, "anna", "Anna Karenina", "unknown"), ("b", 3, "x", "anna karenina", "female"), ("b", 4, "anna", "Anna", "male"), ("c", 1, "anna", "Anna", "male")]
    got = registry.observe(spark.createDataFrame(rows, "book string, ord long, id string, name string, gender string")).orderBy("book", "id").collect()
    assert [(r["book"], r["id"], r["name"], r["seen"], r["aliases"]) for r in got] == [("b", "anna", "Anna Karenina", 3, ["Anna"]), ("b", "anna_2", "Anna", 1, []), ("c", "anna", "Anna", 1, [])]


def test_cast_spreads_voices(spark):
    people = spark.createDataFrame([("b", str(i), "male", "adult", 10 - i, 1) for i in range(3)], "book string, id string, gender string, age string, lines long, first_chapter int")
    voices = spark.createDataFrame([("m1", "male", "adult", ["character"], True), ("m2", "male", "adult", ["character"], True), ("narrator_01", "unknown", "adult", ["character"], True)], "id string, gender string, age_group string, roles array<string>, available boolean")
    assert {r["id"]: r["voice_id"] for r in casting.cast(people, voices).collect()} == {"0": "m2", "1": "m1", "2": "m2"}


def test_reuse_after_shift(spark):
    new = spark.createDataFrame([(1, 0, "n"), (1, 1, "a"), (1, 2, "b")], "chapter int, idx int, key string")
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "chapter int, idx int, key string")
    assert {r["idx"]: r["reuse_from"] for r in plan.synthesis_plan(new, old).collect()} == {0: None, 1: 0, 2: 1}


def test_text_source(spark):
    raw = "Глава 1\r\n\r\nпервая\r\nстрока\r\n— Да.\r\n\r\nвторая".encode("cp1251")
    texts = books.decoded(spark.createDataFrame([("b", bytearray(raw))], "book string, content binary"))
    assert [r["text"] for r in books.text_paragraphs(texts).orderBy("paragraph").collect()] == ["Глава 1", "первая строка", "— Да.", "вторая"]


def test_fb2(spark):
    xml = b"<?xml version='1.0'?><FictionBook><body><section><title><p>Part.</p></title><section><title><p>One</p></title><p>text</p></section></section></body><body name='notes'><section><p>no</p></section></body></FictionBook>"
    rows = [("a.fb2", bytearray(xml)), ("b.fb2", bytearray(b"broken"))]
    got = books.parse_books(spark.createDataFrame(rows, "path string, content binary")).orderBy("path").collect()
    assert [(r["chapter"], r["title"], r["text"]) for r in got] == [(1, "Part. One", "text"), (0, "unreadable: ValueError", None)]


def test_html():
    assert books.html_sections("<h1>A</h1><h2>B</h2><script>x</script><p>one <b>two</b></p><h1>C</h1>") == [("A. B", ["one two"])]
    assert books.html_sections("<h1>A</h1><div>hello</div><p>x</p>") == [("A", ["hello", "x"])]
    assert books.html_sections("<div><p>in</p>lost</div><ul><li>1<li>2</ul><p>a<p>b") == [("", ["in", "1", "2", "a", "b"])]


def test_cut_references(spark, tmp_path):
    """References are read when they are whole; what is cut stays as it is, as in the SQL."""
    cut = ["and&amp;&amp;&amp", "say &quot;so&quot", "&am", "a &amp;amp; &amp;lt;", "&&amp;", "&#39;s &#39", "&copyright; &copy;", "AT&ampT", "?a=1&lt=2", "&;", "&#;", "&", f"&#{'1' * 5000};"]
    pages = [(i, f"<html><body><h1>{t}</h1><p>{t}</p><p>x {t} y</p><p>{t}") for i, t in enumerate(cut)] + [(99, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = [tuple(r) for r in QUERIES["page_sections"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(ORACLES["page_sections"]).fetchall())
    assert (0, 0, "and&&&amp", 0, "and&&&amp") in got and len(got) == 3 * len(cut)
    named = spark.createDataFrame([(1, "<p>&eacute;&nbsp;&#233;&#xE9;&nope;</p>")], "page_id long, html string")
    assert [r["text"] for r in books.page_sections(named).collect()] == ["é éé&nope;"]


def test_parts_across_blocks(spark):
    """Parts do not depend on how rows are dealt to blocks."""
    rng = random.Random(3)
    rows = [(b, i, "x" * rng.choice([0, 1, 5, 30, 120])) for b in ("p", "q", "r") for i in range(400 if b != "r" else 1)]
    want = {}
    for book in ("p", "q", "r"):
        part, held = 1, None
        for b, i, t in rows:
            if b == book:
                if held is not None and held + len(t) > 100:
                    part, held = part + 1, 0
                want[b, i] = part
                held = (held or 0) + len(t)
    df = spark.createDataFrame(rows, "book string, paragraph long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["book"], r["paragraph"]): r["part"] for r in segment.pack_chapters(df, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_running_values_across_blocks(spark):
    rows = [("a" if i % 3 else "b", i, i % 5 if i % 7 == 0 else None) for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], {"n": F.lit(1)}, {"last": F.col("v")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n, last, want = {}, {}, {}
    for g, i, v in rows:
        n[g] = n.get(g, 0) + 1
        last[g] = v if v is not None else last.get(g)
        want[g, i] = (n[g], last[g])
    assert {(r["g"], r["i"]): (r["n"], r["last"]) for r in got} == want


def test_tables_are_replaced_whole(spark, tmp_path):
    t = Workspace(spark, str(tmp_path))
    assert t.read("x", "id int").count() == 0 and not t.exists("x")
    with pytest.raises(LookupError):
        t.read("x")
    t.write("x", spark.range(3))
    before = t.read("x")
    t.write("x", t.read("x").filter("id > 0"))
    assert before.count() == 3 and t.read("x").count() == 2


def test_paths(spark, tmp_path):
    (tmp_path / "a.docx").write_text("x")
    (tmp_path / "b.txt").write_text("x")
    assert books.validate_paths(spark, [str(tmp_path / "b.txt")])
    with pytest.raises(ValueError, match="unsupported type"):
        books.validate_paths(spark, [str(tmp_path / "a.docx")])
    with pytest.raises(FileNotFoundError):
        books.validate_paths(spark, [str(tmp_path / "c.txt")])
