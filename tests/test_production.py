"""Names, labels, page lines, consolidation, voices and streams against literal rows."""

import pytest
from pyspark.sql import functions as F

from storyloom.functions import names as N
from storyloom.operators import assembly, attribution, chapters, labels, plan, registry
from storyloom.sources import voices as library
from storyloom.streaming import counts


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(c) for c in df.columns)).alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "want"), [("a/b\\c.txt", "c.txt"), ("con.txt", "_con.txt"), ('x:"y"?.fb2', "x__y__.fb2"), (" . ", "file"), ("", "file")])
def test_sanitize(spark, raw, want):
    assert one(spark, N.sanitize_filename, raw) == want


def test_repair(spark):
    assert one(spark, N.repair_name, "Родion Ivanov", "Родион и Родион, Родина") == "Родион"
    assert one(spark, N.repair_name, "Анна", "нет") == "Анна"
    assert one(spark, N.repair_name, "Жzz", "нет") == "Жzz"


def test_ground(spark):
    ground = lambda n, t: N.ground_name(n, F.array(F.lit("старуха"), F.lit("Алена")), t)
    assert one(spark, ground, "Анна Петрова", "Анна, о Петровой")["name"] == "Анна Петрова"
    assert one(spark, ground, "Анна Ромашова", "сказала Анна")["name"] == "Анна"
    got = one(spark, ground, "Ромашов", "старуха Алена")
    assert (got["name"], got["aliases"]) == ("Алена", ["старуха"])


def test_names(spark):
    assert [one(spark, N.looks_like_name, x) for x in ("Мармеладов", "Алена Ивановна", "Старуха")] == [True, True, False]
    assert one(spark, N.contains_name, "Раскольников", "Родион Романович Раскольников") is True
    assert one(spark, N.contains_name, "Ивановна", "Алена Ивановна") is False
    assert one(spark, N.escape_metadata, "a=b;c#d\\e") == r"a\=b\;c\#d\\e"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'), ('<think>{"b": 2}</think> {"a": [1,],}', '{"a": [1]}'), ('x {"a": "}{"} y', '{"a": "}{"}'),
        ("<think>{", None), ("[1]", None), ("", None), (None, None), ('{"a": ', None),
    ],
)
def test_json(raw, want):
    assert labels.json_object(raw) == want


def test_labeler_retries(spark):
    class Slow:
        def __init__(self):
            self.asked = 0

        def analyze_chunk(self, prompt):
            self.asked += 1
            return '{"segments": [{"id": 0, "type": "speech", "speaker": ""}]}' if self.asked % 3 == 0 else "no"

    x = labels.run_labeler(spark.createDataFrame([("c", "p")], "chapter string, prompt string"), ["chapter"], Slow)
    got = labels.labels(labels.parsed(x, ["chapter"]), ["chapter"]).collect()
    assert [(r["id"], r["type"], r["speaker"], r["emotion"]) for r in got] == [(0, "dialogue", "unknown", "neutral")]


def test_page_lines(spark):
    rows = [
        ("b", 0, 0, "Глава 1", 12.0, 10.0, 60.0), ("b", 0, 1, "Он сказал что-", 12.0, 10.0, 500.0), ("b", 0, 2, "то и про-", 12.0, 10.0, 500.0),
        ("b", 0, 3, "должил.", 12.0, 10.0, 100.0), ("b", 1, 4, "Дальше", 12.0, 10.0, 500.0), ("b", 1, 5, "— Да.", 12.0, 10.0, 500.0),
        ("b", 1, 6, "отступ", 12.0, 30.0, 500.0), ("b", 1, 7, "крупно", 18.0, 10.0, 500.0), ("b", 1, 8, "мелко", 12.0, 10.0, 500.0),
    ]
    df = spark.createDataFrame(rows, "book string, page int, pos int, text string, size double, x0 double, x1 double")
    got = [(r["page"], r["text"]) for r in chapters.line_paragraphs(df).orderBy("paragraph").collect()]
    assert got == [(0, "Глава 1"), (0, "Он сказал что-то и продолжил."), (1, "Дальше"), (1, "— Да."), (1, "отступ"), (1, "крупно"), (1, "мелко")]


def test_running_headers_go(spark):
    rows = []
    for page in range(10):
        title = "Straße 1" if page % 2 else "STRASSE 22"
        texts = [(title, page < 3), (f"Rare {'abcdefghij'[page]}", True), (f"p{page} of", False), ("Straße 3", page == 9), ("12345" if page < 2 else f"— {page} —" if page == 5 else "x", page in (0, 1, 5))]
        rows += [("b", page, page * 5 + i, t, m if page != 4 else None, 12.0, 10.0, 500.0) for i, (t, m) in enumerate(texts)]
    df = spark.createDataFrame(rows, "book string, page int, pos int, text string, in_margin boolean, size double, x0 double, x1 double")
    gone = {("b", p, t) for p, t in [(0, "STRASSE 22"), (1, "Straße 1"), (2, "STRASSE 22"), (9, "Straße 3"), (5, "— 5 —")]}
    want = sorted(r[2] for r in rows if not (r[4] and (r[:2] + (r[3],)) in gone))
    assert sorted(r["pos"] for r in chapters.drop_margins(df).collect()) == want
    text = " ".join(r["text"] for r in chapters.line_paragraphs(df).collect())
    assert "— 5 —" not in text and "12345" in text and text.count("22") == 3 and "Rare a" in text
    many = spark.createDataFrame([("b", 20)], "book string, pages int")
    assert chapters.drop_margins(df, many).count() == len(rows) - 1


@pytest.mark.parametrize(
    ("remarks", "want"),
    [
        (["said Klara Maria von Stein."], "stein"), (["said old Klara Maria von Stein then."], "stein"), (["said Anna Maria von Ufer."], "unknown"), (["said Anna quietly."], "anna"),
        (["said Boris Petrov to Anna.", "added Anna."], "anna"), (["said Boris Petrov to Anna."], "unknown"), (["said Boris Petrov.", "added Anna."], "unknown"),
        (["said the very last of all kings."], "king"), (["it was then and there that Anna said."], "unknown"), (["Anna smiled."], "unknown"),
    ],
)
def test_speech_tags(spark, remarks, want):
    people = spark.createDataFrame(
        [("stein", "Baroness", ["Klara Maria von Stein"]), ("ufer", "Anna Maria von Ufer", []), ("anna", "Anna", None), ("boris", "Boris Petrov", []), ("king", "The very last of all", [])], "id string, name string, aliases array<string>",
    )
    rows = [(1, 1, 0, "dialogue", "Yes,")] + [(1, 1, k + 1, "narration", t) for k, t in enumerate(remarks)] + [(1, 1, 9, "dialogue", "No.")]
    x = spark.createDataFrame(rows, "chapter int, paragraph int, idx int, hint string, text string")
    got = attribution.apply_tags(x, attribution.tag_speakers(x, people))
    assert {r["speaker"] for r in got.collect() if r["hint"] == "dialogue"} == {want}


def test_reserved_ids(spark):
    rows = [("b", 0, "narrator", "Narrator", "unknown"), ("b", 1, "unknown", "Unknown", "male"), ("b", 2, "anna", "Anna", "female")]
    got = registry.observe(spark.createDataFrame(rows, "book string, ord int, id string, name string, gender string"))
    assert sorted(r["id"] for r in got.collect()) == ["anna", "narrator_character", "unknown_character"]


def test_selection(spark):
    df = spark.range(1, 8).withColumnRenamed("id", "chapter")
    assert sorted(r["chapter"] for r in chapters.selected(df, "1,3,5-6").collect()) == [1, 3, 5, 6]
    assert chapters.selected(df, "").count() == 7
    with pytest.raises(ValueError, match="9"):
        chapters.selected(df, "1,9")


def test_consolidate(spark):
    rows = [
        ("b", "old", "Старуха", "female", 9, 1, None, False), ("b", "alena", "Алена Ивановна", "unknown", 2, 2, "v1", True), ("b", "x", "Чиновник", "male", 1, 1, None, False),
        ("b", "y", "Лиза", "female", 3, 3, "v2", True),
    ]
    people = spark.createDataFrame(rows, "book string, id string, name string, gender string, lines long, first_chapter long, voice_id string, locked boolean")
    pairs = spark.createDataFrame([("b", 0, "old", "alena"), ("b", 1, "x", "old"), ("b", 2, "old", "y"), ("b", 3, "gone", "x"), ("c", 0, "p", "q")], "book string, ord int, a string, b string")
    left, merged = registry.consolidate(people, pairs)
    got = {r["id"]: r for r in left.collect()}
    assert set(got) == {"alena", "x", "y"} and [tuple(r) for r in merged.collect()] == [("b", "old", "alena")]
    assert (got["alena"]["gender"], got["alena"]["lines"], got["alena"]["first_chapter"], got["alena"]["aliases"]) == ("female", 11, 1, ["Старуха"])
    said = spark.createDataFrame([("b", "dialogue", "old"), ("b", "narration", "old")], "book string, type string, speaker string")
    assert {(r["type"], r["speaker"]) for r in registry.rewrite_speakers(said, merged).collect()} == {("dialogue", "alena"), ("narration", "old")}


def test_library(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    (tmp_path / "metadata" / "a.json").write_text('[{"id": "n", "source": "builtin", "builtin_speaker": "S"}, {"id": "r", "source": "reference", "reference_audio": "../x.wav", "gender": "Odd"}]')
    (tmp_path / "metadata" / "b.json").write_text('{"id": "n", "source": "builtin", "builtin_speaker": "T"}')
    (tmp_path / "metadata" / "c.json").write_text("{broken")
    digests = spark.createDataFrame([("../x.wav", "00")], "path string, sha256 string")
    x = library.with_availability(library.parse_library(library.read_library(spark, str(tmp_path))), digests)
    got = {(r["file"], r["id"]): (r["error"], r["available"]) for r in x.collect()}
    assert got[("a.json", "n")] == (None, True) and got[("a.json", "r")] == (None, False) and got[("b.json", "n")] == ("duplicate id", True)
    assert got[("c.json", None)][0] == "unreadable"
    with pytest.raises(LookupError, match="zz"):
        library.require(x, spark.createDataFrame([("zz",)], "voice_id string"))


def test_rates(spark):
    segments = spark.createDataFrame([(1, i, 100) for i in range(4)], "chapter int, idx int, pause_ms int")
    manifest = spark.createDataFrame([(1, i, "k", 24, r) for i, r in enumerate([2000, 1000, 1000, 2000])], "chapter int, idx int, key string, samples long, rate long")
    got = assembly.assemble(segments, manifest).first()
    assert (got["rate"], got["resampled"], got["duration_ms"]) == (2000, 2, 400 + 12 + 24 + 24 + 12 + 600)


def test_scripts(spark):
    hashes = spark.createDataFrame([(1, "a"), (2, "b")], "chapter int, source_hash string")
    scripts = spark.createDataFrame([(1, "a", "heuristic", "x"), (2, "b", "llm", "v1")], "chapter int, source_hash string, method string, prompt_version string")
    todo = lambda m: [r["chapter"] for r in plan.to_analyze(hashes, scripts, m, "v2").orderBy("chapter").collect()]
    assert todo("heuristic") == [2] and todo("llm") == [1, 2]


def test_stream_counts_once(spark, tmp_path):
    def put(n, k):
        spark.createDataFrame([(k,)] * n, "k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    schema = spark.createDataFrame([], "k string").schema
    put(3, "a")
    counts.follow(spark, str(tmp_path / "in"), schema, ["k"], str(tmp_path / "out"))
    put(2, "a")
    for _ in range(2):
        counts.follow(spark, str(tmp_path / "in"), schema, ["k"], str(tmp_path / "out"))
    assert [tuple(r) for r in counts.totals(spark, ["k"], str(tmp_path / "out")).collect()] == [("a", 5)]


def test_bookmarks(spark):
    rows = [("b", p, i, t) for i, (p, t) in enumerate([(1, "x" * 201), (3, " ONE "), (3, "one text"), (4, "two"), (4, "more")])]
    pages = spark.createDataFrame(rows, "book string, page int, pos int, text string")
    marks = spark.createDataFrame([("b", 0, 1, 3, "One"), ("b", 1, 2, 3, "deep"), ("b", 2, 1, 3, "Also"), ("b", 3, 1, 4, "Two"), ("b", 4, 1, 9, "Empty")], "book string, ord int, level int, page int, title string")
    got = [(r["chapter"], r["title"], r["text"][:8]) for r in chapters.bookmarked_paragraphs(pages, marks).orderBy("chapter", "pos").collect()]
    assert got == [(1, "Front matter", "xxxxxxxx"), (2, "One", "one text"), (3, "Also", " ONE "), (3, "Also", "one text"), (4, "Two", "more")]
