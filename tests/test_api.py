"""The client's view of stored tables."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from storyloom import cli
from storyloom.api import NotFound, Service, Store, error_code
from storyloom.config import Config
from storyloom.engine import Engine, RuleLabeler
from storyloom.operators.labels import ChatLabeler, LabelError


@pytest.fixture(scope="module")
def store(spark):
    make = spark.createDataFrame
    return Store(
        make([("a", "A", 1), ("b", "B", 2)], "id string, title string, created_at long"),
        make([("a", 2), ("a", 1)], "book string, idx int"),
        make([("a", 1, 1, "y"), ("a", 1, 0, "x")], "book string, chapter int, idx int, text string"),
        make([("a", "p", 1, None, False), ("a", "q", 5, None, False)], "book string, id string, lines int, voice_id string, locked boolean"),
        make([(f"j{i:02d}", "a", i, "done") for i in range(12)], "id string, book string, created_at long, status string"),
        make([("v", True), ("w", False)], "id string, available boolean"),
    )


def test_reads(store):
    assert store.health() == 1
    assert [r["id"] for r in store.list_books().collect()] == ["b", "a"]
    row, parts, jobs = store.book("a")
    assert row.count() == 1 and [r["idx"] for r in parts.collect()] == [1, 2]
    assert sorted(r["id"] for r in jobs.collect()) == [f"j{i:02d}" for i in range(2, 12)]
    assert [r["text"] for r in store.script("a", 1).collect()] == ["x", "y"]
    assert [r["id"] for r in store.list_characters("a").collect()] == ["q", "p"]
    for ask in (lambda: store.book("z"), lambda: store.script("a", 9), lambda: store.job("j99")):
        with pytest.raises(NotFound):
            ask()


def test_pin_follows_merges(spark, store):
    merged = spark.createDataFrame([("a", "old", "p")], "book string, old string, new string")
    got = {r["id"]: (r["voice_id"], r["locked"]) for r in store.pin_voice("a", "old", "v", merged).collect()}
    assert got == {"p": ("v", True), "q": (None, False)}
    with pytest.raises(NotFound):
        store.pin_voice("a", "p", "none", merged)


SAMPLE = "Глава 1\n\nАнна подошла к окну.\n\n— Ты пришёл? — спросила Анна.\n\nГлава 2\n\n— Пойдём, — сказал Иван.\n"
PEOPLE = [{"id": "anna", "name": "Анна", "gender": "female", "age_group": "adult"}, {"id": "ivan", "name": "Иван", "gender": "male", "age_group": "adult"}]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    voices = spark.createDataFrame([("narrator_01", "unknown", "adult", ["character"], True), ("m", "male", "adult", ["character"], True), ("f", "female", "adult", ["character"], True)], "id string, gender string, age_group string, roles array<string>, available boolean")
    return Engine(spark, str(tmp_path_factory.mktemp("tables")), voices, labeler=lambda: RuleLabeler(PEOPLE))


def test_a_book_from_upload_to_plan(spark, engine, capsys):
    service = Service(engine)
    with pytest.raises(ValueError, match="larger"):
        Service(Engine(spark, engine.tables.root, engine.voices, Config(max_upload_mb=0))).upload("a.txt", b"x")
    row = service.upload("../my:book.txt", SAMPLE.encode()).first()
    book = row["id"]
    assert row["title"] == "my_book" and row["language"] == "ru" and service.upload("again.txt", SAMPLE.encode()).first()["id"] == book
    assert service.find_book(book) == book and service.find_book(row["source_path"]) == book
    with pytest.raises(NotFound):
        service.find_book("nothing")
    assert [r["title"] for r in service.inspect(row["source_path"]).collect()] == ["Глава 1", "Глава 2"]
    job, did = service.analyze(book, chapters="1")
    assert (did["analyzed"], did["cast"]) == (1, 1)
    with pytest.raises(ValueError, match="no such chapters"):
        service.generate(book, chapters="7")
    with pytest.raises(ValueError, match="no audio yet"):
        engine.assemble(book)
    failed = [r for r in service.store.jobs.collect() if r["status"] == "failed"]
    assert len(failed) == 1 and "no such chapters" in failed[0]["error"]
    job, did = service.generate(book)
    assert (did["analyzed"], did["cast"], did["copied"], did["assembled"], did["books"]) == (1, 1, 0, 2, 1)
    assert service.resume(job)["rendered"] == 0
    assert {r["id"]: (r["lines"], r["voice_id"]) for r in service.characters(book).collect()} == {"anna": (1, "f"), "ivan": (1, "m")}
    assert {r["id"]: r["voice_id"] for r in service.characters(book, {"anna": "m"}).collect()} == {"anna": "m", "ivan": "m"}
    assert engine.generate(book)["rendered"] == 0  # the voice is the key's only by its fingerprint, which these lack
    assert [r["has_audio"] for r in service.book(book)[1].collect()] == [True, True]
    kinds = [r["kind"] for r in service.status(book).collect()]
    assert kinds.count("chapter") == 2 and kinds.count("job") == 4 and service.status().count() == 1
    assert cli.run(spark, ["--root", engine.tables.root, "status", book], engine) == 0 and "chapter" in capsys.readouterr().out
    assert cli.run(spark, ["--root", engine.tables.root, "resume", "nothing"], engine) == 1 and "nothing" in capsys.readouterr().err
    assert cli.run(spark, ["--root", engine.tables.root, "doctor"], engine) == 0 and "spark" in capsys.readouterr().out


def test_errors():
    assert [error_code(e) for e in (NotFound("x"), FileNotFoundError("x"), ValueError("x"), LabelError("x"), TypeError("x"))] == [404, 404, 400, 400, 500]


def test_chat_labeler():
    seen = []

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            self.reply(200, {"data": []})

        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.reply(500 if len(seen) > 1 else 200, {"choices": [{"message": {"content": "said"}}]})

        def reply(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    labeler = ChatLabeler(Config(model_url=f"http://127.0.0.1:{server.server_port}/v1", model="m"), schema={"type": "object"})
    assert labeler.health() and labeler.analyze_chunk("p") == "said"
    assert seen[0]["model"] == "m" and seen[0]["messages"][1]["content"] == "p" and seen[0]["response_format"]["type"] == "json_schema"
    with pytest.raises(LabelError, match="500"):
        labeler.same_person("q")
    server.shutdown()
    server.server_close()
    assert not labeler.health()
    with pytest.raises(LabelError, match="cannot be reached"):
        labeler.analyze_chunk("p")
