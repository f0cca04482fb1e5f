"""The command line: python -m storyloom.cli --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import importlib.util
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession

from storyloom.api import Service, error_code
from storyloom.config import configured
from storyloom.engine import BACKENDS, Engine
from storyloom.operators.labels import ChatLabeler
from storyloom.sources import voices as library

VOICES = "id string, name string, gender string, age_group string, roles array<string>, available boolean, fingerprint string"


class Printed:
    """Prints how far a job is."""

    def stage(self, stage: str, total: int) -> None:
        print(f"{stage}: {total}")

    def advance(self, done: int, total: int, message: str = "") -> None:
        print(f"  {done}/{total} {message}".rstrip())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="storyloom")
    out.add_argument("--root", required=True, help="folder of the tables")
    out.add_argument("--library", help="folder of the voice library")
    commands = out.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: tuple, **options: dict) -> None:
        p = commands.add_parser(name)
        for a in arguments:
            p.add_argument(a)
        for o, how in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", **how)

    yes = {"action": "store_true"}
    add("inspect", "path")
    add("import", "path")
    add("analyze", "book", method={"choices": ["llm", "heuristic"], "default": "llm"}, chapters={})
    add("generate", "book", mode={"choices": ["cast", "simple"], "default": "cast"}, chapters={}, force_llm=yes, no_m4b=yes)
    add("resume", "job")
    p = commands.add_parser("status")
    p.add_argument("book", nargs="?")
    add("characters", "book", assign={"action": "append", "default": [], "metavar": "CHARACTER=VOICE"})
    add("voices")
    add("add-voice", "file", overwrite=yes)
    add("doctor")
    return out


def doctor(spark: SparkSession, service: Service) -> list[tuple[str, str]]:
    """What the work needs, and whether it is there."""
    config = service.engine.config
    rows = [("spark", spark.version), ("shared folder", spark.sparkContext.getConf().get("spark.checkpoint.dir") or "not set"), ("ffmpeg", shutil.which("ffmpeg") or "not found")]
    rows += [("voice backend", config.tts_backend if config.tts_backend in BACKENDS else f"{config.tts_backend}: unknown"), ("voices", str(service.store.health()))]
    return rows + [(f"module {m}", "found" if importlib.util.find_spec(m) else "not found") for m in ("pandas", "pyarrow", "numpy")]


def _voices(spark: SparkSession, folder: str | None) -> DataFrame:
    if folder is None:
        return spark.createDataFrame([], VOICES)
    x = library.parse_library(library.read_library(spark, folder)).filter("error is null")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    from pyspark.sql import functions as F

    at = F.regexp_replace("path", ".*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return library.with_availability(x, files.select(at.alias("path"), F.sha2("content", 256).alias("sha256")))


def run(spark: SparkSession, argv: list[str], engine: Engine | None = None) -> int:
    """Runs a command; returns 0, or 1 after an error that was printed."""
    a = parser().parse_args(argv)
    config = configured(spark) if engine is None else engine.config
    service = Service(engine or Engine(spark, a.root, _voices(spark, a.library), config, lambda: ChatLabeler(config), Printed()))
    show = lambda df: df.show(1000, 60)
    try:
        match a.command:
            case "inspect":
                show(service.inspect(a.path))
            case "import":
                show(service.add_books([a.path]))
            case "analyze":
                print(*service.analyze(service.find_book(a.book), a.method, a.chapters))
            case "generate":
                print(*service.generate(service.find_book(a.book), a.mode, a.chapters, a.force_llm, not a.no_m4b))
            case "resume":
                print(service.resume(a.job))
            case "status":
                show(service.status(a.book))
            case "characters":
                show(service.characters(a.book, dict(x.split("=", 1) for x in a.assign)))
            case "voices":
                show(service.voices())
            case "add-voice":
                new = library.parse_library(spark.read.option("wholetext", True).text(a.file).selectExpr("input_file_name() as file", "value as content")).filter("error is null")
                show(service.add_voice(new, a.overwrite))
            case "doctor":
                for row in doctor(spark, service):
                    print(*row, sep=": ")
    except Exception as e:
        if error_code(e) == 500:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("storyloom").getOrCreate(), sys.argv[1:]))
