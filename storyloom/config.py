"""Tunables of the engine, as one immutable value; read from the environment and from the session if asked."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from functools import cache

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    chunk_max_chars: int = 4000
    chunk_context_paragraphs: int = 3
    segment_max_chars: int = 400
    fallback_chapter_chars: int = 20_000
    max_heading_chars: int = 90
    pause_same_ms: int = 150
    pause_speaker_ms: int = 350
    pause_paragraph_ms: int = 600
    pause_chapter_ms: int = 800
    sample_rate: int = 24_000
    narrator_voice: str = "narrator_01"
    unknown_voice: str = ""
    prompt_version: str = "chunk-v2"
    parser_version: int = 2
    model: str = "ornith"
    model_url: str = "http://127.0.0.1:8081/v1"
    model_retries: int = 2
    tts_backend: str = "fake"
    tts_language: str = "auto"
    tts_use_instruct: bool = False
    audio_format: str = "m4a"
    audio_bitrate: str = "96k"
    audio_sample_rate: int = 44_100
    audio_loudnorm: bool = True
    max_upload_mb: int = 200


CONFIG = Config()
PREFIX = "storyloom."


def _typed(kind: str, value: str):
    return {"int": int, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on"), "str": str}[kind](value)


def configured(spark: SparkSession | None = None, environment: dict[str, str] | None = None, base: Config = CONFIG) -> Config:
    """base with what the environment names in upper case (CHUNK_MAX_CHARS) and, over that, what the session has under
    storyloom. (storyloom.chunk_max_chars). Other names are ignored; a value of the wrong type is an error."""
    given = {k.lower(): v for k, v in (os.environ if environment is None else environment).items()}
    found = {}
    for f in fields(Config):
        value = spark.conf.get(PREFIX + f.name, None) if spark is not None else None
        value = given.get(f.name) if value is None else value
        if value is not None:
            found[f.name] = _typed(f.type, value)
    return replace(base, **found)


@cache
def settings() -> Config:
    """What the environment configures, read once."""
    return configured()
