"""Voices for characters."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.config import CONFIG

# The order of ages, and the weights of a voice's score.
AGES = ("child", "teen", "young_adult", "adult", "elderly")
SAME_GENDER, OTHER_GENDER, PER_AGE_STEP, PER_USE = 4.0, -6.0, -0.75, -2.5


#: Voices that a library may hold for characters.
MOST_VOICES = 10_000


def age_distance(a: Column, b: Column) -> Column:
    order = F.array(*(F.lit(x) for x in AGES))
    return F.when((a == "unknown") | (b == "unknown"), 1).otherwise(F.abs(F.array_position(order, a) - F.array_position(order, b)))


def fit_score(gender: Column, age: Column, voice_gender: Column, voice_age: Column) -> Column:
    """The score of an unused voice."""
    same = F.when((gender == "unknown") | (voice_gender == "unknown"), 0.0).when(gender == voice_gender, SAME_GENDER).otherwise(OTHER_GENDER)
    return same + PER_AGE_STEP * age_distance(age, voice_age)


def cast(characters: DataFrame, voices: DataFrame, narrator: str = CONFIG.narrator_voice) -> DataFrame:
    """(book, id, gender, age, lines, first_chapter[, voice_id]) to (book, id, voice_id). A character that has a voice
    keeps it. The others choose in order of lines, each the best voice after a charge for its uses in the book, which the
    voices kept count for too; of equals the last id. Without a voice for characters all are the narrator's.

    The library is small by its nature (files that people record); its voices are one array beside each book."""
    usable = voices.filter(F.col("available") & F.array_contains("roles", "character"))
    others = usable.filter(F.col("id") != narrator)
    pool = [tuple(r) for r in (usable if others.isEmpty() else others).select("id", "gender", "age_group").orderBy("id").limit(MOST_VOICES + 1).collect()]
    if len(pool) > MOST_VOICES:
        raise ValueError(f"the library holds over {MOST_VOICES} voices")
    had = F.col("voice_id") if "voice_id" in characters.columns else F.lit(None)
    x = characters.select("book", F.col("id").cast("string").alias("id"), "gender", "age", "lines", "first_chapter", F.nullif(had.cast("string"), F.lit("")).alias("voice_id"))

    def steps(a: str, b: str) -> int:
        return 1 if "unknown" in (a, b) else abs(AGES.index(a) - AGES.index(b))

    def base(gender: str, age: str) -> list[float]:
        same = [0.0 if "unknown" in (gender, g) else SAME_GENDER if gender == g else OTHER_GENDER for _, g, _ in pool]
        return [s + PER_AGE_STEP * steps(age, a) for s, (_, _, a) in zip(same, pool, strict=True)]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        uses = Counter(pdf["voice_id"].dropna())
        kept = pdf[pdf["voice_id"].notna()]
        new = pdf[pdf["voice_id"].isna()].sort_values(["lines", "first_chapter", "id"], ascending=[False, True, True])
        fits: dict[tuple[str, str], list[float]] = {}
        out = []
        for r in new.itertuples():
            if (r.gender, r.age) not in fits:
                fits[r.gender, r.age] = base(r.gender, r.age)
            scored = [(s + PER_USE * uses[v[0]], v[0]) for s, v in zip(fits[r.gender, r.age], pool, strict=True)]
            out.append(max(scored)[1] if scored else narrator)
            uses[out[-1]] += 1
        return pd.concat([kept[["book", "id", "voice_id"]], new[["book", "id"]].assign(voice_id=out)])

    return x.groupBy("book").applyInPandas(choose, f"book {x.schema['book'].dataType.simpleString()}, id string, voice_id string")


def resolve_voices(segments: DataFrame, cast_: DataFrame, narrator: str = CONFIG.narrator_voice, unknown: str = "", merged: DataFrame | None = None, mode: str = "cast") -> DataFrame:
    """segments with voice_id: narration is the narrator's, dialogue its character's, else the unknown voice's or the
    narrator's. merged (book, old, new), as canonical() gives it, leads to the character that is left. In the mode
    `simple` the narrator reads all."""
    if mode == "simple":
        return segments.withColumn("voice_id", F.lit(narrator))
    x = segments.withColumn("_who", F.col("speaker"))
    if merged is not None:
        x = x.join(merged.select("book", F.col("old").alias("_who"), "new"), ["book", "_who"], "left").withColumn("_who", F.coalesce("new", "_who")).drop("new")
    x = x.join(cast_.select("book", F.col("id").alias("_who"), F.col("voice_id").alias("own")), ["book", "_who"], "left")
    voice = F.when((F.col("type") == "narration") | (F.col("speaker") == "narrator"), narrator).otherwise(F.coalesce("own", F.lit(unknown or narrator)))
    return x.withColumn("voice_id", voice).drop("own", "_who")


def voice_uses(cast_: DataFrame) -> DataFrame:
    """(book, voice_id, uses) of a cast."""
    return cast_.filter("voice_id <> ''").groupBy("book", "voice_id").agg(F.count(F.lit(1)).alias("uses"))
