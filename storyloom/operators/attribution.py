"""Who speaks: deterministic speech tags and label joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import normalize_name
from storyloom.tables import scope

# How many words of a remark count, words that name nobody, beginnings of verbs of speech.
TAG_WINDOW = 6
PRONOUNS = (
    "он", "она", "оно", "они", "я", "ты", "вы", "мы", "тот", "та", "те", "кто", "все", "he", "she", "it", "they", "i", "you", "we", "him", "her", "them",
)
SPEECH_VERBS = (
    "сказ", "ответ", "отвеч", "спрос", "спраш", "прогово", "произн", "крикн", "кричал", "вскрик", "вскрич", "закрич", "прошеп", "шепн",
    "шепт", "пробормо", "бормот", "замет", "приба", "доба", "продолж", "нача", "подхват", "возраз", "воскли", "переб", "подума", "думал",
    "промолв", "молв", "бурк", "встав", "повтор", "объяв", "говор", "провор", "ворч", "отозв", "обрат", "завоп", "вопи", "взвизг",
    "пролепет", "лепет", "выговор", "рявкн", "простон", "протян", "said", "says", "asked", "replied", "answered", "cried", "shouted", "whispered",
    "muttered", "murmured", "added", "continued", "exclaimed", "thought", "called", "began", "repeated", "snapped", "sighed",
)
WORD = r"(?U)(\w+)"


def name_index(characters: DataFrame) -> DataFrame:
    """([book,] id, name, aliases) to ([book,] words, ids): each name as an array of words, with all ids that bear it."""
    keys = [c for c in ("book",) if c in characters.columns]
    names = characters.select(*keys, "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    words = names.select(*keys, "id", F.regexp_extract_all(normalize_name(F.col("name")), F.lit(WORD), 1).alias("words"))
    useful = (F.size("words") > 1) | ((F.size("words") == 1) & (F.length(F.col("words")[0]) >= 3) & ~F.col("words")[0].isin(*PRONOUNS))
    return words.filter(useful).groupBy(*keys, "words").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def tag_speakers(segments: DataFrame, characters: DataFrame) -> DataFrame:
    """([book,] chapter, paragraph, speaker) for paragraphs that open with dialogue and whose remarks name one character
    near a verb of speech. A remark that names several decides nothing and leaves it to the others of its paragraph. The
    first words' n-grams meet the name index in an equi-join, so no name is searched in each text."""
    keys = scope(segments)
    index = name_index(characters)
    order = Window.partitionBy(*keys, "paragraph").orderBy("idx")
    x = segments.withColumn("first", F.first("hint").over(order)).filter((F.col("first") == "dialogue") & (F.col("hint") == "narration"))
    words = F.slice(F.regexp_extract_all(normalize_name(F.col("text")), F.lit(WORD), 1), 1, TAG_WINDOW)
    verbs = "^(" + "|".join(SPEECH_VERBS) + ")"
    x = x.withColumn("w", words).filter(F.exists("w", lambda t: t.rlike(verbs)))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n)))))
    hits = x.select(*keys, "paragraph", "idx", F.explode(grams).alias("words")).join(index, [c for c in index.columns if c != "ids" and c in (*keys, "words")])
    one = lambda d, *by: d.groupBy(*by).agg(F.countDistinct("speaker").alias("n"), F.min("speaker").alias("speaker")).filter("n = 1").drop("n")
    remarks = one(hits.select(*keys, "paragraph", "idx", F.explode("ids").alias("speaker")), *keys, "paragraph", "idx")
    return one(remarks, *keys, "paragraph")


def apply_tags(segments: DataFrame, tags: DataFrame) -> DataFrame:
    """segments with the tag's speaker on all dialogue (by hint) of tagged paragraphs, which also becomes dialogue where a
    label said otherwise. Elsewhere labels (type, speaker) stay; rows without labels go by their hint."""
    keys = [*scope(segments), "paragraph"]
    x = segments.join(tags.withColumnRenamed("speaker", "tagged"), keys, "left")
    old = lambda c: F.col(c) if c in segments.columns else F.lit(None).cast("string")
    speaks = F.col("hint") == "dialogue"
    decided = speaks & F.col("tagged").isNotNull()
    kind = F.when(decided, "dialogue").otherwise(F.coalesce(old("type"), F.when(speaks, "dialogue").otherwise("narration")))
    speaker = F.when(decided, F.col("tagged")).otherwise(F.coalesce(old("speaker"), F.when(speaks, "unknown").otherwise("narrator")))
    return x.withColumn("_type", kind).withColumn("_speaker", speaker).drop("tagged", "type", "speaker").withColumnsRenamed({"_type": "type", "_speaker": "speaker"})


def join_labels(spans: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """spans with the first label of each key (labels have pos, type, speaker); others fall back on their hint."""
    first = labels.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).filter("k = 1").drop("k", "pos")
    x = spans.join(first, keys, "left")
    return x.withColumn("speaker", F.coalesce("speaker", F.when(F.col("hint") == "dialogue", "unknown").otherwise("narrator"))).withColumn("type", F.coalesce("type", "hint"))


def recent_speakers(segments: DataFrame, most: int = 4) -> DataFrame:
    """([book,] chapter, chunk, speakers): who was last heard in dialogue before each chunk of a chapter, the latest last;
    unknown speakers do not count, and a chunk without any has an empty list. Chunks hand on a list of `most` names."""
    keys = scope(segments)
    heard = (F.col("speaker") != "unknown") & (F.col("type") == "dialogue") if "type" in segments.columns else ~F.col("speaker").isin("unknown", "narrator")
    last = segments.groupBy(*keys, "chunk", F.when(heard, F.col("speaker")).alias("speaker")).agg(F.max("idx").alias("at"))
    named = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("at", "speaker"))))
    chunks = last.groupBy(*keys, "chunk").agg(F.slice(F.reverse(F.transform(named, lambda s: s["speaker"])), 1, most).alias("latest"))

    def hand_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        before, out = [], []
        for latest in pdf["latest"]:
            out.append(before[::-1])
            before = [*latest, *(s for s in before if s not in set(latest))][:most]
        return pdf[[*keys, "chunk"]].assign(speakers=out)

    schema = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in (*keys, "chunk")) + ", speakers array<string>"
    return chunks.groupBy(*keys).applyInPandas(hand_on, schema)
