"""Labels of spans: requests, responses and the labelers that answer. A labeler is an object as Labeler says; it is made
once a task, on the executors."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG, Config
from storyloom.functions.text import coerce, normalize_emotion, normalize_name, slug

CHARACTER = "struct<id:string,name:string,aliases:array<string>,gender:string,age_group:string,description:string,same_as:string,possibly_same_as:array<string>>"
LABELS = f"struct<characters:array<{CHARACTER}>,segments:array<struct<id:long,type:string,cue:string,speaker:string,emotion:string>>>"
NOBODY = ("narrator", "unknown")
AGES = ("child", "teen", "young_adult", "adult", "elderly")
#: An answer that leaves more than this share of the spans without label is refused.
MOST_MISSING = 0.2


class LabelError(ValueError):
    """An answer that cannot be used, or a model that cannot be reached."""


class Labeler(Protocol):
    def analyze_chunk(self, prompt: str) -> str:
        """The answer to a prompt of prompts(), as text that holds a JSON object."""
        ...

    def same_person(self, prompt: str) -> str:
        """The answer to a prompt of duplicate_prompts()."""
        ...

    def health(self) -> bool: ...

    def close(self) -> None: ...


def requests(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, paragraph, hint, text) to (keys, prompt): a line per paragraph, each span behind its id and hint."""
    tag = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit(":"), "hint", F.lit("] "), "text")
    lines = spans.groupBy(*keys, "paragraph").agg(F.array_sort(F.collect_list(F.struct("idx", tag.alias("t")))).alias("x"))
    lines = lines.select(*keys, "paragraph", F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("line"))
    listed = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("paragraph", "line"))).alias("x"))
    return listed.select(*keys, F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("prompt"))


def known_line(aliases: Column, description: Column) -> Column:
    """A known character as a prompt lists it, with its id, name and gender."""
    named = F.when(F.size(aliases) > 0, F.concat(F.lit(" (aliases: "), F.array_join(aliases, ", "), F.lit(")"))).otherwise("")
    about = F.when(description != "", F.concat(F.lit(" - "), description)).otherwise("")
    return F.concat(F.lit("- "), "id", F.lit(": "), "name", named, F.lit(", "), "gender", about)


def prompts(requests_: DataFrame, titles: DataFrame, known: DataFrame, recent: DataFrame, context: DataFrame) -> DataFrame:
    """Whole prompts: requests() of (book, chapter, chunk) behind the titles (book, chapter, book_title, chapter_title,
    language), the known characters (cards() of top_characters(), with rank), who spoke last (book, chapter, chunk,
    speakers) and the paragraphs before (book, chapter, chunk, context)."""
    key = ["book", "chapter", "chunk"]
    line = known_line(F.slice("aliases", 1, 5), F.substring("description", 1, 160))
    people = known.select("book", "rank", line.alias("line")).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    people = people.select("book", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("people"))
    x = requests_.join(titles, key[:2]).join(people, "book", "left").join(recent.select(*key, "speakers"), key, "left").join(context.select(*key, "context"), key, "left")
    part = lambda head, body: F.concat(F.lit(head), body)
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    pieces = F.array(
        part("Book: ", F.col("book_title")), part("Chapter: ", F.col("chapter_title")), F.when(F.col("language") != "", part("Language: ", F.col("language"))),
        F.coalesce(part("\nKNOWN CHARACTERS (reuse these ids):\n", F.col("people")), F.lit("\nKNOWN CHARACTERS: none yet")),
        F.when(some("speakers"), part("\nMost recent speakers before this passage: ", F.array_join("speakers", ", "))),
        F.when(some("context"), part("\nPRECEDING CONTEXT (for understanding only, do not label):\n", F.array_join("context", "\n"))),
        part("\nPASSAGE TO LABEL (one paragraph per line):\n", F.col("prompt")),
    )
    return x.select(*key, F.array_join(pieces, "\n").alias("prompt"))


def duplicate_prompts(pairs: DataFrame, cards: DataFrame) -> DataFrame:
    """(book, pair, a, b) and cards() to (book, prompt): the questions whether two characters are the same person."""
    aliases = F.slice("aliases", 1, 5)
    named = F.when(F.size(aliases) > 0, F.concat(F.lit(" (aliases: "), F.array_join(aliases, ", "), F.lit(")"))).otherwise("")
    text = F.concat("name", named, F.lit(", "), "gender", F.lit(": "), "description")
    side = lambda c: cards.select("book", F.col("id").alias(c), text.alias(f"card_{c}"))
    x = pairs.join(side("a"), ["book", "a"]).join(side("b"), ["book", "b"])
    line = F.concat(F.lit("Pair "), F.col("pair").cast("string"), F.lit(":\n  A: "), "card_a", F.lit("\n  B: "), "card_b")
    listed = x.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("pair", line.alias("t")))).alias("x"))
    return listed.select("book", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("prompt"))


def _first_object(text: str) -> str | None:
    """The text from the first brace to the one that closes it, braces in strings aside."""
    depth, at, quoted = 0, text.find("{"), False
    for m in re.finditer(r'\\.|["{}]', text[at:] if at >= 0 else ""):
        sign = m[0]
        if sign == '"':
            quoted = not quoted
        elif not quoted and sign in "{}":
            depth += 1 if sign == "{" else -1
            if not depth:
                return text[at : at + m.end()]
    return None


def json_object(raw: str | None) -> str | None:
    """The JSON object in a model's answer, in compact form: without thoughts; the whole answer, a fence, or the first
    object in it, whatever parses first; trailing commas are forgiven; null if there is none."""
    text = re.sub(r"(?is)<think>.*?</think>", "", raw or "")
    text = re.split(r"(?i)<think>", text)[0]
    for form in (text, *re.findall(r"(?is)```(?:json)?\s*(.*?)```", text), _first_object(text) or ""):
        for variant in (form, re.sub(r",(\s*[}\]])", r"\1", form)):
            try:
                found = json.loads(variant)
            except json.JSONDecodeError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
    return None


def parsed(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, raw) to (keys, body): body is the object as text, null where an answer holds none."""
    schema = ", ".join(f"{k} {responses.schema[k].dataType.simpleString()}" for k in keys) + ", body string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keys].assign(body=[json_object(x) for x in b["raw"]])

    return responses.select(*keys, "raw").mapInPandas(parse, schema)


def labels(responses: DataFrame, keys: list[str], spans: DataFrame | None = None) -> DataFrame:
    """parsed() answers to (keys, id, pos, type, cue, speaker, emotion) with normalised values; of equal ids the first.
    spans (keys, idx): what was asked; labels of other ids go."""
    x = responses.select(*keys, F.from_json("body", LABELS).alias("b")).select(*keys, F.posexplode("b.segments").alias("pos", "s")).filter("s.id is not null")
    spoken = F.lower(F.btrim(F.coalesce("s.type", F.lit("")))).isin("dialogue", "dialog", "speech")
    speaker = F.when(F.col("s.speaker").isNull(), "narrator").otherwise(F.coalesce(F.nullif(F.btrim("s.speaker"), F.lit("")), F.lit("unknown")))
    x = x.select(*keys, F.col("s.id").alias("id"), "pos", F.when(spoken, "dialogue").otherwise("narration").alias("type"), F.substring(F.coalesce("s.cue", F.lit("")), 1, 200).alias("cue"), speaker.alias("speaker"), normalize_emotion(F.col("s.emotion")).alias("emotion"))
    if spans is not None:
        x = x.join(spans.select(*keys, F.col("idx").cast("long").alias("id")).distinct(), [*keys, "id"], "left_semi")
    return x.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("pos"))).filter("k = 1").drop("k")


def characters(responses: DataFrame, keys: list[str]) -> DataFrame:
    """parsed() answers to the characters they report: (keys, pos, id, name, aliases, gender, age, description, same_as,
    possibly_same_as), normalised; one without a name goes."""
    x = responses.select(*keys, F.from_json("body", LABELS).alias("b")).select(*keys, F.posexplode("b.characters").alias("pos", "c")).filter("btrim(c.name) <> ''")
    named = slug(F.coalesce("c.id", F.lit("")), fallback="")
    same = slug(F.when(F.lower("c.same_as").isin("null", "none"), "").otherwise(F.coalesce("c.same_as", F.lit(""))), fallback="")
    none = F.array().cast("array<string>")
    return x.select(
        *keys, "pos", F.when(named == "", slug(F.col("c.name"), fallback="character")).otherwise(named).alias("id"), F.col("c.name").alias("name"), F.coalesce("c.aliases", none).alias("aliases"),
        coerce(F.coalesce("c.gender", F.lit("")), ("male", "female")).alias("gender"), coerce(F.coalesce("c.age_group", F.lit("")), AGES).alias("age"), F.coalesce("c.description", F.lit("")).alias("description"),
        F.nullif(same, F.lit("")).alias("same_as"), F.coalesce("c.possibly_same_as", none).alias("possibly_same_as"),
    )


def refused(labels_: DataFrame, spans: DataFrame, keys: list[str], most: float = MOST_MISSING) -> DataFrame:
    """(keys, labelled, asked): the answers that leave too many of the spans asked without a label."""
    asked = spans.groupBy(*keys).agg(F.countDistinct("idx").alias("asked"))
    got = labels_.groupBy(*keys).agg(F.count(F.lit(1)).alias("labelled"))
    x = asked.join(got, keys, "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)).cast("long"))
    return x.filter((F.col("asked") - F.col("labelled")) > F.col("asked") * most).select(*keys, "labelled", "asked")


def verdicts(responses: DataFrame, keys: list[str]) -> DataFrame:
    """parsed() answers to duplicate questions as (keys, pair, same_person, reason), the last answer of each pair."""
    schema = "struct<answers:array<struct<pair:long,reason:string,same_person:boolean>>>"
    x = responses.select(*keys, F.from_json("body", schema).alias("b")).select(*keys, F.posexplode("b.answers").alias("pos", "a")).filter("a.pair is not null and a.same_person is not null")
    last = x.groupBy(*keys, F.col("a.pair").alias("pair")).agg(F.max_by("a", "pos").alias("a"))
    return last.select(*keys, "pair", "a.same_person", F.coalesce("a.reason", F.lit("")).alias("reason"))


def _usable(raw: str, ids: list[int]) -> None:
    body = json_object(raw)
    if body is None:
        raise LabelError("the last answer held no JSON object")
    given = {s.get("id") for s in json.loads(body).get("segments") or () if isinstance(s, dict)}
    if ids and len(set(ids) - given) > MOST_MISSING * len(set(ids)):
        raise LabelError(f"the last answer labels only {len(set(ids) & given)} of {len(set(ids))} spans")


def run_labeler(requests_: DataFrame, keys: list[str], make: Callable[[], Labeler], retries: int = CONFIG.model_retries, strict: bool = False) -> DataFrame:
    """(keys, prompt[, ids]) to (keys, raw): one labeler per task. An answer without an object, or (ids: the spans asked)
    with too few labels, is asked for again with the reason, up to `retries` times; what is refused even then comes back
    as it is, or is an error if strict."""
    schema = ", ".join(f"{k} {requests_.schema[k].dataType.simpleString()}" for k in keys) + ", raw string"

    def ask(labeler: Labeler, prompt: str, ids: list[int]) -> str:
        said, last = prompt, None
        for _ in range(1 + max(0, retries)):
            answer = labeler.analyze_chunk(said)
            try:
                _usable(answer, ids)
                return answer
            except LabelError as e:
                last = e
                wanted = f" It must label these span ids: {', '.join(map(str, ids))}." if ids else ""
                said = f"{prompt}\n\nYour answer could not be used: {e}.{wanted} The answer began:\n{(answer or '')[:4000]}"
        if strict:
            raise LabelError(f"no valid answer: {last}")
        return answer

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeler = make()
        try:
            for b in batches:
                ids = [list(x) for x in b["ids"]] if "ids" in b else [[]] * len(b)
                yield b[keys].assign(raw=[ask(labeler, p, i) for p, i in zip(b["prompt"], ids, strict=True)])
        finally:
            getattr(labeler, "close", lambda: None)()

    return requests_.select(*keys, "prompt", *(["ids"] if "ids" in requests_.columns else [])).mapInPandas(work, schema)


class ChatLabeler:
    """A labeler that asks a chat model over HTTP, in the form that most model servers share. Off by default: nothing in
    the engine makes one unless it is asked to."""

    def __init__(self, config: Config = CONFIG, key: str = "", system: str = "Label every span. Answer with one JSON object that holds characters and segments.", timeout: float = 600.0, schema: dict | None = None):
        self.config, self.key, self.system, self.timeout, self.schema = config, key, system, timeout, schema

    def _call(self, path: str, body: dict | None) -> dict:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.config.model_url.rstrip("/") + path, json.dumps(body).encode() if body is not None else None, head)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            raise LabelError(f"the model answered {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise LabelError(f"the model at {self.config.model_url} cannot be reached: {e}") from e
        except ValueError as e:
            raise LabelError(f"the model's answer is no JSON: {e}") from e

    def _chat(self, system: str, prompt: str, most: int) -> str:
        body = {"model": self.config.model, "temperature": 0.0, "max_tokens": most, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
        if self.schema is not None:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": self.schema}}
        found = self._call("/chat/completions", body)
        try:
            return found["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise LabelError("the model's answer holds no message") from e

    def analyze_chunk(self, prompt: str) -> str:
        return self._chat(self.system, prompt, 8192)

    def same_person(self, prompt: str) -> str:
        return self._chat("Say for each pair whether both are the same person. Answer with one JSON object that holds answers.", prompt, 4096)

    def health(self) -> bool:
        try:
            self._call("/models", None)
        except LabelError:
            return False
        return True

    def close(self) -> None:
        pass


#: Names that a rule labeler takes; more are a registry's matter (attribution.tag_speakers()).
MOST_NAMES = 10_000


def _name_patterns(names: DataFrame, bounds: bool) -> DataFrame:
    if names.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} characters")
    edge = r"\b" if bounds else ""
    every = F.explode(F.concat(F.array("name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in names.columns else F.array().cast("array<string>")))
    return names.select("ord", F.col("id").cast("string").alias("id"), every.alias("n")).select("ord", "id", F.concat(F.lit(rf"(?iuU){edge}\Q"), "n", F.lit(rf"\E{edge}")).alias("p"))


def rule_labels(spans: DataFrame, names: DataFrame, order: list[str]) -> DataFrame:
    """spans with type and speaker by rule: dialogue is spoken by the character (ord, id, name[, aliases]) whose name or
    alias stands first in ord among those that the next span holds as whole words, else by unknown. The name list is a
    cast that the caller gives, held as one array of patterns; the next span may be of another paragraph."""
    listed = _name_patterns(names, True).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "p"))).alias("cast_"))
    x = spans.withColumn("after", F.coalesce(F.lead("text").over(Window.partitionBy(*order[:-1]).orderBy(order[-1])), F.lit("")))
    hit = F.get(F.filter("cast_", lambda c: F.regexp_count(F.col("after"), c["p"]) > 0), F.lit(0))["id"]
    speaks = F.col("hint") == "dialogue"
    x = x.join(F.broadcast(listed)).withColumn("type", F.when(speaks, "dialogue").otherwise("narration"))
    return x.withColumn("speaker", F.when(speaks, F.coalesce(hit, F.lit("unknown"))).otherwise("narrator")).drop("after", "cast_")


def rule_characters(labelled: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id): the characters that the rule reports for each chunk: those who speak, and those whose name or alias its
    text holds anywhere."""
    listed = _name_patterns(names, False).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "p"))).alias("cast_"))
    held = labelled.join(F.broadcast(listed)).select(*keys, F.explode(F.transform(F.filter("cast_", lambda c: F.regexp_count(F.col("text"), c["p"]) > 0), lambda c: c["id"])).alias("id"))
    said = labelled.filter((F.col("type") == "dialogue") & (F.col("speaker") != "unknown")).select(*keys, F.col("speaker").alias("id"))
    return held.unionByName(said).distinct()


def resolve_speakers(labels_: DataFrame, ids: DataFrame, aliases: DataFrame, merged: DataFrame | None = None, chunk_ids: DataFrame | None = None) -> DataFrame:
    """(book, speaker, ...) with speaker as a registry id: narrator and unknown stay; then the slug as an id that the same
    chunk reported (chunk_ids: book, chapter, chunk, id, character), then as an id of ids (book, id), through merged
    (book, old, new); then a name that one character bears (book, alias, id); else unknown."""
    key = slug(F.btrim("speaker"), fallback="")
    x = labels_.withColumn("low", F.lower(F.btrim("speaker"))).withColumn("sid", key).withColumn("alias", normalize_name(F.col("speaker")))
    if chunk_ids is not None:
        place = ["book", "chapter", "chunk"]
        own = chunk_ids.select(*place, F.col("id").alias("sid"), "character").groupBy(*place, "sid").agg(F.max("character").alias("character"))
        x = x.join(own, [*place, "sid"], "left").withColumn("sid", F.coalesce("character", "sid")).drop("character")
    if merged is not None:
        x = x.join(merged.select("book", F.col("old").alias("sid"), "new"), ["book", "sid"], "left").withColumn("sid", F.coalesce("new", "sid")).drop("new")
    x = x.join(ids.select("book", F.col("id").alias("sid"), F.lit(True).alias("known")).distinct(), ["book", "sid"], "left")
    x = x.join(aliases.select("book", "alias", F.col("id").alias("named")), ["book", "alias"], "left")
    found: Column = F.when(F.col("low").isin(*NOBODY), F.col("low")).when(F.col("known"), F.col("sid")).otherwise(F.coalesce("named", F.lit("unknown")))
    return x.withColumn("speaker", found).drop("low", "sid", "alias", "known", "named")
