"""Characters: observations, duplicates, merges, counts. The fold over a book's observations is sequential by nature (each
one depends on what the earlier ones made); it runs per book in Arrow batches, over indexes of names and words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.names import PATRONYMIC, SURNAME, contains_name
from storyloom.functions.text import name_tokens, normalize_name, slug_text, stems
from storyloom.tables import stored

RESERVED = ("narrator", "unknown")
UNKNOWN = "unknown"
PERSON = "id string, name string, aliases array<string>, gender string, age string, description string, possibly_same_as array<string>, first_chapter long, lines long, voice_id string, locked boolean, seen long"
FIELDS = [c.split()[0] for c in PERSON.split(", ")]


def line_counts(segments: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """([book,] speaker, lines, first_chapter) over the dialogue of all stored segments; narrator and unknown are nobody.
    merged ([book,] old, new) maps ids to canonical ones."""
    keys = [c for c in ("book",) if c in segments.columns]
    x = segments.filter((F.col("type") == "dialogue") if "type" in segments.columns else F.lit(True))
    if merged is not None:
        x = x.join(merged.select(*keys, F.col("old").alias("speaker"), "new"), [*keys, "speaker"], "left").withColumn("speaker", F.coalesce("new", "speaker"))
    return x.filter(~F.col("speaker").isin(*RESERVED)).groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("lines"), F.min("chapter").alias("first_chapter"))


def canonical(merged: DataFrame) -> DataFrame:
    """([book,] old, new) with chains followed to their ends. Pointers are doubled on stored tables, so a chain of n merges
    takes log n rounds; a cycle, which merges cannot make, is an error."""
    keys = [c for c in ("book",) if c in merged.columns]
    x = stored(merged.select(*keys, "old", "new").distinct(), "merged")
    longest = x.count()
    for _ in range(longest.bit_length() + 1):
        step = x.select(*keys, F.col("old").alias("new"), F.col("new").alias("far"))
        y = stored(x.join(step, [*keys, "new"], "left").select(*keys, "old", F.coalesce("far", "new").alias("new"), F.col("far").isNotNull().alias("moved")), "merged")
        x = y.drop("moved")
        if y.filter("moved").isEmpty():
            return x
    raise ValueError("characters were merged in a cycle")


def _optional(df: DataFrame, name: str, kind: str, otherwise=None):
    return F.coalesce(F.col(name).cast(kind), F.lit(otherwise).cast(kind)) if name in df.columns else F.lit(otherwise).cast(kind)


_NONE = "array<string>"


def duplicate_candidates(characters: DataFrame, most: int = 25, shared: int = 2) -> DataFrame:
    """(book, a, b, score): pairs of one book worth a question, the best `most` of each book, by the order of the rows'
    `ord` (else id) where scores are equal. A pair shares `shared` stems of its names and descriptions, or one is linked
    to the other as possibly the same (which counts ten); one at least is new (is_new; all are, without that column); and
    its genders do not contradict.

    Two sets of stems that share two share one besides the commonest of each, so that one is left out of the join.
    """
    everything = F.concat_ws(" ", _optional(characters, "description", "string", ""), "name", F.array_join(F.coalesce(_optional(characters, "aliases", _NONE), F.array().cast(_NONE)), " "))
    new = F.col("is_new") if "is_new" in characters.columns else F.lit(True)
    order = F.col("ord").cast("long") if "ord" in characters.columns else F.row_number().over(Window.partitionBy("book").orderBy("id"))
    x = characters.withColumn("_possibly", F.coalesce(_optional(characters, "possibly_same_as", _NONE), F.array().cast(_NONE)))
    x = x.select("book", "id", "gender", new.alias("new"), order.alias("o"), stems(everything).alias("stems"), "_possibly")
    s = x.select("book", "id", F.explode("stems").alias("stem"))
    often = s.groupBy("book", "stem").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = s.join(often, ["book", "stem"]).withColumn("k", F.row_number().over(Window.partitionBy("book", "id").orderBy("n", "stem"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("book", "id")))
    rare = ranked.filter(F.col("k") <= F.col("m") - (shared - 1)).join(x.select("book", "id", "new"), ["book", "id"])
    a, b = rare.filter("new").select("book", "stem", F.col("id").alias("a")), rare.select("book", "stem", F.col("id").alias("b"))
    met = a.join(b, ["book", "stem"]).filter("a <> b").select("book", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    linked = x.select("book", F.col("id").alias("p"), F.explode("_possibly").alias("q")).join(x.select("book", F.col("id").cast("string").alias("q"), F.col("id").alias("r")), ["book", "q"]).filter("p <> r").select("book", F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b"))
    pairs = met.unionByName(linked).distinct()
    side = lambda c: x.select("book", F.col("id").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("gender", "new", "o", "stems", "_possibly")))
    y = pairs.join(side("a"), ["book", "a"]).join(side("b"), ["book", "b"])
    common = F.size(F.array_intersect("stems_a", "stems_b"))
    link = F.array_contains("_possibly_a", F.col("b").cast("string")) | F.array_contains("_possibly_b", F.col("a").cast("string"))
    fits = (F.col("gender_a") == F.col("gender_b")) | (F.col("gender_a") == UNKNOWN) | (F.col("gender_b") == UNKNOWN)
    y = y.filter(fits & (F.col("new_a") | F.col("new_b")) & ((common >= shared) | link))
    first = F.col("o_a") < F.col("o_b")
    y = y.select("book", F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), (common + F.when(link, 10).otherwise(0)).cast("long").alias("score"), F.least("o_a", "o_b").alias("o1"), F.greatest("o_a", "o_b").alias("o2"))
    return y.withColumn("k", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("score"), "o1", "o2"))).filter(F.col("k") <= most).drop("k", "o1", "o2")


def unique_aliases(characters: DataFrame) -> DataFrame:
    """(book, alias, id): normalised names that exactly one character of a book bears."""
    names = characters.select("book", "id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast(_NONE)))).alias("alias"))
    return names.withColumn("alias", normalize_name(F.col("alias"))).groupBy("book", "alias").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def top_characters(characters: DataFrame, most: int = 40) -> DataFrame:
    """The `most` characters of each book by lines, then id."""
    return characters.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("lines"), "id"))).filter(F.col("rank") <= most)


def cards(characters: DataFrame, aliases: int = 6, description: int = 200) -> DataFrame:
    """(book, id, name, aliases, gender, description) with as many aliases and characters of the description as a question
    about a character holds; a prompt's known characters have 5 and 160."""
    cut = F.slice(F.coalesce(_optional(characters, "aliases", _NONE), F.array().cast(_NONE)), 1, aliases)
    more = [c for c in ("first_chapter", "lines", "possibly_same_as", "rank") if c in characters.columns]
    return characters.select("book", "id", "name", cut.alias("aliases"), "gender", F.substring(_optional(characters, "description", "string", ""), 1, description).alias("description"), *more)


def _key(name: str) -> str:
    return re.sub(r"[^\w]+", " ", name.casefold().replace("ё", "е")).strip()


def _words(name: str) -> frozenset[str]:
    return frozenset(_key(name).split())


def _mixed(name: str) -> bool:
    return bool(re.search("[Ѐ-ӿ]", name) and re.search("[A-Za-z]", name))


def _proper(name: str) -> bool:
    """Two words, or one with a surname's ending."""
    words = _key(name).split()
    return len(words) >= 2 or any(re.search(SURNAME, w) for w in words)


def _telling(words: Iterable[str], least: int) -> set[str]:
    """Words long enough to tell people apart that are no patronymics."""
    return {w for w in words if len(w) >= least and not re.search(PATRONYMIC, w)}


def _agree(a: str, b: str) -> bool:
    return UNKNOWN in (a, b) or a == b


class People:
    """The characters of one book, with indexes of their names and of the telling words of these."""

    def __init__(self, rows: Iterable[dict] = ()):
        self.all: dict[str, dict] = {}
        self.merged: dict[str, str] = {}
        self.number: dict[str, int] = {}
        self.by_name: dict[str, set[str]] = defaultdict(set)
        self.by_word: dict[str, set[str]] = defaultdict(set)
        for r in rows:
            self.all[r["id"]] = r
            self._index(r["id"])

    @staticmethod
    def names(c: dict) -> list[str]:
        return [c["name"], *c["aliases"]]

    def _index(self, i: str) -> None:
        self.number.setdefault(i, len(self.number))
        for name in self.names(self.all[i]):
            self.by_name[_key(name)].add(i)
            for w in _telling(_words(name), 4):
                self.by_word[w].add(i)

    def _bearing(self, name: str) -> list[str]:
        key = _key(name)
        return sorted((i for i in self.by_name.get(key, ()) if i in self.all), key=self.number.get) if key else []

    def _parts(self, name: str, gender: str) -> list[str]:
        """Characters one of whose names holds all words of this one, or the other way round, the shorter being a name."""
        words = _words(name)
        near = {i for w in words for i in self.by_word.get(w, ()) if i in self.all}
        found = []
        for i in near:
            if _agree(self.all[i]["gender"], gender):
                for own in map(_words, self.names(self.all[i])):
                    small, big = sorted((words, own), key=len)
                    if small < big and _telling(small, 4):
                        found.append(i)
                        break
        return found

    def match(self, o: dict) -> str | None:
        """Who an observation is of: whom it says, else the character with its id if nothing speaks against that, else the
        only one with one of its names, else the only one whose name is part of its own or the other way round."""
        if o["same_as"] and o["same_as"] in self.all:
            return o["same_as"]
        if o["id"] in self.all and _agree(self.all[o["id"]]["gender"], o["gender"]):
            mine = [n for n in self.names(o) if _proper(n)]
            theirs = [n for n in self.names(self.all[o["id"]]) if _proper(n)]
            shared = {w for n in mine for w in _words(n)} & {w for n in theirs for w in _words(n)}
            if not mine or not theirs or _telling(shared, 3):
                return o["id"]
        named = {i for n in self.names(o) for i in self._bearing(n) if _agree(self.all[i]["gender"], o["gender"])}
        found = named or set(self._parts(o["name"], o["gender"]))
        return found.pop() if len(found) == 1 else None

    def _learn(self, c: dict, o: dict) -> None:
        now, new = _words(c["name"]), _words(o["name"])
        clean = not _mixed(o["name"])
        if _mixed(c["name"]) and clean:
            c["name"] = o["name"]
        elif clean and new and now != new and (_key(c["name"]) in map(_key, o["aliases"]) or (len(now) == 1 and len(new) >= 2)):
            c["aliases"].append(c["name"])  # a real name takes the place of a description
            c["name"] = o["name"]
        known = set(map(_key, self.names(c)))
        for name in self.names(o):
            if name.strip() and not _mixed(name) and _key(name) not in known:
                c["aliases"].append(name.strip())
                known.add(_key(name))
        for field in ("gender", "age"):
            if c[field] == UNKNOWN:
                c[field] = o[field]
        c["description"] = c["description"] or o["description"]

    def observe(self, o: dict) -> str:
        hit = self.match(o)
        if hit is not None:
            self._learn(self.all[hit], o)
            self.all[hit]["seen"] += 1
            self._index(hit)
            return hit
        base = slug_text(o["id"] or o["name"], fallback="character")
        base = f"{base}_character" if base in RESERVED else base
        new, n = base, 2
        while new in self.all:
            new, n = f"{base}_{n}", n + 1
        perhaps = [i for i in o["possibly_same_as"] if i in self.all]
        perhaps += [i for name in self.names(o) for i in self._bearing(name)]
        aliases, known = [], {_key(o["name"])}
        for name in o["aliases"]:
            if _key(name) and not _mixed(name) and _key(name) not in known:
                aliases.append(name.strip())
                known.add(_key(name))
        self.all[new] = {"id": new, "name": o["name"], "aliases": aliases, "gender": o["gender"], "age": o["age"], "description": o["description"], "possibly_same_as": list(dict.fromkeys(perhaps)), "first_chapter": o["chapter"], "lines": 0, "voice_id": None, "locked": False, "seen": 1}
        self._index(new)
        return new

    def end(self, i: str) -> str:
        while i in self.merged:
            i = self.merged[i]
        return i

    def join(self, a: str, b: str) -> bool:
        """Merges two characters if nothing forbids it: genders that contradict, or two pinned voices. A proper name
        outlives a description, then more lines, then the earlier chapter."""
        a, b = self.end(a), self.end(b)
        if a == b or a not in self.all or b not in self.all:
            return False
        x, y = self.all[a], self.all[b]
        if not _agree(x["gender"], y["gender"]) or (x["locked"] and y["locked"] and x["voice_id"] != y["voice_id"]):
            return False
        rank = lambda c: (_proper(c["name"]), c["lines"], -(c["first_chapter"] or 0))
        keep, gone = (x, y) if rank(x) >= rank(y) else (y, x)
        known = set(map(_key, self.names(keep)))
        for name in self.names(gone):
            if _key(name) not in known and not _mixed(name):
                keep["aliases"].append(name)
                known.add(_key(name))
        for field in ("gender", "age"):
            if keep[field] == UNKNOWN:
                keep[field] = gone[field]
        keep["description"] = keep["description"] or gone["description"]
        keep["lines"] += gone["lines"]
        keep["seen"] += gone["seen"]
        keep["first_chapter"] = min((c["first_chapter"] for c in (keep, gone) if c["first_chapter"]), default=0)
        if gone["locked"] and not keep["locked"]:
            keep["voice_id"], keep["locked"] = gone["voice_id"], True
        keep["voice_id"] = keep["voice_id"] or gone["voice_id"]
        del self.all[gone["id"]]
        self.merged[gone["id"]] = keep["id"]
        for c in self.all.values():
            c["possibly_same_as"] = [i for i in dict.fromkeys(keep["id"] if i == gone["id"] else i for i in c["possibly_same_as"]) if i != c["id"]]
        self._index(keep["id"])
        return True


def _records(pdf: pd.DataFrame) -> list[dict]:
    rows = pdf.to_dict("records")
    for r in rows:
        for k, v in r.items():
            if isinstance(v, np.ndarray):
                r[k] = [x for x in v.tolist() if x is not None]
            elif v is None or v is pd.NA or (isinstance(v, float) and v != v):
                r[k] = None
    return rows


def _person_rows(df: DataFrame) -> DataFrame:
    """Characters with all fields of PERSON, those that are not there filled with nothing."""
    fill = {"aliases": (_NONE, None), "gender": ("string", UNKNOWN), "age": ("string", UNKNOWN), "description": ("string", ""), "possibly_same_as": (_NONE, None), "first_chapter": ("long", 0), "lines": ("long", 0), "voice_id": ("string", None), "locked": ("boolean", False), "seen": ("long", 0)}
    lists = lambda c: F.coalesce(_optional(df, c, _NONE), F.array().cast(_NONE)).alias(c)
    return df.select("book", F.col("id").cast("string").alias("id"), F.coalesce("name", F.lit("")).alias("name"), *(lists(c) if kind == _NONE else _optional(df, c, kind, v).alias(c) for c, (kind, v) in fill.items()))


def observe_all(observations: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(book, ord, id, name, gender[, aliases, age, description, same_as, possibly_same_as, chapter]) folded into the
    characters already known: the characters (book, PERSON) and what each observation is of (book, ord, id, character).

    Ties and repeats: observations go in the order of `ord`; the same one again changes nothing but `seen`. A row without
    a name is of nobody. An id that is taken, or is reserved, gets a suffix.
    """
    cols = [F.col("ord").cast("long").alias("ord"), _optional(observations, "same_as", "string").alias("same_as"), _optional(observations, "chapter", "long", 0).alias("chapter")]
    lists = lambda c: F.coalesce(_optional(observations, c, _NONE), F.array().cast(_NONE)).alias(c)
    full = observations.select(
        "book", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), lists("aliases"), _optional(observations, "gender", "string", UNKNOWN).alias("gender"),
        _optional(observations, "age", "string", UNKNOWN).alias("age"), _optional(observations, "description", "string", "").alias("description"), lists("possibly_same_as"), *cols,
    )
    old = _person_rows(known).withColumnRenamed("book", "of_book") if known is not None else None
    book = observations.schema["book"].dataType.simpleString()

    def fold(seen: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        people = People(_records(before.drop(columns="of_book")) if before is not None else ())
        first = (seen if len(seen) else before.rename(columns={"of_book": "book"}))["book"].iloc[0]
        rows = []
        for o in _records(seen.sort_values("ord", kind="stable")):
            if o["name"].strip():
                rows.append({"book": first, "ord": o["ord"], "observed": o["id"], "id": people.observe(o)})
        rows = [{**r, **dict.fromkeys(FIELDS[1:])} for r in rows] + [{"book": first, "ord": None, "observed": None, **c} for c in people.all.values()]
        return pd.DataFrame(rows, columns=["book", "ord", "observed", *FIELDS]).astype({"ord": "Int64", "first_chapter": "Int64", "lines": "Int64", "seen": "Int64", "locked": "boolean"})

    schema = f"book {book}, ord long, observed string, {PERSON}"
    if old is None:
        done = full.groupBy("book").applyInPandas(lambda pdf: fold(pdf, None), schema)
    else:
        done = full.groupBy("book").cogroup(old.groupBy("of_book")).applyInPandas(fold, schema)
    done = stored(done, "observed")
    return done.filter("ord is null").select("book", *FIELDS), done.filter("ord is not null").select("book", "ord", F.col("observed").alias("id"), F.col("id").alias("character"))


def observe(observations: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The characters that observe_all() makes."""
    return observe_all(observations, known)[0]


def contained_names(characters: DataFrame, names: DataFrame) -> DataFrame:
    """names (book, name) with the one character (book, id, name) whose words contain the name's or are contained in
    them. The shorter name is a part of the longer, so a pair meets on the rarest of the shorter one's words: each name is
    dealt by its rarest word, and met by all words of the others."""
    words = lambda df: df.withColumn("word", F.explode(name_tokens(F.col("name"))))
    people = characters.select("book", "id", F.col("name").alias("own"))
    own = words(people.withColumn("name", F.col("own"))).drop("name")
    asked = words(names.select("book", "name").distinct())
    often = own.select("book", "word").unionByName(asked.select("book", "word")).groupBy("book", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = lambda df, by: df.join(often, ["book", "word"]).groupBy("book", *by).agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = rarest(asked, ["name"]).join(own, ["book", "word"]).unionByName(asked.join(rarest(own, ["id", "own"]), ["book", "word"]))
    hits = met.select("book", "name", "id", "own").distinct().filter(contains_name(F.col("name"), F.col("own")))
    return hits.groupBy("book", "name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1").drop("n")


def consolidate(characters: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """characters (book, id, name, gender, lines, first_chapter, voice_id, locked, ...) and accepted pairs (book, ord, a, b)
    to the characters that are left (book, PERSON), and merged (book, old, new). Pairs are taken in order, each on the
    state that the earlier ones left."""
    kind = characters.schema["book"].dataType.simpleString()

    def fold(people_: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if not len(people_):
            return pd.DataFrame(columns=["book", *FIELDS, "new"])
        book = people_["book"].iloc[0]
        people = People(_records(people_.drop(columns="book")))
        for r in pairs.sort_values("ord").itertuples():
            people.join(r.a, r.b)
        rows = [{"book": book, **c, "new": None} for c in people.all.values()] + [{"book": book, **dict.fromkeys(FIELDS), "id": i, "new": people.end(i)} for i in people.merged]
        return pd.DataFrame(rows, columns=["book", *FIELDS, "new"]).astype({"first_chapter": "Int64", "lines": "Int64", "seen": "Int64", "locked": "boolean"})

    pairs = verdicts.select(F.col("book").alias("of_book"), "ord", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    done = stored(_person_rows(characters).groupBy("book").cogroup(pairs.groupBy("of_book")).applyInPandas(fold, f"book {kind}, {PERSON}, new string"), "consolidated")
    return done.filter("new is null").drop("new"), done.filter("new is not null").select("book", F.col("id").alias("old"), "new")


def rewrite_speakers(segments: DataFrame, merged: DataFrame) -> DataFrame:
    """(book, type, speaker, ...) with the speakers of dialogue replaced by the characters they were merged into."""
    x = segments.join(merged.select("book", F.col("old").alias("speaker"), "new"), ["book", "speaker"], "left")
    return x.withColumn("speaker", F.when(F.col("type") == "dialogue", F.coalesce("new", "speaker")).otherwise(F.col("speaker"))).drop("new")


def pin_voice(characters: DataFrame, pins: DataFrame) -> DataFrame:
    """characters (book, id, voice_id, locked, ...) with the voices of pins (book, id, voice_id), locked."""
    x = characters.join(pins.select("book", "id", F.col("voice_id").alias("pin")), ["book", "id"], "left")
    return x.withColumn("locked", F.col("pin").isNotNull() | F.col("locked")).withColumn("voice_id", F.coalesce("pin", "voice_id")).drop("pin")
