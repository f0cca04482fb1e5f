"""Paragraphs to typed spans, spans to chunks. What runs over a whole book runs over blocks of it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.config import CONFIG
from storyloom.tables import blocked, scope, stored

# What opens a dialogue, switches between line and remark, quotes, ends a sentence or a clause.
DIALOGUE_START = r"(?U)^\s*(?:[—–]|-(?=\s))\s*"
SWITCH = r'(?U)(?<=[,.!?…:;»”"])\s+[—–]\s+'
QUOTED = r'«[^«»]+»|„[^„“]+“|“[^“”]+”|"[^"]+"'
SENTENCE_END = r'(?<=[.!?…])[»”"]?\s+(?=["«“„(\[]?[A-ZА-ЯЁ0-9—–-])'
SOFT_BREAK = r"(?<=[,;:])\s+"


def _span(hint: str | Column, text: Column) -> Column:
    return F.struct((F.lit(hint) if isinstance(hint, str) else hint).alias("hint"), text.alias("text"))


def dash_spans(body: Column) -> Column:
    """Even parts of a dash paragraph are dialogue, odd ones narration; empty parts go after the parity is fixed."""
    parts = F.transform(F.split(body, SWITCH), lambda x, i: _span(F.when(i % 2 == 0, "dialogue").otherwise("narration"), F.btrim(x)))
    return F.filter(parts, lambda x: x["text"] != "")


def quote_spans(text: Column) -> Column:
    """Speech-like quotes (four words, or a closing sign inside) become dialogue; what stands around them narration."""
    marked = F.regexp_replace(text, f"({QUOTED})", "\u0001$1\u0002")
    parts = F.split(marked, "[\u0001\u0002]")
    inner = lambda x: F.btrim(F.substr(x, F.lit(2), F.length(x) - 2))
    speech = lambda x: x.rlike(f"^(?:{QUOTED})$") & ((F.size(F.split(inner(x), r"\s+")) >= 4) | inner(x).rlike("[.!?…,]$"))
    # Quotes that are not speech stay in the narration around them.
    fold = F.aggregate(
        parts,
        F.struct(F.array().cast("array<struct<hint:string,text:string>>").alias("out"), F.lit("").alias("held")),
        lambda acc, x: F.when(speech(x), F.struct(F.concat(acc["out"], F.array(_span("narration", acc["held"]), _span("dialogue", inner(x)))).alias("out"), F.lit("").alias("held"))).otherwise(
            F.struct(acc["out"].alias("out"), F.concat(acc["held"], x).alias("held"))
        ),
    )
    spans = F.concat(fold["out"], F.array(_span("narration", fold["held"])))
    trimmed = F.transform(spans, lambda s: _span(s["hint"], F.when(s["hint"] == "narration", F.btrim(s["text"], F.lit(" ,—–-"))).otherwise(s["text"])))
    spoken = F.flatten(F.transform(trimmed, lambda s: F.when(s["hint"] == "dialogue", dash_spans(s["text"])).otherwise(F.array(s))))
    return F.when(F.exists(spans, lambda s: s["hint"] == "dialogue"), F.filter(spoken, lambda s: s["text"] != "")).otherwise(F.array(_span("narration", text)))


def paragraph_spans(text: Column) -> Column:
    body = F.regexp_replace(text, DIALOGUE_START, "")
    return F.when(text.rlike(DIALOGUE_START), dash_spans(body)).otherwise(quote_spans(text))


def pack_texts(items: Column, most: int | Column) -> Column:
    """Neighbours, stripped, joined by a space for as long as they fit; an item that is too long stands alone."""
    items = F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    step = lambda acc, x: (
        F.when(acc["cur"] == "", F.struct(acc["out"].alias("out"), x.alias("cur")))
        .when(F.length(acc["cur"]) + 1 + F.length(x) <= most, F.struct(acc["out"].alias("out"), F.concat(acc["cur"], F.lit(" "), x).alias("cur")))
        .otherwise(F.struct(F.concat(acc["out"], F.array(acc["cur"])).alias("out"), x.alias("cur")))
    )
    return F.aggregate(items, start, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))


def split_long(text: Column, most: int = CONFIG.segment_max_chars) -> Column:
    """Sentences packed up to `most` characters; a sentence that is longer goes by clauses, a clause that is longer by
    words. What a long sentence leaves is not packed with its neighbours."""

    def level(parts: Column, finer) -> Column:
        return F.flatten(F.transform(pack_texts(parts, most), lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(finer(x))))

    words = lambda x: pack_texts(F.split(x, r"(?U)\s+"), most)
    clauses = lambda x: level(F.split(x, SOFT_BREAK), words)
    return F.when(F.length(text) <= most, F.array(text)).otherwise(level(F.split(text, SENTENCE_END), clauses))


def segment(paragraphs: DataFrame, most: int = CONFIG.segment_max_chars) -> DataFrame:
    """([book,] chapter, paragraph, text) to ([book,] chapter, idx, paragraph, hint, text), idx dense from 0 in each
    chapter."""
    keys = scope(paragraphs)
    parts = paragraphs.select(*keys, "paragraph", F.posexplode(paragraph_spans(F.col("text"))).alias("part", "s"))
    pieces = parts.select(*keys, "paragraph", "part", F.col("s.hint").alias("hint"), F.posexplode(split_long(F.col("s.text"), most)).alias("piece", "text"))
    order = Window.partitionBy(*keys).orderBy("paragraph", "part", "piece")
    return pieces.select(*keys, (F.row_number().over(order) - 1).alias("idx"), "paragraph", "hint", "text")


def chunk(spans: DataFrame, most: int = CONFIG.chunk_max_chars) -> DataFrame:
    """([book,] chapter, paragraph, chunk): paragraphs dealt to chunks from 1. A chunk is closed before a paragraph that
    does not fit, and behind narration once it is seven tenths full."""
    keys = scope(spans)
    groups = spans.groupBy(*keys, "paragraph").agg(F.sum(F.length("text")).alias("size"), F.bool_and(F.col("hint") == "narration").alias("plain"))
    soft = int(most * 0.7)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("paragraph")
        at, held, out = 1, 0, []
        for size, plain in zip(pdf["size"].tolist(), pdf["plain"].tolist(), strict=True):
            if held and held + size > most:
                at, held = at + 1, 0
            out.append(at)
            held += size
            if plain and held >= soft:
                at, held = at + 1, 0
        return pdf[[*keys, "paragraph"]].assign(chunk=np.array(out, np.int32))

    schema = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in (*keys, "paragraph")) + ", chunk int"
    return groups.groupBy(*keys).applyInPandas(deal, schema)


def chunk_context(chunks: DataFrame, paragraphs: DataFrame, before: int = CONFIG.chunk_context_paragraphs) -> DataFrame:
    """([book,] chapter, chunk, context): the texts of the paragraphs before a chunk's first one."""
    keys = scope(chunks)
    firsts = chunks.groupBy(*keys, "chunk").agg(F.min("paragraph").alias("first"))
    wanted = firsts.select(*keys, "chunk", F.explode_outer(F.sequence(F.greatest(F.lit(0), F.col("first") - before), F.col("first"))).alias("paragraph"), "first").filter("paragraph < first")
    found = wanted.join(paragraphs.select(*keys, "paragraph", "text"), [*keys, "paragraph"])
    lists = found.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("x"))
    return firsts.join(lists, [*keys, "chunk"], "left").select(*keys, "chunk", F.coalesce(F.transform("x", lambda p: p["text"]), F.array().cast("array<string>")).alias("context"))


def _cuts(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For paragraphs of a block: the running sizes; the place where the last part begins if a part begins at a
    paragraph; and how many parts begin behind that paragraph."""
    n = len(sizes)
    ends = np.cumsum(sizes)
    after = np.maximum(np.searchsorted(ends, ends - sizes + most, "right"), np.arange(n) + 1)
    last, more = np.arange(n), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            last[i], more[i] = last[after[i]], more[after[i]] + 1
    return ends, last, more


def pack_chapters(paragraphs: DataFrame, most: int = CONFIG.fallback_chapter_chars) -> DataFrame:
    """(book, paragraph, part): paragraphs of a book without headings dealt to parts from 1 by a running size that starts
    anew when the next paragraph does not fit.

    No book meets in one task: blocks of neighbours say what becomes of any size that enters them (only the paragraphs
    within `most` characters of their beginning can be the first to overflow), the short list of blocks is walked, and
    each block then deals its paragraphs.
    """
    x = blocked(paragraphs.select("book", F.col("paragraph").cast("long").alias("paragraph"), F.length("text").cast("long").alias("size")), ["book"], ["paragraph"])
    book = x.schema["book"].dataType.simpleString()

    def enters(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("paragraph")
        sizes = pdf["size"].to_numpy()
        ends, last, more = _cuts(sizes, most)
        k = min(len(ends), int(np.searchsorted(ends, most, "right")) + 1)
        left = ends[-1] - ends[last[:k]] + sizes[last[:k]]
        return pd.DataFrame({"book": [pdf["book"].iloc[0]], "block": [pdf["block"].iloc[0]], "at": [int(pdf["paragraph"].iloc[0])], "total": [int(ends[-1])], "ends": [ends[:k].tolist()], "left": [left.tolist()], "parts": [more[:k].tolist()]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held, part, out = None, 1, []
        for r in pdf.sort_values("at").itertuples():
            out.append((r.book, r.block, -1 if held is None else held, part))
            first = 0 if held is None else int(np.searchsorted(r.ends, most - held, "right"))
            if held is not None and first >= len(r.ends):
                held += r.total
            else:
                part += int(r.parts[first]) + (held is not None)
                held = int(r.left[first])
        return pd.DataFrame(out, columns=["book", "block", "held", "first"])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("paragraph")
        sizes = pdf["size"].tolist()
        held, part, out = int(pdf["held"].iloc[0]), int(pdf["first"].iloc[0]), []
        for size in sizes:
            if held >= 0 and held + size > most:
                part, held = part + 1, 0
            out.append(part)
            held = max(held, 0) + size
        return pdf[["book", "paragraph"]].assign(part=np.array(out, np.int32))

    known = x.groupBy("book", "block").applyInPandas(enters, f"book {book}, block int, at long, total long, ends array<long>, left array<long>, parts array<long>")
    known = stored(known.groupBy("book").applyInPandas(walk, f"book {book}, block int, held long, first long"), "walked")
    return x.join(known, ["book", "block"]).groupBy("book", "block").applyInPandas(deal, f"book {book}, paragraph long, part int")
