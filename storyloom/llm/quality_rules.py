"""Quality rules as a short-circuit cascade.

Every text gets the base counts. The texts that pass the base test then meet the rules one after the other; a rule does
its own work on the texts that all rules before it passed, and on no others. The order is by rejections per second of
cost, both measured on a bounded sample: the rule that rejects most for its cost comes first, then the best on what that
one left, and so on, so rules that reject the same texts do not count twice. Costs are medians of repeated runs, and the
order is fixed before the pass over the table. The verdict is the conjunction of the rules, so it does not depend on the
order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from statistics import median
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import textkit as T
from storyloom.llm.samples import fitted
from storyloom.llm.storage import ID, TEXT

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Texts(NamedTuple):
    """Some texts with their base counts; the rules read these and work out the rest themselves."""

    words: T.Words
    lines: np.ndarray
    counts: dict[str, np.ndarray]


class Rule(NamedTuple):
    """rejects: for a batch and the positions of texts, which of them to reject."""

    name: str
    rejects: Callable[[Texts, np.ndarray], np.ndarray]


def _symbols(x: Texts, at: np.ndarray) -> np.ndarray:
    return 10 * x.counts["n_symbols"][at] > x.counts["word_chars"][at]


def _duplicate_lines(x: Texts, at: np.ndarray) -> np.ndarray:
    return 2 * x.counts["n_dup_lines"][at] > x.lines[at]


def _word_length(x: Texts, at: np.ndarray) -> np.ndarray:
    n, chars = x.counts["n_words"][at], x.counts["word_chars"][at]
    return (chars < 2 * n) | (chars > 15 * n)


def _few_distinct_words(x: Texts, at: np.ndarray) -> np.ndarray:
    return np.fromiter((20 * len(np.unique(x.words.hashes[x.words.of(i)])) < x.counts["n_words"][i] for i in at.tolist()), bool, len(at))


def _few_letters(x: Texts, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at.tolist()):
        s, e = x.words.starts[x.words.of(i)], x.words.ends[x.words.of(i)]
        if len(s):
            letters = np.concatenate([[0], np.cumsum(T.letter_starts(x.words.data[s[0] : e[-1]]))])
            out[k] = 2 * int((letters[e - s[0]] > letters[s - s[0]]).sum()) < len(s)
    return out


def _one_pair(x: Texts, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), bool)
    for k, i in enumerate(at.tolist()):
        pairs = T.windows(x.words.hashes[x.words.of(i)], 2)
        out[k] = bool(len(pairs)) and 5 * int(np.unique(pairs, return_counts=True)[1].max()) > len(pairs)
    return out


#: Reject: over 10 % symbols; over half of the lines repeat earlier ones; mean word length out of 2..15; under 5 %
#: distinct words; under half of the words hold a letter; one pair of neighbours is over 20 % of all pairs.
RULES = (
    Rule("symbols", _symbols), Rule("duplicate_lines", _duplicate_lines), Rule("word_length", _word_length),
    Rule("few_distinct_words", _few_distinct_words), Rule("few_letters", _few_letters), Rule("one_pair", _one_pair),
)


def measure(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Texts:
    """The base counts of some texts."""
    w = T.words(raw, starts, ends)
    n = len(w.doc)
    doc_of = np.repeat(np.arange(n), np.diff(w.bounds))
    word = ~T.SEPARATOR[w.data]
    per = lambda flag: np.add.reduceat(flag, w.doc, dtype=np.int64) if n else np.zeros(0, np.int64)
    chars = per(word & ((w.data & 0xC0) != 0x80))
    symbols = per(SYMBOLS[w.data])
    breaks = np.flatnonzero(w.data == 10)
    a, b = breaks[:-1] + 1, breaks[1:]
    has = np.searchsorted(w.starts, b) > np.searchsorted(w.starts, a)
    a, b = a[has], b[has]
    line_doc = np.searchsorted(w.doc, a, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    keys = np.unique(np.stack([line_doc.astype(T.U), T.span_hashes(w.data, a, b)]), axis=1) if len(a) else np.zeros((2, 0), T.U)
    dup_lines = lines - np.bincount(keys[0].astype(np.int64), minlength=n)
    repeated = np.zeros(len(w.starts), bool)
    if len(w.starts) >= 3:
        whole = np.flatnonzero(doc_of[2:] == doc_of[:-2])
        key = T.mix(T.windows(w.hashes, 3)[whole] + doc_of[whole].astype(T.U) * T.U(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        for k in range(3):
            repeated[whole[hit] + k] = True
    return Texts(w, lines, {"n_words": np.diff(w.bounds), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(doc_of[repeated], minlength=n)})


def base_failed(counts: dict[str, np.ndarray], least: int = 50) -> np.ndarray:
    return (counts["n_words"] < least) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def cascade(x: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """Which texts pass the base test and every rule."""
    left = np.flatnonzero(~base_failed(x.counts))
    for rule in rules:
        if len(left):
            left = left[~rule.rejects(x, left)]
    kept = np.zeros(len(x.lines), bool)
    kept[left] = True
    return kept


def ordered(texts: list[str | None], rules: tuple[Rule, ...] = RULES, runs: int = 5) -> list[str]:
    """The names of the rules by rejections per second on the given texts that pass the base test, each on what the
    rules before it left."""
    raw, s, e, _ = T.text_bytes(pa.array(texts, pa.string()))
    x = measure(raw, s, e)
    left = np.flatnonzero(~base_failed(x.counts))

    def gain(rule: Rule, at: np.ndarray) -> tuple[float, np.ndarray]:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            rejected = rule.rejects(x, at)
            times.append(time.perf_counter() - began)
        return int(rejected.sum()) / max(median(times), 1e-9), rejected

    out, rest = [], list(rules)
    while rest:
        found = [(gain(rule, left), rule) for rule in rest]
        (_, rejected), best = max(found, key=lambda f: f[0][0])
        out.append(best.name)
        rest.remove(best)
        left = left[~rejected]
    return out


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 500, sample_text_bytes: int = 1 << 16) -> DataFrame:
    """One row per row of docs: _id, the base counts (long), base_failed and kept.

    Null and empty texts have zero words and fail the base test; very long texts are judged whole; ids may be null or
    repeat, each row is judged alone, so equal rows get equal verdicts; an empty table gives no rows; only the two named
    columns are read, so other columns may have any name. The rules' order is estimated on about `sample_rows` rows (twice
    as many at most) of up to `sample_text_bytes` bytes, drawn by a hash; it changes the cost, not the verdict.
    """
    rows = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT))
    drawn, every = F.xxhash64(ID, TEXT), max(1, rows.count() // sample_rows)
    sample = rows.filter((F.pmod(drawn, F.lit(every)) == 0) & (F.octet_length(TEXT) <= sample_text_bytes)).select(drawn.alias("i"), F.col(TEXT).alias("t"), F.lit(0).alias("y")).limit(2 * sample_rows)
    by_name = {r.name: r for r in rules}
    best = tuple(by_name[n] for n in fitted(sample, lambda pairs: ordered([t for t, _ in pairs], rules)))
    schema = f"{ID} {rows.schema[ID].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            for i, j in T.slices(s, e):
                x = measure(raw, s[i:j], e[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x.counts[c], pa.int64()) for c in COUNTS), pa.array(base_failed(x.counts)), pa.array(cascade(x, best))], [ID, *COUNTS, "base_failed", "kept"])

    return rows.mapInArrow(judge, schema)
