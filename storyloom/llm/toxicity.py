"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, report, other). Three transducers rewrite the classes of a
clause: the first marks insults and threats that a negation governs, the second those that reported speech governs, the
third those that follow or precede a target. They are composed into one machine, which reads each clause once; the
kinds of match it emits are counted, and a logistic model learned from labelled rows weighs them.

Insult words and word beginnings (for inflected insults) are learned from the labelled rows and added to a small fixed
list. Only clauses with an insult or threat reach the machine; finding them is one vectorised pass over the words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm import textkit as T
from storyloom.llm.samples import fitted, labelled
from storyloom.llm.storage import ID, TEXT

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Words of each class.
INSULTS = "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting imbecile bastard dumb vermin idiota estúpido imbécil basura idiotin dummkopf abschaum crétin ordure"
THREATS = "kill hurt destroy beat smash murder burn shoot strangle töten vernichten matar destruir tuer détruire"
TARGETS = "you your yours yourself u they them he she him her ihr euch dich dir du tú usted ustedes vosotros vous toi"
NEGATIONS = "not never isn't aren't wasn't don't doesn't nicht kein keine niemals nunca jamás jamais pas"
REPORTS = "said says quoted wrote reported claimed called alleged sagte schrieb dijo escribió dit écrit"
#: Byte lengths at which word beginnings are compared.
STEMS = (4, 5, 6, 7, 8)
KINDS = ("insult", "threat", "insult_at", "threat_at", "negated", "reported")
_KIND = {k: i for i, k in enumerate(KINDS)}
#: How many words a negation, a report and a target govern.
SPAN = {NEGATION: 2, REPORT: 8, TARGET: 4}
PLAIN, NEGATED, REPORTED = 0, 1, 2


class Transducer:
    """A deterministic machine: step(state, symbol) gives the next state and the symbol that it writes."""

    def __init__(self, states: int, step):
        self.states, self.step = states, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this machine writes, the other reads."""

        def step(state: int, symbol):
            a, b = divmod(state, other.states)
            a, out = self.step(a, symbol)
            b, out = other.step(b, out)
            return a * other.states + b, out

        return Transducer(self.states * other.states, step)


def _governor(trigger: int, mark: int) -> Transducer:
    """Marks unmarked insults and threats up to SPAN[trigger] words behind a trigger. State: words still governed."""

    def step(left: int, symbol):
        kind, marked, aimed = symbol
        if kind == trigger:
            return SPAN[trigger], symbol
        if left and kind in (INSULT, THREAT) and marked == PLAIN:
            symbol = (kind, mark, aimed)
        return max(0, left - 1), symbol

    return Transducer(SPAN[trigger] + 1, step)


def _aim(left: int, symbol):
    kind, marked, _ = symbol
    if kind == TARGET:
        return SPAN[TARGET], symbol
    return max(0, left - 1), ((kind, marked, True) if left and kind in (INSULT, THREAT) else symbol)


MACHINE = _governor(NEGATION, NEGATED).then(_governor(REPORT, REPORTED)).then(Transducer(SPAN[TARGET] + 1, _aim))


def read_clause(classes: list[int], back: bool = True) -> list[int]:
    """The kinds of match in one clause; a target behind an insult aims it too."""
    state, out, pending = 0, [], []
    for at, kind in enumerate(classes):
        state, (kind, marked, aimed) = MACHINE.step(state, (kind, PLAIN, False))
        if kind in (INSULT, THREAT):
            if marked == NEGATED:
                out.append(_KIND["negated"])
            elif marked == REPORTED:
                out.append(_KIND["reported"])
            else:
                out.append(_KIND[("insult" if kind == INSULT else "threat") + "_at" * aimed])
                if back and not aimed:
                    pending.append((at, len(out) - 1))
        elif kind == TARGET:
            for where, i in pending:
                if at - where <= SPAN[TARGET]:
                    out[i] += 2
            pending = []
    return out


def word_key(words: list[bytes]) -> np.ndarray:
    """The hashes that the scan computes for these words."""
    data = b" ".join(words)
    n = np.array([len(w) for w in words], np.int64)
    s = np.concatenate([[0], np.cumsum(n + 1)])[:-1] if len(n) else n
    return T.span_hashes(np.frombuffer(data, np.uint8), s, s + n, fold=True)


class Lexicon:
    """Word classes by hash; hashes of more insults; hashes of word beginnings that count as insults, by length."""

    def __init__(self, classes: dict[bytes, int], insults: np.ndarray | None = None, stems: dict[int, np.ndarray] | None = None):
        insults = np.zeros(0, T.U) if insults is None else insults
        keys = np.concatenate([word_key(list(classes)), insults])
        kinds = np.concatenate([np.array(list(classes.values()), np.int8), np.full(len(insults), INSULT, np.int8)])
        self.keys, first = np.unique(keys, return_index=True)
        self.kinds = kinds[first]
        self.stems = {n: np.sort(x) for n, x in sorted((stems or {}).items())}

    def classify(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s), np.int8)
        h = T.span_hashes(data, s, e, fold=True)
        out[_in(h, self.keys)] = 1
        hit = np.flatnonzero(out)
        out[hit] = self.kinds[np.searchsorted(self.keys, h[hit])]
        for n, keys in self.stems.items():
            long = np.flatnonzero((e - s >= n) & (out == OTHER))
            out[long[_in(T.span_hashes(data, s[long], s[long] + n, fold=True), keys)]] = INSULT
        return out


def _in(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted keys; a table of their upper bits turns most away first."""
    if not len(keys):
        return np.zeros(len(h), bool)
    table = np.zeros(1 << 16, bool)
    table[(keys >> T.U(48)).astype(np.int64)] = True
    out = table[(h >> T.U(48)).astype(np.int64)]
    near = np.flatnonzero(out)
    out[near] = keys[np.minimum(np.searchsorted(keys, h[near]), len(keys) - 1)] == h[near]
    return out


CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[list(b".;:!?")] = True


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    return np.isin(T.categories(), [ord("L"), ord("M")])


def last_points(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the code points that end before these places begin."""
    at = ends - 1
    for _ in range(3):
        at = at - ((data[np.maximum(at, 0)] & 0xC0) == 0x80)
    return at


def cores(w: T.Words, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Words without the runs of signs that are no letters at their ends; of a word without letters the first byte.

    Runs are read a sign at a time in all words at once; those longer than `steps` in each word alone."""
    s, e = w.starts.copy(), w.ends.copy()
    known = letters()
    left = np.arange(len(s))
    for _ in range(steps):
        c, n = T.code_points(w.data, s[left])
        left, n = left[~known[c]], n[~known[c]]
        s[left] += n
        left = left[s[left] < e[left]]
        if not len(left):
            break
    right = np.flatnonzero(s < e)
    for _ in range(steps):
        at = last_points(w.data, e[right])
        sign = ~known[T.code_points(w.data, at)[0]]
        right = right[sign]
        e[right] = at[sign]
        right = right[e[right] > s[right]]
        if not len(right):
            break
    for i in np.union1d(left, right).tolist():
        text = w.data[s[i] : e[i]].tobytes().decode("utf-8", "replace")
        first = next((k for k, c in enumerate(text) if known[ord(c)]), len(text))
        last = next((k for k in range(len(text), first, -1) if known[ord(text[k - 1])]), first)
        s[i] += len(text[:first].encode())
        e[i] = s[i] + len(text[first:last].encode())
    none = s >= e
    s[none], e[none] = w.starts[none], w.starts[none] + 1
    return s, e


def with_gaps(marks: np.ndarray, kinds: np.ndarray) -> list[int]:
    """The classes of a clause's words at `marks`, with the other words between them. Runs of other words longer than any
    span are written as long as the longest: behind these the machine has forgotten all, whatever the length."""
    gaps = np.minimum(np.diff(marks, prepend=marks[0] - 1) - 1, max(SPAN.values()))
    out = np.full(len(marks) + int(gaps.sum()), OTHER, np.int64)
    out[np.arange(len(marks)) + np.cumsum(gaps)] = kinds[marks]
    return out.tolist()


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """For each text the log of 1 + matches of each kind, of 1 + matches per 100 words, and whether any matches."""
    w = T.words(raw, starts, ends, hashed=False)
    counts = np.zeros((len(w.doc), len(KINDS) + 2))
    s, e = cores(w)
    kinds = lexicon.classify(w.data, s, e)
    last = np.zeros(len(kinds), bool)  # whether a clause ends with this word
    last[w.bounds[1:][np.diff(w.bounds) > 0] - 1] = True
    last = np.flatnonzero(last | CLAUSE_END[w.data[w.ends - 1]])
    hits = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    clauses = np.unique(np.searchsorted(last, hits))
    marks = np.flatnonzero(kinds != OTHER)
    close = np.searchsorted(marks, last[clauses], "right")
    open_ = np.searchsorted(marks, np.where(clauses > 0, last[clauses - 1], -1), "right")
    doc = np.searchsorted(w.bounds, last[clauses], "right") - 1
    for i, j, d in zip(open_.tolist(), close.tolist(), doc.tolist(), strict=True):
        for kind in read_clause(with_gaps(marks[i:j], kinds)):
            counts[d, kind] += 1
    total = counts.sum(axis=1)
    counts[:, -2] = 100 * total / np.maximum(1, np.diff(w.bounds))
    counts[:, -1] = total > 0
    return np.log1p(counts)


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> Lexicon:
    """The fixed lists, and the words and beginnings that occur in toxic texts almost only.

    Items are told by hash. Among all items as frequent, fewer than 0.05 of those taken would come from toxic texts alone
    if labels were dealt at random. Items are taken by what they explain: a text counts half as much with each item taken
    that it holds, so the rare words of a toxic text with many copies, which its insults explain already, are left.
    """
    classes = {x.encode(): kind for kind, xs in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for x in xs.split()}
    if not len(texts):
        return Lexicon(classes)
    raw, s, e, _ = T.text_bytes(pa.array(texts, pa.string()))
    rate = float(toxic.mean())
    totals, items = np.zeros(202), []
    for n in (0, *STEMS):  # one kind of item at a time, to bound the driver's memory
        docs, hashes = [], []
        for i, j in T.slices(s, e):
            w = T.words(raw, s[i:j], e[i:j], hashed=False)
            a, b = cores(w)
            use = b - a > (n or 2)
            doc = np.repeat(np.arange(i, j, dtype=np.int32), np.diff(w.bounds))[use]
            h = T.span_hashes(w.data, a[use], a[use] + n if n else b[use], fold=True)
            once = np.unique(T.mix(h + doc.astype(T.U) * T.U(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
            docs.append(doc[once])
            hashes.append(h[once])
        doc = np.concatenate(docs)
        distinct, inverse, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        yes = np.bincount(inverse, toxic[doc], len(distinct))
        totals += np.bincount(np.minimum(count, 201), minlength=202)
        good = (yes >= 3) & (yes >= 20 * (count - yes))
        at = np.flatnonzero(good[inverse] & (toxic[doc] > 0))
        at = at[np.argsort(inverse[at], kind="stable")]
        names, cut = np.unique(inverse[at], return_index=True)
        items += [(n, distinct[name], held) for name, held in zip(names, np.split(doc[at], cut[1:]), strict=True)] if len(at) else []
    as_many = np.cumsum(totals[::-1])[::-1]
    least = next((k for k in range(3, 202) if as_many[k] * rate**k < 0.05), 202)
    weight = np.ones(len(texts))
    heap = [(-float(len(held)), n, k) for k, (n, _, held) in enumerate(items) if len(held) >= least]
    heapq.heapify(heap)
    taken: dict[int, list] = {n: [] for n in (0, *STEMS)}
    while heap:
        gain, n, k = heapq.heappop(heap)
        now = float(weight[items[k][2]].sum())
        if now < least:
            continue
        if now < -gain - 1e-9:
            heapq.heappush(heap, (-now, n, k))
            continue
        weight[items[k][2]] /= 2
        taken[n].append(items[k][1])
    return Lexicon(classes, np.array(taken[0], T.U), {n: np.array(x, T.U) for n, x in taken.items() if n and x})


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-6, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Weights of 0 or more, and a constant, by projected gradient descent with momentum."""
    w, b, v, vb = np.zeros(x.shape[1]), -2.0, 0.0, 0.0
    rate = 0.5 / (0.25 * (x**2).sum(axis=1).mean() + 0.25 + l2) if len(x) else 0.0
    for _ in range(steps if len(x) else 0):
        d = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        v, vb = 0.9 * v - rate * (x.T @ d / len(x) + l2 * w), 0.9 * vb - rate * d.mean()
        w, b = np.maximum(0, w + v), b + vb
    return w, float(b)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, constant: float):
        self.lexicon, self.weights, self.constant = lexicon, weights, constant

    def scores(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out = [features(raw, s[i:j], e[i:j], self.lexicon) for i, j in T.slices(s, e)]
        x = np.concatenate(out) if out else np.zeros((0, len(KINDS) + 2))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.constant, -30, 30)))


def fit(rows: list[tuple[str, object]]) -> Model:
    """A model from texts and labels; without toxic rows the fixed lists and fixed weights decide."""
    texts, y = [t for t, _ in rows], np.array([int(v) for _, v in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(learn_lexicon([], y), np.array([1.0, 1.5, 2.0, 3.0, 0.2, 0.2, 1.0, 1.0]), -3.0)
    lexicon = learn_lexicon(texts, y)
    raw, s, e, _ = T.text_bytes(pa.array(texts, pa.string()))
    x = np.concatenate([features(raw, s[i:j], e[i:j], lexicon) for i, j in T.slices(s, e)])
    return Model(lexicon, *fit_logistic(x, y))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out=None, most: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """fit() on up to `most` labelled rows (a bounded sample) that are not held out."""
    use = (lambda i: F.lit(True)) if held_out is None else (lambda i: ~held_out(i))
    return fitted(labelled(docs, labels, label_col, use, most, id_col, text_col), fit)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: _id, score (0 to 1) and predicted (1 if score >= 0.5); carry: more columns of docs.

    Null and empty texts have no match and get the score of a clean text; very long texts are read whole, clause by clause.
    Each row is scored alone, so null or repeated ids do no harm and equal rows have equal scores; a score of exactly 0.5
    counts as toxic; an empty table gives no rows. Columns of docs that are not carried may have any name.
    """
    rows = docs.select(F.col(text_col).cast("string").alias(TEXT), F.col(id_col).alias(ID), *(F.col(f"`{c}`") for c in carry))
    kept = [f for f in rows.schema.fields if f.name != TEXT]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(0))
            p = m.scores(raw, s, e)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*(f.name for f in kept), "score", "predicted"])

    from pyspark.sql import types as S

    return rows.mapInArrow(run, S.StructType([*kept, S.StructField("score", S.DoubleType()), S.StructField("predicted", S.IntegerType())]))


def clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that the model predicts to be toxic, with its columns and row for row: null and empty texts
    stay, repeated rows stay or go together, an empty table stays empty, and columns may have any names."""
    columns = docs.columns
    plain = [f"c{k}" for k in range(len(columns))]
    renamed = docs.toDF(*plain)
    at = {c: p for c, p in zip(columns, plain, strict=True)}
    out = score(renamed, model, at[id_col], at[text_col], tuple(plain)).filter("predicted = 0")
    return out.select(*plain).toDF(*columns)
