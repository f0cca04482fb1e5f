"""A quality classifier: naive Bayes support vectors.

A text is the set of its n-gram indicators: words, word pairs, and runs of word shapes (case, digits, symbols, whether a
word repeats one of the two before it). Each indicator is scaled by the log-count ratio of its smoothed frequencies in
the two classes, and a linear hinge loss is minimised over the scaled indicators by dual coordinate descent. A held part
of the sample turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from storyloom.llm import textkit as T
from storyloom.llm.samples import fitted, labelled
from storyloom.llm.storage import ID, TEXT

#: Buckets of words and of word pairs (a power of two each); buckets of shape runs follow.
WORD_BITS = 17
SHAPE_BITS = 14
WIDTH = (2 << WORD_BITS) + (1 << SHAPE_BITS)
#: Kinds of byte: 0 other ASCII, 1 lower case, 2 upper case, 3 digit, 4 symbol, 5 sentence sign, 6 not ASCII.
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58] = 1, 2, 3
KIND[list(b"#*$%&|<>{}[]~^_=+/\\@")] = 4
KIND[list(b".,;:!?")] = 5
KIND[128:] = 6


def shapes(w: T.Words) -> np.ndarray:
    """A small code for each word: its first and last kind, which kinds occur, its length class, whether it repeats."""
    kinds = KIND[w.data]
    out = kinds[w.starts].astype(np.int64) * 7 + kinds[w.ends - 1]
    sums = np.zeros(len(w.data) + 1, np.int32)
    for k in (1, 2, 3, 4):
        np.cumsum(kinds == k, out=sums[1:])
        out = out * 2 + (sums[w.ends] > sums[w.starts])
    out = out * 4 + np.minimum((w.ends - w.starts) // 4, 3)
    again = np.zeros(len(out), np.int64)
    again[1:] |= w.hashes[1:] == w.hashes[:-1]
    again[2:] |= 2 * (w.hashes[2:] == w.hashes[:-2])
    first = w.bounds[:-1][w.bounds[:-1] < len(out)]
    again[first] = 0
    second = first[w.bounds[1:][w.bounds[:-1] < len(out)] - first > 1] + 1
    again[second] &= 1  # the word two before it is another text's
    return out * 4 + again


def indicators(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its indicators' buckets, with repeats."""
    low = T.U((1 << WORD_BITS) - 1)
    for i, j in T.slices(starts, ends):
        w = T.words(raw, starts[i:j], ends[i:j], fold=True)
        one = (w.hashes & low).astype(np.int64)
        two = (T.windows(w.hashes, 2) & low).astype(np.int64) + (1 << WORD_BITS)
        code = T.mix(shapes(w).astype(T.U))
        runs = [(T.windows(code, n) >> T.U(64 - SHAPE_BITS)).astype(np.int64) + (2 << WORD_BITS) for n in (1, 2, 3)]
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            yield np.concatenate([one[a:b], two[a : max(a, b - 1)], *(x[a : max(a, b - k)] for k, x in enumerate(runs))])


class Model:
    def __init__(self, weights: np.ndarray, constant: float, slope: float, shift: float):
        self.weights, self.constant, self.slope, self.shift = weights.astype(np.float32), constant, slope, shift

    def margins(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        out, seen = np.zeros(len(s)), np.zeros(WIDTH, bool)
        for i, x in enumerate(indicators(raw, s, e)):
            if len(x) < 4000:
                x = np.unique(x)
            else:
                seen[x] = True
                x = np.flatnonzero(seen)
                seen[x] = False
            out[i] = self.weights[x].sum(dtype=np.float64) / max(1.0, np.sqrt(len(x))) + self.constant
        return out

    def scores(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(raw, s, e) + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float = 1.0, passes: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss; y is -1 or 1; the last weight is the constant's."""
    w, constant = np.zeros(WIDTH), 0.0
    alpha, norm = np.zeros(len(rows)), np.array([(v**2).sum() + 1 for v in values])
    limit = np.where(y > 0, c * len(y) / (2 * (y > 0).sum()), c * len(y) / (2 * (y < 0).sum()))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slack = y[i] * (w[x] @ v + constant) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                constant += step
                alpha[i] = new
    return w, constant


def fit(rows: list[tuple[str, object]]) -> Model:
    """A model from texts and labels 0 or 1; with one class only, every score is that class's smoothed share."""
    y = np.array([int(v) for _, v in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Model(np.zeros(WIDTH), 0.0, 0.0, float(np.log((n1 + 1) / (n0 + 1))))
    raw, s, e, _ = T.text_bytes(pa.array([t for t, _ in rows], pa.string()))
    sets = [np.unique(x) for x in indicators(raw, s, e)]
    p, q = np.ones(WIDTH), np.ones(WIDTH)
    for x, v in zip(sets, y, strict=True):
        (p if v else q)[x] += 1
    ratio = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))
    ratio[(p + q) < 4] = 0
    values = [ratio[x] / max(1.0, np.sqrt(len(x))) for x in sets]
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    w, b = descend([sets[i] for i in use], [values[i] for i in use], 2 * y[use] - 1)
    test = np.flatnonzero(held) if held.any() else use
    m = np.array([w[sets[i]] @ values[i] + b for i in test])
    return Model(w * ratio, b, *platt(m, y[test]))


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities, by Newton's method on smoothed targets."""
    n1 = y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * m).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (h * m * m).sum() + 1e-3, (h * m).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        a = min(max(a, 1e-3), 50.0)
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out=None, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """fit() on up to `most` labelled rows (a bounded sample) that are not held out."""
    use = (lambda i: F.lit(True)) if held_out is None else (lambda i: ~held_out(i))
    return fitted(labelled(docs, labels, label_col, use, most, id_col, text_col), fit)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: _id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Null and empty texts have no indicator and get the score of the constant; very long texts are read whole, in memory of
    their size. Each row is scored alone, so null or repeated ids do no harm and equal rows have equal scores; a score of
    exactly 0.5 counts as 1; an empty table gives no rows. Other columns are not read, so they may have any name.
    """
    rows = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            p = m.scores(raw, s, e)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [ID, "score", "predicted"])

    return rows.mapInArrow(run, S.StructType([rows.schema[ID], S.StructField("score", S.DoubleType()), S.StructField("predicted", S.IntegerType())]))
