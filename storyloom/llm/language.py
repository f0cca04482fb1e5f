"""Language identification by a linear-chain conditional random field over words.

Each word has features: its beginnings and endings, its byte n-grams, and itself if a learned lexicon holds it. Feature
weights and transitions between the languages of neighbouring words are learned from code-switched sequences, spliced
from runs of words of labelled texts. Forward-backward gives each word's probabilities, over the whole text; the mean
over the words is the text's.

All texts of a slice step together, cut into blocks, so a step is one matrix product and a very long text takes no more
steps than others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from storyloom.llm import textkit as T
from storyloom.llm.samples import fitted, labelled
from storyloom.llm.storage import ID, TEXT

BITS = 16
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
UNDETERMINED = "und"


def word_features(data: np.ndarray, s: np.ndarray, e: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of some words, one after the other, and how many each has."""
    n, size = len(s), e - s
    low = T.U((1 << BITS) - 1)
    at, word = [], []

    def add(which: np.ndarray, values: np.ndarray, salt: int) -> None:
        at.append((T.mix(values + T.U(salt * 0x9E3779B97F4A7C15 % 2**64)) & low).astype(np.int64))
        word.append(which)

    lower = T.LOWER[data].astype(T.U)
    for k in (1, 2, 3):
        w = np.flatnonzero(size >= k)
        a, b = lower[s[w]], lower[e[w] - k]
        for i in range(1, k):
            a, b = a * T.U(257) + lower[s[w] + i], b * T.U(257) + lower[e[w] - k + i]
        add(w, a, k)
        add(w, b, 10 + k)
    total = int(size.sum())
    of = np.repeat(np.arange(n), size)
    pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
    grams = lower[pos]
    for k in (2, 3):
        pos1 = pos + (k - 1)
        fits = pos1 < np.repeat(e, size)
        grams = grams * T.U(257) + lower[np.minimum(pos1, len(lower) - 1)]
        add(of[fits], grams[fits], 20 + k)
    if len(lexicon):
        known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes)
        add(known, hashes[known], 30)
    word_of, features = np.concatenate(word), np.concatenate(at)
    order = np.argsort(word_of, kind="stable")
    return features[order], np.bincount(word_of, minlength=n)


def emissions(features: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of the weights of each word's features, one column per language; every word has a feature."""
    return np.add.reduceat(weights[features], np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, weights.shape[1]), weights.dtype)


#: Words of a block of a sequence.
BLOCK = 128


def marginals(emission: np.ndarray, bounds: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences that lie one after the other: each word's probabilities, and the expected number
    of transitions between languages.

    Sequences are cut into blocks, and all blocks step together, so a long sequence takes no more steps than a short one:
    first each block's words are multiplied into one matrix, then the states at the blocks' edges are carried from block
    to block, then every block is walked from its edges. That is exact, as the products are associative.
    """
    n, labels = emission.shape
    expected = np.zeros((labels, labels))
    out = np.empty_like(emission)
    if not n:
        return out, expected
    step = np.exp(transition - transition.max())
    local = np.exp(emission - emission.max(axis=1, keepdims=True))
    sizes = np.diff(bounds)
    pieces = -(-sizes // block)
    of = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = bounds[:-1][of] + number * block
    lengths = np.minimum(block, sizes[of] - number * block)
    order = np.argsort(-lengths, kind="stable")
    left = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), "left").tolist()  # how many blocks have a word t
    begins = np.zeros(n, bool)
    begins[bounds[:-1][sizes > 0]] = True

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    # A block's matrix; the first word of a sequence forgets what came before.
    whole = np.broadcast_to(np.eye(labels, dtype=local.dtype), (len(of), labels, labels)).copy()
    if pieces.max() > 1:
        for t, k in enumerate(left):
            at = starts[order[:k]] + t
            x = np.where(begins[at][:, None, None], whole[order[:k]].sum(axis=2, keepdims=True), whole[order[:k]] @ step) * local[at][:, None, :]
            whole[order[:k]] = x / x.max(axis=(1, 2), keepdims=True)
    ahead = np.full((len(of), labels), 1 / labels, local.dtype)  # the state before each block
    behind = np.ones((len(of), labels), local.dtype)  # and behind it
    first = np.cumsum(pieces) - pieces
    for k in range(1, int(pieces.max())):
        at = first[pieces > k] + k
        ahead[at] = scaled((ahead[at - 1][:, None, :] @ whole[at - 1])[:, 0])
    for k in range(int(pieces.max()) - 1, 0, -1):
        at = first[pieces > k] + k
        behind[at - 1] = scaled((whole[at] @ behind[at][:, :, None])[:, :, 0])
    alpha = np.empty_like(local)
    a = ahead[order]
    for t, k in enumerate(left):
        at = starts[order[:k]] + t
        a = scaled(np.where(begins[at][:, None], 1, a[:k] @ step) * local[at])
        alpha[at] = a
    b = behind[order]
    for t in range(len(left) - 1, -1, -1):
        k = left[t]
        at = starts[order[:k]] + t
        out[at] = scaled(alpha[at] * b[:k])
        x = local[at] * b[:k]
        inner = ~begins[at]
        before, later = alpha[at[inner] - 1], x[inner]
        expected += step * (before.T @ (later / ((before @ step) * later).sum(axis=1, keepdims=True)))
        b[:k] = scaled(x @ step.T)
    return out, expected


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, lexicon: np.ndarray):
        self.labels, self.weights, self.transition, self.lexicon = labels, weights.astype(np.float32), transition.astype(np.float32), lexicon

    def words(self, w: T.Words) -> np.ndarray:
        """The probabilities of each word's languages."""
        if not len(w.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        _, first, again = np.unique(w.hashes, return_index=True, return_inverse=True)
        features, counts = word_features(w.data, w.starts[first], w.ends[first], w.hashes[first], self.lexicon)
        return marginals(emissions(features, counts, self.weights)[again], w.bounds, self.transition)[0]

    def texts(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score: the mean probability over the text's words."""
        names, scores = [], np.zeros(len(s))
        for i, j in T.slices(s, e):
            w = T.words(raw, s[i:j], e[i:j], fold=True)
            p = self.words(w) if self.labels else None
            n = np.diff(w.bounds)
            letters = np.add.reduceat(LETTER[w.data], w.doc, dtype=np.int64) > 0
            for k in np.flatnonzero(~letters).tolist():
                letters[k] = any(c.isalpha() for c in raw[s[i + k] : e[i + k]].tobytes().decode("utf-8", "replace"))
            mean = np.zeros((j - i, max(1, len(self.labels))))
            if p is not None and len(p):
                some = np.flatnonzero(n)
                mean[some] = np.add.reduceat(p.astype(np.float64), w.bounds[:-1][some], axis=0) / n[some, None]
            best = mean.argmax(axis=1)
            good = letters & (n > 0) & bool(self.labels)
            names.extend(self.labels[b] if g else UNDETERMINED for b, g in zip(best.tolist(), good.tolist(), strict=True))
            scores[i:j] = np.where(good, np.clip(mean.max(axis=1), 0, 1), 0)
        return names, scores


def fit(rows: list[tuple[str, object]], sequences: int = 1500, run: int = 24, passes: int = 3, lexicon_size: int = 4000, seed: int = 11) -> Model:
    """A model from texts and languages. Sequences of about five runs of `run` words are spliced from random texts; a
    run is of the same language as the one before it in most cases. Adagrad on the conditional likelihood."""
    labels = sorted({str(y) for _, y in rows})
    if not labels:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), np.zeros(0, T.U))
    raw, s, e, _ = T.text_bytes(pa.array([t for t, _ in rows], pa.string()))
    w = T.words(raw, s, e, fold=True)
    y = np.array([labels.index(str(v)) for _, v in rows])
    full = np.flatnonzero(np.diff(w.bounds) > 0)
    if not len(full):
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), np.zeros(0, T.U))
    texts_with = Counter()
    for i in full.tolist():
        texts_with.update(set(w.hashes[w.of(i)].tolist()))
    lexicon = np.sort(np.array([h for h, n in texts_with.most_common(lexicon_size) if n >= 3], T.U))
    _, first, again = np.unique(w.hashes, return_index=True, return_inverse=True)
    features, counts = word_features(w.data, w.starts[first], w.ends[first], w.hashes[first], lexicon)
    offset = np.cumsum(counts) - counts
    rng = np.random.default_rng(seed)
    by = [full[y[full] == k] for k in range(len(labels))]
    have = np.array([k for k in range(len(labels)) if len(by[k])])
    weights, transition = np.zeros((1 << BITS, len(labels))), np.zeros((len(labels), len(labels)))
    g_w, g_t = np.full_like(weights, 1e-3), np.full_like(transition, 1e-3)

    def splice() -> tuple[np.ndarray, np.ndarray]:
        ids, tags, k = [], [], rng.choice(have)
        for _ in range(5):
            if rng.random() < 0.4:
                k = rng.choice(have)
            i = rng.choice(by[k])
            a, b = int(w.bounds[i]), int(w.bounds[i + 1])
            m = int(min(b - a, 1 + rng.integers(2 * run)))
            a += int(rng.integers(b - a - m + 1))
            ids.append(again[a : a + m])
            tags.append(np.full(m, k))
        return np.concatenate(ids), np.concatenate(tags)

    made = [splice() for _ in range(sequences)]
    for _ in range(passes):
        for at in range(0, sequences, 50):
            batch = made[at : at + 50]
            ids, tags = np.concatenate([x for x, _ in batch]), np.concatenate([t for _, t in batch])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x, _ in batch])])
            used, inv = np.unique(ids, return_inverse=True)
            take = np.repeat(offset[used] - (np.cumsum(counts[used]) - counts[used]), counts[used]) + np.arange(int(counts[used].sum()))
            f = features[take]
            p, expected = marginals(emissions(f, counts[used], weights)[inv], bounds, transition)
            d = p.copy()
            d[np.arange(len(tags)), tags] -= 1
            inside = np.ones(len(tags) - 1, bool)
            inside[bounds[1:-1] - 1] = False
            seen = np.zeros_like(transition)
            np.add.at(seen, (tags[:-1][inside], tags[1:][inside]), 1)
            per_word = np.stack([np.bincount(inv, d[:, k], len(used)) for k in range(len(labels))], axis=1)
            repeated = np.repeat(per_word, counts[used], axis=0)
            g = np.stack([np.bincount(f, repeated[:, k], 1 << BITS) for k in range(len(labels))], axis=1) / len(batch)
            gt = (expected - seen) / len(batch) + 1e-3 * transition
            g_w += g**2
            g_t += gt**2
            weights -= 0.3 * g / np.sqrt(g_w)
            transition -= 0.3 * gt / np.sqrt(g_t)
    return Model(labels, weights, transition, lexicon)


def train(docs: DataFrame, label_col: str = "lang", held_out=None, most: int = 800, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """fit() on up to `most` rows (a bounded sample) with a language that are not held out."""
    use = (lambda i: F.lit(True)) if held_out is None else (lambda i: ~held_out(i))
    return fitted(labelled(docs, None, label_col, use, most, id_col, text_col), fit)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: _id, lang_pred and score (0 to 1).

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing could be learned; very long
    texts are read whole. Each row is judged alone, so null or repeated ids do no harm and equal rows get equal answers; of
    languages with equal means the first by name is taken; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias(ID), F.col(text_col).cast("string").alias(TEXT))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, s, e, _ = T.text_bytes(batch.column(1))
            names, p = m.texts(raw, s, e)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(p, pa.float64())], [ID, "lang_pred", "score"])

    return rows.mapInArrow(run, S.StructType([rows.schema[ID], S.StructField("lang_pred", S.StringType()), S.StructField("score", S.DoubleType())]))
