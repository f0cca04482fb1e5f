"""Each operator against brute force on a small table, and on rows that are odd in every way."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import anchors, difference_cover, exact_dedup, language, minhash, mixing, packing, quality_model, quality_rules, substring, suffix_dedup, toxicity
from storyloom.llm import textkit as T
from storyloom.llm.queries import EXACT_TOKENS, FAST_TOKENS


def words(text):
    return (text or "").encode().split()


def rows(df):
    return {r["_id"]: r.asDict() for r in df.collect()}


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("how", [{}, {"block_bytes": 64}, {"block_bytes": 50, "block_hash": lambda b: F.octet_length(b) % 3}])
def test_exact(plain, texts, how):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t or ""].append(i)
    for i, r in rows(exact_dedup.exact_duplicates(plain, **how)).items():
        g = groups[texts[i] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), sha((texts[i] or "").encode()))


def test_exact_keeps_one_of_each_text(messy):
    out = exact_dedup.drop_exact_duplicates(messy)
    assert out.columns == messy.columns
    assert Counter(r["text"] or "" for r in out.collect()) == Counter({r["text"] or "": 1 for r in messy.collect()})


def test_names_are_native(plain):
    plan = exact_dedup.exact_duplicates(plain)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 300])
@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_ranks(n, letters):
    s = np.random.default_rng(n * letters).integers(1, letters + 1, n)
    tails = [tuple(s[i:]) for i in range(n)]
    assert difference_cover.ranks(s, 10**9).tolist() == [sorted(tails).index(t) for t in tails]


@pytest.mark.parametrize("how", [{}, {"crowded": 1, "shard_bytes": 2000}])
def test_byte_repeats(plain, texts, how):
    seen = Counter(t[k : k + 200] for t in ((x or "").encode() for x in texts.values()) for k in range(len(t) - 199))
    for i, r in rows(suffix_dedup.remove_repeats(plain, **how)).items():
        t = (texts[i] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), gone.sum(), spans, sha(bytes(b for b, g in zip(t, gone, strict=False) if not g)))


def test_word_repeats(plain, texts):
    first = {}
    for i in sorted(texts):
        w = words(texts[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, r in rows(substring.remove_repeats(plain)).items():
        w = words(texts[i])
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))


@pytest.mark.parametrize("width", [1, 5, 41])
def test_winnow(width):
    for top in (3, 1 << 60):
        h = np.random.default_rng(width).integers(0, top, 300).astype(T.U) << T.U(anchors.PLACE if top == 3 else 0)
        upper = h >> T.U(anchors.PLACE)
        assert anchors.winnow(h, width).tolist() == [i + width - 1 - int(np.argmin(upper[i : i + width][::-1])) for i in range(300 - width + 1)]


@pytest.mark.parametrize("shingle", [4, 5])
def test_near(plain, texts, shingle):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in texts.items():
        w = [x.translate(lower) for x in words(t)]
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    for i, r in rows(minhash.near_duplicates(plain, shingle=shingle)).items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), low[i], low[i] == i)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (5, 5)]
    found = {r["node"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_rules(plain, texts):
    for i, r in rows(quality_rules.quality_rules(plain)).items():
        t = texts[i] or ""
        w = words(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(tri)
        again = {k + j for k, x in enumerate(tri) if often[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        base = (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in quality_rules.COUNTS) == base
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        bad = 10 * base[2] > base[1] or 2 * base[3] > len(lines) or base[1] < 2 * len(w) or base[1] > 15 * len(w) or 20 * len(set(w)) < len(w)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not bad)


def test_rules_do_not_depend_on_their_order(texts):
    raw, s, e, _ = T.text_bytes(pa.array(list(texts.values()), pa.string()))
    x = quality_rules.measure(raw, s, e)
    assert (quality_rules.cascade(x, quality_rules.RULES) == quality_rules.cascade(x, quality_rules.RULES[::-1])).all()


def test_duels_keep_expectations():
    for p, q in ((0.2, 0.3), (0.7, 0.8), (0.5, 0.5)):
        got = np.mean([mixing.duel(p, q, u) for u in (np.arange(4000) + 0.5) / 4000], axis=0)
        assert np.allclose(got, (p, q), atol=1e-3)


def test_mix(plain, texts):
    out = rows(mixing.mix(plain, leaf_rows=4, fan_in=2))
    again = rows(mixing.mix(plain.repartition(7), leaf_rows=4, fan_in=2))
    assert {i: r["taken"] for i, r in out.items()} == {i: r["taken"] for i, r in again.items()}
    sizes, source = {i: len(words(t)) for i, t in texts.items()}, {i: r["source"] for i, r in out.items()}
    total = Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, capped = {}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        goal = {s: 2 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and goal[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for i, r in out.items():
        assert r["size"] == sizes[i] and r["source_size"] == total[source[i]] and abs(r["target"] - goal[source[i]]) < 1e-6
        assert r["taken"] in (0, sizes[i], 2 * sizes[i])
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= max(n for i, n in sizes.items() if source[i] == s) for s in names)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for window, count in ((10, 200), (64, 500), (1024, 300)):
        lengths = sorted(rng.integers(1, window, count).tolist(), reverse=True)
        left = []
        for n in lengths:
            fits = [(c, k) for k, c in enumerate(left) if c >= n]
            if fits:
                left[min(fits)[1]] -= n
            else:
                left.append(window - n)
        runs, made = packing.plan(Counter(lengths), window)
        filled = defaultdict(list)
        for length, _, n, first, at in runs:
            for k in range(n):
                filled[first + k].append((at, length))
        assert made == len(left) and sum(n for _, _, n, _, _ in runs) == count
        assert sorted(window - sum(x for _, x in v) for v in filled.values()) == sorted(left)
        for v in filled.values():
            assert [a for a, _ in sorted(v)] == np.cumsum([0, *[x for _, x in sorted(v)][:-1]]).tolist()


def test_pack(messy):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(EXACT_TOKENS)
    out = packing.pack(messy, FAST_TOKENS, EXACT_TOKENS, window=64).collect()
    want = Counter()
    for r in messy.select("doc_id", "text").collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            want[r["doc_id"], k, min(64, len(ids) - k), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r["_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        assert sum(n for _, n in v) <= 64 and [a for a, _ in sorted(v)] == np.cumsum([0, *[n for _, n in sorted(v)][:-1]]).tolist()


@pytest.mark.parametrize("block", [1, 2, 3, 128])
def test_forward_backward(block):
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    got, pairs = language.marginals(e, np.array([0, 4, 4, 9]), t, block)
    expected = np.zeros((3, 3))
    for a, b in ((0, 4), (4, 9)):
        total, p = 0.0, np.zeros((b - a, 3))
        pair = np.zeros((3, 3))
        for path in np.ndindex(*[3] * (b - a)):
            w = np.exp(sum(e[a + k, y] for k, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            for k, y in enumerate(path):
                p[k, y] += w
            for x, y in zip(path, path[1:], strict=False):
                pair[x, y] += w
        assert np.allclose(got[a:b], p / total)
        expected += pair / total
    assert np.allclose(pairs, expected)


def test_blocks_do_not_change_probabilities():
    rng = np.random.default_rng(2)
    bounds = np.array([0, 1, 1, 700, 702, 5000])
    e, t = (20 * rng.normal(size=(5000, 4))).astype(np.float32), (5 * rng.normal(size=(4, 4))).astype(np.float32)
    a, x = language.marginals(e, bounds, t, 10_000)
    b, y = language.marginals(e, bounds, t)
    assert np.isfinite(b).all() and np.allclose(a, b, atol=1e-4) and np.allclose(x, y, rtol=1e-3, atol=1e-3)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(4)) == 2
    out = language.identify(docs, language.train(docs, held_out=held)).join(docs.select(F.col("doc_id").alias("_id"), "lang"), "_id").filter(held(F.col("_id")))
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right >= 0.97 * n


def test_code_switched_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    parts = [docs.filter(f"lang = '{x}' and n_chars > 900").orderBy("doc_id").first()["text"].split()[20:60] for x in ("de", "es")]
    raw, s, e, _ = T.text_bytes(pa.array([" ".join(parts[0] + parts[1])]))
    best = model.words(T.words(raw, s, e, fold=True)).argmax(axis=1)
    assert (best[:40] == model.labels.index("de")).mean() > 0.9 and (best[40:] == model.labels.index("es")).mean() > 0.9


def test_undetermined():
    model = language.fit([("der die das und ist", "de"), ("the of and is was", "en")] * 5, sequences=20)
    raw, s, e, _ = T.text_bytes(pa.array([None, "", "12 34 --", "漢字", "the of"], pa.string()))
    names, scores = model.texts(raw, s, e)
    assert names[:3] == ["und"] * 3 and names[3] != "und" and names[4] == "en" and (scores >= 0).all() and (scores <= 1).all()


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(3)) == 1
    out = quality_model.score(docs, quality_model.train(docs, labels, held_out=held)).join(labels.withColumnRenamed("doc_id", "_id"), "_id").filter(held(F.col("_id")))
    right, n = out.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count(F.lit(1))).first()
    assert right >= 0.95 * n


def test_dual_descent_separates():
    sets = [np.array([k % 2, 2 + k % 5]) for k in range(40)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(40)])
    w, b = quality_model.descend(sets, [np.ones(2)] * 40, y)
    assert all((w[x].sum() + b) * v > 0 for x, v in zip(sets, y, strict=True))


def test_grammar():
    o, i, t, n, r, h = toxicity.OTHER, toxicity.INSULT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT
    kinds = lambda *c: [toxicity.KINDS[k] for k in toxicity.read_clause(list(c))]
    assert kinds(o, i, o) == ["insult"] and kinds(t, o, i) == ["insult_at"] and kinds(i, t) == ["insult_at"]
    assert kinds(n, i) == ["negated"] and kinds(n, o, o, i) == ["insult"] and kinds(r, o, i) == ["reported"]
    assert kinds(h, t) == ["threat_at"] and kinds(o, o) == [] and kinds(r, n, i) == ["negated"]


@pytest.mark.parametrize(
    "word",
    ["idiot!!!!", "idiot###", "$$$idiot&&&", "“idiot”", "«idiot»…", "((((((((((((idiot))))))))))))", "—idiot—", "💩idiot💩💩", "“" * 40 + "idiot" + "”" * 40],
)
def test_cores_strip_whole_runs(word):
    texts = [f"ein {word} is", "#### “” a", word, "crème été! л'été… 123 cafe\u0301!"]
    raw, s, e, _ = T.text_bytes(pa.array(texts))
    w = T.words(raw, s, e, hashed=False)
    got = [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(*toxicity.cores(w), strict=True)]
    assert got[:3] == ["ein", "idiot", "is"] and got[5:7] == ["a", "idiot"] and got[7:10] == ["crème", "été", "л'été"] and got[11] == "cafe\u0301"
    assert got[3] == "#" and len(got) == 12 and toxicity.features(raw, s, e, toxicity.learn_lexicon([], np.zeros(0)))[[0, 2], -1].all()


def test_clauses_are_read_to_their_ends():
    rng, lexicon = np.random.default_rng(5), toxicity.learn_lexicon([], np.zeros(0))
    sample = lambda n: " ".join(rng.choice(["x"] * 40 + ["idiot", "kill", "you", "not", "said", "moron,", "y."], n))
    texts = ["idiot " + "x " * 62 + "moron x you", "", "not " * 3, *(sample(n) for n in (1, 70, 200, 3000)), "idiot " + "x " * 500 + "idiot. you", "you"]
    raw, s, e, _ = T.text_bytes(pa.array(texts))
    got = np.expm1(toxicity.features(raw, s, e, lexicon))
    classes = {"idiot": toxicity.INSULT, "moron,": toxicity.INSULT, "moron": toxicity.INSULT, "idiot.": toxicity.INSULT, "kill": toxicity.THREAT, "you": toxicity.TARGET, "not": toxicity.NEGATION, "said": toxicity.REPORT}
    for text, row in zip(texts, got, strict=True):
        clause, want = [], Counter()
        for word in [*text.split(), "."]:
            clause.append(classes.get(word, toxicity.OTHER))
            if word.endswith("."):
                want.update(toxicity.read_clause(clause))
                clause = []
        assert [round(x) for x in row[: len(toxicity.KINDS)]] == [want[k] for k in range(len(toxicity.KINDS))]
    assert [round(x) for x in got[0][:3]] == [1, 0, 1] and [round(x) for x in got[-2][:1]] == [2]


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(5)) == 0
    out = toxicity.score(docs, toxicity.train(docs, labels, held_out=held)).join(labels.withColumnRenamed("doc_id", "_id"), "_id").filter(held(F.col("_id")))
    found, toxic, wrong, clean = out.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")), F.count_if(F.expr("toxic = 1")), F.count_if(F.expr("toxic = 0 and predicted = 1")), F.count_if(F.expr("toxic = 0"))).first()
    assert found >= 0.7 * toxic and wrong <= 0.01 * clean


MODELS = {
    "language": lambda: language.fit([("der die das", "de"), ("the of and", "en")] * 4, sequences=20),
    "quality": lambda: quality_model.fit([("good words here now", 1), ("bad ### bad ###", 0)] * 6),
    "toxicity": lambda: toxicity.fit([]),
}
OPERATORS = {
    "language": lambda d: language.identify(d, MODELS["language"]()),
    "exact": exact_dedup.exact_duplicates,
    "suffix": suffix_dedup.remove_repeats,
    "rules": quality_rules.quality_rules,
    "mix": mixing.mix,
    "quality": lambda d: quality_model.score(d, MODELS["quality"]()),
    "substring": substring.remove_repeats,
    "toxicity": lambda d: toxicity.score(d, MODELS["toxicity"]()),
    "near": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(messy, name):
    """One row for each row, null and repeated ids included."""
    out = OPERATORS[name](messy).collect()
    assert Counter(r["_id"] for r in out) == Counter(r["doc_id"] for r in messy.select("doc_id").collect())


@pytest.mark.parametrize("name", [*OPERATORS, "pack"])
def test_empty_table(empty, name):
    run = OPERATORS.get(name) or (lambda d: packing.pack(d, FAST_TOKENS, EXACT_TOKENS))
    assert run(empty).collect() == []


def test_learning_from_nothing(empty):
    labels = empty.selectExpr("doc_id", "1 as toxic", "1 as quality")
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert quality_model.score(empty, quality_model.train(empty, labels)).count() == 0
    assert language.identify(empty, language.train(empty)).count() == 0
