"""The ten queries as their contracts have them; values on odd rows; models against plain arithmetic; the stages of the
pipeline on odd, empty and clashing tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import exact_dedup, language, minhash, mixing, packing, quality_model, quality_rules, substring, suffix_dedup, toxicity
from storyloom.llm import textkit as T
from storyloom.llm.queries import EXACT_TOKENS, FAST_TOKENS, QUERIES

SF = "/root/testdata/sf0.001"
FOLDS = {"op1_crf_language": (4, 2), "op7_nbsvm_quality": (3, 1), "op9_toxic_grammar": (5, 0)}
CONTRACT = {
    "op1_crf_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_block_naming": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op3_suffix_array": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4_rule_cascade": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_pivotal_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op6_best_fit_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7_nbsvm_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_seed_extend": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op9_toxic_grammar": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.fixture(scope="module")
def tables(spark, plain, tmp_path_factory):
    """A folder of tables with the odd documents that have whole unique ids."""
    at = str(tmp_path_factory.mktemp("tables"))
    plain.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 3 = 0 as int) as toxic").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def results(spark, tables):
    return {name: QUERIES[name](spark, tables) for name in CONTRACT}


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_rows(results, texts, name):
    df = results[name]
    assert dict(df.dtypes[: len(CONTRACT[name])]) == CONTRACT[name] and list(dict(df.dtypes))[: len(CONTRACT[name])] == list(CONTRACT[name])
    ids = Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert set(ids) == set(texts)
    if name != "op6_best_fit_packing":
        assert max(ids.values()) == 1


@pytest.mark.parametrize("name", FOLDS)
def test_folds_and_scores(results, texts, name):
    parts, held = FOLDS[name]
    for r in results[name].collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == held) and 0 <= r["score"] <= 1
        if name == "op1_crf_language":
            none = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert r["lang_pred"] == "und" if none else r["lang_pred"] in ("de", "en")
        else:
            assert r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_labels_are_not_read(spark, tables, results, tmp_path):
    """Other labels for the rows that are held out change no score."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, label in (("op7_nbsvm_quality", "quality"), ("op9_toxic_grammar", "toxic"), ("op1_crf_language", "lang")):
        parts, held = FOLDS[name]
        out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == held
        at = str(tmp_path / name)
        labels = spark.read.parquet(f"{tables}/labels.parquet")
        if label == "lang":
            docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).write.parquet(f"{at}/documents.parquet")
        else:
            docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")).write.parquet(f"{at}/documents.parquet")
            labels = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        labels.write.parquet(f"{at}/labels.parquet")
        column = "lang_pred" if label == "lang" else "score"
        assert {r["doc_id"]: r[column] for r in QUERIES[name](spark, at).collect()} == {r["doc_id"]: r[column] for r in results[name].collect()}


def test_packed_sequences(results):
    by, sizes = defaultdict(list), defaultdict(list)
    for r in results["op6_best_fit_packing"].collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        sizes[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for v in by.values():
        assert sum(n for _, n in v) <= 1024 and [a for a, _ in sorted(v)] == np.cumsum([0, *[n for _, n in sorted(v)][:-1]]).tolist()
    for v in sizes.values():
        assert [a for a, _, _ in sorted(v)] == np.cumsum([0, *[n for _, n, _ in sorted(v)][:-1]]).tolist() and {sum(n for _, n, _ in v)} == {t for _, _, t in v}


def test_mix_of_the_query(results):
    taken, goal, most = Counter(), {}, Counter()
    for r in results["op5_pivotal_mix"].collect():
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        most[key] = max(most[key], r["size"])
        goal[key] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-6
    assert all(abs(taken[k] - goal[k]) <= most[k] for k in goal)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.fixture(scope="module")
def twins(spark):
    """Texts that sums modulo a power of two cannot tell apart."""
    one = thue_morse(2048)
    two = one.translate(str.maketrans("ab", "ba"))
    pad = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(0, one), (1, two), (2, f"{pad}\n{one}\n{two}"), (3, " ".join(one)), (4, " ".join(two))], "doc_id long, text string")


def test_regular_texts_do_not_collide(twins):
    rules = {r["_id"]: r["n_dup_lines"] for r in quality_rules.quality_rules(twins).collect()}
    assert rules == dict.fromkeys(range(5), 0)
    near = {r["_id"]: r["component_id"] for r in minhash.near_duplicates(twins.filter("doc_id < 3")).collect()}
    assert near == {0: 0, 1: 1, 2: 2}
    one, two = (thue_morse(2048), thue_morse(2048).translate(str.maketrans("ab", "ba")))
    first = {tuple(one[k : k + 50]) for k in range(2048 - 49)}
    gone = [False] * 2048
    for k in range(2048 - 49):
        if tuple(two[k : k + 50]) in first:
            gone[k : k + 50] = [True] * 50
    assert {r["_id"]: r["n_removed"] for r in substring.remove_repeats(twins).collect()}[4] == sum(gone)


def test_hashes_of_words_and_runs():
    rng = random.Random(1)
    words = ["", *("".join(rng.choice("ab ") for _ in range(rng.randrange(1, 40))).strip() for _ in range(400))]
    text = np.frombuffer("|".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for fold in (False, True):
        h = T.span_hashes(text, starts, ends, fold)
        assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    runs = T.windows(T.mix(np.array([0, 1, 1, 0, 1, 0, 0, 1] * 9, T.U)), 5)
    want = [tuple(([0, 1, 1, 0, 1, 0, 0, 1] * 9)[k : k + 5]) for k in range(68)]
    assert len(set(zip(want, runs.tolist(), strict=True))) == len(set(want)) == len(set(runs.tolist()))


# ---- values on odd rows
def by_row(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_exact_values_on_odd_rows(messy):
    out = exact_dedup.exact_duplicates(messy).collect()
    want = Counter(r["text"] or "" for r in messy.select("text").collect())
    sha = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in want.items()}
    kept = Counter()
    for r in out:
        assert r["group_size"] == sha[r["text_sha256"]]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(want)


def test_repeated_rows_lose_their_bytes_and_words(messy):
    """Both of two equal rows lose all bytes; of words the first row keeps what no earlier row has."""
    twice = {t for t, n in Counter(r["text"] for r in messy.select("text").collect()).items() if t and n > 1 and len(t.encode()) >= 200}
    digest = {hashlib.sha256(t.encode()).hexdigest() for t in twice}
    lost = messy.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).select("doc_id", "sha")
    ids = {r["doc_id"] for r in lost.filter(F.col("sha").isin(*digest)).collect()}
    single = {i for i in ids if i is not None and i != 7}
    for r in suffix_dedup.remove_repeats(messy).collect():
        if r["_id"] in single:
            assert r["n_removed"] == r["n_bytes"] and r["kept_sha256"] == hashlib.sha256(b"").hexdigest()
        if r["_id"] in (100, 101):
            assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (0, 0, 0)
    words = [r for r in substring.remove_repeats(messy).collect() if r["_id"] == 8]
    assert len(words) == 3 and len({r["n_words"] for r in words}) == 1 and sorted(r["n_removed"] for r in words)[1:] == [words[0]["n_words"]] * 2


def test_near_values_on_odd_rows(messy):
    out = minhash.near_duplicates(messy).collect()
    for r in out:
        if r["_id"] in (100, 101, 102):
            assert r["n_shingles"] == 0 and r["kept"] and r["component_id"] == r["_id"]
    same = [r for r in out if r["_id"] == 8]
    assert len({r["component"] for r in same}) == 1 and sum(r["kept"] for r in same) <= 1
    assert Counter(r["component"] for r in out if r["kept"]) == dict.fromkeys({r["component"] for r in out}, 1)


def test_rules_and_mix_on_odd_rows(messy):
    for r in quality_rules.quality_rules(messy).collect():
        if r["_id"] in (100, 101, 102):
            assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["base_failed"], r["kept"]) == (0, 0, 0, True, False)
        if r["_id"] == 103:
            assert (r["n_words"], r["word_chars"], r["base_failed"]) == (1, 50_000, True)
    out = mixing.mix(messy).collect()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out) and {r["size"] for r in out if r["_id"] in (100, 101, 102)} == {0}
    assert {r["source"] for r in out if r["_id"] == 101} == {None}


def test_scores_on_odd_rows(messy):
    """Null, empty and blank texts have one score; equal rows have equal scores; a very long text has one."""
    good = [("good words here now", 1), ("bad ### bad ###", 0)] * 6
    for score in (lambda d: quality_model.score(d, quality_model.fit(good)), lambda d: toxicity.score(d, toxicity.fit([]))):
        rows = defaultdict(set)
        for r in score(messy).collect():
            rows[r["_id"]].add(r["score"])
        assert rows[100] == rows[101] and len(rows[8]) == 1 and len(rows[104]) == 1
    rows = defaultdict(set)
    for r in language.identify(messy, language.fit([("der die das", "de"), ("the of and", "en")] * 4, sequences=20)).collect():
        rows[r["_id"]].add((r["lang_pred"], round(r["score"], 6)))
    assert rows[100] == rows[101] == rows[102] == {("und", 0.0)} and len(rows[8]) == 1


# ---- models against plain arithmetic
def test_word_features_by_hand():
    words = [b"Haus", b"a", "für".encode(), b"the"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    e = np.cumsum([len(w) + 1 for w in words]) - 1
    s = e - [len(w) for w in words]
    hashes = T.span_hashes(data, s, e, fold=True)
    lexicon = np.sort(hashes[[1, 3]])
    got, counts = language.word_features(data, s, e, hashes, lexicon)
    at = np.concatenate([[0], np.cumsum(counts)])

    def bucket(piece: bytes, salt: int) -> int:
        value = 0
        for c in piece:
            value = (value * 257 + c) % 2**64
        return int(T.mix(np.array([(value + salt * 0x9E3779B97F4A7C15) % 2**64], T.U))[0]) & 0xFFFF

    for i, w in enumerate(words):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        want = [bucket(low[:k], k) for k in (1, 2, 3) if len(low) >= k] + [bucket(low[len(low) - k :], 10 + k) for k in (1, 2, 3) if len(low) >= k]
        want += [bucket(low[j : j + k], 20 + k) for k in (2, 3) for j in range(len(low) - k + 1)]
        if i in (1, 3):
            want.append(int(T.mix(np.array([(int(hashes[i]) + 30 * 0x9E3779B97F4A7C15) % 2**64], T.U))[0]) & 0xFFFF)
        assert sorted(got[at[i] : at[i + 1]].tolist()) == sorted(want)
    weights = np.random.default_rng(0).normal(size=(1 << language.BITS, 3))
    assert np.allclose(language.emissions(got, counts, weights), [weights[got[at[i] : at[i + 1]]].sum(axis=0) for i in range(len(words))])


def test_language_of_a_text_by_hand():
    model = language.fit([("der die das und ist", "de"), ("the of and is was", "en")] * 5, sequences=20)
    text = "der the 12 und was"
    raw, s, e, _ = T.text_bytes(pa.array([text]))
    w = T.words(raw, s, e, fold=True)
    features, counts = language.word_features(w.data, w.starts, w.ends, w.hashes, model.lexicon)
    score = np.array([model.weights[f].sum(axis=0) for f in np.split(features, np.cumsum(counts)[:-1])], float)
    total, p = 0.0, np.zeros((5, 2))
    for path in np.ndindex(*[2] * 5):
        v = np.exp(sum(score[k, y] for k, y in enumerate(path)) + sum(model.transition[x, y] for x, y in zip(path, path[1:], strict=False)))
        total += v
        for k, y in enumerate(path):
            p[k, y] += v
    mean = (p / total).mean(axis=0)
    names, scores = model.texts(raw, s, e)
    assert names[0] == model.labels[int(mean.argmax())] and abs(scores[0] - mean.max()) < 1e-4


def test_support_vectors_by_hand():
    rng = random.Random(4)
    pool = {1: "alpha beta gamma delta epsilon zeta".split(), 0: "beta gamma kappa lambda mu nu".split()}
    rows = [(" ".join(rng.choice(pool[y]) for _ in range(rng.randrange(3, 12))), y) for y in (0, 1) * 40]
    raw, s, e, _ = T.text_bytes(pa.array([t for t, _ in rows]))
    sets = [set(x.tolist()) for x in quality_model.indicators(raw, s, e)]
    model = quality_model.fit(rows)
    # Log-count ratios and margins from sets alone.
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    ratio = {}
    for f in set().union(*sets):
        p, q = (1 + sum(f in x for x, (_, y) in zip(sets, rows, strict=True) if y == v) for v in (1, 0))
        ratio[f] = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2)) if p + q >= 4 else 0.0
    use = [i for i in range(len(rows)) if i % 5 != 4]
    xs = [np.array(sorted(sets[i])) for i in use]
    vs = [np.array([ratio[f] for f in x]) / np.sqrt(len(x)) for x in xs]
    y = np.array([2.0 * rows[i][1] - 1 for i in use])
    w, b = quality_model.descend(xs, vs, y)
    for i in range(len(rows)):
        x = sorted(sets[i])
        want = sum(w[f] * ratio[f] for f in x) / np.sqrt(len(x)) + b
        assert abs(model.margins(raw, s[i : i + 1], e[i : i + 1])[0] - want) < 1e-3
    # The descent ends near the optimum: the gap between the primal and the dual objective closes.
    w, b = quality_model.descend(xs, vs, y, passes=400)
    limit = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    m = np.array([w[x] @ v + b for x, v in zip(xs, vs, strict=True)])
    primal = 0.5 * (w @ w + b * b) + (limit * np.maximum(0, 1 - y * m)).sum()
    for step in (1e-2, -1e-2):
        for f in {*xs[0].tolist(), *xs[1].tolist()}:
            moved = w.copy()
            moved[f] += step
            m2 = np.array([moved[x] @ v + b for x, v in zip(xs, vs, strict=True)])
            assert 0.5 * (moved @ moved + b * b) + (limit * np.maximum(0, 1 - y * m2)).sum() >= primal - 1e-4 * primal


def test_toxicity_score_by_hand():
    """Scores from clauses that are read word by word in plain Python."""
    rows = [(f"you are an idiot number {i}.", 1) if i % 3 == 0 else (f"he said nothing about it, not {i}.", 0) for i in range(60)]
    model = toxicity.fit(rows)
    texts = ["you idiot! he is not stupid. fine.", "nothing here", "they said you are scum; kill you", ""]
    raw, s, e, _ = T.text_bytes(pa.array(texts))
    for k, text in enumerate(texts):
        counts, clause, n = Counter(), [], 0
        for word in [*text.split(), "."]:
            n += word != "."
            core = word.strip("!.;,:")
            if core:
                b = core.encode()
                kind = model.lexicon.classify(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]
                clause.append(int(kind))
            if word[-1] in "!.;:?":
                counts.update(toxicity.read_clause(clause))
                clause = []
        x = np.array([counts[i] for i in range(len(toxicity.KINDS))], float)
        x = np.log1p([*x, 100 * x.sum() / max(1, n), x.sum() > 0])
        want = 1 / (1 + np.exp(-(x @ model.weights + model.constant)))
        assert abs(model.scores(raw, s[k : k + 1], e[k : k + 1])[0] - want) < 1e-9


def test_both_tokenisers_agree():
    """The fast library and the one that the contract names give the same ids for all sorts of strings."""
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(EXACT_TOKENS)
    with open(FAST_TOKENS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    blocks = [(32, 127), (9, 14), (0xA0, 0x250), (0x300, 0x370), (0x400, 0x500), (0x600, 0x700), (0x900, 0xA00), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0x1F300, 0x1F650), (0, 32)]
    for _ in range(4000):
        text = "".join(chr(rng.randrange(*rng.choice(blocks[:2] if rng.random() < 0.5 else blocks))) for _ in range(rng.randrange(1, 60)))
        if "<|" not in text:
            assert fast.encode_ordinary(text) == exact.encode(text, add_special_tokens=False).ids, repr(text)


# ---- the pipeline
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("kind", ["messy", "empty"])
def test_stages_on_odd_tables(spark, request, name, kind):
    """Odd and empty tables with extra columns of clashing names pass through each stage with all their columns."""
    docs = request.getfixturevalue(kind)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    rows = out.collect()
    if kind == "empty":
        assert rows == []
    if name == "packing":
        ids = Counter(r["doc_id"] for r in rows if r["start"] == 0)
        assert ids == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        return
    assert out.columns == docs.columns
    key = lambda r: tuple(map(str, r))
    before, after = Counter(map(key, docs.collect())), Counter(map(key, rows))
    assert set(after) <= set(before)
    if name == "mixing" and kind == "messy":
        assert all(n <= 2 * before[r] for r, n in after.items())
    elif kind == "messy":
        assert all(n <= before[r] for r, n in after.items()) and after
    if name == "exact_dedup" and kind == "messy":
        assert Counter(r["text"] or "" for r in rows) == Counter({r["text"] or "": 1 for r in docs.collect()})
    if name == "near_dedup" and kind == "messy":
        assert sum(not (r["text"] or "").split() for r in rows) == sum(not (r["text"] or "").split() for r in docs.collect())


def test_near_stage_by_brute_force(spark, plain, texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, plain, SF).collect()}
    assert got == {i for i in sets if top(i) == i}
