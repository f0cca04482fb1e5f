import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _rid string, `a.b` string"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids, texts and sources, empty, blank and very long texts, repeated ids and rows, near copies, shared passages,
    multi-byte letters, and other columns with the operators' own names."""
    rng = random.Random(5)
    shared, base = prose(rng, 80), prose(rng, 300)
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice([1, 2, 3, 5, 60, 200]))
        if i % 5 == 0:
            text = base
        if i % 10 == 3:
            text = base.replace("alpha ", "ALPHA ", 1) + " end" * (i % 3)
        if i % 7 == 1:
            text = f"{prose(rng, 30)}\n{shared}\t{prose(rng, 20)} 漢字 ñandú"
        if i % 11 == 2:
            text = "Same Same\nSame Same\n" * 30
        rows.append((i, text, ["de", "en", None][i % 3], ["a", "b", "é", None][i % 4], len(text)))
    rows += [(100, None, "en", "a", None), (101, "", None, None, 0), (102, " \n\t ", "en", "a", 4), (103, "x" * 50_000, "en", "b", 1), (104, prose(rng, 20_000), "en", "b", 1)]
    rows += [(None, base, "en", "a", 1), (None, "null id", None, None, 1), (7, rows[7][1], "en", "b", 1), (7, "another text of seven", "en", "b", 1), rows[8], rows[8]]
    return spark.createDataFrame([(*r, True, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain(messy):
    """Rows with whole unique ids only."""
    return messy.filter("doc_id is not null").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="session")
def texts(plain):
    return {r["doc_id"]: r["text"] for r in plain.select("doc_id", "text").collect()}
