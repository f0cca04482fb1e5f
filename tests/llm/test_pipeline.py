"""The stages one by one on whole small tables, each against what it promises for its own input."""

from collections import Counter

import corpus_pipeline

from storyloom.llm import mixing
from storyloom.llm.storage import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    gone = ids["toxicity"] - ids["exact_dedup"]
    assert all(labels.get(i) != 0 for i in gone) and sum(labels.get(i) == 1 for i in gone) >= 5
    last = {}
    for r in seen["exact_dedup"].collect():
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert ids["near_dedup"] == set(last.values())
    assert ids["mixing"] <= ids["near_dedup"]
    copies = {r["_id"]: r["copies"] for r in mixing.mix(seen["mixing"]).collect()}
    assert Counter(r["doc_id"] for r in seen["packing"].collect()) == Counter({i: n for i, n in copies.items() if n})
    tokens = Counter()
    for r in docs.collect():
        tokens[r["doc_id"]] += r["length"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
    assert tokens == Counter({i: whole[i] * copies[i] for i in whole})
