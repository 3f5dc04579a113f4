"""The pipeline's stages one after the other, each held against brute force on its own input."""

from collections import Counter

import corpus_pipeline as P
from test_minhash import brute_groups
from test_packing import check_layout
from test_quality_rules import brute as statistics

from seatracks.llm.common import written
from seatracks.llm.quality_rules import line_hash


def test_stages(spark, data):
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_rules", "simhash_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, data), name)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = docs.collect()
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    lang = {r["doc_id"]: r["text"] for r in seen["language_id"]}
    assert set(lang) >= {i for i, t in start.items() if t and sum(map(str.isalpha, t)) > 100} and all(lang[i] == start[i] for i in lang)

    rules = {r["doc_id"]: r["text"] for r in seen["quality_rules"]}
    stats = {i: statistics(t) for i, t in lang.items()}
    fine = {i for i, n in stats.items() if n[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    assert set(rules) <= fine and len(rules) > 0.9 * len(fine)
    for i, text in rules.items():
        rest = iter(lang[i].split("\n"))
        assert all(any(x == y for y in rest) for x in text.split("\n"))  # lines in their order, some left out
        gone = Counter(lang[i].split("\n")) - Counter(text.split("\n"))
        assert not {line_hash(x) for x in gone} & {line_hash(x) for x in text.split("\n")} - {None}

    assert {r["doc_id"] for r in seen["simhash_dedup"]} == set(brute_groups(rules, 0.8).values())

    mixed = Counter()
    for r in seen["mixing"]:
        mixed[r["source"]] += len(r["text"].split())
    had = Counter()
    for r in seen["simhash_dedup"]:
        had[r["source"]] += len(r["text"].split())
    assert abs(sum(mixed.values()) - 1.5 * sum(had.values())) <= len(had) and all(mixed[s] <= 2 * had[s] + 1 for s in mixed)

    rows = docs.collect()
    check_layout(rows, 4096)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in seen["mixing"])


def test_empty_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, data), name)
    assert docs.count() == 0


def test_run_is_registered(spark, data):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is P.run and P.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()}
