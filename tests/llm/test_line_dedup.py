import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatracks.llm import line_dedup as D

SCHEMA = "doc_id long, text string"
STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_docs=5, least_chars=40):
    """(id, lines, dropped, text) of each row; None is the smallest id."""
    rank = lambda i: (i is not None, i)
    key = lambda line: line.strip(STRIP).translate(LOWER)
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append((n, i))
    keeper = {k: max((i for _, i in own), key=rank) for k, own in holders.items() if len(own) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (key(x) in keeper and keeper[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    long = [f"a line of some forty letters and a few more {k} É" for k in range(12)]
    spaced = lambda x: rng.choice([x, f"\t {x}\x0b", x.upper().replace("é", "É"), f"{x}\r"])
    rows = [(i, "\n".join(spaced(rng.choice([*long, "short", "", "x" * 39, "y" * 40])) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    rows += [(None, long[0]), (None, long[0]), (50, long[0] + "\n" + long[0]), (119, long[1]), (119, long[1]), (5, None), (6, ""), (7, "\n\n")]
    rows += [(None, "only in rows without any id, " * 3)] * 6 + [(k, "e" * 39 + " ") for k in range(200, 206)]
    return rows + [(300 + k, "four documents are too few for this line to go") for k in range(4)]


@pytest.mark.parametrize("shard_lines", [1, 4, D.SHARD_LINES])
def test_lines_against_brute_force(spark, shard_lines):
    rows = cases()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"shard": F.lit("clash"), "_gone": F.lit(1), "r": F.lit(None).cast("string")})
    got = D.deduplicated(df, shard_lines=shard_lines)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute(rows)


def test_text_ids_limits_empty_table_and_a_very_long_text(spark):
    rows = [("b", "One Line\nz"), ("c", "one line"), (None, "ONE LINE")]
    got = D.deduplicated(spark.createDataFrame(rows, "doc_id string, text string"), least_docs=3, least_chars=3).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["n_dropped"]) for r in got] == [(None, "", 1), ("b", "z", 1), ("c", "one line", 0)]
    assert D.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    lines = [f"line {k} of a text that is very long indeed, all in all" for k in range(100_000)]
    long = [(i, "\n".join(lines)) for i in range(5)]
    assert [(r["n_lines"], r["n_dropped"]) for r in D.deduplicated(spark.createDataFrame(long, SCHEMA), shard_lines=20_000).orderBy("doc_id").collect()] == [(100_000, 100_000)] * 4 + [(100_000, 0)]


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        a, b = rng.integers(0, 2**64, size=(2, n), dtype=np.uint64)
        if n > 10:
            a[:5] = a[0]  # halves may be equal, pairs not
        places = D.PerfectHash.over(a, b).places(a, b)
        assert np.array_equal(np.sort(places), np.arange(n))
        shard = D.Shard.unpack(*D.Shard.of(a, b, np.arange(n), np.arange(n) * 3).pack())
        known, counts, keepers = shard.look_up(a, b)
        assert known.all() and np.array_equal(counts, np.arange(n)) and np.array_equal(keepers, np.arange(n) * 3)
        if n:
            known, counts, _ = shard.look_up(a, b + np.uint64(1))
            assert not known.any() and not counts.any()


def test_probes_of_one_line_are_shared_out(spark, monkeypatch):
    """A line in all documents is probed by several tasks."""
    shares = []
    real = D._probes
    monkeypatch.setattr(D, "_probes", lambda df, own, n: shares.append(own) or real(df, own, n))
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("this line stands in each and every document\nown "), F.col("id").cast("string")).alias("text"))
    assert D.deduplicated(df).agg(F.sum("n_dropped")).first()[0] == 19_999
    assert shares[0][0] >= 4
