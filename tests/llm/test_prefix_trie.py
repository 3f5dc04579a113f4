import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatracks.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = defaultdict(list)
    for n, (c, t, r, x) in enumerate(rows):
        if c is not None:
            turns[c].append(((t is not None, t or 0), n, (r or "", x or "")))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children[x]), leaves[x], saved[x], sha(ends[x])) for x, m in members.items()
    )


def result(df, **how):
    got = T.trie(df, **how)
    assert set(got.columns) == set(COLUMNS) and {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


def random_conversations(seed, n=70, most=14, texts=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 150), n):
        numbers = sorted(rng.sample(range(30), rng.randrange(1, most)))
        rows += [(c, t, rng.choice([None, "", "user"]), rng.choice([None, "", "é", "long text"][: texts + 1])) for t in numbers]
        if rng.random() < 0.3:
            rows.append((c, None, "user", "no turn"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, shard_nodes, block", [(1, 200_000, 1024), (2, 5, 3), (3, 1, 2), (4, 20, 1)])
def test_trie_against_brute_force(spark, monkeypatch, seed, shard_nodes, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rows = random_conversations(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "k": F.lit(1), "place": F.lit(None).cast("int")})
    assert result(df, shard_nodes=shard_nodes) == brute(rows)


def test_copies_prefixes_chains_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "ID_BLOCK", 8)
    rows = [(c, t, "user", f"turn {t}") for c in range(1000, 1060) for t in range(12)]  # copies
    rows += [(c, t, "user", f"turn {t}") for c in range(2000, 2020) for t in range(c - 2000)]  # each begins the next
    rows += [(3000, t, "user", f"own {t}") for t in range(300)] + [(None, 1, "user", "nobody's"), (4000, None, None, None)]
    for shard_nodes in (3, 200_000):
        assert result(spark.createDataFrame(rows, SCHEMA), shard_nodes=shard_nodes) == brute(rows)
    twice = [(c, 5, "user", "same") for c in (10, 11, 13) for _ in range(12)]  # equal rows are turns of their own
    assert result(spark.createDataFrame(twice, SCHEMA)) == brute(twice)
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_long_conversation_in_blocks(spark):
    n = 3000
    got = result(spark.createDataFrame([(c, t, "user", f"turn {t}" if c < 10 or t < n - 1 else "other") for c in (5, 10) for t in range(n)], SCHEMA))
    assert len(got) == n + 2 and got[0][:7] == (5, 0, None, 2, 1, 2, sum(len(f"turn {t}") for t in range(n - 1)))
    assert {r[:6] for r in got if 0 < r[1] < n - 1} == {(5, d, 5, 2, 1, 2) for d in range(1, n - 1)}
    assert {(r[0], r[2], r[3], r[4], r[6]) for r in got if r[1] == n} == {(5, 5, 1, 0, 0), (10, 5, 1, 0, 0)}


def test_find_close_over_many_blocks():
    rng = random.Random(2)
    for n in (1, 5, 200, 5000):
        opens, depth, left = [], 0, n
        while left or depth:
            up = left and (depth == 0 or rng.random() < 0.55)
            opens.append(bool(up))
            depth += 1 if up else -1
            left -= bool(up)
        stack, want = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                want[stack.pop()] = i
        tree = T.Parentheses(np.array(opens))
        at = np.flatnonzero(np.array(opens))
        assert np.array_equal(tree.find_close(at, rows=100), [want[i] for i in at.tolist()])
    deep = np.repeat([True, False], 10_000)
    assert np.array_equal(T.Parentheses(deep).find_close(np.arange(10_000)), np.arange(19_999, 9_999, -1))
