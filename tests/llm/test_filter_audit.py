import random
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from seatracks.llm import filter_audit as A

DOCS, LABELS = "doc_id long, source string, text string", "doc_id long, quality int, toxic int"
COLUMNS = ("part", "filter_order", "step", *A.COUNTS, "shapley")


def brute(docs, labels):
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = []
    for i, part, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (i is None or first[t] < i),
        }
        rows.append((part or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for o in map("".join, permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for step, x in enumerate(o, 1):
                cut = [r for r in alive if x in r[1]]
                redundant = sum(x in r[1] for r in gone)
                alive, gone = [r for r in alive if x not in r[1]], gone + cut
                unique = sum(r[1] == {x} for r in rows if r[0] == part)
                out[part, o, step] = (len(alive), len(cut), redundant, unique, sum(r[2] for r in cut), sum(r[3] for r in cut))
                shapley[part, x] += len(cut)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_all_orders_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "B", "cc", "D#", "e\x0b", "É", " "]
    texts = [None, "", " \n", "x#", "LOUD", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "a " * 400, " ".join(str(i) for i in range(300)) + " |"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(400))) for _ in range(10)]
    docs = [(rng.choice([None, *range(30)]), rng.choice([None, "", "p", "q"]), rng.choice(texts)) for _ in range(150)]  # ids repeat
    docs += [(7, "p", "twice"), (7, "p", "twice"), (7, "q", "twice"), (9, "p", "twice"), (None, "q", "twice")]
    labels = [(rng.choice([None, *range(30)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1, 2])) for _ in range(25)]
    df = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit(1)).withColumn("mask", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = A.audit(df, spark.createDataFrame(labels, LABELS)).select(*COLUMNS)
    rows = got.collect()
    assert len(rows) == 600 * 3
    assert {tuple(r) for r in rows} == brute(docs, labels)
    assert {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}


def test_empty_table_and_long_text(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(spark.createDataFrame([], DOCS), none).count() == 0
    one = A.audit(spark.createDataFrame([(1, "s", "word " * 500_000)], DOCS), none).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r["removed"] for r in one] == [0, 1, 0, 0, 0] and [r["shapley"] for r in one] == [0, 120, 0, 0, 0]


def test_no_python_and_no_cross_join_in_the_plan(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    plan = A.audit(docs, labels)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop"))
