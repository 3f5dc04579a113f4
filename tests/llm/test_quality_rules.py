import re
from collections import Counter

from pyspark.sql import functions as F

from seatracks.llm import quality_rules as Q
from seatracks.llm.queries import queries

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    inside = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_statistics_on_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\nx\n\n\ny\nx", "a\x0bb\x1cc d", "é#*$%&|<> \n #", "a b c d " * 3000, "a a a a a", "one two\none two three one two three"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("host", F.lit(1))
    got = Q.text_statistics(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in Q.STATS) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_boilerplate_lines_are_removed_and_depleted_documents_rejected(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits count as one
    own = lambda i: " ".join(f"word{letters(i)}x{letters(k)}" for k in range(60))
    foot = "All news at 9 " + " ".join(f"foot{letters(k)}" for k in range(90))
    rows = [(i, f"{own(i)}\n{foot}", "a") for i in range(20)]
    rows.append((20, f"{' '.join('z' * k for k in range(1, 11))}\n{foot.upper()}", "a"))
    rows += [(100 + i, f"{own(1000)}\nlast line {i % 2}", "b") for i in range(30)]  # copies count once
    rows += [(200, f"{own(3000)}\n{foot}", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    verdicts, _ = Q.judged(df)
    by = {r["doc_id"]: r for r in verdicts.collect()}
    words = len(foot.split())
    assert all(by[i]["words_removed"] == words and by[i]["kept"] for i in range(20))
    assert by[20]["words_removed"] == words and not by[20]["kept"] and not by[20]["base_failed"]
    assert all(by[100 + i]["words_removed"] == 0 and by[100 + i]["kept"] for i in range(30))
    assert by[200]["words_removed"] == 0
    left = {r["doc_id"]: r["text"] for r in Q.cleaned(df).collect()}
    assert 20 not in left and left[3] == own(3) and left[200].endswith(foot)


def test_stage_removes_frequent_lines_from_large_hosts_and_hosts_of_copies(spark):
    import corpus_pipeline as P

    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits count as one
    own = lambda i: " ".join(f"word{letters(i)}x{letters(k)}" for k in range(60))
    foot = "footer " * 3
    rows = [(i, own(i) + (f"\n{foot}" if i < 15 else ""), "large") for i in range(300)]  # 15 of 300 documents, under a tenth
    rows += [(1000 + i, f"{own(999)}\n{foot}", "copies") for i in range(200)]  # 200 rows, but 1 document
    rows += [(2000 + i, f"{own(2000 + i)}\n{foot}", "copies") for i in range(12)]
    rows += [(3000 + i, f"{own(3000 + i)}\n{foot}", "rare") for i in range(10)]
    left = {r["doc_id"]: r["text"] for r in P.apply_quality_rules(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert set(left) == {i for i, _, _ in rows}
    assert all(("footer" in left[i]) == (host == "rare") for i, _, host in rows)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.judged(empty)[0].count() == 0 and Q.cleaned(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a"), (1, text, "a"), (None, text, "a"), (2, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.judged(df)[0].collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got) == [(0, True), (1, True), (1, True), (2, False)]
    assert Q.cleaned(df).count() == 3


def test_query_matches_brute_force(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op5_quality_rules"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        n = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in Q.STATS) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_documents_that_differ_in_numbers_only_count_each(spark):
    foot = "\n".join(f"shared footer line {'abcdefgh'[k]} of the shop " + "x " * 8 for k in range(8))
    rows = [(i, f"Order {i} placed on day {i % 28}\n" + " ".join(f"item{k}" for k in range(300)) + f" {i}\n{foot}", "shop") for i in range(60)]
    rows += [(100 + i, f"note\n{foot}", "copies") for i in range(60)]  # exact copies are one document
    by = {r["doc_id"]: r["words_removed"] for r in Q.judged(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert all(by[i] >= len(foot.split()) for i in range(60)) and all(by[100 + i] == 0 for i in range(60))


def brute_cleaned(rows, most=10):
    """(id, text left) of the kept rows, lines counted as texts."""
    docs, out = {}, []
    norm = lambda x: b" ".join(re.sub("[0-9]", "0", x.lower()).encode().split())
    for _, text, host in rows:
        for line in (text or "").split("\n"):
            if norm(line):
                docs.setdefault((host or "", norm(line)), set()).add(text)
    for i, text, host in rows:
        n, _, _, _, inside = brute(text)
        left = [x for x in (text or "").split("\n") if not norm(x) or len(docs[host or "", norm(x)]) <= most]
        if n >= 50 and 100 * inside <= 50 * n and len(WORD.findall("\n".join(left))) >= 0.3 * n:
            out.append((i, "\n".join(left)))
    return out


def test_cleaned_matches_brute_force_on_rows_that_share_ids(spark):
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    foot = "all rights of this page " * 3
    rows = [(None if i % 3 else i % 6, own(f"{i:b}".replace("0", "a").replace("1", "b")) + (f"\n{foot}" if i % 2 else ""), "a") for i in range(60)]
    rows += [(0, "two words", "a"), (0, own("q") + f"\n{foot}", "b"), (0, own("q") + f"\n{foot}", "a"), (7, None, "a"), (8, foot * 2, None)] * 2
    plain = spark.createDataFrame(rows, SCHEMA)
    clash = plain.withColumns({c: F.lit(1) for c in ("_cut", "_rid", "rid", "host", "h", "hashes", "kept", "n_words", "lines")})
    got = Q.cleaned(clash)
    assert got.columns == clash.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted(brute_cleaned(rows), key=key)


def test_pipeline_stage_matches_brute_force_on_the_table(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = P.apply_quality_rules(spark, docs, data)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(brute_cleaned(rows))
