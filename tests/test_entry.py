import importlib
import sys


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert {"model", "gap_steps", "n", "ADE_km"} <= set(df.columns) and df.count() > 0


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_llm_folders(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("seatracks.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "seatracks.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "gap_windows" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) == names
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
