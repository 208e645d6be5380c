import __spark_entry__ as entry


def test_entry_has_rows_and_queries_match_oracles(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "map" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_stay_without_the_llm_folders(monkeypatch):
    import importlib.util

    real = importlib.util.find_spec
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name, *a: None if name in ("orpheon.llm", "corpus_pipeline") else real(name, *a))
    names = set(entry.queries())
    assert "retrieval_map_mrr" in names and not any(n.startswith("op") and "_" in n and n[2].isdigit() for n in names)
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_the_llm_folder():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for f in [*root.glob("orpheon/**/*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts:
            assert "orpheon.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
