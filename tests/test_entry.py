import importlib
import sys

from .conftest import rows


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_core_stands_without_the_llm_subpackage(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("stratalog.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "stratalog.llm", None)
    importlib.reload(entry)
    assert "p2_found" in entry.queries() and "p7_ids" not in entry.queries()


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["entry_key", "sequence_number"] and len(rows(df)) > 0
