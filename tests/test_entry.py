import sys


def test_a_library_that_is_missing_costs_only_its_queries(monkeypatch):
    """Whatever keeps the subpackage for training data from being imported, all other queries are there."""
    import __spark_entry__ as entry
    from maldure.plans.registry import QUERIES, SQL

    monkeypatch.setitem(sys.modules, "maldure.llm.queries", None)
    if "maldure.llm" in sys.modules:
        monkeypatch.delattr(sys.modules["maldure.llm"], "queries", raising=False)
    assert entry.queries() == QUERIES and entry.oracle_sql() == SQL and len(QUERIES) > 90


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
