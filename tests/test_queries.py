"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others have tests of their own."""

import pytest

from strainspark.plans import abundance, contrasts, curation, discovery, experiments, features, inference, methods

MODULES = (abundance, contrasts, curation, discovery, experiments, features, inference, methods)
QUERIES, SQL = {k: v for m in MODULES for k, v in m.Q.items()}, {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, duck, same, name):
    same(QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(SQL) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "strainspark"
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "strainspark.llm" not in path.read_text(), path
