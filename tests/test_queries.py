import pytest
from oracle import compare

from granary.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, SMALL, catalog.QUERIES[name], catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry_imports_without_the_training_data_package(monkeypatch):
    import sys

    import __spark_entry__

    for name in [*[m for m in sys.modules if m.startswith("granary.llm")], "corpus_pipeline", "granary.llm"]:
        monkeypatch.delitem(sys.modules, name, raising=False)

    class Hide:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("granary.llm"):
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Hide(), *sys.meta_path])
    assert set(__spark_entry__.queries()) == set(catalog.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalog.ORACLES)
