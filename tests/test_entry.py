"""The driver's entry points: the core's queries are there whatever becomes of the training-data operators."""

import importlib

import pytest

import __spark_entry__
from siltstone.plans import queries as core


@pytest.mark.parametrize("error", [ImportError("no module named zstandard"), ModuleNotFoundError("siltstone.llm")])
def test_core_without_the_training_data_operators(monkeypatch, error):
    inner = importlib.import_module

    def broken(name, *args):
        if name.startswith("siltstone.llm") or name == "corpus_pipeline":
            raise error
        return inner(name, *args)

    monkeypatch.setattr(importlib, "import_module", broken)
    assert set(__spark_entry__.queries()) == set(core.QUERIES) and set(__spark_entry__.oracle_sql()) == set(core.ORACLES)


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(core.QUERIES) <= set(__spark_entry__.queries())
