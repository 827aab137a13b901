"""The optional query modules: absent ones are left out, broken ones are an error."""

import importlib

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("missing", ["xxhash", "kpiforge.llm.mistyped", "kpiforge.llm", "corpus_pipeline"])
def test_only_an_absent_package_is_left_out(monkeypatch, missing):
    def fail(name):
        raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

    monkeypatch.setattr(importlib, "import_module", fail)
    if missing in ("kpiforge.llm", "corpus_pipeline"):
        assert entry._optional("corpus_pipeline") is None
    else:
        with pytest.raises(ModuleNotFoundError):
            entry._optional("corpus_pipeline")
