"""The entry without its optional part."""

from __future__ import annotations

import importlib
import sys
import warnings

import pytest

import __spark_entry__ as entry


def test_core_queries_survive_a_missing_dependency(monkeypatch):
    pytest.importorskip("corpus_pipeline")
    core = set(entry.catalog.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("kassa.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow.compute", None)          # as if it were not installed
    monkeypatch.setitem(sys.modules, "zstandard", None)
    try:
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            alone = importlib.reload(entry)
        assert set(alone.queries()) == core and set(alone.oracle_sql()) <= core
        assert any("left out" in str(w.message) for w in said)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
