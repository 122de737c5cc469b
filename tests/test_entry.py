"""The driver contract, and the independence of the rest from the corpus operators."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[:2] == ["project", "index"] and out.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_operators():
    for path in ROOT.glob("montage/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", path.read_text()), path


def test_a_missing_module_of_ours_is_left_out_and_others_are_not(monkeypatch):
    def missing(name):
        raise ModuleNotFoundError(name="montage.llm" if name.startswith("montage.llm") else name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing)
    assert __spark_entry__._optional("montage.llm.queries") is None
    assert __spark_entry__._optional("corpus_pipeline") is None
    monkeypatch.setattr(__spark_entry__.importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError(name="numpy")))
    try:
        __spark_entry__._optional("montage.llm.queries")
    except ModuleNotFoundError as e:
        assert e.name == "numpy"
    else:
        raise AssertionError("a missing library went unnoticed")
