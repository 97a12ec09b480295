"""The entry points with and without the training-data operators."""

import builtins
import sys

import pytest


@pytest.mark.parametrize("absent", ["contextmill.llm", "zstandard", "public_tokenizers"])
def test_other_queries_work_without_them(monkeypatch, capsys, absent):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("contextmill.llm") or m in ("corpus_pipeline", absent)]:
        monkeypatch.delitem(sys.modules, name)
    plain = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name == absent or name.startswith(absent + "."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return plain(name, *args, **kwargs)

    class Finder:
        def find_spec(self, name, path=None, target=None):
            if name == absent or name.startswith(absent + "."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Finder(), *sys.meta_path])
    monkeypatch.setattr(builtins, "__import__", refuse)
    assert set(entry.queries()) == set(entry.QUERIES) and set(entry.oracle_sql()) == set(entry.ORACLE)
    assert "without the training-data operators" in capsys.readouterr().err


def test_sql_is_for_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
