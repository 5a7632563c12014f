import sys

import pytest

import __spark_entry__ as entry


def test_only_what_was_taken_away_may_be_missing(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "mistyped_part.py").write_text("import no_such_module_at_all\n")
    assert entry._optional("taken_away_part") is None
    assert entry._optional("mistyped_part", "no_such_module_at_all") is None
    with pytest.raises(ModuleNotFoundError):
        entry._optional("mistyped_part")
    sys.modules.pop("mistyped_part", None)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "derived_device" in entry.oracle_sql()
