"""The driver's contract, and that nothing outside llm imports it."""

from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "sentence_statistics" in entry.queries()


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.lang for r in rows} == {"de", "en", "es", "fr"} and all(r.n_sentences >= r.n_docs > 0 for r in rows)


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "sentria").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"sentria\.llm|corpus_pipeline", p.read_text()), p
