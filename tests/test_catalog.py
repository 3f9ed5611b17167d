"""Queries against their SQL on small tables of odd texts."""

from __future__ import annotations

import duckdb
import pytest

from sentria.plans import catalog

# the mark that ends the last of the letters spaced out ends its sentence too
ODD = [
    (1, "Wa wa y. y. y. y. Doím doím. Es ra.\nDe ra.", "es", "web"),
    (2, "Que é. é. é. Ai ai oum. Que é. é. é. ai oum.", "fr", "web"),
    (3, "Edat a. a. a. Ered ered.\nTo be.\nTo be.", "en", "books"),
    (4, "Edat a. a. a.\nOrat. Orat.", "en", "books"),
    (5, "Die a. a. a. Der Hund.", "de", "code"),
    (6, "a. a. a. Ered ered. Ered ered.", "en", "code"),
    (7, "Edat a. a. a. Edshea,", "en", "code"),
    (8, "", "en", "code"),
]
#: Queries whose results followed the places of sentences that differed from the SQL.
QUERIES = ["explode_sentences", "gold_units", "projection", "repeated_sentences", "sentence_statistics", "split_mode_compare", "tiling_length", "context_window", "profile_comparison", "protected_periods", "sentences_clean"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()[name]).fetchall()
    got = [tuple(x) for x in catalog.queries()[name](spark, tables).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
