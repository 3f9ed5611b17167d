"""Column functions, corpus and streaming operators against the kernel and DuckDB."""

from __future__ import annotations

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from sentria.api import Segmenter
from sentria.functions import clean as c
from sentria.functions import sentences as s
from sentria.kernel import segment
from sentria.kernel.profiles import BUILT_IN, Hooks
from sentria.operators import corpus, scoring
from sentria.plans import catalog
from sentria.streaming.sentences import replay_sentences, stream_sentences

SF = "/root/testdata/sf0.001"


def test_columns_equal_the_kernel(spark):
    rows = [(1, "Mr. Fox ran. He won!", "en"), (2, None, "en"), (3, "", "de"), (4, "Hallo. Welt.", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in df.select("doc_id", s.sentences("text").alias("a"), s.sentences("text", F.col("lang")).alias("b"), s.sentence_spans("text").alias("c")).collect()}
    assert got[1].a == Segmenter().segment(rows[0][1]) and got[2].a == [] and got[3].b == [] and got[4].b is None
    assert "".join(x.sent for x in got[1].c) == rows[0][1]


def test_sql_functions(spark):
    s.register(spark)
    assert spark.sql("SELECT sentences('One. Two.', 'en') AS x").first().x == ["One.", "Two."]
    assert spark.sql("SELECT count(*) AS n FROM explode_sentences('One. Two. Three.', 'en')").first().n == 3
    assert spark.sql("SELECT count(*) AS n FROM explode_sentences('One. Two.', 'xx')").first().n == 0
    assert spark.sql("SELECT sentences('Wait... She left.', 'en', 'conservative') AS a, sentences('x', 'xx') AS b, sentences('x', 'en', 'wild') AS c").first() == (["Wait... She left."], None, None)
    row = spark.sql("SELECT sentences_clean('a\\\\nB', 'en') AS a, clean_text('It ended.Now') AS b, terminal_punct('Yes!»', 'fr') AS c, boundary_f1(array('A.', 'B.'), array('A.B.')) AS d, strip_zero_width('\u200b x') AS e, sentences_lookahead('See Dr.', 'en').should_wait_for_more AS f").first()
    assert (row.b, row.c, row.d, row.e, row.f) == ("It ended. Now", "!", 0.0, " x", True) and row.a == ["a", "B"]


def test_odd_rows_of_every_column_function(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", "de"), (3, " \u200b\n ", None), (4, "x" * 300000, "en")], "i int, text string, lang string")
    got = df.select("i", s.sentence_spans("text").alias("a"), s.should_wait("text").alias("b"), s.protected_periods("text").alias("c"), s.sentences_lookahead("text").alias("d"), s.sentences("text", F.col("lang")).alias("e"), s.sentences_clean("text").alias("f")).orderBy("i").collect()
    assert [len(r.a) for r in got] == [0, 0, 1, 1] and [r.b for r in got] == [False, False, False, True]
    assert [r.e for r in got][:3] == [[], [], None] and all(r.c == [] for r in got) and [len(r.f) for r in got] == [0, 0, 0, 1]
    assert df.limit(0).select(s.sentences_lookahead("text").alias("x")).count() == 0


def test_clean_is_the_same_in_both_planes(spark):
    texts = ["a\\nb. C", "x \nand y", "Hello.World is", "<b>bold</b> text &lt;i&gt;z&lt;/i&gt;", "see [why?] ``quoted''", "Contents.....12\nnext", "http://a.B.com x.Y", "", "a-\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for doc_type in (None, "pdf"):
        got = {r.i: r.t for r in df.select("i", c.clean_text("text", doc_type).alias("t")).collect()}
        assert [got[i] for i in range(len(texts))] == [c.clean(t, doc_type) for t in texts]


def test_hooks_and_small_tables(spark):
    own = replace(BUILT_IN["en"], code="own", hooks=Hooks(numbers=lambda line, at, cut: None if line[at - 1] == "§" else cut))
    df = spark.createDataFrame([("Section §. 5 applies. Next one.",)], "text string")
    assert df.select(s.sentences("text", own).alias("x")).first().x == ["Section §. 5 applies.", "Next one."]
    kept = replace(BUILT_IN["en"], code="own", hooks=Hooks(split=lambda line, cuts: set(), classify=lambda word, kind: "title" if word == "Zog" else kind))
    assert segment.sentences("One. Two.", kept) == ["One. Two."]
    empty = spark.createDataFrame([], "bucket string, exact_match double, boundary_f1 double")
    base = spark.createDataFrame([("golden_rules", 0.98, 0.99), ("x", 0.5, 0.5)], "bucket string, exact_match double, boundary_f1 double")
    assert {r.bucket for r in scoring.gate(empty, base).collect()} == {"golden_rules", "x"}
    now = spark.createDataFrame([("golden_rules", 0.979, 0.99), ("x", 0.47, 0.49)], "bucket string, exact_match double, boundary_f1 double")
    assert [r.bucket for r in scoring.gate(now, base).collect()] == ["golden_rules"]


def test_scores(spark):
    rows = [(["a b", "c"], ["a b", "c"]), (["a b c"], ["a b", "c"]), (["x"], ["y"]), (["z"], ["z"])]
    got = spark.createDataFrame(rows, "p array<string>, g array<string>").select(scoring.exact_match("p", "g").alias("em"), scoring.boundary_scores("p", "g").alias("f")).collect()
    assert [r.em for r in got] == [True, False, False, True]
    assert got[0].f.f1 == 1.0 and got[1].f.recall == 0.0 and got[2].f is None and got[3].f.f1 == 1.0


def test_replay_equals_the_stream_operator(spark, tmp_path):
    rows = [(k, i, d) for k in (1, 2) for i, d in enumerate(["Mr. ", "Fox ran. He ", "won!", " Then U.S. ", "left"])]
    df = spark.createDataFrame(rows, "stream_id long, seq long, delta string")
    batch = sorted(tuple(r) for r in replay_sentences(df).collect())
    folder = str(tmp_path / "in")
    df.union(spark.createDataFrame([(1, 99, None), (2, 99, None)], "stream_id long, seq long, delta string")).coalesce(1).write.json(folder)
    source = spark.readStream.schema("stream_id long, seq long, delta string").json(folder)
    query = stream_sentences(source).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("streamed").collect()) == batch
    assert "".join(r[2] for r in batch if r[0] == 1) == "Mr. Fox ran. He won! Then U.S. left"


def test_context_and_starts(spark):
    docs = spark.createDataFrame([("d", "One two. Three.")], "doc_id string, text string")
    rows = corpus.explode_sentences(docs)
    got = corpus.context_window(rows).orderBy("sent_id").collect()
    assert got[0].before_1 is None and got[0].after_1 == "Three."
    tokens = spark.createDataFrame([("d", 0, 0, "One"), ("d", 1, 4, "two."), ("d", 2, 9, "Three.")], "doc_id string, token_id int, idx int, token string")
    assert [r.is_sent_start for r in corpus.tokens_with_sentence_starts(tokens, rows).orderBy("idx").collect()] == [True, False, True]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "events", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert name in catalog.oracle_sql()
    got = catalog.queries()[name](spark, SF)
    wanted = con.sql(catalog.oracle_sql()[name])
    tidy = lambda rows: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    at = [wanted.columns.index(x) for x in got.columns]
    assert tidy(tuple(r) for r in got.collect()) == tidy(tuple(r[i] for i in at) for r in wanted.fetchall())
