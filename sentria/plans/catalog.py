"""Named queries of the sentence engine. Their SQL is in :mod:`sentria.plans.oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentria import registry
from sentria.functions import clean as c
from sentria.functions import sentences as s
from sentria.kernel import segment
from sentria.operators import corpus, scoring
from sentria.plans import cases, oracles
from sentria.runtime import new_path, read_table, spread
from sentria.sources import readers
from sentria.streaming.sentences import replay_sentences, stream_sentences

Query = Callable[[SparkSession, str], DataFrame]
MODES = segment.MODES


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text", "lang"))))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


def _rows(spark: SparkSession, sf_dir: str, mode: str = "balanced") -> DataFrame:
    return corpus.explode_sentences(_docs(spark, sf_dir), language=F.col("lang"), mode=mode)


# ---- sentences and spans

def sentence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.sentence_statistics(_docs(spark, sf_dir, "text", "lang"), F.col("lang"))


def explode_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


def explode_sentences_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, called for each row of a table."""
    s.register(spark)
    _turns(spark, sf_dir).createOrReplaceTempView("sentria_turns")
    return spark.sql("SELECT conv_id, turn, e.sent_id, e.sent, e.start, e.`end` FROM sentria_turns t, LATERAL explode_sentences(t.text, 'en', 'balanced') e")


def functions_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar SQL function over a table."""
    s.register(spark)
    _turns(spark, sf_dir).createOrReplaceTempView("sentria_turns")
    return spark.sql(
        """
        SELECT conv_id, turn, size(sentences(text, 'en', 'aggressive')) AS n_aggressive, size(sentence_spans(text)) AS n_spans,
          should_wait(text, 'en') AS waits, sentences_lookahead(text, 'en').should_wait_for_more AS waits_again,
          size(protected_periods(text)) AS n_protected, size(sentences_clean(replace(text, ' ', '  '), 'en')) AS n_clean,
          clean_text(replace(text, '!', '`')) AS cleaned, strip_zero_width(concat(' \\u200b', text)) AS stripped,
          terminal_punct(concat(text, '?”'), 'en') AS mark, boundary_f1(sentences(text), sentences(text, 'en', 'balanced')) AS f1
        FROM sentria_turns"""
    )


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _docs(spark, sf_dir).select("doc_id", s.sentence_spans("text", F.col("lang")).alias("spans"))
    return spans.select("doc_id", F.array_join(F.transform("spans", lambda x: x["sent"]), "").alias("text"))


def tiling_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _docs(spark, sf_dir).select("doc_id", s.sentence_spans("text", F.col("lang")).alias("spans"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return spans.select("doc_id", F.size("spans").alias("n_spans"), total.alias("total"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"])), F.lit(0)).cast("long").alias("last_end"))


def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sentences are not their spans without white space at the ends."""
    docs = _docs(spark, sf_dir).select(s.sentences("text", F.col("lang")).alias("a"), s.sentence_spans("text", F.col("lang")).alias("b"))
    bare = F.transform("b", lambda x: F.regexp_replace(x["sent"], rf"\A[\s{c.ZERO_WIDTH}]+|[\s{c.ZERO_WIDTH}]+\z", ""))
    return docs.agg(F.count_if(F.col("a") != F.filter(bare, lambda x: x != "")).alias("n_mismatches"), F.sum(F.size("a")).alias("n_sentences"))


def hard_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a line break ends: as many as there are breaks between texts."""
    return _rows(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("sent").rlike(r"\S\s*[\r\n]")).alias("n"), F.count_if(F.col("sent").rlike(r"[\r\n]\s*\S")).alias("n_inside"))


def number_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods between digits that lie inside a sentence."""
    return _rows(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.regexp_count("sent", F.lit(r"[0-9]\.[0-9]"))).cast("long").alias("n"))


def protected_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.transform(s.protected_periods("text", F.col("lang")), lambda x: x.cast("string"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(places, " ").alias("places"))


def split_mode_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", *[F.size(s.sentences("text", F.col("lang"), mode)).alias(mode) for mode in MODES])


def should_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", s.should_wait("text").alias("should_wait"))


def lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _turns(spark, sf_dir).select("conv_id", "turn", s.sentences_lookahead("text").alias("x"))
    return found.select("conv_id", "turn", F.size("x.segments").alias("n_segments"), "x.should_wait_for_more")


# ---- streams

def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("delta"))


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay_sentences(_deltas(spark, sf_dir))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sent"))), lambda x: x["sent"]), "")
    return out.groupBy("stream_id").agg(joined.alias("text")).withColumnRenamed("stream_id", "conv_id")


def stream_replay_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their places in each stream, as the stream emits them."""
    return replay_sentences(_deltas(spark, sf_dir), buffering="aggressive", max_buffer_size=1 << 20)


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas that arrive as files, through the stateful operator into files: a source, a sink and what lies between."""
    folder, out, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    turns = _deltas(spark, sf_dir)
    readers.write_results(turns.union(turns.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq"), F.lit(None).cast("string").alias("delta"))).coalesce(1), folder)
    readers.drain_stream(stream_sentences(readers.deltas(spark, folder)), out, state).awaitTermination()
    return spark.read.parquet(out).select("stream_id", "sent", "start", "end")


def emission_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens between each sentence's last character and the end of its turn, where a batch emits it."""
    turns = _turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    words = F.split("text", " ", -1)
    tokens = turns.select("stream_id", F.posexplode(F.transform(words, lambda w: F.length(w) + 1)).alias("token_id", "size"))
    ends = corpus.explode_sentences(turns, keep=("stream_id",)).select("stream_id", (F.col("start") + F.length(F.rtrim("sent"))).alias("end"))
    last = turns.select("stream_id", (F.size(words) - 1).alias("at_token"))
    return scoring.emission_lag(ends.join(last, "stream_id"), tokens).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("lag").alias("lag"), F.max("lag").alias("longest"))


# ---- cleaner

def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", c.clean_text("text").alias("text"))


def clean_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout line breaks: every third word begins a line."""
    broken = F.regexp_replace("text", r"([^ \n]+ [^ \n]+) ", "$1 \n")
    return _docs(spark, sf_dir).select("doc_id", c.clean_text(broken, "pdf").alias("text"))


def sentences_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of texts in which markup and written breaks stand for blanks."""
    marked = F.replace(F.replace("text", F.lit(" a"), F.lit("<b class='x>y'> </b>a")), F.lit("\n"), F.lit("\\n"))
    return _docs(spark, sf_dir).where("lang = 'en'").select("doc_id", F.size(s.sentences_clean(marked)).alias("n_sentences"))


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", c.strip_tags("html").alias("text"))


def clean_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", c.escapes(F.replace("text", F.lit(" a"), F.lit("\\n"))).alias("text"))


def clean_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", c.plain_quotes(F.translate("text", ".,", "`'")).alias("text"))


def clean_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", c.drop_repeats(F.regexp_replace("text", "[*&%$#]", "./")).alias("text"))


def strip_zero_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", c.strip_zero_width(F.concat(F.lit("​ "), "text", F.lit(" ‍"))).alias("text"))


def terminal_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", c.terminal_mark("text").alias("mark"))


# ---- corpus operators

def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return corpus.paragraphs(doubled)


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.context_window(_rows(spark, sf_dir))


def longest_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.longest_sentences(_rows(spark, sf_dir), 20)


def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_sentences(_rows(spark, sf_dir))


def sentence_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token annotation: how many tokens of each conversation turn start a sentence."""
    turns = _turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a token's place is the sum of the sizes before it, kept while the words are folded
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<idx:int,token:string>>").alias("seen"))
    step = lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.array_append(a["seen"], F.struct(a["at"].alias("idx"), w.alias("token"))).alias("seen"))
    placed = turns.select("doc_id", F.posexplode(F.aggregate(F.split("text", " ", -1), start, step, lambda a: a["seen"])).alias("token_id", "t"))
    tokens = placed.select("doc_id", "token_id", "t.idx", "t.token").where("token <> ''")
    marked = corpus.tokens_with_sentence_starts(tokens, corpus.explode_sentences(turns))
    return marked.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.col("is_sent_start").cast("int")).alias("n_starts"))


# ---- sources and sinks

def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written one a file and read whole: the sentences of each file."""
    folder = new_path(spark, "texts")
    turns = read_table(spark, sf_dir, "benchmark").select("text").where("text is not null and text <> ''").distinct()
    turns.repartition(F.lit(1)).write.option("maxRecordsPerFile", 1).text(folder)
    files = readers.texts(spark, folder)
    return files.select(F.regexp_replace("text", r"\n\z", "").alias("text")).select("text", F.size(s.sentences("text")).alias("n_sentences"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose gold is the documents' lines."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(F.col("source").alias("corpus"), F.lit("prose").alias("genre"), F.col("lang").alias("language"), F.col("doc_id").cast("string").alias("unit_id"), "text", lines.alias("gold"))


def gold_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold units written as JSON lines and read back, with their scores."""
    folder = new_path(spark, "units")
    readers.write_results(_gold(spark, sf_dir), folder)
    units = spread(readers.gold_units(spark, folder)).withColumn("pred", s.sentences("text", F.col("language")))
    return units.select("unit_id", F.size("gold").alias("n_gold"), scoring.exact_match("pred", "gold").alias("em"), scoring.boundary_scores("pred", "gold").getField("recall").alias("recall"))


def treebank_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences written in the treebank format, a folder a language, and read back: how many there are, and the characters of their text."""
    folder = new_path(spark, "treebank")
    rows = _gold(spark, sf_dir).select("language", F.explode("gold").alias("sent")).withColumn("sent", F.regexp_replace("sent", r"\s+", " "))
    lines = rows.select("language", F.concat(F.lit("# text = "), "sent", F.lit("\n1\t_\t_\n")).alias("value"))
    lines.write.option("maxRecordsPerFile", 100_000).partitionBy("language").text(folder)
    units = readers.conll_u(spark, folder, "xx").select(F.regexp_extract("unit_id", "/language=([^/]*)/", 1).alias("language"), F.size("gold").alias("n"), F.length("text").alias("c"))
    # units of a language are joined by a blank each
    return units.groupBy("language").agg(F.sum("n").cast("int").alias("n_sentences"), (F.sum("c") + F.count("*") - 1).cast("int").alias("n_chars")).drop("language")


def plain_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of free texts as units without gold."""
    doubled = _docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return readers.plain_units(doubled, "table", "prose", "en", "doc_id").select("unit_id", "text", F.col("gold").isNull().alias("no_gold"))


# ---- scores

def _modes(spark: SparkSession, sf_dir: str, pred: str = "conservative") -> DataFrame:
    """Units with one mode's sentences as prediction and the balanced ones as gold."""
    docs = _docs(spark, sf_dir, "doc_id", "text", "lang", "source")
    return docs.select(F.col("doc_id").alias("unit_id"), F.lit(pred).alias("segmenter"), F.col("source").alias("corpus"), "lang", s.sentences("text", F.col("lang"), pred).alias("pred"), s.sentences("text", F.col("lang")).alias("gold"))


def boundary_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_modes(spark, sf_dir)).select("unit_id", "em", F.round("f1", 9).alias("f1"))


def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scoreboard(_modes(spark, sf_dir)).withColumn("boundary_f1", F.round("boundary_f1", 9)).withColumn("exact_match", F.round("exact_match", 9))


def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    units = docs.select(F.col("doc_id").alias("unit_id"), F.explode(F.array(*[F.struct(F.lit(m).alias("segmenter"), s.sentences("text", F.col("lang"), m).alias("pred")) for m in ("conservative", "aggressive")])).alias("u")).select("unit_id", "u.*")
    return scoring.divergences(units, 50)


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages whose conservative sentences fall below a baseline of full agreement; one of them may not fall at all."""
    scores = scoring.scored(_modes(spark, sf_dir)).groupBy(F.col("lang").alias("bucket")).agg(F.avg("em").alias("exact_match"), F.avg("f1").alias("boundary_f1"))
    base = spark.createDataFrame([(x, 1.0, 1.0) for x in oracles.GATED], "bucket string, exact_match double, boundary_f1 double")
    return scoring.gate(scores, base, {"de": 0.0}).select("bucket", F.round("em_drop", 9).alias("em_drop"), F.round("f1_drop", 9).alias("f1_drop"))


def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose sentences change between two modes."""
    docs = _docs(spark, sf_dir).select("lang", F.coalesce("text", F.lit("")).alias("input")).distinct()
    now, before = (docs.select("*", s.sentences("input", F.col("lang"), m).alias("sents")) for m in ("conservative", "aggressive"))
    return scoring.snapshot_difference(now, before).groupBy("lang").agg(F.count("*").alias("n_changed"))


def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.latency_statistics(read_table(spark, sf_dir, "events").where("value is not null"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


# ---- languages and rules

def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.languages(spark).select("code", "family", F.array_join("terminals", "").alias("marks"))


def lexicon_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms of each language that end a sentence before a lower-case word, which none may."""
    words = spread(registry.lexicon(spark).where(~F.col("abbr").rlike(r"\s|\.$")))
    held = words.withColumn("n", F.size(s.sentences(F.concat(F.lit("foo "), "abbr", F.lit(". bar baz")), F.col("lang"))))
    return held.groupBy("lang").agg(F.count_if(F.col("n") != 1).alias("n_split"), (F.count("*") >= 5).alias("enough"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every rule's cases."""
    rows = spark.createDataFrame([(n, rule, code, text) for n, rule, code, text, _ in cases.rules()], "id int, rule string, lang string, text string")
    return rows.select("id", "rule", "lang", F.array_join(s.sentences("text", F.col("lang")), "|").alias("sentences"))


def golden_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoreboard of the rules' cases."""
    units = readers.golden_rules(spark, [(code, text, want) for _, _, code, text, want in cases.rules()])
    scored = units.select(F.lit("kernel").alias("segmenter"), "corpus", F.col("language").alias("lang"), s.sentences("text", F.col("language")).alias("pred"), "gold")
    return scoring.scoreboard(scored)


def golden_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, x[0], x[1], x[2]) for i, x in enumerate(cases.MODES)], "id int, rule string, lang string, text string")
    return rows.select("id", "rule", *[F.size(s.sentences("text", F.col("lang"), m)).alias(m) for m in MODES])


def golden_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, x[0], x[1], x[2]) for i, x in enumerate(cases.WAITS)], "id int, rule string, lang string, text string")
    return rows.select("id", "rule", s.should_wait("text", F.col("lang")).alias("waits"))


def golden_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, x[0], x[1], x[2]) for i, x in enumerate(cases.PERIODS)], "id int, rule string, lang string, text string")
    return rows.select("id", "rule", F.concat_ws(" ", F.transform(s.protected_periods("text", F.col("lang")), lambda x: x.cast("string"))).alias("places"))


def golden_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, x[0], x[1], x[2]) for i, x in enumerate(cases.CLEAN)], "id int, rule string, kind string, text string")
    cleaned = F.when(F.col("kind") == "pdf", c.clean_text("text", "pdf")).when(F.col("kind") == "ja", c.clean_text("text", None, "ja")).otherwise(c.clean_text("text"))
    return rows.select("id", "rule", cleaned.alias("cleaned"))


def legal_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal texts under the general and the legal profile."""
    rows = [(f"legal-{i}", text, want) for i, (text, want) in enumerate(cases.LEGAL)]
    return scoring.compare_profiles(spark.createDataFrame(rows, "unit_id string, text string, gold array<string>"))


def profile_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many English documents each profile reads alike."""
    docs = _docs(spark, sf_dir).where("lang = 'en'").select(F.col("doc_id").alias("unit_id"), "text", F.lit(None).cast("array<string>").alias("gold"))
    return scoring.compare_profiles(docs, ("en", "es")).agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"), F.sum("n_en").alias("n_en"), F.sum("n_es").alias("n_es"))


_QUERIES = (
    sentence_statistics, explode_sentences, explode_sentences_sql, functions_sql, roundtrip, tiling_length, projection, hard_newlines, number_periods, protected_periods,
    split_mode_compare, should_wait, lookahead, stream_replay, stream_replay_sentences, stream_files, emission_lag, clean_text, clean_pdf, sentences_clean, clean_html,
    clean_escapes, clean_quotes, clean_repeated, strip_zero_width, terminal_mark, paragraphs, context_window, longest_sentences, repeated_sentences, sentence_starts,
    whole_files, gold_units, treebank_units, plain_units, boundary_f1, scoreboard, divergences, gate, snapshot_difference, latency_statistics, languages, lexicon_lint,
    golden, golden_scores, golden_modes, golden_waits, golden_periods, golden_clean, legal_comparison, profile_comparison,
)
flagship = sentence_statistics


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
