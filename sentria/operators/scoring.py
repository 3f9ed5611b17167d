"""Quality metrics over predicted and gold sentence lists, in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ANY_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bare(c: Column) -> Column:
    return F.transform(c, lambda x: F.regexp_replace(x, _ANY_SPACE, ""))


def boundaries(sents: Column | str) -> Column:
    """Places of the inner boundaries in the text without white space: running sums of the items' lengths, without the last."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["seen"], a["at"] + n).alias("seen"))
    lengths = F.transform(_bare(_col(sents)), lambda x: F.length(x))
    inner = F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0)))
    return F.array_distinct(F.aggregate(inner, start, step, lambda a: a["seen"]))


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    """Equality of the trimmed lists without empty items."""
    tidy = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, rf"\A{_ANY_SPACE}|{_ANY_SPACE}\z", "")), lambda x: x != "")
    return tidy(_col(pred)) == tidy(_col(gold))


def _scores(pb: Column, gb: Column) -> Column:
    hit = F.size(F.array_intersect(pb, gb)).cast("double")
    precision = F.when(F.size(pb) > 0, hit / F.size(pb)).otherwise(1.0)
    recall = F.when(F.size(gb) > 0, hit / F.size(gb)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(1.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def _same(p: Column, g: Column) -> Column:
    return F.regexp_replace(F.array_join(p, ""), _ANY_SPACE, "") == F.regexp_replace(F.array_join(g, ""), _ANY_SPACE, "")


def boundary_scores(pred: Column | str, gold: Column | str) -> Column:
    """struct(precision, recall, f1); null where the characters differ; a side without boundaries counts as 1.

    For long lists use :func:`scored`, which computes each side's boundaries once.
    """
    p, g = _col(pred), _col(gold)
    return F.when(_same(p, g), _scores(boundaries(p), boundaries(g)))


def scored(units: DataFrame) -> DataFrame:
    """``units`` with em and f1. A generator of one row keeps the optimizer from copying the boundary lists into every use."""
    once = F.explode(F.array(F.struct(boundaries("pred").alias("p"), boundaries("gold").alias("g"), _same(F.col("pred"), F.col("gold")).alias("same"), exact_match("pred", "gold").cast("int").alias("em"))))
    return units.withColumn("_x", once).withColumn("em", F.col("_x.em")).withColumn("f1", F.when(F.col("_x.same"), _scores(F.col("_x.p"), F.col("_x.g")).getField("f1"))).drop("_x", "pred", "gold")


def scoreboard(units: DataFrame) -> DataFrame:
    """``units(segmenter, corpus, lang, pred, gold)`` to mean scores by segmenter, and by corpus and by language: one expand, one partial aggregation."""
    grouped = scored(units).select("segmenter", "corpus", "lang", "em", "f1").groupingSets([["segmenter"], ["segmenter", "corpus"], ["segmenter", "lang"]], "segmenter", "corpus", "lang")
    return grouped.agg(F.count("*").alias("n"), F.avg("em").alias("exact_match"), F.avg("f1").alias("boundary_f1"))


def divergences(units: DataFrame, k: int = 120) -> DataFrame:
    """Units that segmenters read differently, the most different first: ``units(unit_id, segmenter, pred)``.

    Ranked by the number of different readings, then by the boundaries that not all segmenters have.
    """
    by_unit = units.withColumn("at", boundaries("pred")).groupBy("unit_id").agg(F.count_distinct("pred").alias("n_readings"), F.count("*").alias("n"), F.flatten(F.collect_list("at")).alias("all"))
    apart = F.size(F.filter(F.array_distinct("all"), lambda x: F.size(F.filter(F.col("all"), lambda y: y == x)) < F.col("n")))
    return by_unit.where("n_readings > 1").withColumn("n_disputed", apart).select("unit_id", "n_readings", "n", "n_disputed").orderBy(F.desc("n_readings"), F.desc("n_disputed"), "unit_id").limit(k)


# Points of exact match that a corpus may lose; others have the default.
EM_TOLERANCES = {"golden_rules": 0.0, "ud_zh_gsd": 0.0}
EM_TOLERANCE, F1_TOLERANCE = 0.034, 0.015


def gate(scores: DataFrame, baseline: DataFrame, tolerances: dict[str, float] | None = None, tolerance: float = EM_TOLERANCE, f1_tolerance: float = F1_TOLERANCE) -> DataFrame:
    """Buckets whose scores fell below the baseline by more than their tolerance, with both drops. A bucket that is missing fails."""
    own = EM_TOLERANCES if tolerances is None else tolerances
    b = baseline.select("bucket", F.col("exact_match").alias("base_em"), F.col("boundary_f1").alias("base_f1"))
    allowed = F.lit(tolerance)
    for bucket, value in own.items():
        allowed = F.when(F.col("bucket") == bucket, F.lit(value)).otherwise(allowed)
    joined = b.join(scores.select("bucket", "exact_match", "boundary_f1"), "bucket", "left").withColumn("em_drop", F.col("base_em") - F.col("exact_match")).withColumn("f1_drop", F.col("base_f1") - F.col("boundary_f1"))
    return joined.where(F.col("exact_match").isNull() | (F.col("em_drop") > allowed + 1e-12) | (F.col("f1_drop") > f1_tolerance + 1e-12)).select("bucket", "em_drop", "f1_drop")


def compare_profiles(units: DataFrame, profiles: tuple[str, ...] = ("en", "en_legal")) -> DataFrame:
    """Each unit's sentences under several profiles, and their scores where ``units(unit_id, text, gold)`` has gold."""
    from sentria.functions.sentences import sentences

    out = units
    for name in profiles:
        out = out.withColumn(name, sentences("text", name))
    scores = [c for name in profiles for c in (F.size(name).alias(f"n_{name}"), F.when(F.col("gold").isNotNull(), exact_match(name, "gold")).alias(f"em_{name}"), boundary_scores(name, "gold").getField("f1").alias(f"f1_{name}"))]
    same = F.lit(True)
    for name in profiles[1:]:
        same = same & (F.col(name) == F.col(profiles[0]))
    return out.select("unit_id", *scores, same.alias("same"))


def snapshot_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """Inputs whose sentences changed, appeared or went: ``(lang, input, sents)`` on both sides."""
    a, b = now.withColumnRenamed("sents", "now"), before.withColumnRenamed("sents", "before")
    return a.join(b, ["lang", "input"], "full").where(~F.col("now").eqNullSafe(F.col("before")))


def latency_statistics(measured: DataFrame, by: str = "name", value: str = "seconds") -> DataFrame:
    """Mean, median, p95 and p99."""
    return measured.groupBy(by).agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.percentile(value, F.lit(0.99)).alias("p99"))


def emission_lag(emitted: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens between a sentence's last character and its emission: ``emitted(stream_id, end, at_token)``, ``tokens(stream_id, token_id, size)``.

    Ends and the tokens' reaches are sorted together, and every end takes the first token that reaches it.
    """
    order = Window.partitionBy("stream_id").orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    reach = tokens.select("stream_id", F.sum("size").over(order).alias("end"), "token_id")
    both = emitted.select("stream_id", "end", "at_token").unionByName(reach, allowMissingColumns=True)
    after = Window.partitionBy("stream_id").orderBy("end", F.col("token_id").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    met = both.withColumn("first", F.first("token_id", ignorenulls=True).over(after)).where("at_token is not null")
    return met.select("stream_id", "end", "at_token", F.col("first").alias("token_id"), (F.col("at_token") - F.col("first")).alias("lag"))
