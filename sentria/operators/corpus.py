"""Corpus operators: sentences of a DataFrame of documents as rows, and the analytics that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from sentria import registry
from sentria.functions.sentences import sentences
from sentria.kernel import segment
from sentria.kernel.profiles import Profile
from sentria.options import Options
from sentria.runtime import ship


def explode_sentences(docs: DataFrame, text: str = "text", language: str | Profile | Column = "en", mode: str = "balanced", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per sentence: the kept columns, sent_id, sent, start, end. No shuffle; only needed columns are read.

    Rows of an unknown language code have no sentences. The rows are made in Arrow: arrays of spans would cross to the JVM first.
    """
    Options(split_mode=mode)
    ship(docs.sparkSession)
    by_row = isinstance(language, Column)
    known = dict(registry.LANGUAGE_CODES) if by_row else {None: registry.profile(language)}
    chosen = docs.select(*keep, F.col(text).alias("_text"), *([language.alias("_lang")] if by_row else []))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            codes = batch.column(len(keep) + 1).to_pylist() if by_row else [None] * len(texts)
            for begin in range(0, len(texts), 200):  # a batch of long texts has very many sentences
                rows, ids, sents, starts, ends = [], [], [], [], []
                for at in range(begin, min(begin + 200, len(texts))):
                    if codes[at] in known:
                        found = segment.spans(texts[at], known[codes[at]], mode)
                        rows += [at] * len(found)
                        ids += range(len(found))
                        starts += [a for a, _ in found]
                        ends += [b for _, b in found]
                        sents += [texts[at][a:b] for a, b in found]
                at = pa.array(rows, pa.int64())
                values = [pa.array(ids, pa.int32()), pa.array(sents, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(keep))), *values], names=[*keep, "sent_id", "sent", "start", "end"])

    schema = StructType([*(docs.schema[k] for k in keep), StructField("sent_id", IntegerType()), StructField("sent", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return chosen.mapInArrow(run, schema)


def hard_segments(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of non-empty pieces between line breaks."""
    from sentria.functions.clean import hard_lines

    return docs.select(*keep, F.size(hard_lines(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("n_pieces"))


def context_window(sentence_rows: DataFrame, by: str = "doc_id", before: int = 1, after: int = 1) -> DataFrame:
    """Each sentence with its neighbours; one sort per document."""
    order = Window.partitionBy(by).orderBy("sent_id")
    out = sentence_rows
    for k in range(1, before + 1):
        out = out.withColumn(f"before_{k}", F.lag("sent", k).over(order))
    for k in range(1, after + 1):
        out = out.withColumn(f"after_{k}", F.lead("sent", k).over(order))
    return out


def longest_sentences(sentence_rows: DataFrame, k: int = 10) -> DataFrame:
    """A report of the k longest sentences."""
    return sentence_rows.orderBy(F.length("sent").desc(), "doc_id", "sent_id").limit(k)


def repeated_sentences(sentence_rows: DataFrame, least: int = 2) -> DataFrame:
    """Trimmed sentences that occur ``least`` times or more: how often, in how many documents, and the first of them.

    Grouped by two 64-bit hashes, first within a document, so a sentence that very many documents hold is counted before the second shuffle.
    """
    keyed = sentence_rows.select("doc_id", F.trim("sent").alias("sent")).where("sent <> ''").select("doc_id", "sent", F.xxhash64("sent").alias("k1"), F.xxhash64(F.lit(1), "sent").alias("k2"))
    counts = keyed.groupBy("k1", "k2", "doc_id").agg(F.count("*").alias("n"), F.min("sent").alias("sent"))
    found = counts.groupBy("k1", "k2").agg(F.min("sent").alias("sent"), F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return found.where(F.col("n") >= least).select("sent", "n", "n_docs", "first_doc")


def sentence_statistics(docs: DataFrame, language: str | Column = "en", mode: str = "balanced") -> DataFrame:
    """By language: documents, sentences and their mean length. One partial aggregation after the kernel."""
    arrays = docs.select("lang", sentences(F.col("text"), language, mode).alias("s"))
    sizes = arrays.select("lang", F.size("s").alias("n"), F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).alias("c"))
    return sizes.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_sentences"), (F.sum("c") / F.sum("n")).alias("mean_length"))


def tokens_with_sentence_starts(tokens: DataFrame, sentence_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mark the first token at or after each sentence's start, within the sentence.

    ``tokens(key, token_id, idx, token)``; rows outside any sentence are not marked. Tokens and starts are sorted together by
    place, and every token takes the last start before it: one sort of both, no pair of a token and a sentence.
    """
    names = [c for c in tokens.columns if c not in (key, "idx")]
    marks = sentence_rows.select(key, F.col("start").alias("idx"), F.struct("start", "end").alias("_span"))
    both = tokens.withColumn("_is_token", F.lit(1)).unionByName(marks.withColumn("_is_token", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("idx", "_is_token")
    reached = both.withColumn("_in", F.last("_span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_is_token = 1")
    first = F.coalesce(F.col("_in.start") != F.lag("_in.start").over(Window.partitionBy(key).orderBy("idx")), F.col("_in").isNotNull())
    return reached.withColumn("is_sent_start", F.coalesce(first & (F.col("idx") < F.col("_in.end")), F.lit(False))).select(key, "idx", *names, "is_sent_start")


def paragraphs(docs: DataFrame, text: str = "text", least: int = 40, most: int = 2000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Blank-line paragraphs of ``least`` to ``most`` characters that hold a sentence mark, white space made single blanks."""
    parts = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return docs.select(*keep, F.posexplode(F.filter(parts, lambda x: F.length(x).between(least, most) & x.rlike("[.!?。！？]"))).alias("paragraph_id", "paragraph"))


def languages(spark) -> DataFrame:
    return registry.languages(spark)
