"""Sources and sinks: whole files, gold units, token streams; JSON and parquet results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentria.operators.corpus import paragraphs

UNIT = "corpus string, genre string, language string, unit_id string, text string, gold array<string>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def gold_units(spark: SparkSession, path: str) -> DataFrame:
    """Gold units from JSON lines."""
    return spark.read.schema(UNIT).json(path)


def golden_rules(spark: SparkSession, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Units from rules in code: (language, text, sentences)."""
    rows = [("golden_rules", "rule-test", code, f"{code}-{i:03d}", text, gold) for i, (code, text, gold) in enumerate(rules, 1)]
    return spark.createDataFrame(rows, UNIT)


def plain_units(docs: DataFrame, corpus: str, genre: str, language: str, unit: str = "path") -> DataFrame:
    """Units without gold: the paragraphs of free texts such as books, articles or judgments (:func:`texts`)."""
    rows = paragraphs(docs.select(unit, "text"), keep=(unit,))
    return rows.select(F.lit(corpus).alias("corpus"), F.lit(genre).alias("genre"), F.lit(language).alias("language"), F.concat_ws("#", unit, "paragraph_id").alias("unit_id"), F.col("paragraph").alias("text"), F.lit(None).cast("array<string>").alias("gold"))


def conll_u(spark: SparkSession, path: str, language: str, most: int = 5) -> DataFrame:
    """Units of ``most`` consecutive sentences at most from the ``# text`` lines of CoNLL-U files; a new paragraph or document begins a unit.

    Files are read line by line in splits, so neither a file nor its text has to fit into a row. A file's sentences are sorted by place.
    """
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    marked = lines.where(F.col("value").startswith("# text = ") | F.col("value").rlike("^# new(par|doc)"))
    order = Window.partitionBy("file").orderBy("place")
    is_text = F.col("value").startswith("# text = ")
    pars = marked.withColumn("par", F.sum((~is_text).cast("long")).over(order)).where(is_text)
    numbered = pars.withColumn("n", F.row_number().over(Window.partitionBy("file", "par").orderBy("place")) - 1)
    found = numbered.groupBy("file", "par", F.floor(F.col("n") / most).alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", F.substring("value", 10, 1 << 30).alias("sent")))).alias("sents"))
    gold = found.select(F.concat_ws("#", "file", "par", "part").alias("unit_id"), F.transform("sents", lambda x: x["sent"]).alias("gold"))
    return gold.select(F.lit("ud").alias("corpus"), F.lit("treebank").alias("genre"), F.lit(language).alias("language"), "unit_id", F.array_join("gold", " ").alias("text"), "gold")


def deltas(spark: SparkSession, path: str, schema: str = "stream_id long, seq long, delta string") -> DataFrame:
    """A stream of text deltas from JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def write_results(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)


def drain_stream(df: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """Start writing a stream's finished sentences to files, each micro-batch once; ``availableNow`` drains what is there and stops."""
    return df.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
