"""Operator 1: benchmark decontamination by winnowing.

A text's fingerprints are the minima of the hashes of its k-word grams over every w consecutive grams. Texts that share
w + k - 1 words share such a window, so they share its minimum: every shared span of that length is found. Shared
fingerprints are extended word by word in both directions, and runs of at least ``span`` words are hits. An item of
fewer words is looked up whole, by the hash of all its words.

Defined results: a null or empty text has no words and is never contaminated; an item without words is never found;
a null item_id is written ``null``; repeated items count once by id; an empty benchmark leaves every document clean; rows
are kept one by one, also repeated ones.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.hashing import ALNUM, Words, winnow
from sentria.llm.tokens import column_groups, forget, text_groups
from sentria.runtime import materialize, read_table, release, ship, spread

SPAN, GRAM = 10, 5
#: Benchmark tables of up to so many bytes of text go to the executors whole; larger ones are joined by fingerprint.
BROADCAST_BYTES = 48 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words(raw: bytes) -> list[bytes]:
    return _WORD.findall(raw.lower())


class ItemIndex:
    """Items by fingerprint; equal word sequences are held once, with all their ids."""

    def __init__(self, items: list[tuple[str, str | None]], span: int = SPAN, gram: int = GRAM) -> None:
        self.span, self.gram = span, gram
        by_words: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            words = tuple(_words((text or "").encode("utf-8", "surrogatepass")))
            if words:
                by_words.setdefault(words, set()).add(item_id)
        self.words = list(by_words)
        self.ids = [sorted(x) for x in by_words.values()]
        long = [i for i, w in enumerate(self.words) if len(w) >= span]
        self.prints, self.places = self._index([(i, *self._prints(i)) for i in long])
        self.short: dict[int, tuple[np.ndarray, list]] = {}
        for n in sorted({len(w) for w in self.words if len(w) < span}):
            own = [i for i, w in enumerate(self.words) if len(w) == n]
            self.short[n] = self._index([(i, Words([self._text(i)], ALNUM).grams(n)[0], [0]) for i in own])

    def _text(self, i: int) -> str:
        return b" ".join(self.words[i]).decode("utf-8", "surrogatepass")

    def _prints(self, i: int) -> tuple[np.ndarray, list[int]]:
        w = Words([self._text(i)], ALNUM)
        grams, inside = w.grams(self.gram)
        at = winnow(grams, inside, w.doc, self.gram, self.span - self.gram + 1)
        return grams[at], at.tolist()

    @staticmethod
    def _index(found) -> tuple[np.ndarray, list]:
        places: dict[int, list[tuple[int, int]]] = {}
        for i, hashes, at in found:
            for h, q in zip(hashes.tolist(), at, strict=False):
                places.setdefault(h, []).append((i, q))
        keys = sorted(places)
        return np.array(keys, dtype=np.uint64), [places[k] for k in keys]

    @staticmethod
    def _find(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys) or not len(hashes):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        found = np.flatnonzero(keys[at] == hashes)
        return found, at[found]

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: its number of words, the hit word ranges, and the word sequences found in it."""
        w = Words(texts, ALNUM)
        hits: dict[int, list[tuple[int, int, int, int]]] = {}

        def note(positions: np.ndarray, keys: np.ndarray, places: list, least: int) -> None:
            for p, k in zip(positions.tolist(), keys.tolist(), strict=True):
                d = int(w.doc[p])
                hits.setdefault(d, []).extend((p - int(w.first[d]), q, i, least) for i, q in places[k])

        if len(self.prints):
            grams, inside = w.grams(self.gram)
            at = winnow(grams, inside, w.doc, self.gram, self.span - self.gram + 1)
            found, keys = self._find(self.prints, grams[at])
            note(at[found], keys, self.places, self.span)
        for n, (prints, places) in self.short.items():
            grams, inside = w.grams(n)
            at = np.flatnonzero(inside)
            found, keys = self._find(prints, grams[at])
            note(at[found], keys, places, n)
        out = []
        for d in range(len(texts)):
            ranges, seen = [], set()
            if d in hits:
                own = _words(w.raw[int(w.base[d]) : int(w.base[d + 1])])
                done: dict[tuple[int, int], int] = {}
                for p, q, i, least in sorted(hits[d]):
                    if done.get((i, p - q), -1) > p:
                        continue  # inside a run that has been walked
                    item = self.words[i]
                    a, b = p, p
                    while a > 0 and q - (p - a) > 0 and own[a - 1] == item[q - (p - a) - 1]:
                        a -= 1
                    while b < len(own) and q + b - p < len(item) and own[b] == item[q + b - p]:
                        b += 1
                    done[i, p - q] = max(b, p + 1)
                    if b - a >= least and a <= p < b:
                        ranges.append((a, b))
                        seen.add(i)
            out.append((int(w.count[d]), ranges, seen))
        return out

    def report(self, texts: list[str | None]) -> list[tuple[int, int, int, str]]:
        """n_words, n_hit, n_items, items_sha256 of each text."""
        out = []
        for n, ranges, seen in self.scan(texts):
            hit, last = 0, 0
            for a, b in sorted(ranges):
                hit += max(0, b - max(a, last))
                last = max(last, b)
            ids = sorted({x for i in seen for x in self.ids[i]})
            out.append((n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
        return out


def _emit(keys: list, rows: list[tuple], id_type: str = "long"):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    names = ("n_words", "n_hit", "n_items")
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64() if id_type == "long" else pa.string())} | {c: pa.array(columns[j], pa.int64()) for j, c in enumerate(names)} | {"items_sha256": pa.array(columns[3], pa.string()), "contaminated": pa.array([x > 0 for x in columns[1]], pa.bool_())})


def find_contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per row of ``docs(doc_id, text)`` with the benchmark passages it holds.

    The benchmark is broadcast while its text is at most ``broadcast_bytes``; then nothing is shuffled. Beyond that,
    fingerprints of both sides are joined, and each document meets only the items that share one with it.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("item_text"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _joined(plain, items)
    sent = spark.sparkContext.broadcast([tuple(r) for r in items.distinct().collect()])

    def scan(batches):
        index = ItemIndex(sent.value)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_groups(texts, 1_000_000):
                yield _emit(keys[a:b], index.report(texts[a:b]))

    return plain.mapInArrow(scan, RESULT)


def _joined(docs: DataFrame, items: DataFrame, id_type: str = "long") -> DataFrame:
    spark = docs.sparkSession

    def prints(kind):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_groups(texts, 1_000_000):
                    w = Words(texts[a:b], ALNUM)
                    grams, inside = w.grams(GRAM)
                    at = winnow(grams, inside, w.doc, GRAM, SPAN - GRAM + 1)
                    got = [(w.doc[at], grams[at])]
                    for n in range(1, SPAN):  # short items are looked up whole
                        grams, inside = w.grams(n)
                        own = np.flatnonzero(inside & (w.count[w.doc[: len(grams)]] == n) if kind == "item" else inside) if len(grams) else np.zeros(0, dtype=np.int64)
                        if kind == "item" or n in lengths:
                            got.append((w.doc[own], grams[own] ^ np.uint64(n)))
                    doc, h = (np.concatenate(x) for x in zip(*got, strict=True))
                    pairs = np.unique(np.stack([doc.astype(np.uint64), h], axis=1), axis=0)
                    yield pa.RecordBatch.from_pydict({"key": pa.array([keys[a + int(d)] for d in pairs[:, 0]], pa.string()), "print": pa.array(pairs[:, 1].astype(np.int64))})

        return run

    length = F.size(F.regexp_extract_all(F.lower("item_text"), F.lit(r"([0-9a-z\x{80}-\x{10ffff}]+)"), F.lit(1)))
    lengths = {r[0] for r in items.select(length.alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect()}
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.withColumn("key", key)
    texts = items.distinct().withColumn("item_key", F.sha2(F.concat_ws(":", "item_id", "item_text"), 256))
    own = materialize(texts.select("item_key", "item_text").mapInArrow(prints("item"), "key string, print long"), "item-prints").withColumnRenamed("key", "item_key")
    there = materialize(keyed.select("key", "text").distinct().mapInArrow(prints("doc"), "key string, print long"), "doc-prints")
    pairs = there.join(own, "print").select("key", "item_key").distinct()
    found = materialize(pairs.join(texts, "item_key").groupBy("key").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")), "found-items")

    def verify(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [ItemIndex([(x["item_id"], x["item_text"]) for x in r["items"] or []]).report([r["text"]])[0] for r in rows]
            yield _emit([r["doc_id"] for r in rows], out, id_type)

    result = keyed.join(found, "key", "left").select("doc_id", "text", "items").mapInArrow(verify, RESULT.replace("doc_id long", f"doc_id {id_type}"))
    release(own, there)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage. Sent-along columns survive clashing names."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("item_text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text") + 64), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        # whether a row goes depends on its text alone, so the text's key stands in for the row
        texts = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_id"), "text").distinct()
        found = _joined(texts, items, "string").where("contaminated").select(F.col("doc_id").alias("_found"))
        return docs.join(found, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == found["_found"], "left_anti")
    sent = spark.sparkContext.broadcast([tuple(r) for r in items.distinct().collect()])
    place = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        forget()
        index = ItemIndex(sent.value)
        for batch in batches:
            flags = []
            for a, b in column_groups(batch.column(place), 1_000_000):
                flags += [not seen for _, _, seen in index.scan(batch.column(place).slice(a, b - a).to_pylist())]
            yield batch.filter(pa.array(flags, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SPLIT} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, win FROM (
  SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda x: array_to_string(w[x:x + least(len(w), 10) - 1], ' '))) AS win
  FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT r, n, p, item FROM dw JOIN iw USING (n, win)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
