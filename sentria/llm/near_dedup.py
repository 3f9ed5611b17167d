"""Operator 4: MinHash near-duplicates with fast similarity sketching.

A document's set is its distinct 4-word shingles. In rounds, every shingle is hashed into one of t bins with a value
that starts with the round's number; a bin keeps its least value, and a document is done when all bins are filled. Round
t + b sends every shingle to bin b, so no bin stays empty; equal coordinates estimate similarity with concentration
bounds (Dahlgaard, Knudsen and Thorup, 2017). Coordinates are grouped into bands; texts that agree on a band are candidates, and
links are confirmed on the full sets. At the threshold 0.8, 40 bands of 5 coordinates miss a pair with probability
(1 - 0.8^5)^40 = 1.3e-7.

Equal sets are one class first. In a band's bucket every class meets the bucket's centre, not every other class; large
buckets that still hold several components meet two more centres. What is then apart is searched exactly: in
small buckets class by class, in large ones by an exact prefix and position bound on the sets, which edited copies with many
shingles of their own never pass. No confirmed link between different texts is lost.

Defined results: a null or empty text (or one without words) has no shingle, is linked with nothing and kept; a null
doc_id is linked with nothing, has a null component and is kept; rows that repeat a doc_id have a row each, and the
component of their own text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.components import components
from sentria.llm.hashing import SPACED, Words, mix
from sentria.llm.tokens import column_groups, forget
from sentria.runtime import materialize, read_table, release, ship, spread

BANDS, ROWS = 40, 5
#: Buckets of up to so many classes are searched directly.
SMALL = 30
#: Items that an entry of the prefix search carries along, so that a pair of sets meets at few of its common items.
BEFORE = 24
COUNTERS = 1 << 20
_U = np.uint64
#: With its doc_id, tells a text from others of the same doc_id.
_PRINT = "xxhash64(text)"


def shingle_sets(texts: list[str | None], size: int, table=SPACED) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``size`` make one shingle."""
    w = Words(texts, table)
    grams, inside = w.grams(size)
    out = []
    for d in range(len(texts)):
        n, first = int(w.count[d]), int(w.first[d])
        if n >= size:
            out.append(np.unique(grams[first : first + n - size + 1]))
        elif n:
            h = np.array([n], dtype=np.uint64)
            for j in range(first, first + n):
                h = mix(h * _U(0x9E3779B97F4A7C15) + w.hash[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: t coordinates of each non-empty set."""
    out = np.full(len(sets) * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(items):
                break
            x = mix(items + _U((i * 0x9E3779B97F4A7C15 + 0x1F83D9ABFB41BD6B) % (1 << 64)))
            bins = (x % _U(t)).astype(np.int64) if i < t else np.full(len(items), i - t)
            np.minimum.at(out, owner * t + bins, (_U(i) << _U(48)) | (x >> _U(16)))
            open_ = (out.reshape(len(sets), t) == np.iinfo(np.uint64).max).any(axis=1)
            if i < 8 or i % 8 == 0:
                left = open_[owner]
                items, owner = items[left], owner[left]
            elif not open_[owner].any():
                break
    return out.reshape(len(sets), t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            h = mix(h * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _described(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, the text's print, n, two halves of a set's key, and its bands."""

    def run(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            keys, prints = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in column_groups(batch.column(1), 750_000):
                sets = shingle_sets(batch.column(1).slice(a, b - a).to_pylist(), shingle)
                found = band_keys(sketches(sets, bands * rows), bands, rows)
                with np.errstate(over="ignore"):
                    k1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                    k2 = np.array([mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                offsets = pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys[a:b], pa.int64()), "print": pa.array(prints[a:b], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "k1": pa.array(k1), "k2": pa.array(k2), "bands": pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))})

    return docs.select("doc_id", "text", F.expr(_PRINT).alias("print")).mapInArrow(run, "doc_id long, print long, n long, k1 long, k2 long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The full sets of the classes in ``wanted(rep, first, k1, k2)``, from their texts: (rep, items)."""

    def run(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            rows = batch.select(["rep", "k1", "k2"]).to_pydict()
            text = batch.column(batch.schema.get_field_index("text"))
            for a, b in column_groups(text, 750_000):
                sets = shingle_sets(text.slice(a, b - a).to_pylist(), shingle)
                with np.errstate(over="ignore"):
                    same = [(int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))) == k for s, k in zip(sets, zip(rows["k1"][a:b], rows["k2"][a:b], strict=True), strict=True)]
                yield pa.RecordBatch.from_pydict({"rep": pa.array([r for r, x in zip(rows["rep"][a:b], same, strict=True) if x], pa.int64()), "items": pa.array([s.view(np.int64) for s, x in zip(sets, same, strict=True) if x], pa.list_(pa.int64()))})

    texts = docs.select("doc_id", F.expr(_PRINT).alias("print"), "text").where("doc_id is not null and text is not null")
    named = wanted.select("rep", F.col("first.doc_id").alias("doc_id"), F.col("first.print").alias("print"), "k1", "k2")
    return texts.join(named, ["doc_id", "print"]).select("rep", "k1", "k2", "text").mapInArrow(run, "rep long, items array<long>").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("rep").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("rep").alias("v"), F.col("items").alias("b"))
    met = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("a", "b"))
    return met.where(100 * common >= percent * (F.size("a") + F.size("b") - common)).select("u", "v")


def _apart(state: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in small buckets, each in its first common band."""
    rest = state.join(classes.select("rep", "bands"), "rep")
    a = rest.select("key", F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"), F.col("bands").alias("bu"), "band")
    b = rest.select("key", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"), F.col("bands").alias("bv"))
    first = F.array_position(F.zip_with("bu", "bv", lambda x, y: x == y), True) == F.col("band") + 1
    apart = (F.col("cu") < F.col("cv")) & (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & first
    return a.join(b, (a["key"] == b["key"]) & apart).select("u", "v")


def _by_prefix(wide: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that can still be links, among the classes ``wide(rep, n, component)``.

    With a set's items in one order of all, the rarer first, two sets of the wanted similarity share one of their first
    n - ceil(percent * n / 100) + 1 items, and what stands before the first shared one is missing in the other. Both bounds are
    exact in any order; rare items first make few meet. How rare an item is is read from counts by COUNTERS buckets of its hash, a table
    of a fixed size that every task holds. Classes whose rare items are their own, as edited copies have, meet nobody.
    """
    held = materialize(sets.join(wide, "rep").select("rep", "n", "component", "items"), "wide-sets")
    counted = held.select(F.explode("items").alias("item")).groupBy(F.pmod("item", F.lit(COUNTERS)).alias("b")).agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(COUNTERS, dtype=np.int64)
    df[counted.column("b").to_numpy()] = counted.column("df").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(df)

    def run(batches):
        import pyarrow as pa

        names = ("rep", "n", "component", "place", "item", "before")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for rep, n, component, items in zip(*(batch.column(i) for i in range(4)), strict=True):
                x = items.values.to_numpy(zero_copy_only=False)
                often = sent.value[x % COUNTERS]
                order = np.lexsort((x, often))[: len(x) + (-percent * len(x)) // 100 + 1]
                places = np.flatnonzero(often[order] > 1)
                shared = x[order][places].tolist()
                for k, (place, item) in enumerate(zip(places.tolist(), shared, strict=True)):
                    # the shared items right before: a pair that has one of them in common has met there
                    for column, value in zip(out, (rep.as_py(), n.as_py(), component.as_py(), place, item, shared[max(0, k - BEFORE) : k]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.list_(pa.int64()) if c == "before" else pa.int64()) for c, v in zip(names, out, strict=True)})

    entries = materialize(held.mapInArrow(run, "rep long, n long, component long, place long, item long, before array<long>"), "prefixes")
    a = entries.select("item", F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"), F.col("place").alias("pu"), F.col("before").alias("bu"))
    b = entries.select("item", F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"), F.col("place").alias("pv"), F.col("before").alias("bv"))
    enough = (100 + percent) * F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) >= percent * (F.col("nu") + F.col("nv"))
    return a.join(b, (a["item"] == b["item"]) & (F.col("cu") < F.col("cv")) & enough & ~F.arrays_overlap("bu", "bv")).select("u", "v")


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS, centre_rounds: int = 3, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """The rows' set keys, and the classes as (k1, k2, n, first, head): the class's and its component's least (doc_id, print).

    A class is a node by a number of its own, as different texts may repeat a doc_id.
    """
    spark = docs.sparkSession
    ship(spark)
    described = materialize(_described(docs, shingle, bands, rows), "sketches")
    linked = described.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "print")).alias("first"), F.min_by("bands", "doc_id").alias("bands"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    entries = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("size")).where("least < most")
    buckets = materialize(shared.select("key", "size"), "buckets")
    members = materialize(entries.join(buckets, "key"), "members")
    release(buckets)
    wanted = members.select("rep").distinct().join(classes.select("rep", "first", "k1", "k2"), "rep")
    sets = materialize(_sets(docs, wanted, shingle), "sets")
    found_links: list[DataFrame] = []
    spent: list[DataFrame] = []
    tested = labels = None
    state = members.withColumn("component", F.col("rep"))

    def untested(pairs: DataFrame, name: str) -> DataFrame:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        return materialize(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), name)

    def relabelled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        found_links.append(found)
        links = found_links[0]
        for x in found_links[1:]:
            links = links.union(x)
        new = components(links)
        named = members.join(new.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        spent.append(state)
        return new, materialize(named, "state")

    for step in range(centre_rounds):
        # first every bucket; then other centres for the large buckets that still hold several components
        order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
        here = state if step == 0 else state.where(F.col("size") > small)
        centres = here.groupBy("key").agg(F.min_by("rep", order).alias("centre"), F.min_by("n", order).alias("m"), F.min_by("component", order).alias("middle"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").drop("lo", "hi")
        centres = materialize(centres, "centres")
        spent.append(centres)
        if centres.isEmpty():
            break
        met = here.join(centres, "key").where("component <> middle").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
        pairs = untested(met.select(F.col("rep").alias("u"), F.col("centre").alias("v")), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        spent.append(pairs)
        found = materialize(_confirmed(pairs, sets, percent), "confirmed")
        if not found.isEmpty():
            labels, state = relabelled(found)
    # what is still apart: within small buckets directly, within large ones by the prefixes of the sets
    open_ = state.where("size > 2").groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = materialize(state.join(open_, "key"), "open")
    pairs = _apart(rest.where(F.col("size") <= small), classes, percent)
    wide = materialize(rest.where(F.col("size") > small).select("rep", "n", "component").distinct(), "wide")
    if not wide.isEmpty():
        pairs = pairs.union(_by_prefix(wide, sets, percent))
    pairs = untested(pairs, "rest")
    found = materialize(_confirmed(pairs, sets, percent), "confirmed")
    if labels is None or not found.isEmpty():
        labels, state = relabelled(found)
    # the components' heads; a centre is in its component too
    labels = labels.union(labels.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "rep")
    heads = labels.join(classes.select("rep", "first"), "rep").groupBy("component").agg(F.min("first").alias("head"))
    named = classes.select("k1", "k2", "n", "rep", "first").join(labels.join(heads, "component").select("rep", "head"), "rep", "left")
    named = materialize(named.select("k1", "k2", "n", "first", F.coalesce("head", "first").alias("head")), "named")
    release(sets, rest, wide, pairs, state, members, classes, *spent, *found_links)
    return described, named


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest reachable doc_id) and kept, for each row of ``docs(doc_id, text)``."""
    described, named = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, percent, small=small)
    named = named.select("k1", "k2", "n", F.col("head.doc_id").alias("component_id"))
    rows_ = described.select("doc_id", "k1", "k2", "n").where("n > 0 and doc_id is not null").join(named, ["k1", "k2", "n"], "left")
    rows_ = rows_.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = described.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows_.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row, of the text that has the smallest doc_id, and every row
    without a doc_id or without words. Rows that share a doc_id go only if their texts are linked or equal."""
    _, named = _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle, percent)
    kept = named.where("first = head").select(F.col("head.doc_id").alias("_kept"), F.col("head.print").alias("_kept_print")).distinct()
    linked = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs.where(linked).withColumn("_own_print", F.expr(_PRINT))
    stay = own.join(kept, (own["doc_id"] == kept["_kept"]) & (own["_own_print"] == kept["_kept_print"]), "left_semi").dropDuplicates(["doc_id", "_own_print"]).drop("_own_print")
    return stay.union(docs.where(~linked))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(read_table(spark, sf_dir, "documents")))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda x: array_to_string(w[x:x + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * m >= 80 * (nu.n + nv.n - m)),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v),
t AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, t.component_id, d.doc_id = t.component_id AS kept
FROM d JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
