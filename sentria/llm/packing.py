"""Operator 5: packing token sequences as a cutting-stock problem.

A document's ids are cut into whole sequences and one rest. The rests' length histogram (at most capacity - 1 rows) is the
demand of a cutting-stock problem: a linear program over patterns of lengths that fit one sequence, solved by column
generation over the whole histogram, from pairs of lengths that fill a sequence; an unbounded-knapsack dynamic program prices columns from the
dual values. It stops within ``gap`` of the optimum, by the dual values or by the total length, or after ``most_steps`` columns: later
ones would change padding only, never which ids are packed. Solutions are rounded down,
what is left is packed best-fit, and patterns go to documents by rank: the j-th rest of a length takes the j-th slot
of that length. Ranks come from counts by input partition, so no length is gathered, however common it is. Rests that
only patterns with more than ``most_padding`` empty places would take are laid end to end instead and cut at sequence
ends; the last, part-filled sequence is cut into powers of two, which need no padding.

Defined results: a null or empty text is its end id alone; rows with a null doc_id are packed like others and keep the
null; repeated rows are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentria.llm.tokens import END_ID, PieceEncoder, column_groups, encoder, vocabulary
from sentria.runtime import materialize, read_table, ship, spread

CAPACITY = 1024
#: Texts that a worker encodes together, and rows that reach it together; both bound memory only.
GROUP_BYTES, BATCH_ROWS = 1_000_000, 2000
PIECE = "bucket int, k long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
Pattern = dict[int, int]


def best_pattern(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """Unbounded knapsack: the pattern of the largest total value within the capacity."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c] = best[c - 1]
        if n:
            total = values[:n] + best[c - lengths[:n]]
            i = int(total.argmax())
            if total[i] > best[c] + 1e-12:
                best[c], took[c] = total[i], lengths[i]
    out: Counter = Counter()
    c = capacity
    while c > 0:
        if took[c]:
            out[int(took[c])] += 1
            c -= int(took[c])
        else:
            c -= 1
    return float(best[capacity]), dict(out)


def solve(demand: dict[int, int], capacity: int = CAPACITY, most_steps: int = 1200, gap: float = 1e-3) -> list[tuple[Pattern, float]]:
    """Column generation for the linear program: patterns and how often each is used."""
    lengths = np.array(sorted(demand), dtype=np.int64)
    m = len(lengths)
    if not m:
        return []
    place = {int(x): i for i, x in enumerate(lengths)}
    need = np.array([demand[int(x)] for x in lengths], dtype=float)
    bound = float((lengths * need).sum()) / capacity  # no solution uses fewer sequences
    # the first basis: each length alone, but for two that fill a sequence together their pair and the surplus of one
    columns: list[Pattern] = [{int(x): int(capacity // x)} for x in lengths]
    inverse = np.diag([1.0 / (capacity // x) for x in lengths])
    for i, short in enumerate(lengths):
        j = place.get(int(capacity - short))
        if j is not None and i < j:
            less, more = (i, j) if need[i] <= need[j] else (j, i)
            columns[less] = {int(short): 1, int(capacity - short): 1}
            inverse[less, less], inverse[more, less] = 1.0, -inverse[more, more]
    x = inverse @ need
    duals = inverse.sum(axis=0)
    for _ in range(most_steps):
        if x.sum() <= (1 + gap) * bound:
            break
        value, pattern = best_pattern(duals, lengths, capacity)
        if value <= 1 + gap:  # the program's value is at least the present one divided by this
            break
        a = np.zeros(m)
        for length, n in pattern.items():
            a[place[length]] = n
        w = inverse @ a
        ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        x -= theta * w
        x[out] = theta
        np.maximum(x, 0, out=x)
        row = inverse[out] / w[out]
        inverse -= np.outer(w, row)
        inverse[out] = row
        duals = duals + (1 - value) * row
        columns[out] = pattern
    return [(p, float(v)) for p, v in zip(columns, x, strict=True) if v > 0]


def plan(demand: dict[int, int], capacity: int = CAPACITY, most_padding: int = 8) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Whole numbers of patterns that never need more than the demand, and the demand that is left for cutting."""
    left = Counter({k: v for k, v in demand.items() if v > 0 and k < capacity})
    chosen: list[tuple[Pattern, int]] = []
    if demand.get(capacity):
        chosen.append(({capacity: 1}, demand[capacity]))

    def take(pattern: Pattern, times: int) -> None:
        if capacity - sum(k * n for k, n in pattern.items()) > most_padding:
            return
        times = min([times, *(left[k] // n for k, n in pattern.items())])
        if times > 0:
            chosen.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= times * n

    solved = solve({k: v for k, v in left.items() if v > 0}, capacity)
    for pattern, times in sorted(solved, key=lambda s: -sum(k * n for k, n in s[0].items())):
        take(pattern, int(times + 1e-7))
    # what rounding left: best-fit over the few rests that remain, as long as patterns fill a sequence
    for pattern, times in sorted(solved, key=lambda s: -s[1]):
        take(pattern, 1)
    for _ in range(capacity):
        lengths = np.array(sorted(k for k, v in left.items() if v > 0), dtype=np.int64)
        if not len(lengths):
            break
        _, pattern = best_pattern(lengths.astype(float), lengths, capacity)
        pattern = {k: min(n, left[k]) for k, n in pattern.items()}
        room = capacity - sum(k * n for k, n in pattern.items())
        while room > 0:  # a length that ran out leaves room for others
            fit = [int(k) for k in lengths if k <= room and left[int(k)] > pattern.get(int(k), 0)]
            if not fit:
                break
            pattern[fit[-1]] = pattern.get(fit[-1], 0) + 1
            room -= fit[-1]
        if room > most_padding:
            break
        take(pattern, min(left[k] // n for k, n in pattern.items()))
    return chosen, {k: v for k, v in left.items() if v > 0}


def power_cuts(size: int) -> list[int]:
    """Ends of pieces of ``size`` places whose sizes are powers of two, largest first."""
    ends, at = [], 0
    for bit in reversed(range(size.bit_length())):
        if size >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def cut_batches(batches, bucket: int, bpe: PieceEncoder, capacity: int):
    """Batches of ``PIECE`` rows of batches of (doc_id, text); a group's texts alone become Python strings at a time."""
    import pyarrow as pa

    seen: Counter = Counter()
    end = np.array([END_ID], dtype="<u4").tobytes()
    types = {"doc_id": pa.int64(), "ids": pa.binary()}
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        for a, b in column_groups(texts, GROUP_BYTES):
            out: dict[str, list] = {c: [] for c in ("k", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for key, raw in zip(keys[a:b], bpe.encode_many(texts.slice(a, b - a).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, capacity):
                    part = raw[4 * at : 4 * (at + capacity)]
                    size = len(part) // 4
                    for c, v in zip(out, (seen[size], key, at, size, zlib.crc32(part), n, part if size < capacity else None), strict=True):
                        out[c].append(v)
                    seen[size] += 1
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * len(out["k"]), pa.int32())} | {c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})


def _pieces(docs: DataFrame, tokenizer_path: str, capacity: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        yield from cut_batches(batches, TaskContext.get().partitionId(), encoder(tokenizer_path), capacity)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, most_padding: int = 8) -> DataFrame:
    """A row per piece of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    pieces = materialize(_pieces(docs, tokenizer_path or vocabulary(), capacity), "pieces", BATCH_ROWS)
    counts = pieces.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-bases")
    demand = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per length
    chosen, cut = plan(demand, capacity, most_padding)
    slots, used, sequence = [], Counter(), 0
    for pattern, times in chosen:
        at = 0
        for length, n in sorted(pattern.items(), reverse=True):
            slots.append((length, used[length], used[length] + n * times, n, sequence, at))
            used[length] += n * times
            at += length * n
        sequence += times
    # rests that no pattern takes lie end to end, by length and rank
    at = 0
    for length, n in sorted(cut.items(), reverse=True):
        slots.append((length, used[length], used[length] + n, 0, sequence, at))
        at += length * n
    table = F.broadcast(spark.createDataFrame(slots, "slot_length long, lo long, hi long, each long, first long, at long"))  # within the number of patterns times their lengths
    small = pieces.drop("ids").join(bases.drop("n"), ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("k"))
    dealt = small.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    j = F.col("rank") - F.col("lo")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = dealt.where("each > 0").select(*columns, (F.col("first") + F.floor(j / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (j % F.col("each")) * F.col("length")).cast("long").alias("offset"))
    if not cut:
        return whole
    last = at - at % capacity
    ends = [last + x for x in power_cuts(at % capacity)]

    def divide(batches):
        import pyarrow as pa

        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*columns, "sequence_id", "offset")}
            for r in batch.to_pylist():
                begin, position = 0, r["position"]
                while begin < r["length"]:
                    here = position + begin
                    if here < last:
                        number, opened, stop = here // capacity, here - here % capacity, here - here % capacity + capacity
                    else:
                        i = int(np.searchsorted(ends, here, side="right"))
                        number, opened, stop = last // capacity + i, ([last, *ends])[i], ends[i]
                    size = min(r["length"] - begin, stop - here)
                    ids = r["ids"][4 * begin : 4 * (begin + size)]
                    for c, v in zip(out, (r["doc_id"], r["start"] + begin, size, zlib.crc32(ids), r["doc_tokens"], r["first"] + number, here - opened), strict=True):
                        out[c].append(v)
                    begin += size
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    loose = dealt.where("each = 0").select("bucket", "length", "k", "first", (F.col("at") + j * F.col("length")).alias("position"))
    loose = materialize(loose, "loose-pieces")
    if sum(cut.values()) <= 500_000:
        loose = F.broadcast(loose)  # 40 bytes a row
    ids = pieces.where(F.col("length") < capacity).join(loose, ["bucket", "length", "k"])
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return whole.union(ids.mapInArrow(divide, schema))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(read_table(spark, sf_dir, "documents")))
