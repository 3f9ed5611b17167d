"""Operator 9: token-id files with Elias-Fano document boundaries.

A shard file holds a run of documents in ascending id order: the concatenated token ids, and two monotone
sequences in Elias-Fano form, the documents' ids and their end offsets. A sequence of n values below u takes about
2 + log2(u / n) bits a value. Select samples (the bit position of every 64th one) give any document's offset
without a table of 64-bit numbers.

Defined results: a null text is an empty text (its ids are the end id alone); rows with a null doc_id come first, with
a null doc_id in the result; repeated rows each keep their own entry; an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentria.llm.tokens import END_ID, encoder, text_groups, vocabulary
from sentria.runtime import materialize, new_path, ship, spread

MAGIC = b"EFIDS001"
_HEAD = struct.Struct("<8sIIqqqqq")  # magic, crc32 of the rest, id width, documents, null ids, tokens, bytes of the ids' and ends' sections
SAMPLE = 64


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    shifts = np.arange(bits, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A monotone sequence of non-negative integers with constant-time select and near-minimal space."""

    _H = struct.Struct("<QQQQ")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.frombuffer(_pack_low(values, bits), dtype=np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        left += 1
        while (ones := word.bit_count()) < left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left - 1):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        begin, value = i * self.bits, 0
        for k in range(self.bits):
            bit = begin + k
            value |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return (position - i) << self.bits | value

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.bits)
        if self.bits:
            flags = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.uint64)
            out |= (flags << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def to_bytes(self) -> bytes:
        return self._H.pack(self.n, self.bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, low, high = cls._H.unpack_from(raw)
        at = cls._H.size
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), np.frombuffer(raw[at + low + high :], "<u8"))


def build_shard(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """File contents for documents in ascending order (null ids first); ``ids``: 32-bit little-endian ids of each."""
    tokens = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(tokens) or int(tokens.max()) < 1 << 16 else 4
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    docs = struct.pack("<q", base) + EliasFano.encode((known.astype(np.uint64) - np.uint64(base % (1 << 64)))).to_bytes()
    ends = EliasFano.encode(np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)).to_bytes()
    body = docs + ends + tokens.astype(f"<u{width}").tobytes()
    return _HEAD.pack(MAGIC, zlib.crc32(body), width, len(doc_ids), len(doc_ids) - len(known), len(tokens), len(docs), len(ends)) + body


class ShardReader:
    """Random access to one shard file's contents."""

    def __init__(self, raw: bytes) -> None:
        magic, crc, width, self.n_docs, self.n_null, self.n_tokens, docs, ends = _HEAD.unpack_from(raw)
        if magic != MAGIC or zlib.crc32(memoryview(raw)[_HEAD.size :]) != crc:
            raise ValueError("not an intact shard file")
        at = _HEAD.size
        self.base = struct.unpack_from("<q", raw, at)[0]
        self.docs = EliasFano.from_bytes(raw[at + 8 : at + docs])
        self.ends = EliasFano.from_bytes(raw[at + docs : at + docs + ends])
        self.ids = np.frombuffer(raw, dtype=f"<u{width}", count=self.n_tokens, offset=at + docs + ends)

    def offsets(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        begin, end = self.offsets(i)
        return self.ids[begin:end]

    def doc_ids(self) -> list[int | None]:
        known = (self.docs.decode() + np.uint64(self.base % (1 << 64))).astype(np.int64)
        return [None] * self.n_null + known.tolist()


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, shard_tokens: int = 4_000_000) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shard files in ascending doc_id order below ``folder``.

    Returns the manifest (part, shard, path, n_docs, n_tokens). One range shuffle of the texts; a task holds one shard.
    A file is named after the attempt that wrote it, and only files of attempts that Spark commits are in the manifest: a retried, speculative or
    lost task leaves at most files that nobody reads.
    """
    ship(docs.sparkSession)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        context, bpe = TaskContext.get(), encoder(tokenizer_path)
        part, shard = context.partitionId(), 0
        ids, raw, size = [], [], 0
        end = np.array([END_ID], dtype="<u4").tobytes()

        def flush():
            nonlocal shard, ids, raw, size
            name = f"ids-{part:06d}-{shard:05d}-{context.taskAttemptId()}.ef"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(build_shard(ids, raw))
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "path": [name], "n_docs": [len(ids)], "n_tokens": [size]}, schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            shard, ids, raw, size = shard + 1, [], [], 0
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_groups(texts):
                for key, got in zip(keys[a:b], bpe.encode_many(texts[a:b]), strict=True):
                    if size and size + len(got) // 4 + 1 > shard_tokens:
                        yield flush()
                    ids.append(key)
                    raw.append(got + end)
                    size += len(got) // 4 + 1
        if ids:
            yield flush()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash and the row number split an id that very many rows share
    dealt = plain.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id())
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = ordered.mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long")
    return materialize(manifest, "manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shard files back: a row per document (doc_id, start, n_tokens, ids_crc32), starts counted over all files."""
    ship(manifest.sparkSession)

    def read(batches):
        import pyarrow as pa

        store, root = _store(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path}") as f:
                    shard = ShardReader(f.read())
                ends = shard.ends.decode().astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(), pa.int64()), "start": pa.array(begins + base), "n_tokens": pa.array(ends - begins), "ids_crc32": pa.array(crcs, pa.int64())})

    # a row per file, so one task numbers them
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    tasks = max(1, min(manifest.count(), 20_000))  # an explicit number: small rows stand for large files
    return files.repartitionByRange(tasks, "part", "shard").select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(docs: DataFrame, tokenizer_path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as shard files (below the shared folder unless ``folder`` says otherwise) and read them back."""
    folder = folder or new_path(docs.sparkSession, "ids")
    return read_shards(write_shards(docs, folder, tokenizer_path or vocabulary()), folder)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentria.runtime import read_table

    return token_id_output(spread(read_table(spark, sf_dir, "documents")))
