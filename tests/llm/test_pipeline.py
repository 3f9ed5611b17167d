"""The pipeline's stages, one after another, on a small corpus whose fate is known."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from sentria.llm import packing
from sentria.llm.tokens import PieceEncoder, vocabulary
from sentria.runtime import ARROW_ROWS, materialize
from tests.llm.test_operators import SCHEMA, docs, prose


def test_stages(spark, tmp_path):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        w = prose(r, r.randint(20, 50)).split()
        toxic = int(i % 4 == 0)
        for _ in range(4 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["idiotic", "worthless", "pathetic"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    item = prose(r, 15)
    rows += [(300, prose(r, 30) + " " + item), (301, rows[1][1]), (302, rows[2][1] + " " + prose(r, 1)), (303, "write to someone@example.com " + prose(r, 20)), (304, None), (305, "")]
    for name, table in (("documents", docs(spark, rows)), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept = {i for i, t in rows if not (i < 240 and i % 4 == 0)} - {300, 301, 302}
    sf_dir, now = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        now.write.parquet(str(tmp_path / "out" / name))
        now = spark.read.parquet(str(tmp_path / "out" / name))
    left = {x.doc_id: x.text for x in now.collect()}
    assert set(left) == kept and "[EMAIL]" in left[303] and left[3] == dict(rows)[3]
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    encoder = PieceEncoder(vocabulary())
    raw = {i: encoder.encode_many([t or ""])[0] + b"\0\0\0\0" for i, t in left.items()}
    assert {p.doc_id for p in pieces} == kept and sum(p.length for p in pieces) == sum(len(x) // 4 for x in raw.values())
    assert all(zlib.crc32(raw[p.doc_id][4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in pieces)


def test_packing_holds_few_texts_at_a_time():
    class Short:
        def encode_many(self, texts):
            return [zlib.crc32(t.encode()).to_bytes(4, "little") for t in texts]

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text": [f"{i} " + "word " * 20_000 for i in range(400)]})
    tracemalloc.start()
    rows = [r for out in packing.cut_batches([batch], 3, Short(), 1024) for r in out.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["doc_id"] for r in rows] == list(range(400)) and {(r["bucket"], r["length"], r["doc_tokens"]) for r in rows} == {(3, 2, 2)}
    assert most < 5_000_000  # 40 MB of texts; a group of them is 1 MB


def test_rows_of_an_arrow_batch_are_bounded_and_the_setting_is_put_back(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    sizes = spark.range(0, 5000, 1, 1).mapInArrow(run, "n long")
    before = spark.conf.get(ARROW_ROWS, None)
    assert materialize(sizes, "sizes", 2000).agg(F.max("n"), F.sum("n")).first() == (2000, 5000)
    assert spark.conf.get(ARROW_ROWS, None) == before
    spark.conf.set(ARROW_ROWS, "700")  # a smaller one of the user's holds
    try:
        assert materialize(sizes, "sizes", 2000).agg(F.max("n"), F.sum("n")).first() == (700, 5000)
        assert spark.conf.get(ARROW_ROWS) == "700"
    finally:
        spark.conf.unset(ARROW_ROWS) if before is None else spark.conf.set(ARROW_ROWS, before)
