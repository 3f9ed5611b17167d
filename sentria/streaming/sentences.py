"""Sentences of growing texts: a stateful operator for streams, and the same replayed over a table.

State is the unemitted tail and its offset, so it stays as long as a sentence, however long the stream. Rows of a key are
applied in the order of their sequence number; numbers up to the last applied one are late and dropped, which also makes
a repeated micro-batch harmless. A null delta ends the stream and flushes what is left, as does ``idle_ms`` without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sentria import registry
from sentria.api import StreamState, advance, finish
from sentria.options import Options, check_buffering
from sentria.runtime import ship

OUTPUT = "stream_id long, ord long, sent string, start long, end long"
_STATE = "buffer string, offset long, last long, ord long, wait boolean"
_COLUMNS = ["stream_id", "ord", "sent", "start", "end"]


def stream_sentences(deltas: DataFrame, language: str = "en", mode: str = "balanced", buffering: str = "conservative", max_buffer_size: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Finished sentences of ``deltas(stream_id, seq, delta)``, a streaming DataFrame; append mode."""
    Options(language, split_mode=mode)
    check_buffering(buffering, max_buffer_size)
    profile = registry.profile(language)
    ship(deltas.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, offset, last, order, wait = state.get if state.exists else ("", 0, -1, 0, False)
        held, out = StreamState(buffer, offset, wait), []
        if state.hasTimedOut:
            out += finish(held, profile, mode)
        else:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for seq, delta in zip(rows["seq"], rows["delta"], strict=True):
                if seq <= last:
                    continue
                last = int(seq)
                out += finish(held, profile, mode) if delta is None else advance(held, delta, profile, mode, buffering, max_buffer_size)
        state.update((held.buffer, held.offset, last, order + len(out), held.wait))
        if idle_ms is not None and held.buffer:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], order + i, s.sent, s.start, s.end) for i, s in enumerate(out)], columns=_COLUMNS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return deltas.select("stream_id", "seq", "delta").groupBy("stream_id").applyInPandasWithState(run, OUTPUT, _STATE, "append", timeout)


def replay_sentences(deltas: DataFrame, language: str = "en", mode: str = "balanced", buffering: str = "conservative", max_buffer_size: int | None = None) -> DataFrame:
    """The same over a finished table: streams end with their last row.

    Rows are dealt and sorted by (stream_id, seq) and read one after another, so a very long stream is never in memory whole.
    """
    Options(language, split_mode=mode)
    check_buffering(buffering, max_buffer_size)
    profile = registry.profile(language)
    ship(deltas.sparkSession)

    def run(batches):
        import pyarrow as pa

        now, held, order = None, StreamState(), 0

        def rows(spans):
            nonlocal order
            for s in spans:
                yield now, order, s.sent, s.start, s.end
                order += 1

        for batch in batches:
            out = []
            for stream, delta in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream != now:
                    if now is not None:
                        out += rows(finish(held, profile, mode))
                    now, held, order = stream, StreamState(), 0
                out += rows(advance(held, delta, profile, mode, buffering, max_buffer_size))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=_COLUMNS)
        if now is not None:
            out = list(rows(finish(held, profile, mode)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=_COLUMNS)

    dealt = deltas.select(F.col("stream_id").cast("long").alias("stream_id"), "seq", "delta").where("stream_id is not null").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return dealt.select("stream_id", "delta").mapInArrow(run, OUTPUT)
