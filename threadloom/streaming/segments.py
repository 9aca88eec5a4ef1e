"""Conversation segments of a stream, in event-time order, on keyed state with timers.

Messages wait until the watermark has passed their time, since an earlier one may still arrive. Keys share a state by
the hash of the key (``buckets``): what waits there is a list of Arrow pieces, and a timer at the earliest waiting time
wakes all of it, so calls to the state and conversions are paid by piece, not by message or key. What is due is then put
in order and numbered, all keys of the bucket at once, against each key's last message (time, topic, vector, number), so
the result equals the batch operator's on the same messages. A task holds what waits in one bucket, bounded by the watermark
delay, and the last messages of its keys. A key that is quiet for ``ttl_ms`` is forgotten: its next message is a first one,
whether or not its last message was cleared before. Messages later than the delay are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom.streaming.jobs import STATE_TTL_MS, event_time

RESULT = "platform string, message_id long, segment_no long, is_new boolean, reason string, similarity double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_WAITING = pa.schema([("platform", pa.string()), ("us", pa.int64()), ("message_id", pa.int64()), ("topic", pa.string()), ("embedding", pa.list_(pa.float64()))])
_LAST = pa.schema([("platform", pa.string()), ("us", pa.int64()), ("topic", pa.string()), ("embedding", pa.list_(pa.float64())), ("seq", pa.int64())])
# the store reads a list again for each piece that is added, so pieces are large
_PIECE = 500_000
_SHOWN = 10_000


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the RocksDB state store, which timers and list states need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _packed(batches: list[pa.RecordBatch]) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return (out.getvalue().to_pybytes(),)


def _unpacked(state, schema: pa.Schema) -> pa.Table:
    pieces = state.get() if state.exists() else []
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(piece)).read_all() for (piece,) in pieces)]).combine_chunks()


def _put(state, rows: pa.Table) -> None:
    if len(rows):
        state.put([_packed([piece]) for piece in rows.combine_chunks().to_batches(_PIECE)])
    elif state.exists():
        state.clear()


def _timer(us):
    """The first whole millisecond at which a watermark has reached a time, or one for each of an array of times."""
    return -(-us // 1000)


def _similarities(vectors: pa.ListArray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """As ``functions.vectors.cosine`` of the vectors at two lists of places: 0 where one is missing, zero or of another length."""
    found = np.zeros(len(at))
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    start = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    usable = np.flatnonzero((size[at] == size[before]) & (size[at] > 0))
    # sums run from the first component on, as in SQL; a block holds about a million components
    dot = lambda x, y: np.add.accumulate(x * y, axis=1)[:, -1]
    for n in np.unique(size[at][usable]).tolist():
        same = usable[size[at][usable] == n]
        for lo in range(0, len(same), step := max(1, 1_000_000 // n)):
            block = same[lo : lo + step]
            a, b = (values[start[x[block]][:, None] + np.arange(n)] for x in (at, before))
            with np.errstate(all="ignore"):
                scale = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
                found[block] = np.where(scale > 0, dot(a, b) / scale, 0.0)
    return found


class Segmenter(StatefulProcessor):
    def __init__(self, gap_us: int, least_similarity: float | None, ttl_ms: int):
        self.gap_us, self.least_similarity, self.ttl_ms = gap_us, least_similarity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "piece binary")
        self.waiting = handle.getListState("waiting", "piece binary")
        # the watermark at which the earliest message that waits is due, or the last key is forgotten
        self.wake = handle.getValueState("wake", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held = None, []
        for part in rows:
            if part["us"].isna().any():
                raise ValueError("a message has no time")
            absent = {"message_id": part["no_id"].to_numpy()}
            columns = [pa.array(part[f.name], f.type, mask=absent.get(f.name), from_pandas=True) for f in _WAITING]
            held.append(pa.RecordBatch.from_arrays(columns, schema=_WAITING))
            if sum(map(len, held)) >= _PIECE:
                self.waiting.appendValue(_packed(held))
                held = []
            least = _timer(int(part["us"].min()))
            first = least if first is None else min(first, least)
        if held:
            self.waiting.appendValue(_packed(held))
        wake = self.wake.get()
        if first is not None and (wake is None or first < wake[0]):
            self._wake_at(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        wake = self.wake.get()
        if wake is None or wake[0] > now:
            return
        waiting, last = _unpacked(self.waiting, _WAITING), _unpacked(self.last, _LAST)
        timers = _timer(waiting["us"].to_numpy())
        due, rest = waiting.filter(timers <= now), waiting.filter(timers > now)
        del waiting
        last = yield from self._numbered(last, due)
        ends = _timer(last["us"].to_numpy()) + self.ttl_ms
        last = last.filter(ends > now)
        _put(self.waiting, rest)
        _put(self.last, last)
        if len(rest):
            self._wake_at(int(timers[timers > now].min()))
        elif len(last):
            self._wake_at(int(ends.max()))
        else:
            self.wake.clear()

    def _wake_at(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def _numbered(self, last: pa.Table, due: pa.Table) -> Iterator[pd.DataFrame]:
        """The segments of what is due; returns each key's last message after it."""
        rows = pa.concat_tables([last, due], promote_options="default").combine_chunks()
        if not len(rows):
            return last
        column = lambda name: rows[name].combine_chunks()
        # a key's last message stands before what is due, a message without id before others of its time
        old = np.arange(len(rows)) < len(last)
        key = column("platform").dictionary_encode(null_encoding="encode").indices.to_numpy()
        us, ids = rows["us"].to_numpy(), column("message_id")
        order = np.lexsort((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), us, ~old, key))
        old, key, us = old[order], key[order], us[order]

        starts = np.append(True, key[1:] != key[:-1])
        first = starts | (_timer(us) > _timer(np.roll(us, 1)) + self.ttl_ms)
        gap = ~first & (us - np.roll(us, 1) > self.gap_us)
        near = np.flatnonzero(~first & ~gap)
        similarity, apart = np.ones(len(us)), np.zeros(len(us), bool)
        if self.least_similarity is not None:
            similarity[near] = _similarities(column("embedding"), order[near], order[near - 1])
            apart = similarity < self.least_similarity
            apart[first | gap] = False
        topic = column("topic").dictionary_encode().indices.fill_null(-1).to_numpy()[order]
        moved = np.zeros(len(us), bool)
        moved[near] = (topic[near] != topic[near - 1]) & (topic[near] >= 0) & (topic[near - 1] >= 0)
        reason = np.select([first, gap, apart, moved], ["first_message", "time_gap", "topic_change", "entity_change"], "").astype(object)
        reason[reason == ""] = None

        # new segments are counted on from the number of the key's last message, or from 1 at a first one
        new = (first | gap | apart | moved) & ~old
        count = np.cumsum(new)
        base = np.maximum.accumulate(np.where(first, np.arange(len(us)), 0))
        seq = count - count[base] + np.where(old, column("seq").fill_null(0).to_numpy()[order], 1)[base]

        given = np.flatnonzero(~old)
        for lo in range(0, len(given), _SHOWN):
            at = given[lo : lo + _SHOWN]
            shown = rows.select(["platform", "message_id"]).take(order[at])
            yield pd.DataFrame({
                "platform": shown["platform"].to_pandas(), "message_id": shown["message_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                "segment_no": seq[at], "is_new": new[at], "reason": reason[at], "similarity": similarity[at],
            })
        ends = np.flatnonzero(np.append(starts[1:], True))
        return rows.select(["platform", "us", "topic", "embedding"]).take(order[ends]).append_column(_LAST.field("seq"), pa.array(seq[ends], pa.int64()))

    def close(self) -> None:
        pass


def segment_stream(
    stream: DataFrame, gap_seconds: int = 7200, least_similarity: float | None = None, delay: str = "72 hours", ttl_ms: int = STATE_TTL_MS,
    buckets: int = 1024,
) -> DataFrame:
    """Segments of a stream with ``platform, message_id, ts, topic`` and, for ``least_similarity``, ``embedding``.

    Start the query inside ``keyed_state``. A checkpoint holds for one number of ``buckets``.
    """
    vector = F.col("embedding").cast("array<double>") if least_similarity is not None else F.lit(None).cast("array<double>")
    timed = event_time(stream, "ts", delay).select(
        F.pmod(F.xxhash64("platform"), F.lit(buckets)).alias("bucket"), F.col("platform").cast("string").alias("platform"), "ts", F.unix_micros("ts").alias("us"),
        # pandas has no whole numbers beside nulls
        F.coalesce("message_id", F.lit(0)).cast("long").alias("message_id"), F.col("message_id").isNull().alias("no_id"), F.col("topic").cast("string").alias("topic"), vector.alias("embedding"),
    )
    return timed.groupBy("bucket").transformWithStateInPandas(
        Segmenter(gap_seconds * 1_000_000, least_similarity, ttl_ms), RESULT, "Append", "EventTime"
    )
