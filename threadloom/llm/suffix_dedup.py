"""Removal of byte strings that repeat anywhere, by counting fingerprints at window minima in place of sorted suffix ranks.

Every byte covered by a string of ``length`` bytes that starts at another place too is removed; all occurrences go.

Ranking the suffix at every byte would shuffle more than a hundred times the input. Two equal strings share the place
of their least 16-byte hash (the leftmost, within the first ``window`` starts), so only suffixes at such minima, about
one in 85 bytes, are ranked; every start i belongs to the minimum of its string. Ranks then cover more in fixed steps, and
suffixes drop out as soon as they are unique:

1. rank by the first ``length - window`` bytes from the minimum, which every string of it covers;
2. rank pair with the run: all strings that belong to the minimum, from the first start to the last end. A run that
   occurs twice is removed whole;
3. runs that are unique while their rank is not (ends of repeats) are cut into cells of ``CELL`` starts, counted from
   the minimum. If all bytes of a cell's strings repeat together, the cell goes whole; if the part that all of them
   share is unique, so are they; only the cells between are ranked string by string.

Ranks are fingerprints; a decision rests on a pair of them, over 100 bits. Ranks are counted by partial aggregation and
looked up by joins that adaptive execution can split, so a passage that a third of all documents hold is no single
task's work. Texts move once, those with candidates once more.

Texts are taken as UTF-8; null texts are empty, texts shorter than ``length`` stay as they are. Matches never cross
documents. Repeated rows are copies of each other and lose all their strings. Empty tables give empty tables. The
result has fixed columns; other input columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.words import blocks
from threadloom.session import scratch_path

GRAM, CELL = 16, 14
_POSITION_BITS = 30
_PIECE = 4_000_000
_U = np.uint64
_random = np.random.default_rng(977)
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_random.integers(0, 2**62)) * 4 + 3


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.full(n, _U(base % 2**64))]).cumprod(dtype=np.uint64)


class _Prints:
    """Fingerprints of substrings of a byte array: polynomial prefix sums modulo 2**64, then mixed."""

    up = _powers(_BASE, 1 << 16)
    down = _powers(pow(_BASE, -1, 2**64), 1 << 16)

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        while len(_Prints.up) <= n:
            _Prints.up, _Prints.down = _powers(_BASE, 2 * len(_Prints.up)), _powers(pow(_BASE, -1, 2**64), 2 * len(_Prints.down))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * self.up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def window_of(length: int) -> int:
    """Starts among which the minimum is sought: wide, but leaving 32 bytes that all strings of a minimum share."""
    return max(1, min(length - GRAM + 1, length - 32) if length >= 64 else length - GRAM + 1)


def minima(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[_Prints, np.ndarray, np.ndarray, np.ndarray]:
    """(prints, minimum, first, last) of each run of string starts; ``starts`` says where a string may begin."""
    prints, window = _Prints(raw), window_of(length)
    low = _U((1 << _POSITION_BITS) - 1)
    key = (prints.grams(GRAM) & ~low) | np.arange(len(raw) - GRAM + 1, dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < window:
        key = np.minimum(key[: len(key) - (window - size)], key[window - size :])
    at = np.flatnonzero(starts)
    least = (key[at] & low).astype(np.int64)
    new = np.flatnonzero((least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], new]) if len(at) else new
    last = np.concatenate([new, [len(at)]])[: len(first)] - 1
    return prints, least[first], at[first], at[last]


def _pieces(texts: pa.Array, length: int):
    """(rows, bases, parts, own): whole texts put together up to 250 kB, longer ones alone and cut with overlap.

    A piece of a cut text has the runs whose first start lies in ``own``. It begins one start before them and ends a
    window after them, so that each of its own runs lies in it whole and no other piece has the same run.
    """
    base, window = 0, window_of(length)
    for block in blocks(texts, 250_000):
        encoded = [(t or "").encode() for t in block.to_pylist()]
        if len(encoded) == 1 and len(encoded[0]) > _PIECE:
            for a in range(0, len(encoded[0]) - length + 1, _PIECE):
                begin = max(a - 1, 0)
                yield [base], [begin], [encoded[0][begin : a + _PIECE + window + length]], (a, a + _PIECE)
        else:
            yield [base + i for i in range(len(encoded))], [0] * len(encoded), encoded, None
        base += len(encoded)


def _runs(texts: pa.Array, length: int):
    """For each piece: row numbers, positions of minimum, first and last start in their text, rank and run rank."""
    window = window_of(length)
    for rows, bases, parts, own in _pieces(texts, length):
        sizes = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        if len(raw) < length:
            continue
        ends = np.cumsum(sizes)
        starts = np.zeros(len(raw), bool)
        for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
            starts[begin : max(begin, end - length + 1)] = True
        if not starts.any():
            continue
        prints, least, first, last = minima(raw, starts, length)
        if own:
            mine = (first + bases[0] >= own[0]) & (first + bases[0] < own[1])
            least, first, last = least[mine], first[mine], last[mine]
        owner = np.searchsorted(ends, first, "right")
        shift = (ends - sizes)[owner] - np.array(bases, np.int64)[owner]
        rank = prints(least, least + length - window)
        yield np.array(rows)[owner], least - shift, first - shift, last - shift, rank, prints(first, last + length)


def _ranks(length: int):
    def ranks(batches):
        for batch in batches:
            for *_, rank, _run in _runs(batch["text"], length):
                yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64))], ["rank"])

    return ranks


def _suffixes(length: int):
    def suffixes(batches):
        for batch in batches:
            doc_id, version = batch["doc_id"], batch["version"]
            for rows, least, first, last, rank, run in _runs(batch["text"], length):
                rows = pa.array(rows)
                # minimum and the distances to its first and last start, in one number
                place = least << 24 | (least - first) << 12 | (least - last)
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(rows), version.take(rows), pa.array(place), pa.array(rank.view(np.int64)), pa.array(run.view(np.int64))],
                    ["doc_id", "version", "place", "rank", "run"],
                )

    return suffixes


def _cells(length: int):
    """Cells of open runs: (doc_id, version, place, cell, core, hull); a cell that leaves its text has a hull of its own."""
    window = window_of(length)

    def cells(batches):
        for batch in batches:
            columns = [[], [], [], [], [], []]
            for doc_id, version, text, places in zip(*(batch[c].to_pylist() for c in ("doc_id", "version", "text", "open"))):
                places = np.array(places, np.int64)
                if not len(places):
                    continue
                prints = _Prints(np.frombuffer(text.encode(), np.uint8))
                size = len(prints.sums) - 1
                least, back, near = places >> 24, places >> 12 & 4095, places & 4095
                many = back // CELL - near // CELL + 1
                of = np.repeat(np.arange(len(places)), many)
                cell = (near // CELL)[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                low, high = cell * CELL, np.minimum(cell * CELL + CELL, window) - 1
                m = least[of]
                rank = prints(m, m + length - window)
                inside = (m - high >= 0) & (m - low + length <= size)
                hull = prints(np.where(inside, m - high, 0), np.where(inside, m - low + length, 0))
                own = np.maximum(near[of], low), np.minimum(back[of], high)
                place = m << 24 | own[1] << 12 | own[0]
                hull = np.where(inside, hull, _mix(place.astype(np.uint64) + _U(version % 2**64)))
                name = _mix(rank + _U(0x9E3779B97F4A7C15) * cell.astype(np.uint64))
                n = len(of)
                for column, values in zip(columns, ([doc_id] * n, [version] * n, place, name.view(np.int64), prints(m - low, m - high + length).view(np.int64), hull.view(np.int64))):
                    column.extend(values if isinstance(values, list) else values.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "version", "place", "cell", "core", "hull"])

    return cells


def _strings(length: int):
    """Single strings of the runs that are open: (doc_id, version, start, rank of the string within its suffix rank)."""

    def strings(batches):
        for batch in batches:
            for i, (text, places) in enumerate(zip(batch["text"].to_pylist(), batch["open"].to_pylist())):
                places = np.array(places, np.int64)
                if not len(places):
                    continue
                raw = np.frombuffer(text.encode(), np.uint8)
                least, back, near = places >> 24, places >> 12 & 4095, places & 4095
                sizes = back - near + 1
                which = np.repeat(np.arange(len(places)), sizes)
                start = (least - back)[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                share, window = length - window_of(length), window_of(length)
                out = ([], [])
                # prints of the neighbourhood only: a text of any length needs no more than its open runs
                for a in range(0, len(start), 200_000):
                    s = start[a : a + 200_000]
                    lo = int(s.min())
                    prints = _Prints(raw[lo : int(s.max()) + length])
                    m = least[which[a : a + 200_000]]
                    rank = prints(m - lo, m - lo + share) + _U(0x9E3779B97F4A7C15) * (m - s).astype(np.uint64)
                    out[0].append(_mix(rank).view(np.int64))
                    out[1].append(prints(s - lo, s - lo + length).view(np.int64))
                n = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([batch["doc_id"].slice(i, 1)]).take(pa.array(np.zeros(n, np.int64))), pa.array([batch["version"][i].as_py()] * n, pa.int64()),
                     pa.array(start), pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]))],
                    ["doc_id", "version", "start", "rank", "string"],
                )

    return strings


def _cut(length: int):
    """kept bytes and counts, from the runs that go whole and the single strings."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, whole, single in zip(batch["text"].to_pylist(), batch["whole"].to_pylist(), batch["single"].to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                places = np.array(whole or [], np.int64)
                np.add.at(edge, (places >> 24) - (places >> 12 & 4095), 1)
                np.add.at(edge, (places >> 24) - (places & 4095) + length, -1)
                starts = np.array(single or [], np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
                kept = raw[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), spans, kept))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def _with_version(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(doc_id, body).alias("version"), body.alias("text"))


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` holds the remaining bytes."""
    if length < GRAM + CELL or window_of(length) > 4096:
        raise ValueError(f"length must lie between {GRAM + CELL} and 4127 bytes")
    base, shelf = _with_version(docs, doc_id, text), _Shelf(docs.sparkSession)
    suffixes = shelf.put("suffixes", _repeated_suffixes(base.where(F.octet_length("text") >= length), length))
    runs = shelf.put("runs", _counted(suffixes, "rank", "run"))
    touched = shelf.put("touched", _with_places(base, _open(runs, "rank"), {"place": "open"}, "inner"))
    cells = shelf.put("cells", touched.mapInArrow(_cells(length), "doc_id bigint, version bigint, place bigint, cell bigint, core bigint, hull bigint"))
    hulls = shelf.put("hulls", _counted(cells, "cell", "core", "hull"))
    mixed = shelf.put("mixed", _open(hulls, "cell", "core"))
    whole = shelf.put("whole", _twice(suffixes, runs, "rank", "run").union(_twice(cells, hulls, "cell", "core", "hull")))
    shelf.drop("suffixes", "runs", "cells", "hulls")
    strings = shelf.put("strings", _with_places(touched.drop("open"), mixed, {"place": "open"}, "inner").mapInArrow(
        _strings(length), "doc_id bigint, version bigint, start bigint, rank bigint, string bigint"
    ))
    shelf.drop("touched", "mixed")
    again = strings.groupBy("rank", "string").count().where("count > 1").select("rank", "string")
    none = F.lit(None).cast("long")
    single = strings.join(again, ["rank", "string"], "left_semi").select("doc_id", "version", F.col("start").alias("single"), none.alias("whole"))
    gone = shelf.put("gone", whole.select("doc_id", "version", none.alias("single"), F.col("place").alias("whole")).union(single))
    shelf.drop("whole", "strings")
    ready = _with_places(base, gone, {"whole": "whole", "single": "single"}, "left")
    return ready.mapInArrow(_cut(length), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def _repeated_suffixes(long: DataFrame, length: int) -> DataFrame:
    """Suffixes at minima whose first bytes occur twice."""
    repeated = long.select("text").mapInArrow(_ranks(length), "rank bigint").groupBy("rank").count().where("count > 1").select("rank")
    suffixes = long.mapInArrow(_suffixes(length), "doc_id bigint, version bigint, place bigint, rank bigint, run bigint")
    return suffixes.join(repeated, "rank", "left_semi")


def _counted(rows: DataFrame, *ranks: str) -> DataFrame:
    """How often each rank occurs (n), and its first place."""
    return rows.groupBy(*ranks).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "place")).alias("first"))


def _twice(rows: DataFrame, counted: DataFrame, *ranks: str) -> DataFrame:
    """Places whose rank occurs twice."""
    return rows.join(counted.where("n > 1").select(*ranks), list(ranks), "left_semi").select("doc_id", "version", "place")


def _open(counted: DataFrame, *shorter: str) -> DataFrame:
    """One place of each rank, for the shorter ranks that occur twice and hold a unique one."""
    ranks = counted.groupBy(*shorter).agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1")
    return counted.join(ranks.select(*shorter), list(shorter), "left_semi").select("first.*")


def _with_places(docs: DataFrame, rows: DataFrame, lists: dict[str, str], how: str) -> DataFrame:
    """Documents with the rows of each gathered into arrays, bounded by the document's own length."""
    found = rows.groupBy(F.col("doc_id").alias("__id"), F.col("version").alias("__v")).agg(*[F.collect_set(c).alias(name) for c, name in lists.items()])
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("version") == F.col("__v")), how).drop("__id", "__v")


class _Shelf:
    """Tables of finished steps in the shared folder, dropped when no later step reads them.

    Shuffles of finished steps go too: Spark's cleaner removes them when the driver collects garbage, by default every
    half hour, so a step asks for it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = scratch_path(self.spark, f"suffix-{name}")
        df.write.option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
