"""Which text positions can begin with one of many keys of equal length: one bit for the hash of each key.

The bits take the same few megabytes for any number of keys. A position without its bit has none of the keys; the others
are rows for a join that decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Number of bits, a power of two.
BITS = 1 << 25
#: Rows of windows, and their characters, that a task holds at a time.
_ROWS, _CHARS = 5_000, 1 << 20


def _slots(text: str, k: int) -> np.ndarray:
    """The bit of the ``k`` characters at every position that has as many."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += points[j : j + n]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return ((total >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def of_keys(keys: DataFrame, column: str, k: int) -> bytes:
    """The bits of the keys, which have ``k`` characters each; a task sends its bits only, one task after another."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BITS, dtype=bool)
        seen = False
        for batch in batches:
            for key in batch.column(0):
                if key.is_valid:
                    found[_slots(key.as_py(), k)] = seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(BITS // 8, dtype=np.uint8)
    for row in keys.select(column).distinct().mapInArrow(build, "bits binary").toLocalIterator():
        total |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return total.tobytes()


def windows(docs: DataFrame, id_col: str, text_col: str, bits: bytes, k: int, m: int) -> DataFrame:
    """(id, start, window): the ``m`` characters, fewer at the end of a text, from each position that has its bit."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    types = StructType.fromDDL("start int, window string")
    types = StructType([docs.schema[id_col], *types])
    schema = to_arrow_schema(types)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).view(bool)
        step = max(1, min(_ROWS, _CHARS // m))
        ids: list = []
        starts: list = []
        cut: list = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((ids, starts, cut), schema)], schema=schema)
            for v in (ids, starts, cut):
                v.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time, so that a batch is not held twice
                text = batch.column(1)[i].as_py()
                if text is None:
                    continue
                own = batch.column(0)[i].as_py()
                at = np.flatnonzero(held[_slots(text, k)]).tolist()
                for j in range(0, len(at), step):
                    some = at[j : j + step]
                    ids.extend([own] * len(some))
                    starts.extend(some)
                    cut.extend([text[p : p + m] for p in some])
                    if len(ids) >= step:
                        yield out()
        if ids:
            yield out()

    return docs.select(id_col, text_col).mapInArrow(find, types)
