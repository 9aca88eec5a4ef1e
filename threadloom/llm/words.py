"""Words of Arrow text columns inside tasks: cut and numbered by Arrow, so that Python only sees distinct words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Words:
    """Row i has the words ``index[offsets[i]:offsets[i + 1]]``, numbers into ``distinct``."""

    offsets: np.ndarray
    index: np.ndarray
    distinct: list[str]

    def rows(self):
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            yield self.index[a:b]


def _numbered(lists: pa.Array) -> Words:
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return Words(offsets - offsets[0], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist())


def at_blanks(texts: pa.Array) -> Words:
    """What lies between blanks (U+0020), empty strings included."""
    return _numbered(pc.split_pattern(pc.fill_null(texts, ""), " "))


def between_spaces(texts: pa.Array) -> Words:
    """Runs of characters other than blank, tab, line feed, vertical tab, form feed and return."""
    words = _numbered(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    if "" in words.distinct:
        full = words.index != words.distinct.index("")
        words.offsets = np.concatenate([[0], np.cumsum(full)])[words.offsets]
        words.index = words.index[full]
    return words


def blocks(texts: pa.Array, most: int) -> list[pa.Array]:
    """The column in runs of rows of about ``most`` bytes, so that working memory does not follow the batch size."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    out, start, size = [], 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            out.append(texts.slice(start, i - start))
            start, size = i, 0
        size += n
    return [*out, texts.slice(start)] if lengths else out


def content(texts: pa.Array) -> bytes:
    """The UTF-8 bytes of all rows, one behind the other (what null rows cover is undefined)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[[texts.offset, texts.offset + len(texts)]] if len(texts) else (0, 0)
    return data[int(ends[0]) : int(ends[1])].to_pybytes() if data is not None else b""


def gathered(parts: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of ``parts[index[0]]``, ``parts[index[1]]``, ... and where each of these begins (and the end)."""
    table = np.frombuffer(b"".join(parts), "<u4")
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    starts = np.cumsum(lengths) - lengths
    sizes = lengths[index]
    ends = np.cumsum(sizes)
    at = np.repeat(starts[index] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return table[at], np.concatenate([[0], ends])
