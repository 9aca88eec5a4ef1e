"""Byte-level BPE over Arrow batches with the tokenizers library.

A text is cut into the matches of the pre-tokenizer's pattern; each is mapped to the characters of its bytes and
merged on its own. Natural text repeats its words, so a worker remembers the ids of words it has met and hands only
new ones to the library. Texts that hold one of the description's added tokens go to the library as they are. Nothing
is shuffled; a row needs its text, its ids and the cache.

Null texts count as empty and give no ids. Null ids decode to an empty value. An id outside the vocabulary raises.
Repeated rows give repeated results; empty tables give empty tables. An output column replaces an input column of the
same name; all other columns pass through.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import worker_cache
from threadloom.llm.words import at_blanks, blocks, content, gathered

#: Words of each of two generations that a worker remembers (about 25 MB each), bytes of text handled at once, and the
#: length of the longest word remembered. More of both is faster and takes more memory.
CACHE_ENTRIES, BLOCK_BYTES, CACHED_CHARS = 100_000, 2_000_000, 64
_MARKS = (".", ",", ";", ":", "!", "?")


# ---------------------------------------------------------------- the byte table
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, take the code points from 256 on.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def token_bytes(token: str) -> bytes:
    """Reverse of the byte table."""
    table = _character_bytes()
    return bytes(table[c] for c in token)


@lru_cache(1)
def _character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


# ---------------------------------------------------------------- vocabularies
def vocabulary_from_file(path: str) -> str:
    """A tokenizer description (JSON) of the tokenizers library, read on the driver and shipped with the job."""
    return Path(path).read_text()


def vocabulary_from_ranks(path: str, pattern: str) -> str:
    """The tokenizer description that merges by the ranks of a rank file (base64 token and rank on each line).

    The pair that a token was merged from is what lower ranks alone leave of it.
    """
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, Path(path).read_bytes().splitlines())}
    chars = byte_characters()
    name = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = _merged(token, ranks, rank)
            if len(parts) == 2:
                merges.append([name(parts[0]), name(parts[1])])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            ],
        },
        "post_processor": None,
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
            "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False,
            "vocab": {name(t): r for t, r in ranks.items()}, "merges": merges,
        },
    })


def _merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


# ---------------------------------------------------------------- inside a task
class Encoder:
    """Encodes whole texts to little-endian 32-bit ids; remembers the words that stand behind a blank.

    The library's model merges one match at a time, given as the characters of its bytes. Words are remembered in two
    generations: when the newer one is full it becomes the older one, and words still met move up again.
    """

    def __init__(self, vocabulary: str, pattern: str, remembered: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        self.find = regex.compile(pattern).findall
        self.character = dict(enumerate(byte_characters()))
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        described = json.loads(vocabulary)
        self.bytes_of = [token_bytes(t) for t, _ in sorted(described["model"]["vocab"].items(), key=lambda x: x[1])]
        self.added = [t["content"] for t in described.get("added_tokens") or []]
        # an added token stands for its own text
        for token in sorted(described.get("added_tokens") or [], key=lambda t: t["id"]):
            self.bytes_of[token["id"] : token["id"] + 1] = [token["content"].encode()]

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern."""
        mapped = match.encode().decode("latin-1").translate(self.character)
        return b"".join([self.id_bytes[t.id] for t in self.merge(mapped)])

    def _word(self, word: str) -> bytes:
        """Ids of a blank and a word."""
        if word.isalpha():
            # ASCII letters stand for themselves, the blank for the next free character
            return b"".join([self.id_bytes[t.id] for t in self.merge("Ġ" + word)]) if word.isascii() else self._match(" " + word)
        if word[-1:] in _MARKS and word[:-1].isalpha():
            return self._known(word[:-1]) + self._match(word[-1])
        return b"".join([self._match(m) for m in self.find(" " + word)])

    def _known(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                ids = self._word(word)
            if len(word) <= CACHED_CHARS:
                if len(self.words) >= self.remembered:
                    self.older, self.words = self.words, {}
                self.words[word] = ids
        return ids

    def _text(self, text: str) -> bytes:
        """Ids of a text with more than single blanks between its words."""
        return b"".join([self._known(m[1:]) if m[0] == " " and m[1:].isalpha() else self._match(m) for m in self.find(text)])

    def _special(self, text: str) -> bytes:
        """Ids of a text that holds an added token."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text of a column.

        A match never crosses a blank that follows something not blank. Texts in which no blank follows white space
        are therefore cut at their blanks; the first word of a text has none before it.
        """
        words = at_blanks(texts)
        rows = len(texts)
        odd = np.array([not w or w[-1].isspace() for w in words.distinct], bool)[words.index]
        whole = np.logical_or.reduceat(odd, words.offsets[:-1])
        special = np.zeros(rows, bool)
        held = content(texts) if self.added else b""
        for token in self.added:
            if token.encode() in held:
                special |= pc.match_substring(pc.fill_null(texts, ""), token).to_numpy(zero_copy_only=False)
        whole |= special
        index = words.index.copy()
        index[words.offsets[:-1]] = len(words.distinct) + np.arange(rows)
        firsts = []
        uncut = iter(texts.filter(pa.array(whole)).to_pylist())
        for i, at in enumerate(words.index[words.offsets[:-1]].tolist()):
            if whole[i]:
                text = next(uncut)
                index[words.offsets[i] : words.offsets[i + 1]] = len(words.distinct) + rows  # stands for nothing
                index[words.offsets[i]] = len(words.distinct) + i
                firsts.append(self._special(text) if special[i] else self._text(text) if text else b"")
            else:
                firsts.append(b"".join([self._match(m) for m in self.find(words.distinct[at])]))
        get, known = self.words.get, self._known
        parts = [get(w) or known(w) for w in words.distinct]
        ids, bounds = gathered([*parts, *firsts, b""], index)
        return pa.ListArray.from_arrays(pa.array(bounds[words.offsets], pa.int32()), pa.array(ids.view("<i4"), pa.int32()))


def encoder(vocabulary: str, pattern: str, remembered: int = CACHE_ENTRIES) -> Encoder:
    return worker_cache.kept(("encoder", vocabulary, pattern, remembered), lambda: Encoder(vocabulary, pattern, remembered))


def _ended(ids: pa.Array, end_id: int) -> pa.Array:
    offsets = ids.offsets.to_numpy()
    flat = np.insert(ids.values.to_numpy(), offsets[1:], end_id)
    return pa.ListArray.from_arrays(pa.array(offsets + np.arange(len(offsets)), pa.int32()), pa.array(flat, pa.int32()))


def id_rows(ids: pa.Array):
    """The ids of each row of a list column, as arrays; null rows are empty."""
    flat = ids.values.to_numpy(zero_copy_only=False)
    offsets = ids.offsets.to_numpy()
    null = ids.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(ids)):
        yield flat[0:0] if null[i] else flat[offsets[i] : offsets[i + 1]]


# ---------------------------------------------------------------- columns and tables
def encode_column(
    text: Column | str, vocabulary: str, pattern: str, end_id: int | None = None, remembered: int = CACHE_ENTRIES, block_bytes: int = BLOCK_BYTES,
) -> Column:
    """array<int>: the ids of a text, with ``end_id`` behind them where given."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        enc = encoder(vocabulary, pattern, remembered)
        gc.disable()  # large lists of strings and no cycles: collections would only walk over them again and again
        try:
            out = [enc.encode(block) for block in blocks(texts, block_bytes)] or [pa.array([], pa.list_(pa.int32()))]
        finally:
            gc.enable()
        return pa.concat_arrays(out if end_id is None else [_ended(ids, end_id) for ids in out])

    # not deterministic only in name: Spark then runs it once, not again for every later use of the column
    return encode.asNondeterministic()(text)


def decode_column(ids: Column | str, vocabulary: str, pattern: str) -> Column:
    """binary: the bytes that the ids stand for. They need not be valid UTF-8: a character can be split over tokens."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        table = encoder(vocabulary, pattern).bytes_of
        return pa.array([b"".join([table[i] for i in row.tolist()]) for row in id_rows(lists)], pa.binary())

    return decode(ids)


def round_trip_column(text: Column | str, vocabulary: str, pattern: str) -> Column:
    """struct<ids,decoded>: the ids of a text and the bytes they stand for, from one worker with one vocabulary."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        enc = encoder(vocabulary, pattern)
        ids, decoded = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.binary())]
        gc.disable()  # as in encode_column
        try:
            for block in blocks(texts, BLOCK_BYTES):
                ids.append(enc.encode(block))
                decoded.append(pa.array([b"".join([enc.bytes_of[i] for i in row.tolist()]) for row in id_rows(ids[-1])], pa.binary()))
        finally:
            gc.enable()
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(decoded)], ["ids", "decoded"])

    # not deterministic only in name: Spark then runs it once, not again for every field
    return both.asNondeterministic()(text)


def ids_digest_column(ids: Column | str) -> Column:
    """Lowercase hex SHA-256 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def digest(lists: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in id_rows(lists)], pa.string())

    return digest(ids)


def offsets_column(ids: Column | str, vocabulary: str, pattern: str) -> Column:
    """array<struct<start,end,byte_start,byte_end,split>>: where each token lies in the decoded text.

    ``start`` and ``end`` count code points and cover every character the token has a byte of; ``split`` marks tokens
    that begin or end inside a character, so neighbours then share a character.
    """
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("split", pa.bool_())])

    @F.arrow_udf("array<struct<start:int,end:int,byte_start:int,byte_end:int,split:boolean>>")
    def offsets(lists: pa.Array) -> pa.Array:
        table = encoder(vocabulary, pattern).bytes_of
        bounds, parts = [0], []
        for row in id_rows(lists):
            tokens = [table[i] for i in row.tolist()]
            raw = np.frombuffer(b"".join(tokens), np.uint8)
            first = np.append((raw & 0xC0) != 0x80, True)  # bytes that begin a character
            chars = np.concatenate([[0], np.cumsum(first[:-1])])
            ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
            starts = ends - [len(t) for t in tokens] if tokens else ends
            inside = lambda at: ~first[at]
            parts.append((chars[starts] - inside(starts), chars[ends], starts, ends, inside(starts) | inside(ends)))
            bounds.append(bounds[-1] + len(tokens))
        columns = [np.concatenate([p[k] for p in parts] or [[]]) for k in range(5)]
        fields = [pa.array(c.astype(np.int32)) for c in columns[:4]] + [pa.array(columns[4].astype(bool))]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))

    return offsets(ids)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Every row with its ``ids`` and, where a name is given, their ``offsets``."""
    out = df.withColumn(ids, encode_column(F.col(text), vocabulary, pattern))
    return out.withColumn(offsets, offsets_column(F.col(ids), vocabulary, pattern)) if offsets else out


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the ``decoded`` bytes of its ids."""
    return df.withColumn(decoded, decode_column(F.col(ids), vocabulary, pattern))
