"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback cuts every word. Ordinary prose of a language yields a narrow range of
characters per token; noise, tables and markup yield shorter tokens and many without letters, foreign scripts fall back
to bytes, and repeated or random text has a low token entropy for its length. Each language has a band (scripts have one
for other languages); a text outside it is rejected. One narrow pass: words seen before are looked up, texts are handled in blocks of a few MB.

Null and empty texts have zero words, symbols, lines and tokens, and are rejected. Repeated rows get equal results;
empty tables give empty tables. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import worker_cache
from threadloom.llm.words import between_spaces, blocks, gathered

#: Words a worker remembers (about 25 MB at most), and the longest of them.
CACHE_ENTRIES, CACHED_CHARS = 150_000, 64
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
MEASURES = (
    "n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_tokens:bigint,"
    "chars_per_token:double,fallback_share:double,token_entropy:double,script:string,bare_share:double"
)
# first code points of script blocks; a block lasts until the next one
_SCRIPTS = [
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"),
    (0x2E80, "cjk"), (0xD7FC, "other"), (0xF900, "cjk"), (0xFB00, "other"), (0x20000, "cjk"), (0x32000, "other"),
]


@dataclass(frozen=True)
class Band:
    """Limits of a language or script.

    Short texts scatter: ``slack / sqrt(words)`` widens both limits of the characters per token, ``bare_slack /
    sqrt(words)`` that of the share of tokens without letters. A short text cannot have many different tokens: the
    least entropy is ``entropy_drop / sqrt(tokens)`` lower.
    """

    chars_per_token: float
    slack: float = 0.0
    most_chars_per_token: float = 9.0
    fallback_share: float = 0.2
    token_entropy: float = 4.5
    entropy_drop: float = 0.0
    bare_share: float = 1.0
    bare_slack: float = 0.0


def _fitted(centre: float, entropy: float, drop: float, bare: float) -> Band:
    """The band around a language's centres."""
    return Band(centre, 4.0, centre, token_entropy=entropy - 0.4, entropy_drop=drop, bare_share=bare, bare_slack=2.5)


#: Fitted to the rows of even id that sf0.1 labels good (154 to 951 a language): medians, and the entropy's least squares.
BANDS = {
    "de": _fitted(2.245, 6.949, 12.3, 0.0584), "en": _fitted(2.219, 7.205, 14.89, 0.0639),
    "es": _fitted(1.942, 7.056, 13.93, 0.0535), "fr": _fitted(1.978, 6.865, 11.67, 0.0586),
    "latin": Band(1.0), "greek": Band(0.6, fallback_share=0.6), "cyrillic": Band(0.9),
    "hebrew": Band(0.6, fallback_share=0.6), "arabic": Band(0.6, fallback_share=0.6),
    "devanagari": Band(0.5, fallback_share=0.7), "cjk": Band(0.3, fallback_share=0.8), "other": Band(0.2, fallback_share=1.0),
}


class Meter:
    """Measures texts inside a task."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # the sign of a word's start alone is no token without letters
        self.bare = np.array([p != "\u2581" and not any(c.isalpha() for c in p) for p in pieces]) & ~self.fallback
        self.words: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """Token ids of each word; words not met before go to the model together."""
        if len(self.words) > CACHE_ENTRIES:
            self.words = {}
        new = [w for w in words if w not in self.words]
        coded = dict(zip(new, (np.array(ids, "<i4").tobytes() for ids in self.model.encode(new, num_threads=1))))
        found = [coded[w] if w in coded else self.words[w] for w in words]
        self.words.update((w, ids) for w, ids in coded.items() if len(w) <= CACHED_CHARS)
        return found

    def measure(self, texts: pa.Array) -> list[tuple]:
        words = between_spaces(texts)
        ids, bounds = gathered(self._ids(words.distinct), words.index)
        bounds = bounds[words.offsets]
        return [
            self._one(t or "", codes, ids[a:b])
            for t, codes, a, b in zip(texts.to_pylist(), words.rows(), bounds[:-1].tolist(), bounds[1:].tolist())
        ]

    def _one(self, text: str, codes: np.ndarray, ids: np.ndarray) -> tuple:
        raw = text.encode()
        chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
        counts = np.unique(ids, return_counts=True)[1]
        share = counts / max(len(ids), 1)
        return (
            len(codes), chars, symbols, len(lines) - len(set(lines)), repeated_words(codes), len(ids), chars / len(ids) if len(ids) else 0.0,
            float(self.fallback[ids].mean()) if len(ids) else 0.0, float(-(share * np.log2(share)).sum()) + 0.0, script(text),
            float(self.bare[ids].mean()) if len(ids) else 0.0,
        )


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    if len(codes) < 3:
        return 0
    pair = np.unique((codes[:-1] << 31) | codes[1:], return_inverse=True)[1].astype(np.int64)
    _, of, times = np.unique((pair[:-1] << 31) | codes[2:], return_inverse=True, return_counts=True)
    twice = times[of] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : len(codes) - 2 + k] |= twice
    return int(covered.sum())


def script(text: str) -> str:
    """The script of most letters outside ASCII punctuation; a text without letters is 'other'."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_letters = int((((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)).sum())
    blocks = np.bincount(np.searchsorted([a for a, _ in _SCRIPTS], points[points >= 0xC0], "right"), minlength=len(_SCRIPTS) + 1)
    totals = {"latin": ascii_letters}
    for n, (_, name) in zip(blocks[1:].tolist(), _SCRIPTS):
        if name != "common":
            totals[name] = totals.get(name, 0) + n
    best = max(sorted(totals), key=totals.get)
    return best if totals[best] else "other"


def _meter(model: bytes) -> Meter:
    return worker_cache.kept(("meter", model), lambda: Meter(model))


def measure_column(text: Column | str, model: bytes) -> Column:
    """struct of the base counts and the fertility of a text (fields: ``MEASURES``)."""

    @F.arrow_udf(f"struct<{MEASURES}>")
    def measure(texts: pa.Array) -> pa.Array:
        out, meter = [], _meter(model)
        for block in blocks(texts, 2_000_000):
            out += meter.measure(block)
        names = [f.split(":")[0] for f in MEASURES.split(",")]
        kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string(), pa.float64()]
        columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]
        worker_cache.give_back()
        return pa.StructArray.from_arrays(columns, names)

    # not deterministic only in name: Spark then runs it once, not again for every later use of the column
    return measure.asNondeterministic()(text)


def in_band(measure: Column, lang: Column, bands: dict[str, Band]) -> Column:
    """Whether the measures lie in the band of the language, or else of the script."""
    limits = F.create_map(*[
        x for name, b in bands.items() for x in (
            F.lit(name),
            F.struct(*[F.lit(float(v)).alias(k) for k, v in vars(b).items()]),
        )
    ])
    known = lang.isNotNull() & lang.isin(list(bands))
    band = F.element_at(limits, F.when(known, lang).otherwise(measure["script"]))
    words, tokens = (F.sqrt(F.greatest(measure[n], F.lit(1))) for n in ("n_words", "n_tokens"))
    fits = (
        (measure["chars_per_token"] >= band["chars_per_token"] - band["slack"] / words)
        & (measure["chars_per_token"] <= band["most_chars_per_token"] + band["slack"] / words)
        & (measure["fallback_share"] <= band["fallback_share"])
        & (measure["token_entropy"] >= band["token_entropy"] - band["entropy_drop"] / tokens)
        & (measure["bare_share"] <= band["bare_share"] + band["bare_slack"] / words)
    )
    return F.coalesce(fits, F.lit(False))


def rate(
    df: DataFrame, model: bytes, bands: dict[str, Band] = BANDS, text: str = "text", lang: str | None = "lang",
    least_words: int = 50, most_repeated: int = 50,
) -> DataFrame:
    """Every row with ``measure``, ``base_failed`` (too few words, or over ``most_repeated`` % in repeated windows) and ``kept``."""
    language = F.col(lang) if lang in df.columns else F.lit(None).cast("string")
    out = df.withColumn("measure", measure_column(F.col(text), model))
    m = F.col("measure")
    failed = (m["n_words"] < least_words) | (m["n_repeat_words"] * 100 > m["n_words"] * most_repeated)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & in_band(m, language, bands))
