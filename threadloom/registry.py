"""Named text providers, operators and operator chains that a user can extend."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import spans as sp
from threadloom.functions import textfn as tx
from threadloom.operators import text as tt


@dataclass(frozen=True)
class TextProvider:
    """Five Column -> Column functions; an external model plugs in as an Arrow pandas UDF."""

    name: str
    language: Callable[[Column], Column]
    entities: Callable[[Column], Column]
    keywords: Callable[[Column], Column]
    sentiment: Callable[[Column], Column]
    sentences: Callable[[Column], Column]


def _builtin() -> TextProvider:
    return TextProvider(
        "builtin",
        tx.guess_language,
        tt.entity_spans,
        lambda text: F.array_distinct(tx.tokens(text, r"\b[a-z]{3,}\b")),
        tx.sentiment_by_tokens,
        lambda text: sp.regex_spans(text, tt.SENTENCE),
    )


_PROVIDERS: dict[str, TextProvider] = {}
_DEFAULT = "builtin"
_OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def register_provider(provider: TextProvider, default: bool = False) -> None:
    global _DEFAULT
    _PROVIDERS[provider.name] = provider
    if default:
        _DEFAULT = provider.name


def set_default_provider(name: str) -> None:
    global _DEFAULT
    provider(name)
    _DEFAULT = name


def provider(name: str | None = None) -> TextProvider:
    name = name or _DEFAULT
    if name == "builtin" and name not in _PROVIDERS:
        _PROVIDERS[name] = _builtin()
    return _PROVIDERS[name]


def register_operator(name: str, fn: Callable[..., DataFrame]) -> None:
    _OPERATORS[name] = fn


def run_operator(name: str, df: DataFrame, **args) -> DataFrame:
    return _OPERATORS[name](df, **args)


def operators() -> list[str]:
    return sorted(_OPERATORS)


def chain(df: DataFrame, steps: Sequence[tuple[str, Mapping]]) -> DataFrame:
    """Apply registered operators in order, each to the result of the one before."""
    for name, args in steps:
        df = df.transform(lambda d, name=name, args=args: run_operator(name, d, **args))
    return df
