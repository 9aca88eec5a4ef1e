"""Personal data: fixed rules for e-mail addresses, IP addresses, cards and phones, and learned spans for secrets.

Base spans are the leftmost, non-overlapping matches of a pattern for each kind that also pass its test (parts of an
address up to 255, Luhn's sum, number of digits). The patterns below only start where a match can start and repeat no
group without bound, so a text of any length needs linear time and a flat stack.

Further spans are tokens with a digit that look like secrets. Labelers vote on every candidate of the corpus (1 for a
secret, -1 against, 0 abstains): regular expressions for the shape, gazetteers of key prefixes and of harmless
neighbours, and the context before it. Expectation-maximisation estimates how often each labeler is right, over the
counts of vote patterns, and gives every candidate a probability. A logistic classifier over shape and context
features is trained on those probabilities and decides. Candidates that touch a base span are left out.

Only DataFrame functions run on the executors; the driver gets at most one row for each pattern of votes and of
features, a fixed number. Texts without a digit or "@" are passed over.

Null and empty texts have no spans. Repeated rows get equal spans. Offsets count code points, ends are exclusive.
Without candidates no span is added. Empty tables give empty tables. Added columns replace input columns of the same
name; the others pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.spans import let, regex_spans

KINDS = ["email", "ip", "card", "phone", "secret"]
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Equal to the plain patterns, but a match starts at the start of a run (or where the last match ended).
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?={_LABEL}++\.{_LABEL})[A-Za-z0-9.-]*?(?=\.(?!{_LABEL})|[^A-Za-z0-9.-]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPANS = "array<struct<start:int,kind:int,end:int>>"
_TOKEN = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{_TOKEN})(?=[A-Za-z+/_-]*+[0-9]){_TOKEN}{{8,}}+"

# Cue words, key prefixes and harmless neighbours.
CUES = ["password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "passwort", "kennwort", "contraseña", "clave", "mot de passe"]
KEY_PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "eyJ"]
HARMLESS = ["version", "license", "isbn", "issn", "chapter", "figure", "page", "section", "rfc", "iso", "http", "www"]


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]


# ---------------------------------------------------------------- base spans
def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits have Luhn's sum: every second one from the right doubled, nine taken off above nine."""
    places = F.split(F.reverse(digits), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(places, lambda d: d != ""), value), F.lit(0), lambda s, v: s + v) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3
        return F.forall(F.split(match, r"\."), lambda p: small(p) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    n = F.length(_digits(match))
    if kind == "card":
        return n.between(12, 19) & _luhn(_digits(match))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start,kind,end>> by start, then kind (its number in ``KINDS``)."""
    none = F.array().cast(SPANS)

    def of(kind: str) -> Column:
        found = F.filter(regex_spans(text, PATTERNS[kind]), lambda s: _passes(kind, s["text"]))
        number = F.lit(KINDS.index(kind))
        spans = F.transform(found, lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))
        sign = {"email": "@", "phone": "+", "ip": "."}.get(kind)
        return F.when(F.contains(text, F.lit(sign)), spans).otherwise(none) if sign else spans

    return F.when(F.rlike(text, F.lit("[0-9@]")), F.array_sort(F.concat(*[of(k) for k in PATTERNS]))).otherwise(none)


# ---------------------------------------------------------------- candidates, votes, features
def candidates(text: Column, base: Column) -> Column:
    """array<struct<start,end,token,before>> of tokens that may be secrets, clear of base spans."""
    none = F.array().cast("array<struct<start:int,end:int,token:string,before:string>>")
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))

    def seen(s: Column) -> Column:
        left = F.greatest(s["start"] - 24, F.lit(0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("token"), F.lower(F.substring(text, left + 1, s["start"] - left)).alias("before"))

    return F.when(F.rlike(text, F.lit("[0-9]")), F.transform(F.filter(regex_spans(text, CANDIDATE), free), seen)).otherwise(none)


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def votes(c: Column) -> list[Column]:
    """One vote of each labeler: 1, 0 or -1."""
    token, before = c["token"], c["before"]
    rule = lambda condition, vote: F.when(condition, F.lit(vote)).otherwise(F.lit(0))
    like = lambda x, pattern: F.rlike(x, F.lit(pattern))
    return [
        rule(like(before, _any(CUES) + "[\"' ]*[:=][\"' ]*$"), 1),  # context: a cue and a sign of assignment
        rule(like(token, "^" + _any(KEY_PREFIXES)), 1),  # gazetteer: how known keys begin
        rule(like(before, _any(HARMLESS) + r"[^a-z]*$"), -1),  # gazetteer: what precedes harmless numbers
        rule(like(token, "^(?=.*[a-f])[0-9a-f]{16,}$"), 1),  # shape: hexadecimal
        rule(like(token, "^(?=.*[A-Z])(?=.*[0-9].*[0-9].*[0-9])[A-Za-z0-9+/_-]{16,}$"), 1),  # shape: long and mixed
        rule(like(token, "^[0-9+/_-]+$") | like(token, "^[A-Za-z]+[0-9]{1,4}$"), -1),  # shape: a number, a numbered word
        F.when(F.length(token) < 12, -1).when(F.length(token) >= 18, 1).otherwise(0),  # length
    ]


def features(c: Column) -> list[Column]:
    """Shape and context of a candidate, as booleans."""
    token, before = c["token"], c["before"]
    share = F.length(_digits(token)) / F.length(token)
    return [
        F.length(token) >= 12, F.length(token) >= 16, F.length(token) >= 24, share >= 0.2, share >= 0.9,
        F.rlike(token, F.lit("[A-Z]")), F.rlike(token, F.lit("[a-z]")), ~F.rlike(token, F.lit("[^0-9a-fA-F]")),
        F.rlike(before, F.lit("[:=][\"' ]*$")), F.rlike(before, F.lit(_any(CUES))), F.rlike(token, F.lit("[0-9][A-Za-z]+[0-9]")),
    ]


# ---------------------------------------------------------------- learning, from counts of patterns
def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Probability of a secret for each vote pattern, by expectation-maximisation from the majority of votes.

    The share of each vote (1, 0, -1) of each labeler among secrets and among the rest is what is estimated.
    """
    share = {v: 0.9 if sum(v) > 0 else 0.1 for v in counts}
    for _ in range(rounds):
        tables, totals = [], []
        for side in (1, 0):
            weight = {v: n * (share[v] if side else 1 - share[v]) for v, n in counts.items()}
            total = sum(weight.values())
            totals.append(total + 1)
            tables.append([
                {x: (sum(w for v, w in weight.items() if v[k] == x) + 0.1) / (total + 0.3) for x in (-1, 0, 1)}
                for k in range(len(next(iter(counts))))
            ])
        new = {}
        for v in counts:
            odds = math.log(totals[0] / totals[1]) + sum(math.log(tables[0][k][x] / tables[1][k][x]) for k, x in enumerate(v))
            new[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
        moved = max(abs(new[v] - share[v]) for v in counts)
        share = new
        if moved < 1e-6:
            break
    return share


def logistic(rows: list[tuple[tuple[bool, ...], float, float]], ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Weights (the first is the constant) from (features, share of secrets, number), by Newton steps."""
    width = len(rows[0][0]) + 1
    w = [0.0] * width
    for _ in range(rounds):
        slope = [-ridge * x for x in w]
        curve = [[ridge * (i == j) for j in range(width)] for i in range(width)]
        for fs, share, n in rows:
            on = [0, *(i + 1 for i, f in enumerate(fs) if f)]
            p = 1 / (1 + math.exp(-max(min(sum(w[i] for i in on), 30), -30)))
            for i in on:
                slope[i] += n * (share - p)
                for j in on:
                    curve[i][j] += n * p * (1 - p)
        step = _solved(curve, slope)
        w = [a + max(min(b, 4.0), -4.0) for a, b in zip(w, step)]
        if max(map(abs, step)) < 1e-6:
            break
    return tuple(w)


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination; the matrix is positive definite."""
    rows = [[*r, x] for r, x in zip(a, b)]
    for i in range(len(rows)):
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


def fit(docs: DataFrame, text: str = "text") -> Classifier | None:
    """The span classifier from all candidates of the corpus; None where there is none."""
    body = F.col("__text")
    rows = docs.select(F.col(text).alias("__text")).where(F.rlike(body, F.lit("[0-9]")))
    rows = rows.select(F.explode(candidates(body, base_spans(body))).alias("c"))
    table = rows.groupBy(F.array(*votes(F.col("c"))).alias("v"), F.array(*features(F.col("c"))).alias("f")).count()
    # votes are at most 3^7 and features 2^11 patterns, most of which exclude each other
    seen = [(tuple(r["v"]), tuple(r["f"]), r["count"]) for r in table.collect()]
    if not seen:
        return None
    counts: dict[tuple[int, ...], int] = {}
    for v, _, n in seen:
        counts[v] = counts.get(v, 0) + n
    share = reliabilities(dict(sorted(counts.items())))
    by: dict[tuple[bool, ...], list[float]] = {}
    for v, f, n in sorted(seen):
        s = by.setdefault(f, [0.0, 0.0])
        s[0] += n * share[v]
        s[1] += n
    return Classifier(logistic([(f, s / n, n) for f, (s, n) in sorted(by.items())]))


# ---------------------------------------------------------------- operators
def find(docs: DataFrame, classifier: Classifier | None, text: str = "text") -> DataFrame:
    """Every row with ``base`` and ``spans`` (base and learned ones), both ordered by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("base", base_spans(body))
    if classifier is None:
        return out.withColumn("spans", F.col("base"))
    constant, *weights = classifier.weights

    def secret(c: Column) -> Column:
        total = F.lit(constant)
        for w, f in zip(weights, features(c)):
            total = total + F.when(f, w).otherwise(0.0)
        return total >= 0

    added = F.transform(
        F.filter(candidates(body, F.col("base")), secret),
        lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("secret")).alias("kind"), c["end"].alias("end")),
    )
    return out.withColumn("spans", F.array_sort(F.concat("base", added)))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones joined) replaced by the first one's kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.array_append(acc["out"], piece)).alias("out")
        )

    def whole(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(F.aggregate(spans, zero, step), whole)).otherwise(text)
