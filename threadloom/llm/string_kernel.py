"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words counts the runs of four letters they have in common, in order but with gaps: such a
subsequence weighs ``DECAY`` to the power of the span it covers, spans up to ``SPAN`` characters. A few letters put
in, left out or swapped lower it only a little. It is normalised, so a word and itself give 1. Words are folded first:
lower case, look-alike digits as letters, other signs left out, both ends marked; letters set apart by blanks are
joined; long strings are cut into windows.

A document is as toxic as its worst word. Training (labelled documents, at most about ``train_documents``, drawn by a hash of
the id):

1. the sentences of a toxic document hold a bad word somewhere. Words are counted by the different words they follow,
   so copies of a text count once. A word is bad if it stands in toxic documents alone (all but a twentieth) and more
   often than chance allows; further words are taken where they alone explain documents, those that explain most
   first. Each also counts with a letter put in. Words of clean documents are the other class;
2. landmarks are drawn from both classes; the kernel to the landmarks, whitened, gives the features of a linear
   squared-hinge SVM. It is fitted, scores the clean words, and is fitted again with the worst of them, twice;
3. a logistic curve over the worst word of each document turns margins into scores with 0.5 as the border.

The fitted model is one table of subsequence weights, 21 MB in a worker at any corpus size, so distinct words are
scored by look-ups. Null and empty texts get the score of a text without bad words. Repeated rows get equal scores. Without
labels of both classes every score is 0. Empty tables give empty tables. The result has fixed columns.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import worker_cache
from threadloom.llm.words import between_spaces, blocks
from threadloom.session import cut_lineage

LENGTH, SPAN, DECAY, WINDOW, LETTERS = 4, 6, 0.6, 32, 48
#: Distances between the letters of a subsequence within SPAN characters.
_STEPS = [x for x in itertools.product(range(1, SPAN), repeat=LENGTH - 1) if sum(x) < SPAN]
_LOOK_ALIKE = str.maketrans("013457@$", "oieastas")
CACHE_ENTRIES = 400_000
#: Weight of the errors of a class against the size of the SVM's weights.
CAPACITY = 20_000.0


@dataclass(frozen=True)
class Model:
    weights: bytes  # of the subsequences that have one: numbers (int32), then weights (float32)
    bias: float
    slope: float
    offset: float


# ---------------------------------------------------------------- the kernel
def fold(word: str) -> str:
    """Lower case; digits and signs that stand for letters as these letters, other signs left out."""
    low = word.lower()
    return low if low.isalpha() else "".join(c for c in low.translate(_LOOK_ALIKE) if c.isalnum())


def windows(word: str) -> list[str]:
    return [word[i : i + WINDOW] for i in range(0, max(len(word) - WINDOW // 2, 1), WINDOW // 2)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence, weight): each subsequence of each folded word once."""
    marked = [f"^{w}$" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    # a to z, the two ends, then everything else by its remainder
    codes = np.select([(points >= 97) & (points <= 122), points == 94, points == 36], [points - 96, 27, 28], 29 + points % (LETTERS - 29))
    owner = np.repeat(np.arange(len(words)), sizes)
    parts = []
    for steps in _STEPS:
        n = len(codes) - sum(steps)
        if n > 0:
            fits = owner[:n] == owner[sum(steps) :]
            code, at = codes[:n], 0
            for step in steps:
                at += step
                code = code * LETTERS + codes[at : n + at]
            parts.append((owner[:n][fits] * LETTERS**LENGTH + code[fits], np.full(int(fits.sum()), DECAY ** (at + 1))))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    both, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    weight = np.bincount(of, np.concatenate([p[1] for p in parts]), len(both))
    return both // LETTERS**LENGTH, both % LETTERS**LENGTH, weight


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of words (rows) and landmarks (columns); a word too short for a subsequence has kernel 0."""
    owner, code, weight = subsequences(landmarks)
    norm = np.sqrt(np.bincount(owner, weight**2, len(landmarks)))
    known, column = np.unique(code, return_inverse=True)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    table[column, owner] = weight / np.maximum(norm, 1e-12)[owner]
    out = np.zeros((len(words), len(landmarks)))
    for a in range(0, len(words), 500):
        part = words[a : a + 500]
        owner, code, weight = subsequences(part)
        norm = np.sqrt(np.bincount(owner, weight**2, len(part)))
        at = np.searchsorted(known, code)
        at[(at == len(known)) | (np.append(known, -1)[at] != code)] = len(known)
        dense = np.zeros((len(part), len(known) + 1), np.float32)
        np.add.at(dense, (owner, at), weight)
        out[a : a + 500] = dense @ table / np.maximum(norm, 1e-12)[:, None]
    return out


# ---------------------------------------------------------------- fitting (driver, bounded input)
def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        gap = 1 - y * (x1 @ w)
        on = gap > 0
        left = ridge + 2 * (x1[on] * cost[on, None]).T @ x1[on]
        new = np.linalg.solve(left, 2 * (x1[on] * cost[on, None]).T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = w + 0.7 * (new - w) if _ > 5 else new
    return w[:-1], float(w[-1])


def _disguised(word: str) -> list[str]:
    """The word with a letter put in, near its middle and in its second half."""
    return [word[:i] + "x" + word[i:] for i in (len(word) // 2, 2 * len(word) // 3)]


def fit_words(bad: list[str], good: list[str], landmarks: int = 320) -> tuple[bytes, float]:
    """Subsequence weights and bias from folded words of both classes."""
    half = landmarks // 2
    marks = list(dict.fromkeys([*bad[:half], *good[:half]]))
    inner = kernel(marks, marks)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    keep = value > 1e-6
    white = vector[:, keep] / np.sqrt(value[keep])
    bad = [*bad, *[v for w in bad if len(w) > 4 for v in _disguised(w)]]
    words = [*bad, *good]
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    cost = np.where(y > 0, 1.0 / max(len(bad), 1), 1.0 / max(len(good), 1)) * CAPACITY
    w, bias = _svm(kernel(words, marks) @ white, y, cost)
    beta = white @ w
    owner, code, weight = subsequences(marks)
    norm = np.sqrt(np.bincount(owner, weight**2, len(marks)))
    codes, of = np.unique(code, return_inverse=True)
    weights = np.bincount(of, weight * (beta / np.maximum(norm, 1e-12))[owner], len(codes))
    return codes.astype("<i4").tobytes() + weights.astype("<f4").tobytes(), bias


def _explaining(pairs: dict[str, set[int]], least: int) -> list[str]:
    """Words in the order in which they explain most documents that are still unexplained."""
    left, out = {w: set(d) for w, d in pairs.items()}, []
    while left:
        word = max(left, key=lambda w: (len(left[w]), len(pairs[w]), w))
        done = left.pop(word)
        if len(done) < least:
            break
        out.append(word)
        left = {w: rest for w, d in left.items() if (rest := d - done)}
    return out


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve, with his smoothed targets."""
    pos, neg = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        left = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-4, 1e-4])
        step = np.linalg.solve(left, x.T @ (target - p) - 1e-4 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


# ---------------------------------------------------------------- inside a task
class Scorer:
    """Margins of texts; remembers words."""

    def __init__(self, weights: bytes, bias: float):
        codes, values = np.frombuffer(weights, "<i4").reshape(2, -1)
        self.table, self.bias, self.known = np.zeros(LETTERS**LENGTH, np.float32), bias, {}
        self.table[codes] = values.view("<f4")

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        new = [w for w in words if w not in self.known]
        fresh = dict(zip(new, self._margins(new).tolist()))
        out = np.array([fresh[w] if w in fresh else self.known[w] for w in words])
        self.known.update((w, m) for w, m in fresh.items() if len(w) <= WINDOW)
        return out

    def _margins(self, words: list[str]) -> np.ndarray:
        parts, owner = [], []
        for i, w in enumerate(words):
            for part in windows(fold(w)):
                parts.append(part)
                owner.append(i)
        out = np.full(len(words), self.bias)
        for a in range(0, len(parts), 10_000):
            part = parts[a : a + 10_000]
            of, code, weight = subsequences(part)
            total = np.bincount(of, weight * self.table[code], len(part))
            norm = np.sqrt(np.bincount(of, weight**2, len(part)))
            np.maximum.at(out, owner[a : a + 10_000], total / np.maximum(norm, 1e-12) + self.bias)
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """The largest margin of a word of each text; the bias where there is none."""
        found = between_spaces(texts)
        margins = self.words(found.distinct)
        single = np.fromiter((len(w) == 1 for w in found.distinct), bool, len(found.distinct))
        out = np.full(len(texts), self.bias)
        spaced, owner = [], []
        for i, index in enumerate(found.rows()):
            if len(index):
                out[i] = margins[index].max()
                alone = single[index]
                if alone.sum() > 2:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], alone, [False]]).astype(np.int8)))
                    for a, b in zip(edge[::2], edge[1::2]):
                        if b - a > 2:
                            spaced.append("".join(found.distinct[k] for k in index[a:b]))
                            owner.append(i)
        if spaced:
            np.maximum.at(out, owner, self._margins(spaced))
        return out


def _scorer(weights: bytes, bias: float) -> Scorer:
    return worker_cache.kept(("scorer", weights, bias), lambda: Scorer(weights, bias))


def margin_column(text: Column | str, weights: bytes, bias: float) -> Column:
    @F.arrow_udf("double")
    def margin(texts: pa.Array) -> pa.Array:
        scorer = _scorer(weights, bias)
        return pa.array(np.concatenate([scorer.texts(b) for b in blocks(texts, 4_000_000)] or [np.zeros(0)]))

    return margin.asNondeterministic()(text)


def word_margin_column(word: Column | str, weights: bytes, bias: float) -> Column:
    @F.arrow_udf("double")
    def margin(words: pa.Array) -> pa.Array:
        return pa.array(_scorer(weights, bias).words([w or "" for w in words.to_pylist()]))

    return margin(word)


def held_out(doc_id: Column) -> Column:
    """A fifth of all ids, never trained on."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


# ---------------------------------------------------------------- operators
def fit(
    docs: DataFrame, labels: DataFrame, train_documents: int = 20_000, train_words: int = 4_000, least_documents: int = 3, hard_rounds: int = 2,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model | None:
    """Model from the labelled documents that are not held out; None without both classes.

    What reaches the driver is bounded: ``train_words`` words of a kind, words of at most ``train_documents`` toxic
    documents that survive the first count, and one margin for each document trained on.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).alias("__toxic"))
    known = known.where(~held_out(F.col("__id")))
    share = min(1.0, train_documents / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")
    follows = lambda ws: F.zip_with(ws, F.concat(F.array(F.lit("")), F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))), lambda w, p: F.struct(w.alias("w"), F.xxhash64(p).alias("p")))
    words = F.filter(F.split(F.lower("__text"), r"[\x20\x09-\x0D.,;:!?]+"), lambda w: F.length(w) > 2)
    pairs = rows.where("__text is not null").select("__id", "__toxic", F.explode(F.array_distinct(follows(words))).alias("x")).select("__id", "__toxic", "x.*")
    seen = pairs.groupBy("w", "p").agg(F.max("__toxic").alias("t"), F.max(1 - F.col("__toxic")).alias("c"))
    counts = cut_lineage(seen.groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    total = counts.agg(F.count("*").alias("n"), (F.sum("t") / F.sum(F.col("t") + F.col("c"))).alias("rate")).first()
    if not total["n"] or not 0 < total["rate"] < 1:
        return None
    # so often that chance would not do it to one word in twenty corpora
    surely = max(least_documents, math.ceil(math.log(0.05 / total["n"]) / math.log(total["rate"])))
    suspects = counts.where((F.col("t") >= least_documents) & (F.col("c") * 20 <= F.col("t"))).orderBy(F.desc("t"), "w").limit(train_words)
    sure = {fold(r["w"]) for r in suspects.where(F.col("t") >= surely).collect()}
    found: dict[str, set[int]] = {}
    for w, i in pairs.where("__toxic = 1").join(F.broadcast(suspects), "w").select("w", "__id").distinct().toLocalIterator():
        found.setdefault(fold(w), set()).add(i)
    explained = set().union(*(found.get(w, ()) for w in sure))
    rest = {w: d - explained for w, d in found.items() if w not in sure}
    bad = [w for w in [*sorted(sure, key=lambda w: (-len(found.get(w, ())), w)), *_explaining(rest, least_documents)] if len(w) > 2]
    taken = set(bad)
    clean = counts.where("c > 0 and t <= c").select("w", "c")
    common = [fold(r["w"]) for r in clean.orderBy(F.desc("c"), "w").limit(train_words // 4).collect()]
    drawn = [fold(r["w"]) for r in clean.orderBy(F.xxhash64("w"), "w").limit(train_words).collect()]
    good = [w for w in dict.fromkeys([*drawn, *common]) if len(w) > 2 and w not in taken]
    if not bad or not good:
        return None
    for _ in range(hard_rounds):
        weights, bias = fit_words(bad, good)
        worst = clean.withColumn("m", word_margin_column("w", weights, bias)).orderBy(F.desc("m"), "w").limit(train_words // 4).collect()
        good = list(dict.fromkeys([*[w for r in worst if len(w := fold(r["w"])) > 2 and w not in taken], *good]))
    weights, bias = fit_words(bad, good)
    worst = rows.select("__toxic", margin_column("__text", weights, bias).alias("m")).collect()
    margin, toxic = np.array([r["m"] for r in worst]), np.array([r["__toxic"] for r in worst], float)
    slope, offset = _logistic(margin, toxic)
    # where no document lies between the classes, the border stays near the SVM's own, for words not seen before
    border = -offset / slope if slope > 0 else 0.0
    below = margin[(toxic == 0) & (margin < border)]
    border = min(border, max(0.25, (below.max() + border) / 2)) if len(below) else border
    return Model(weights, bias, slope, -slope * border)


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted``; columns of these names are replaced."""
    if model is None:
        return df.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    margin = margin_column(F.col(text), model.weights, model.bias)
    out = df.withColumn("score", 1 / (1 + F.exp(-(margin * model.slope + model.offset))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
