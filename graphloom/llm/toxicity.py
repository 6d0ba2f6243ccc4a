"""Toxicity by a linear-chain conditional random field over words.

Tokens have two states. Only features that toxic documents favour carry weight, so most tokens of a text are background
and share one transfer matrix; forward-backward steps from one active token to the next through that matrix's power,
which gives the exact marginals at a cost that follows the active tokens. Marginals become document scores through a
logistic map fitted on documents that the field was not fitted on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")
PREFIXES = range(3, 8)


def features(word: str) -> list[str]:
    """The word itself and its prefixes."""
    w = word.lower()
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) >= k)]


@dataclass
class Field:
    """Weights of features (toxic against clean), the bias, log transitions and the logistic map over a document."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    stay: float = 0.2
    enter: float = 0.002
    map: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


class Chain:
    """Marginals of a field over sequences given as active tokens ``(place, emission)`` and a length."""

    def __init__(self, f: Field):
        b = exp(f.bias)
        self.bias = b
        self.move = ((1 - f.enter, f.enter), (1 - f.stay, f.stay))  # from clean, from toxic
        (cc, ct), (tc, tt) = self.move
        self.step = np.array([[cc, ct * b], [tc, tt * b]])

        @lru_cache(4096)
        def power(n: int) -> tuple[float, float, float, float]:
            m = np.linalg.matrix_power(self.step, n) if n < 256 else np.linalg.matrix_power(self.step, 256)
            m = m / m.max()
            return float(m[0, 0]), float(m[0, 1]), float(m[1, 0]), float(m[1, 1])

        self.power = power

    def marginals(self, active: list[tuple[int, float]], length: int) -> list[float]:
        """Probability of the toxic state at each active token, by scaled forward and backward passes.

        Powers beyond 256 background tokens equal the 256th up to scale: the matrix forgets far faster than that.
        """
        (cc, ct), (tc, tt) = self.move
        ahead, c, t, at = [], 1.0, 0.0, -1  # before the first token: clean
        for place, weight in active:
            a, b, d, e = self.power(place - at - 1)
            c, t = c * a + t * d, c * b + t * e
            g = exp(min(50.0, weight)) * self.bias
            c, t = c * cc + t * tc, (c * ct + t * tt) * g
            s = c + t
            c, t = c / s, t / s
            ahead.append((c, t))
            at = place
        out = [0.0] * len(active)
        c, t, at = 1.0, 1.0, length
        for k in range(len(active) - 1, -1, -1):
            place, weight = active[k]
            a, b, d, e = self.power(at - place - 1)
            c, t = a * c + b * t, d * c + e * t
            fc, ft = ahead[k]
            out[k] = ft * t / (fc * c + ft * t)
            g = exp(min(50.0, weight)) * self.bias
            c, t = cc * c + ct * g * t, tc * c + tt * g * t
            s = c + t
            c, t, at = c / s, t / s, place
        return out


def _sequence(words: list[str], emit) -> list[tuple[int, float]]:
    return [(k, e) for k, e in ((k, emit(w)) for k, w in enumerate(words)) if e]


def document_features(marginals: list[float], n_words: int) -> tuple[float, ...]:
    total = sum(marginals)
    return (1.0, log1p(total), max(marginals, default=0.0), log1p(100 * total / (n_words + 20)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def train(sample: Iterable[tuple[str, int]], least: int = 3, floor: float = 2.0, sure: float = 4.5, rounds: int = 12, rate: float = 0.5, ridge: float = 0.01) -> Field:
    """Fit a field on documents with labels 0 or 1; two thirds of them fit the field, the rest the logistic map.

    Tokens are labelled from their documents: a token of a toxic document is toxic if one of its features has document
    log-odds of at least ``sure``. Features with log-odds of at least ``floor`` in at least ``least`` toxic documents get
    a weight, raised along the gradient of the conditional likelihood (observed minus expected counts); transitions are
    the labelled tokens' counts. A sample without both labels gives a field that scores every document alike.
    """
    parts: tuple[list, list] = ([], [])
    toxic, clean, n = Counter(), Counter(), [0, 0]
    for k, (text, label) in enumerate(sample):
        words = _WORD.findall(text or "")
        fit = k % 3 != 2
        parts[not fit].append((words, int(label)))
        if fit:
            n[int(label)] += 1
            seen = {x for w in set(words) for x in features(w)}
            (toxic if label else clean).update(seen)
    if not n[0] or not n[1]:
        return Field(map=(log((n[1] + 0.5) / (n[0] + 0.5)), 0.0, 0.0, 0.0))
    odds = {f: log((c + 0.5) / (n[1] + 1)) - log((clean[f] + 0.5) / (n[0] + 1)) for f, c in toxic.items() if c >= least}
    odds = {f: o for f, o in odds.items() if o >= floor}
    tagged, runs, tokens, total = [], 0, 0, 0
    known: dict[str, tuple[str, ...]] = {}
    for words, label in parts[0]:
        total += len(words)
        spots = []
        last = -2
        for k, w in enumerate(words):
            fs = known.get(w)
            if fs is None:
                fs = known[w] = tuple(f for f in features(w) if f in odds)
            if fs:
                hot = bool(label) and max(odds[f] for f in fs) >= sure
                spots.append((k, fs, hot))
                if hot:
                    tokens += 1
                    runs += last == k - 1
                    last = k
        if spots:
            tagged.append((len(words), spots))
    out = Field(
        weights={f: 0.5 * o for f, o in odds.items()}, bias=-1.0, stay=min(0.9, (runs + 0.5) / (tokens + 1)), enter=min(0.5, max(1e-6, (tokens - runs + 0.5) / (total - tokens + 1)))
    )
    scale: Counter = Counter()
    for _ in range(rounds):
        chain, slope = Chain(out), Counter()
        for length, spots in tagged:
            active = [(k, sum(out.weights[f] for f in fs)) for k, fs, _ in spots]
            for (_, fs, hot), p in zip(spots, chain.marginals(active, length), strict=True):
                for f in fs:
                    slope[f] += hot - p
        for f, g in slope.items():
            g -= ridge * out.weights[f]
            scale[f] += g * g
            out.weights[f] += rate * g / (scale[f] ** 0.5 + 1e-6)
    out.weights = {f: w for f, w in out.weights.items() if abs(w) > 1e-3}
    chain = Chain(out)
    rest = parts[1] if len({label for _, label in parts[1]}) == 2 else parts[0]
    x = np.array([document_features(chain.marginals(_sequence(ws, out.emission), len(ws)), len(ws)) for ws, _ in rest])
    y = np.array([label for _, label in rest], float)
    out.map = tuple(_logistic(x, y).tolist())
    return out


class Scorer:
    def __init__(self, model: Field, most: int = 600_000):
        self.model, self.chain, self.most = model, Chain(model), most
        self.memo: dict[str, float] = {}

    def _emit(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            found = self.memo[word] = self.model.emission(word)
        return found

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score and the offending words: begin, end (characters) and marginal of at least one half."""
        words = _WORD.findall(text or "")
        emit = self._emit
        active = _sequence(words, emit)
        p = self.chain.marginals(active, len(words))
        z = sum(a * b for a, b in zip(self.model.map, document_features(p, len(words)), strict=True))
        spans = []
        if p and max(p) >= 0.5:
            hot = {k: q for (k, _), q in zip(active, p, strict=True) if q >= 0.5}
            spans = [(m.start(), m.end(), hot[k]) for k, m in enumerate(_WORD.finditer(text)) if k in hot]
        return 1 / (1 + exp(-max(-30.0, min(30.0, z)))), spans


def fold(id_col: str | Column, folds: int = 5) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % folds


def training_sample(docs: DataFrame, labels: DataFrame, most_rows: int = 9000, most_chars: int = 40_000_000) -> list[tuple[str, int]]:
    """At most ``most_rows`` labelled documents outside fold 0, in hash order, until ``most_chars`` characters are read.

    Both bounds are there for the fit alone; scoring covers all rows.
    """
    chosen = labels.where((fold("doc_id") != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "toxic").limit(most_rows)
    both = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most most_rows rows
    out, used = [], 0
    for row in both.select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "text").toLocalIterator():
        out.append((row["text"] or "", row["toxic"]))
        used += len(out[-1][0])
        if used >= most_chars:
            break
    return out


SCORES = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<begin:long,end:long,p:double>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    + [("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))]
)


def score_documents(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every row's whole text with a fitted field: ``doc_id, held_out, score, predicted, spans``.

    Null and empty texts get the score of a document without active tokens; null ids pass through; repeated rows score
    alike; an empty table gives an empty result. No shuffle.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            rows = []
            for doc_id, held, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                score, spans = scorer.score(text)
                rows.append(
                    {"doc_id": doc_id, "held_out": held, "score": score, "predicted": int(score >= 0.5), "spans": [{"begin": b, "end": e, "p": p} for b, e, p in spans]}
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(each, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on a bounded labelled sample outside fold 0, then score all documents."""
    return score_documents(docs, train(training_sample(docs, labels)))
