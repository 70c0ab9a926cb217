"""Quality by positive-unlabelled learning: trusted positives, unlabelled web text and an estimated class prior.

Texts are read into numbers once: shares of neighbouring byte classes, and
statistics of words and lines. A linear model f is fitted by Newton steps on
the non-negative unbiased risk with the logistic loss,

    prior * mean over trusted of loss(f) + max(0, mean over all of loss(-f) - prior * mean over trusted of loss(-f)),

whose second term estimates the risk on the bad texts, though none is known. A
step that makes that estimate negative has begun to fit the sample and is
halved until it no longer does. Each step is one pass over the numbers of all
documents; only sums of a fixed size reach the driver.

The prior is the largest share of the corpus that can be like the trusted
texts: with a first model, the smallest ratio of the shares of all and of
trusted texts that score above a threshold, thresholds of few texts paying for
their uncertainty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import array_sum, map_lists
from .shared import Stored, beside, result, scratch
from .toxicity import held_out

#: Classes of bytes: others, blanks, line ends, small and capital letters, digits, what ends sentences, other marks of prose, symbols, beyond ASCII.
KINDS = 10
KIND = np.zeros(256, np.uint8)
for k, members in enumerate([b" \t", b"\n", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b".!?", b",;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))], 1):
    KIND[list(members)] = k
#: Numbers that a text is read into.
FEATURES = KINDS * KINDS + 12
#: Ridge of a weight of standardised numbers, over the number of rows; Newton steps at most; bins of the scores that tell the prior.
RIDGE, STEPS, BINS = 40.0, 12, 512
#: The prior before one is estimated.
GUESS = 0.5


def read(text: str) -> np.ndarray:
    """The numbers of a whole text."""
    raw = text.encode()
    kinds = KIND[np.frombuffer(raw, np.uint8)].astype(np.int64)
    pairs = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) if len(kinds) > 1 else np.zeros(KINDS * KINDS)
    words, lines = text.split(), text.split("\n")
    n = len(words)
    often = Counter(words)
    there = max(n, 1)
    last = words[0] if words else ""
    longest = run = 0
    repeats = sum(map(eq, words, words[1:]))
    if repeats:
        for w in words:
            run = run + 1 if w == last else 1
            last, longest = w, max(longest, run)
    stats = [
        np.log1p(n) / 10,
        min(len(text) / there, 50) / 10,
        np.log1p(len(often)) / np.log1p(there),
        len(often) / there,
        repeats / there,
        longest / there,
        max(often.values(), default=0) / there,
        sum(map(str.isupper, words)) / there,
        sum(map(str.isalpha, words)) / there,
        np.log1p(len(text) / len(lines)) / 10,
        len(set(lines)) / len(lines),
        min(len(zlib.compress(raw, 1)) / max(len(raw), 1), 2.0),
    ]
    return np.r_[np.sqrt(pairs / max(len(kinds) - 1, 1)), stats].astype(np.float32)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, x: the numbers of each text as float32 in bytes. Null text is empty text."""

    def make():
        return lambda ids, held, texts: (ids, held, [read(t or "").tobytes() for t in texts])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return map_lists(rows, make, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, x binary")


def matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), FEATURES).astype(float)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Quality:
    """Weights over standardised numbers, the constant last; without trusted texts all scores are 0.5."""

    def __init__(self):
        self.mean, self.spread = np.zeros(FEATURES), np.ones(FEATURES)
        self.weights, self.prior = np.zeros(FEATURES + 1), None

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.clip((x - self.mean) / self.spread, -8, 8), np.ones(len(x))]

    def margin(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.standardised(x) @ (self.weights if weights is None else weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def risk_terms(x: np.ndarray, weights: np.ndarray, trusted: bool) -> np.ndarray:
    """Sums over rows: how many, loss(f), loss(-f), slope of f's part of the risk, and over all texts its curvature."""
    f = x @ weights
    p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    head = [len(x), softplus(-f).sum(), softplus(f).sum()]
    if trusted:
        return np.r_[head, x.sum(axis=0)]
    return np.r_[head, p @ x, (x.T @ (x * (p * (1 - p))[:, None])).ravel()]


def unbiased_risk(all_: np.ndarray, trusted: np.ndarray, weights: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The risk with its ridge, slope and curvature, and the part of it that should not be negative, from sums of ``risk_terms``."""
    d, n, k = FEATURES + 1, all_[0], trusted[0]
    penalty = np.r_[np.full(FEATURES, RIDGE / n), 1e-6]
    bad = all_[2] / n - prior * trusted[2] / k
    risk = prior * trusted[1] / k + bad + 0.5 * penalty @ weights**2
    slope = all_[3 : 3 + d] / n - prior * trusted[3:] / k + penalty * weights
    return risk, slope, all_[3 + d :].reshape(d, d) / n + np.diag(penalty), bad


def prior_of(all_: np.ndarray, trusted: np.ndarray) -> float:
    """The share of trusted kind among all texts, from how many of each score in each bin."""
    above = lambda counts: counts[::-1].cumsum()[::-1]
    n, k = all_.sum(), trusted.sum()
    u, p = above(all_) / n, above(trusted) / k
    doubt = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n) + 1 / np.sqrt(k))
    some = p > 0
    best = np.argmin((u[some] + doubt) / p[some])
    return float(np.clip(u[some][best] / p[some][best], 0.05, 0.99))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Quality:
    """A model of ``rows`` (as ``features`` gives them, stored) and of the labelled ones that are good and not held out.

    Labels of bad texts are not read. An id that repeats counts with each of its rows.
    """
    good = labels.where((F.col(f"`{label_col}`") == 1) & ~held_out(id_col)).select(F.col(f"`{id_col}`").alias("good")).distinct()
    good = beside(Stored(good, "good").df)
    trusted = Stored(rows.join(good, F.col("doc_id") == F.col("good"), "left_semi").select("x"), "trusted").df
    both = rows.select("x", F.lit(0).alias("trusted")).union(trusted.select("x", F.lit(1)))
    model, d = Quality(), FEATURES + 1

    def sums(of, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``of(numbers, whether they are of trusted texts)`` summed over all, and over trusted texts."""

        def make():
            def step(xs, flags):
                out = np.zeros((2, width))
                for k in (0, 1):
                    mine = [x for x, flag in zip(xs, flags) if flag == k]
                    if mine:
                        found = of(matrix(mine), k == 1)
                        out[k, : len(found)] = found
                return out.ravel()

            return step

        return tuple(array_sum(both, make, 2 * width).reshape(2, width))

    (moments, some) = sums(lambda x, _: np.r_[len(x), x.sum(axis=0), (x**2).sum(axis=0)], 1 + 2 * FEATURES)
    if not some[0]:
        return model
    model.mean = moments[1 : 1 + FEATURES] / moments[0]
    model.spread = np.sqrt(np.maximum(moments[1 + FEATURES :] / moments[0] - model.mean**2, 1e-8)) + 1e-3

    def newton(prior: float, steps: int) -> None:
        at, step, before = model.weights, None, np.inf
        for _ in range(steps):
            read_at = at if step is None else at + step
            all_, mine = sums(lambda x, is_trusted: risk_terms(model.standardised(x), read_at, is_trusted), 3 + d + d * d)
            risk, slope, curve, bad = unbiased_risk(all_, mine[: 3 + d], read_at, prior)
            if step is not None and (bad < 0 or risk > before + 1e-9):
                step = step / 2
                continue
            small = before - risk < 1e-5
            at, before = read_at, risk
            if small:
                break
            step = -np.linalg.solve(curve, slope)
            most = np.abs(step).max()
            step = step / max(1.0, most / 2)
        model.weights = at

    newton(GUESS, STEPS // 2)
    bins = lambda x, _: np.bincount((model.scores(x) * (BINS - 1e-6)).astype(int), minlength=BINS)
    model.prior = prior_of(*sums(bins, BINS))
    newton(model.prior, STEPS)
    return model


def score(rows: DataFrame, model: Quality, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of ``rows`` as ``features`` gives them."""

    def make():
        def step(ids, held, xs):
            found = model.scores(matrix(xs))
            return ids, held, found, (found >= threshold).astype(np.int32)

        return step

    return map_lists(rows, make, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, by a model fitted on all of ``docs`` and the good ones in ``labels``.

    Null text is empty text, scored like any other. Null ids count as empty for
    held_out and are never trusted. Repeated rows give repeated rows; other
    columns are not read; an empty table gives an empty result. Without trusted
    texts every score is 0.5.
    """
    with scratch():
        rows = Stored(features(docs, id_col, text_col), "features").df
        return result(score(rows, fit(rows, labels, id_col, label_col), threshold), "quality")
