"""Toxicity by weak supervision.

Voters are many small lexicons and some patterns. Lexicons are a short seed
list, and units (whole words and word beginnings, so that inflected or
compounded insults of any language count) mined from labelled rows in one half
and confirmed in the other, dealt into parts by a hash so that no voter is all
of them; patterns look at how many, how various and how dense hits are and at
shouting. A generative label model explains the votes alone: given the label,
voters form a tree in which each depends on the one it is most correlated
with, and expectation maximisation estimates their accuracies and those
dependences together. A linear classifier over hashed words and hit counts is
trained on the posterior labels, and its scale set on the labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists
from .sampling import draw, smallest
from .shared import Stored, beside, scratch

#: Labelled rows a class that voters and classifier are fitted on.
ROWS = 1_500
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6, 8)
#: Precision on toxic rows, in their share of the corpus, that tells a strong from a weak lexicon.
STRONG, WEAK = 0.95, 0.8
#: Chunks whose hits a process keeps.
KEPT = 120_000
#: Ridge of a hashed word's weight.
RIDGE = 20.0
WORD = re.compile(r"[^\W\d_]+")

#: A seed lexicon of English insults.
SEEDS = frozenset(["idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown"])

#: Lexicons that the units of each kind are dealt into.
PARTS = 4
KINDS = ("strong word", "weak word", "strong beginning", "weak beginning")
LEXICONS = ("seed", *(f"{kind} {k}" for kind in KINDS for k in range(PARTS)))
#: Bits of a hashed word, and of a chunk's number that tell lexicons.
CELLS, TELLS = 10, 32


def lexical(text: str) -> set[str]:
    """Words, and beginnings of longer words marked by a hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


class Lexicons:
    """Which of ``LEXICONS`` a chunk of text has words in, as bits, and above ``TELLS`` of those a hash of the chunk's words."""

    def __init__(self, strong: set[str] = frozenset(), weak: set[str] = frozenset()):
        self.strong, self.weak = frozenset(strong), frozenset(weak - strong)
        of = lambda unit, kind: 1 << 1 + kind * PARTS + zlib.crc32(unit.encode()) % PARTS
        self.word = {u: of(u, 0) for u in self.strong if not u.endswith("-")} | {u: of(u, 1) for u in self.weak if not u.endswith("-")}
        self.beginning = {u[:-1]: of(u, 2) for u in self.strong if u.endswith("-")} | {u[:-1]: of(u, 3) for u in self.weak if u.endswith("-")}

    def bits(self, chunk: str) -> int:
        out, words = 0, WORD.findall(chunk.lower())
        for w in words:
            out |= (w in SEEDS) | self.word.get(w, 0)
            for n in BEGINNINGS:
                if len(w) > n:
                    out |= self.beginning.get(w[:n], 0)
        return out | zlib.crc32(" ".join(words).encode()) % (1 << CELLS) << TELLS


class Hits(dict):
    def __init__(self, lexicons: Lexicons):
        super().__init__()
        self.lexicons = lexicons

    def __missing__(self, chunk: str) -> int:
        self[chunk] = bits = self.lexicons.bits(chunk)
        return bits

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with words of each lexicon and of any, chunks at all, exclamation runs, share of capitals; and the cells of the chunks' words."""
        if len(self) > KEPT:
            self.clear()
        chunks = text.split()
        all_ = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        found = all_[all_ & ((1 << TELLS) - 1) > 0]
        capitals = sum(map(str.isupper, chunks)) if text.isupper() or len(found) else 0
        counts = (found[:, None] >> np.arange(len(LEXICONS)) & 1).sum(axis=0) if len(found) else np.zeros(len(LEXICONS))
        return np.array([*counts, len(found), len(chunks), text.count("!!"), capitals / max(1, len(chunks))], float), all_ >> TELLS


def votes(x: np.ndarray) -> np.ndarray:
    """Voters, a column each, 1 where they fire: the lexicons, then patterns."""
    n = len(LEXICONS)
    some, words, kinds = x[:, n], np.maximum(x[:, n + 1], 1), (x[:, :n] > 0).sum(axis=1)
    patterns = [some >= 2, some >= 3, kinds >= 2, kinds >= 4, some / words > 0.02, some / words > 0.1, (some >= 1) & (x[:, n + 2] > 0), (some >= 1) & (x[:, n + 3] > 0.3)]
    return np.c_[x[:, :n] > 0, np.array(patterns).T].astype(float)


def counts_of(x: np.ndarray) -> np.ndarray:
    n = len(LEXICONS)
    words = np.maximum(x[:, n + 1 : n + 2], 1)
    return np.c_[np.log1p(x[:, : n + 1]), np.minimum(x[:, n : n + 1], 3), np.minimum(x[:, n : n + 1] / words * 20, 3), np.minimum(np.log1p(words), 10) / 10]


def features(x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    """Hit counts and hashed words of texts; what a linear classifier can read without the label model."""
    bag = np.array([np.bincount(c, minlength=1 << CELLS) / max(1.0, len(c)) ** 0.5 for c in cells]).reshape(len(cells), 1 << CELLS)
    return np.c_[counts_of(x), bag]


def mine(rows: list[tuple[str, int]], odds: float) -> Lexicons:
    """Units whose presence means toxic, found in each half of the rows and confirmed in the other.

    ``odds``: how many clean rows of the corpus one clean row of the sample
    stands for, against toxic ones.
    """
    halves = [(Counter(), Counter()), (Counter(), Counter())]
    for k, (text, label) in enumerate(dict.fromkeys(rows)):  # copies count once
        halves[k % 2][label].update(lexical(text))

    def passing(half, least: float, rows: int) -> set[str]:
        clean, toxic = half
        return {u for u, n in toxic.items() if n >= rows and n / (n + (clean[u] + 0.5) * odds) >= least}

    confirm = [{u: 1 for u in passing(h, 0.6, 2)} for h in halves]
    strong = (passing(halves[0], STRONG, 3) & confirm[1].keys()) | (passing(halves[1], STRONG, 3) & confirm[0].keys())
    weak = (passing(halves[0], WEAK, 3) & confirm[1].keys()) | (passing(halves[1], WEAK, 3) & confirm[0].keys())
    return Lexicons(strong, weak)


class LabelModel:
    """Votes given the label as a tree of dependent voters; fitted to votes alone, by expectation maximisation.

    ``table[y, i, u, v]`` is the chance that voter i says v where its parent
    says u (either where it has none); ``toxic`` and ``clean`` are the rates at
    which voters fire, ``correlation`` what remains between them given the label.
    """

    def __init__(self, v: np.ndarray, prior: float, rounds: int = 30):
        n = v.shape[1]
        self.prior, self.parent = prior, np.full(n, -1)
        fires = v.any(axis=0)
        # to begin with a voter that fires says toxic, one that never does says nothing
        rates = np.where(fires, [[0.05], [0.3]], 0.05)
        self.table = np.stack([1 - rates, rates], axis=-1)[:, :, None, :].repeat(2, axis=2)
        for k in range(rounds):
            p = self.posterior(v)
            self.prior = float(np.clip(p.mean(), 0.01, 0.9))
            both = np.stack([1 - p, p])
            ones = both @ v
            pair = np.einsum("yr,ri,rj->yij", both, v, v)  # rows of label y in which i and j fire
            total = both.sum(axis=1)
            if k:  # voters first for themselves
                self.parent = self.tree(pair, ones, total)
            self.table = self.tables(pair, ones, total)
            self.table[:, ~fires] = 0.5
            self.clean, self.toxic = (ones + [[0.1], [1.0]]) / (total[:, None] + 2)
        rest = v - np.outer(p, self.toxic) - np.outer(1 - p, self.clean)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        self.correlation = np.clip(rest.T @ rest / len(v) / np.outer(spread, spread), -1, 1)

    @staticmethod
    def joint(pair: np.ndarray, ones: np.ndarray, total: np.ndarray) -> np.ndarray:
        """[y, i, j, a, b]: smoothed share of rows of label y in which i says a and j says b."""
        i, j, t = ones[:, :, None], ones[:, None, :], total[:, None, None]
        each = np.stack([np.stack([t - i - j + pair, j - pair], axis=-1), np.stack([i - pair, pair], axis=-1)], axis=-2) + 0.25
        return each / each.sum(axis=(-1, -2), keepdims=True)

    def tree(self, pair: np.ndarray, ones: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Parents in the tree of largest mutual information given the label; what shares next to none stays for itself."""
        q = self.joint(pair, ones, total)
        info = (q * np.log(q / (q.sum(axis=-1, keepdims=True) * q.sum(axis=-2, keepdims=True)))).sum(axis=(-1, -2))
        info = np.tensordot(total / total.sum(), info, 1)
        n = len(info)
        parent, best, of, out = np.full(n, -1), np.full(n, -1.0), np.full(n, -1), np.zeros(n, bool)
        for _ in range(n):
            k = int(np.where(out, -np.inf, best).argmax())
            out[k], parent[k] = True, of[k] if best[k] > 1e-3 else -1
            nearer = ~out & (info[k] > best)
            best[nearer], of[nearer] = info[k][nearer], k
        return parent

    def tables(self, pair: np.ndarray, ones: np.ndarray, total: np.ndarray) -> np.ndarray:
        q = self.joint(pair, ones, total)
        rate = (ones + [[0.1], [1.0]]) / (total[:, None] + 2)
        out = np.stack([1 - rate, rate], axis=-1)[:, :, None, :].repeat(2, axis=2)
        some = np.flatnonzero(self.parent >= 0)
        given = q[:, self.parent[some], some]  # what the parent says, then the voter
        out[:, some] = given / given.sum(axis=-1, keepdims=True)
        return np.clip(out, 1e-3, 1)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        said = v.astype(int)
        above = np.where(self.parent >= 0, said[:, self.parent], 0)
        voter = np.arange(v.shape[1])
        odds = (np.log(self.table[1, voter, above, said]) - np.log(self.table[0, voter, above, said])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds + np.log(self.prior / (1 - self.prior)), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the constant last, for labels between 0 and 1, by Newton steps; ``ridge`` of all or of each weight."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.broadcast_to(ridge, x.shape[1] - 1), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Toxicity:
    """Fitted on (text, 0 or 1) rows and on how many rows of each there are."""

    def __init__(self, rows: list[tuple[str, int]], there: dict[int, int] | None = None):
        taken = Counter(y for _, y in rows)
        there = there or taken
        odds = (there.get(0, 0) / max(1, taken[0])) / max(1e-9, there.get(1, 0) / max(1, taken[1])) if taken[1] else 1.0
        self.lexicons = mine(rows, max(odds, 1e-3)) if rows else Lexicons()
        self.label_model = None
        self.share = there.get(1, 0) / max(1, there.get(0, 0) + there.get(1, 0))
        self.weights, self.scale = None, np.array([1.0, 0.0])
        if taken[0] and taken[1]:
            hits = Hits(self.lexicons)
            x, cells = zip(*[hits.of(t) for t, _ in rows])
            x, y = np.array(x), np.array([c for _, c in rows], float)
            self.label_model = LabelModel(votes(x), prior=y.mean())
            soft = self.label_model.posterior(votes(x))
            read = features(x, cells)
            self.weights = logistic(read, soft, np.r_[np.ones(read.shape[1] - (1 << CELLS)), np.full(1 << CELLS, RIDGE)])
            margin = np.c_[read, np.ones(len(x))] @ self.weights
            self.scale = logistic(margin[:, None], y)
            if self.scale[0] <= 0:
                self.scale = np.array([1.0, 0.0])

    def scores(self, texts: list[str], hits: Hits) -> np.ndarray:
        few = len(LEXICONS) + 4  # features before the hashed words
        x, words = np.zeros((len(texts), len(LEXICONS) + 4)), np.zeros(len(texts))
        bag = np.zeros(1 << CELLS) if self.weights is None else self.weights[few:-1]
        for k, text in enumerate(texts):
            x[k], cells = hits.of(text)
            words[k] = bag[cells].sum() / max(1.0, len(cells)) ** 0.5
        if self.weights is None:  # no labels of both kinds to learn from: their share is all that is known
            return np.full(len(texts), self.share)
        margin = counts_of(x) @ self.weights[:few] + words + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin * self.scale[0] + self.scale[1], -30, 30)))


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS) -> Toxicity:
    """A classifier fitted on at most ``rows`` labelled rows a class that are not held out."""
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & ~held_out(id_col))
    known = known.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("class"))
    texts = docs.select(F.col(f"`{id_col}`").alias("__doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    with scratch():
        drawn, counts, most = draw(known, rows, F.col("__id").cast("string"))
        there = {r["class"]: r["count"] for r in counts.collect()}  # of two classes
        drawn = beside(Stored(drawn.select("__id", "class", "h").distinct(), "labelled").df)  # small, so that no text is shuffled
        found = smallest(texts.join(drawn, F.col("__doc") == F.col("__id")), most)
    return Toxicity(found, there)


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Null text is empty text, scored like any other. Null ids count as empty for
    held_out. Repeated rows give repeated rows; other columns are not read; an
    empty table gives an empty result. Without labels of both classes every
    score is the share of toxic ones among them, 0 without any.
    """

    def make():
        hits = Hits(model.lexicons)

        def step(ids, held, texts):
            found = model.scores([t or "" for t in texts], hits)
            return ids, held, found, (found >= 0.5).astype(np.int32)

        return step

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return map_lists(rows, make, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are."""
    at = docs.columns.index(text_col)

    def make():
        hits = Hits(model.lexicons)

        def step(*columns):
            stays = (model.scores([t or "" for t in columns[at]], hits) < 0.5).nonzero()[0]
            return tuple([c[k] for k in stays] for c in columns)

        return step

    return map_lists(docs, make, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes))
