"""Language identification by interpolated Kneser-Ney character models.

Words are framed by a mark, so a word's cost under a language does not depend
on its neighbours and is computed once a process. The n-grams of all languages
are hashes in one sorted array; beside it stand, a column a language, the
discounted probability of an n-gram's last character and the weight that the
n-gram gives, as a context, to the next shorter one.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists
from .sampling import draw, smallest
from .shared import scratch

ORDER = 4
#: Labelled rows a language that a model is fitted on.
ROWS = 400
#: Words whose costs a process keeps.
KEPT = 200_000
MARK = "\x02"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Share of rows of a language that its rejection limit accepts.
ACCEPTED = 0.995


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the 1..order-grams that end at each character of the framed words, 0 where a word has not begun;
    place of each character in its word; number of the word."""
    framed = [MARK + w + MARK for w in words]
    sizes = np.fromiter(map(len, framed), np.int64, len(framed))
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(framed)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, before = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            h = (before * np.uint64(0x100000001B3) + codes + np.uint64(n << 40)) * MIX
            h = np.where(place >= n - 1, h ^ (h >> np.uint64(29)) | np.uint64(1), np.uint64(0))
            out.append(h)
            before = np.r_[np.uint64(0), h[:-1]]
    return out, place, word


class KneserNey:
    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.order, self.langs = order, sorted(texts)
        per = [self.fit(texts[lang]) for lang in self.langs]
        self.key = np.unique(np.concatenate([p[0] for p in per])) if per else np.zeros(0, np.uint64)
        self.prob = np.zeros((len(self.key) + 1, len(per)), np.float32)
        self.back = np.ones((len(self.key) + 1, len(per)), np.float32)
        for k, (key, prob, back) in enumerate(per):
            at = np.searchsorted(self.key, key)
            self.prob[at, k], self.back[at, k] = prob, back
        self.limit = np.full(len(per), np.inf)
        self.sharp = 8.0

    def fit(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted n-gram hashes of one language, their probabilities and their weights as contexts."""
        words, weight = np.unique(np.array(list(chain.from_iterable(t.lower().split() for t in texts)) or [""]), return_counts=True)
        hashes, place, word = grams(words.tolist(), self.order)
        keys, probs, backs = [], [], []
        top = None
        for n in range(self.order, 0, -1):
            ok = (place >= max(1, n - 1)) & (hashes[n - 1] > 0)  # a frame's first mark is only context
            gram, context = hashes[n - 1][ok], (np.r_[np.uint64(0), hashes[n - 2][:-1]][ok] if n > 1 else np.zeros(ok.sum(), np.uint64))
            if n == self.order or top is None:
                count = weight[word[ok]].astype(float)
            else:  # kinds of longer n-grams that end like this one; those at a word's begin count as they are
                longer = np.r_[hashes[n]][ok]
                count = np.where(longer == 0, weight[word[ok]], 0).astype(float)
                first = np.zeros(len(longer), bool)
                first[np.unique(longer, return_index=True)[1]] = True
                count += first & (longer > 0)
            uniq, inverse = np.unique(gram, return_inverse=True)
            counts = np.bincount(inverse, count)
            context_of = np.zeros(len(uniq), np.uint64)
            context_of[inverse] = context
            ones, twos = (np.abs(counts - 1) < 0.5).sum(), (np.abs(counts - 2) < 0.5).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            ctx, of = np.unique(context_of, return_inverse=True)
            total = np.bincount(of, counts)
            kinds = np.bincount(of, (counts > 0).astype(float))
            keys.append(uniq)
            probs.append(np.maximum(counts - discount, 0) / total[of])
            backs.append((ctx, discount * kinds / total))
            top = n
        key = np.concatenate(keys + [c for c, _ in backs])
        order = np.unique(key)
        prob, back = np.zeros(len(order)), np.ones(len(order))
        for k, p in zip(keys, probs):
            prob[np.searchsorted(order, k)] = p
        for c, b in backs:
            back[np.searchsorted(order, c)] = b
        return order, prob, back

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, at, len(self.key))

    def nats(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cost of each character behind the begin mark, a column a language, and its place in its word."""
        hashes, place, _ = grams(words, self.order)
        scored = np.flatnonzero(place >= 1)
        p = np.full((len(scored), len(self.langs)), 1 / 65536, np.float32)
        context = np.full(len(place) + 1, self.find(np.zeros(1, np.uint64))[0])  # of no characters
        for h in hashes:
            at = self.find(h)
            longer = self.prob[at[scored]] + self.back[context[scored]] * p
            p = np.where((h[scored] > 0)[:, None], longer, p)
            context = np.r_[len(self.key), at]  # [i]: the gram that ends before character i
        return -np.log(np.maximum(p, 1e-12)), place[scored]

    def costs(self, words: list[str]) -> np.ndarray:
        """Nats of each word in each language, its end mark included."""
        nats, place = self.nats(words)
        return np.add.reduceat(nats, np.flatnonzero(place == 1), axis=0)

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Sets, from rows not fitted on, what cost a language still accepts and how sharp scores are."""
        if not self.langs:
            return
        scorer, costs, truth = Scorer(self), [], []
        for k, lang in enumerate(self.langs):
            own = np.array([scorer.entropy(t) for t in texts.get(lang, []) if letters(t)]).reshape(-1, len(self.langs))
            costs.append(own)
            truth += [k] * len(own)
            if len(own):
                self.limit[k] = np.quantile(own[:, k], ACCEPTED) + 0.25
        costs, truth = np.concatenate(costs), np.array(truth)
        if len(truth):
            loss = {t: -np.log(np.maximum(softmax(-costs * t)[np.arange(len(truth)), truth], 1e-9)).mean() for t in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)}
            self.sharp = min(loss, key=loss.get)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class Scorer:
    """Cross-entropies of texts, nats a character, with the costs of recent words kept."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at = Places()
        self.cost = np.zeros((0, len(self.model.langs) + 1), np.float32)

    def entropies(self, texts: list[str]) -> np.ndarray:
        if len(self.at) > KEPT:
            self.clear()
        split = [t.lower().split() for t in texts]
        rows = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.at) > len(self.cost):
            new = list(islice(self.at, len(self.cost), None))
            parts = [self.model.costs(new[k : k + 20_000]) for k in range(0, len(new), 20_000)]
            sizes = np.fromiter(map(len, new), np.float32, len(new)) + 1
            self.cost = np.concatenate([self.cost, np.c_[np.concatenate(parts), sizes].astype(np.float32)])
        out = np.zeros((len(texts), self.cost.shape[1]))
        ends = np.cumsum([len(words) for words in split])
        for k, (end, words) in enumerate(zip(ends, split)):
            if words:
                out[k] = self.cost[rows[end - len(words) : end]].sum(axis=0, dtype=np.float64)
        return out[:, :-1] / np.maximum(out[:, -1:], 1)

    def entropy(self, text: str) -> np.ndarray:
        return self.entropies([text])[0]


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> KneserNey:
    """A model fitted on at most ``rows`` rows a language that are not held out; a quarter as many more calibrate it.

    Every language is learned; where there are more than ``sampling.ROWS`` has room for, each from fewer rows.
    Without any such row the model knows no language.
    """
    known = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    known = known.select(F.col(f"`{lang_col}`").alias("class"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").cast("string").alias("key"))
    with scratch():
        drawn, _, most = draw(known, rows + rows // 4, F.col("key"))
        found = smallest(drawn, most)
    fit, rest = {}, {}
    for k, (text, lang) in enumerate(found):
        (rest if k % 5 == 4 else fit).setdefault(lang, []).append(text)
    for lang in rest:
        fit.setdefault(lang, rest[lang])
    model = KneserNey(fit)
    model.calibrate(rest)
    return model


def identify(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of each row.

    lang_pred is the language of least cost a character, ``und`` for text that
    is null or has no letter (score 0, no cross_entropy) and if the model knows
    no language; rejected tells that the cost exceeds what held-back rows of
    that language accept, so it may be none of those learned. Null ids count
    as empty for held_out. Repeated rows give repeated rows, other columns are
    not read, an empty table gives an empty result.
    """

    def make():
        scorer = Scorer(model)

        def step(ids, held, texts):
            langs, scores, costs, rejected = [], [], [], []
            texts = [t or "" for t in texts]
            some = [k for k, t in enumerate(texts) if model.langs and letters(t)]
            found = dict(zip(some, scorer.entropies([texts[k] for k in some])))
            for k in range(len(texts)):
                if k not in found:
                    new = "und", 0.0, None, True
                else:
                    best = int(np.argmin(found[k]))
                    cost = float(found[k][best])
                    new = model.langs[best], float(softmax(-found[k] * model.sharp)[best]), cost, bool(cost > model.limit[best])
                for column, value in zip((langs, scores, costs, rejected), new):
                    column.append(value)
            return ids, held, langs, scores, costs, rejected

        return step

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return map_lists(rows, make, f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
