"""Periodic runs of words by partition refinement.

Positions of a text are classed by the factor of words that begins there: by
single words first, then by ever longer factors. Two positions stay together
at length l + 1 if they were together at length l and the positions behind
them were too, so classes are split by the classes that split before; of the
parts of a class all but the largest need to be looked at, so that a position
is looked at as often as its class halves. Positions next to each other in a
class and exactly l apart at length l begin a square, whose root is primitive
because nothing of the class lies between; squares of one period at
consecutive positions are one run, and all runs are found that way.

Many texts are refined at once in numpy, their words numbered apart. Classes
are ranges of one array of positions, and their members are linked in order of
place. A link remembers the length at which it was made; when it breaks, it
was a square if its distance lay between that length and the present one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists

#: Words refined at once; a longer text is refined alone.
WORDS = 500_000
#: Words of a run at least.
LEAST = 12


def sort_by(major: np.ndarray, minor: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The order by three keys from 0 to n; places differ."""
    bits = int(n).bit_length()
    if 3 * bits <= 62:
        return np.argsort((major << (2 * bits)) | (minor << bits) | place)
    return np.lexsort((place, minor, major))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - sizes.cumsum() + sizes, sizes) + np.arange(total) if total else np.zeros(0, np.int64)


def after(first, rest: np.ndarray) -> np.ndarray:
    """One value, then an array of its kind."""
    out = np.empty(len(rest) + 1, rest.dtype)
    out[0], out[1:] = first, rest
    return out


def gaps(starts: np.ndarray, end: int) -> np.ndarray:
    """How long the parts are that begin at ``starts`` and end with the next one."""
    out = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1] = end - starts[-1]
    return out


class Classes:
    """Positions by the factor that begins there, refined length by length; ``squares`` are (position, period) arrays."""

    def __init__(self, words: np.ndarray, half: np.ndarray):
        """``words``: numbers, of which no two texts share one; ``half``: half the words of each one's text."""
        n = self.n = len(words)
        order = np.argsort(words, kind="stable")
        new = after(True, words[order[1:]] != words[order[:-1]])
        self.half, self.length, self.squares = half, 1, []
        self.perm, self.place = order, np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        begins = np.flatnonzero(new)
        self.classes = len(begins) + 1  # the last one is what lies behind all texts
        self.of, self.begin, self.size = np.empty(n + 1, np.int64), np.zeros(n + 2, np.int64), np.ones(n + 2, np.int64)
        self.of[order], self.of[n] = np.cumsum(new) - 1, len(begins)
        self.begin[: len(begins)], self.size[: len(begins)] = begins, gaps(begins, n)
        self.next, self.previous, self.born = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        self.next[order[:-1]] = np.where(new[1:], -1, order[1:])
        self.previous[order[1:]] = np.where(new[1:], -1, order[:-1])
        self.moved = np.zeros(n + 1, bool)
        self.small = np.arange(n + 1)

    def refine(self) -> bool:
        """From one length to the next; false where nothing is left to split."""
        t = self.small - 1
        t = t[t >= 0]
        t = t[(self.half[t] > self.length) & (self.size[self.of[t]] > 1)]
        if not len(t):
            return False
        # groups: those of a class whose next position lies in the same class
        c, d = self.of[t], self.of[t + 1]
        order = sort_by(c, d, t, self.n + 1)
        t, c, d = t[order], c[order], d[order]
        first = after(True, (c[1:] != c[:-1]) | (d[1:] != d[:-1]))
        sizes = gaps(np.flatnonzero(first), len(t))
        of = c[first]
        head = np.flatnonzero(after(True, of[1:] != of[:-1]))
        who, parts, out = of[head], gaps(head, len(of)), np.add.reduceat(sizes, head)
        rest = self.size[who] - out
        split = (rest > 0) | (parts > 1)
        if not split.all():
            group = np.repeat(split, parts)
            member = np.repeat(group, sizes)
            t, c, first, sizes, of = t[member], c[member], first[member], sizes[group], of[group]
            who, parts, out, rest = who[split], parts[split], out[split], rest[split]
            head = parts.cumsum() - parts
        if not len(t):
            self.small = t
            self.length += 1
            return True
        most = np.maximum.reduceat(sizes, head)
        is_most = sizes == np.repeat(most, parts)
        candidates = np.flatnonzero(is_most)
        owner = np.repeat(np.arange(len(who)), parts)[candidates]
        largest = candidates[after(True, owner[1:] != owner[:-1])]  # a group of each class
        fresh = np.ones(len(sizes), bool)
        fresh[largest[rest == 0]] = False  # it keeps the class's number
        names = of.copy()
        n_new = int(fresh.sum())
        names[fresh] = self.classes + np.arange(n_new)
        self.classes += n_new
        looked_at = np.ones(len(sizes), bool)
        looked_at[largest[most > rest]] = False

        slots = self.move(t, who, rest, out)
        self.link(t, c, first, np.repeat(rest > 0, out))
        self.of[t] = np.repeat(names, sizes)
        self.size[who], self.size[names] = rest, sizes  # in this order: a group may have kept its class's number
        self.begin[names] = slots[first]
        fewer = (rest > 0) & (most > rest)
        self.small = np.concatenate([t[np.repeat(looked_at, sizes)], self.perm[ranges(self.begin[who[fewer]], rest[fewer])]])
        self.length += 1
        return True

    def move(self, t: np.ndarray, who: np.ndarray, rest: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The members ``t`` go to the ends of their classes' ranges, what was there to the places they leave."""
        self.moved[t] = True
        limit = self.begin[who] + rest
        slots = ranges(limit, out)
        there = self.perm[slots]
        stays = there[~self.moved[there]]
        left = self.place[t]
        left = left[left < np.repeat(limit, out)]
        self.perm[left], self.place[stays] = stays, left
        self.perm[slots], self.place[t] = t, slots
        return slots

    def link(self, t: np.ndarray, c: np.ndarray, first: np.ndarray, some_stay: np.ndarray) -> None:
        """Links members of groups to each other, and what stays of a class over what left; tells squares by links that break."""
        before, behind = self.previous[t], self.next[t]
        opens, ends = some_stay & ~self.moved[before], some_stay & ~self.moved[behind]
        by = lambda which: which[np.argsort(c[which] * (self.n + 1) + t[which])]
        p, q = before[by(np.flatnonzero(opens))], behind[by(np.flatnonzero(ends))]
        within = np.full(len(t), -1)
        np.copyto(within[:-1], t[1:], where=~first[1:])
        self.set_next(np.concatenate([t, p[p >= 0]]), np.concatenate([within, q[p >= 0]]))
        self.previous[t] = after(-1, np.where(first[1:], -1, t[:-1]))
        self.previous[q[q >= 0]] = p[q >= 0]
        self.moved[t] = False

    def set_next(self, at: np.ndarray, to: np.ndarray) -> None:
        old = self.next[at]
        changed = old != to
        at, to, old = at[changed], to[changed], old[changed]
        self.tell(at[old >= 0], old[old >= 0], self.length)
        self.next[at], self.born[at] = to, self.length + 1

    def tell(self, at: np.ndarray, to: np.ndarray, until: np.ndarray | int) -> None:
        apart = to - at
        square = (self.born[at] <= apart) & (apart <= until)
        if square.any():
            self.squares.append((at[square], apart[square]))

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        while self.refine():
            pass
        at = np.flatnonzero(self.next >= 0)  # texts are left when no square can be longer than half of them
        self.tell(at, self.next[at], self.half[at])
        found = self.squares or [(np.zeros(0, np.int64),) * 2]
        return tuple(np.concatenate(x) for x in zip(*found))


def runs_of(words: np.ndarray, half: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length, period of all runs of at least ``least`` words, by start, then period."""
    if not len(words):
        return (np.zeros(0, np.int64),) * 3
    at, period = Classes(words, half).finish()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.r_[True, (np.diff(period) != 0) | (np.diff(at) != 1)])
    last = np.r_[new[1:], len(at)] - 1
    start, q = at[new], period[new]
    length = at[last] - start + 2 * q
    long = length >= least
    start, length, q = start[long], length[long], q[long]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def batches_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some ``WORDS`` words together."""
    first = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > WORDS:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def find(texts: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs (start, length, period) of each text of words."""
    out = []
    sizes = [len(t) for t in texts]
    for a, b in batches_of(sizes):
        fresh, numbers = count(), []
        for t in texts[a:b]:
            known = defaultdict(fresh.__next__)
            numbers.append(np.fromiter(map(known.__getitem__, t), np.int64, len(t)))
        many = np.array(sizes[a:b])
        start, length, period = runs_of(np.concatenate(numbers), np.repeat(many // 2, many), least)
        begins = np.r_[0, many.cumsum()]
        cuts = np.searchsorted(start, begins)
        for k in range(b - a):
            x = slice(cuts[k], cuts[k + 1])
            out.append((start[x] - begins[k], length[x], period[x]))
    return out


def kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in no run behind that run's first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return edges.cumsum()[:-1] == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs, collapsed of each row.

    Words are what stands between ASCII white space, numbered from 0. ``runs``
    are struct<start, length, period>, by start, then period: the longest
    stretches whose smallest period fits twice at least, of ``least`` words or
    more. ``collapsed`` is the words joined by one space, of each run only the
    first period. Null text is empty text, without words. Repeated rows give
    repeated rows, null ids are carried, other columns are not read; an empty
    table gives an empty result.
    """

    def make():
        def step(ids, texts):
            words = [(t or "").encode().split() for t in texts]
            runs, collapsed = [], []
            for ws, found in zip(words, find(words, least)):
                if len(found[0]):
                    ws = [w for w, stays in zip(ws, kept(len(ws), *found).tolist()) if stays]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in zip(*(x.tolist() for x in found))])
                collapsed.append(b" ".join(ws).decode())
            return ids, [len(w) for w in words], runs, collapsed

        return step

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_lists(rows, make, f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
