"""Images that fit a task: their rows are moved once and paired in arrays, many images at a time.

Rows are dealt by image and sorted, so a task meets one image after another
and gathers some before it works on them. Nothing but rows of cells is
shuffled: pairs and counts stay in the task. Images of more than ``WHOLE``
rows are told apart first and left to the joins of the callers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows of an image that a task takes whole at most; rows worked on at once where images are small; pairs looked at at once.
WHOLE, GATHERED, AT_ONCE = 200_000, 20_000, 1 << 19


def split(df: DataFrame, by: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of at most ``most`` or ``WHOLE`` rows, and those of larger ones if there are any."""
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > (WHOLE if most is None else most)).select(*by)
    if large.isEmpty():
        return df, None
    large = written(large)
    known = [large[c].eqNullSafe(df[c]) for c in by]
    return df.join(large, known, "left_anti"), df.join(large, known, "left_semi")


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, -1 for null, and the values by number."""
    found = column.combine_chunks().dictionary_encode() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    """The values of numbers, null for -1."""
    return values.take(pa.array(at, mask=at < 0))


def floats(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).cast(pa.float64()).fill_null(np.nan).to_numpy() for n in names]


def firsts(table: pa.Table, by: list[str]) -> np.ndarray:
    """Whether each row begins a group; the first one does."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for c in by:
        found, _ = codes(table.column(c))
        out[1:] |= found[1:] != found[:-1]
    return out


def gathered(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that are sorted by them, several at once where they are small."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        ahead = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), table]) if held else table
        begin = np.flatnonzero(firsts(ahead, by)[len(ahead) - len(table) :] if held else firsts(ahead, by))
        last = begin[-1] if len(begin) else 0
        if len(begin) and sum(map(len, held)) + last >= GATHERED:
            yield pa.concat_tables([*held, table.slice(0, last)]).combine_chunks()
            held = [table.slice(last)]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def by_group(df: DataFrame, by: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` on tables of whole groups: gets a table and each row's group, sorted from 0; gives columns of ``schema``."""
    names = df.sparkSession.createDataFrame([], schema).columns

    def run(batches):
        for table in gathered(batches, by):
            for out in work(table, firsts(table, by).cumsum() - 1):
                made = pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (out[n] for n in names)], names=names)
                yield from made.to_batches(max_chunksize=50_000)

    return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def ranges(low: np.ndarray, high: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows and what their ranges [low, high) hold, some ``most`` at once."""
    n = np.maximum(high - low, 0)
    ends = n.cumsum()
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        m = n[at:stop]
        row = np.repeat(np.arange(at, stop), m)
        if len(row):
            yield row, np.arange(len(row)) - np.repeat(m.cumsum() - m, m) + low[row]
        at = stop


class Places:
    """Points by group in buckets of half a radius, the radius one for all or one a group."""

    def __init__(self, group: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float | np.ndarray):
        self.side = np.broadcast_to(np.asarray(radius, float) / 2, group.shape) if np.ndim(radius) == 0 else radius[group] / 2
        gx, gy = self.bucket(x), self.bucket(y)
        order = np.lexsort((gy, gx, group))
        self.order, g, self.gx, self.gy = order, group[order], gx[order], gy[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (self.gx[1:] != self.gx[:-1])] if len(g) else np.zeros(0, bool)
        self.strip = new.cumsum() - 1
        self.base = self.gy.min() - 3 if len(g) else 0
        self.high = (self.gy.max() - self.base + 4) if len(g) else 1
        self.first_g, self.first_x = g[new], self.gx[new]
        self.key = self.strip * self.high + (self.gy - self.base)
        self.group, self.x, self.y = g, x[order], y[order]

    def bucket(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            return np.clip(np.nan_to_num(np.floor(v / np.where(self.side > 0, self.side, 1.0))), -(2.0**36), 2.0**36).astype(np.int64)

    def strip_at(self, offset: int) -> np.ndarray:
        """Of each strip, the one of its group so many buckets on, or -1."""
        n, out = len(self.first_g), np.full(len(self.first_g), -1)
        for step in range(-2, 3) if offset else (0,):
            other = np.arange(n) + step
            ok = (other >= 0) & (other < n)
            other = np.clip(other, 0, max(n - 1, 0))
            ok &= (self.first_g[other] == self.first_g) & (self.first_x[other] == self.first_x + offset)
            out[ok] = other[ok]
        return out

    def pairs(self, most: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of pairs of a group, each once in one order and none with itself, that hold all within the radius."""
        own = np.arange(len(self.key))
        for offset in (0, 1, 2):
            if offset:
                strip = self.strip_at(offset)[self.strip]
                mid = strip * self.high + (self.gy - self.base)
                low = np.searchsorted(self.key, mid - 2, "left")
                high = np.where(strip < 0, low, np.searchsorted(self.key, mid + 2, "right"))
            else:
                low, high = own + 1, np.searchsorted(self.key, self.key + 2, "right")
            for i, j in ranges(low, high, most):
                yield i, j

    def around(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of some rows (numbers in the order here), pairs with all that may be within the radius, themselves included."""
        every = [rows, [], []]
        for offset in (-2, -1, 0, 1, 2):
            strip = self.strip_at(offset)[self.strip[rows]]
            mid = strip * self.high + (self.gy[rows] - self.base)
            low = np.searchsorted(self.key, mid - 2, "left")
            every[1].append(low)
            every[2].append(np.where(strip < 0, low, np.searchsorted(self.key, mid + 2, "right")))
        low, high, row = np.stack(every[1], 1).ravel(), np.stack(every[2], 1).ravel(), np.repeat(rows, 5)
        for i, j in ranges(low, high):
            yield row[i], j


def summed(keys: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and how often each is there, or what its weights add up to."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, None if weights is None else np.concatenate(weights), len(key)).astype(np.int64)


class Tally:
    """Counts of keys below ``size``: in place where these are few, else in sorted runs."""

    def __init__(self, size: int):
        self.size, self.dense, self.runs = size, np.zeros(size, np.int64) if size <= 1 << 24 else None, []

    def add(self, key: np.ndarray) -> None:
        if self.dense is not None:
            self.dense += np.bincount(key, minlength=self.size)
            return
        self.runs.append(np.unique(key, return_counts=True))
        if len(self.runs) > 32:
            self.runs = [self._merged()]

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return summed([r[0] for r in self.runs], [r[1] for r in self.runs])

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys counted, ascending, and their counts."""
        if self.dense is None:
            return self._merged()
        key = np.flatnonzero(self.dense)
        return key, self.dense[key]


def ring_numbers(d2: np.ndarray, radii: list[float], closed_left: bool) -> np.ndarray:
    """Ring of each squared distance, -1 beyond all."""
    edges = np.array([float(r) ** 2 for r in radii])
    ring = np.searchsorted(edges, d2, "right" if closed_left else "left") - 1
    return np.where((ring >= 0) & (ring < len(radii) - 1), ring, -1)


def ring_counts(rows: DataFrame, radii: list[float], closed_left: bool, exclude_self: bool, image: str, cell_id: str, phenotype: str, center: str | None, total: str | None, schema: str) -> DataFrame:
    """``spatial.ring_counts`` of images that fit a task."""

    def work(table: pa.Table, group: np.ndarray):
        x, y = floats(table, "x", "y")
        fine = np.isfinite(x) & np.isfinite(y)
        kind, kinds = codes(table.column(phenotype))
        number, _ = codes(table.column(cell_id))
        _, at, cell = np.unique(group * (number.max() + 2) + number + 1, return_index=True, return_inverse=True)
        n_kinds, n_rings = len(kinds) + 1, len(radii) - 1
        rows = np.flatnonzero(fine)
        p = Places(group[rows], x[rows], y[rows], float(max(radii)))
        cell_, kind_, number_ = (v[rows][p.order] for v in (cell, kind + 1, number))
        tally = Tally(len(at) * n_kinds * n_rings)
        if closed_left and not exclude_self and float(radii[0]) == 0.0:  # a cell is at distance 0 of itself
            tally.add((cell_ * n_kinds + kind_) * n_rings)
        for i, j in p.pairs():
            dx, dy = p.x[i] - p.x[j], p.y[i] - p.y[j]
            d2 = dx * dx + dy * dy
            ring = ring_numbers(d2, radii, closed_left)
            ok = (ring >= 0) & (d2 <= float(max(radii)) ** 2)
            if exclude_self:  # cells without an id are told from none
                ok &= (number_[i] != number_[j]) & (number_[i] >= 0) & (number_[j] >= 0)
            i, j, ring = i[ok], j[ok], ring[ok]
            tally.add((cell_[i] * n_kinds + kind_[j]) * n_rings + ring)
            tally.add((cell_[j] * n_kinds + kind_[i]) * n_rings + ring)
        key, n = tally.found()
        ring, of = key % n_rings, key // n_rings
        whose, cell, kind_at = cell, of // n_kinds, of % n_kinds - 1
        out = {image: table.column(image).take(pa.array(at[cell])), cell_id: table.column(cell_id).take(pa.array(at[cell])), "neighbor": taken(kinds, kind_at), "ring": pa.array(ring.astype(np.int32)), "n": pa.array(n)}
        if total:
            all_ = np.bincount(cell * n_rings + ring, n, len(at) * n_rings).astype(np.int64)
            out[total] = pa.array(all_[cell * n_rings + ring])
        if center:  # of rows that share an id the least
            names = kinds.to_pylist()
            rank = np.empty(len(names) + 1, np.int64)
            order = sorted(range(len(names)), key=lambda k: names[k].encode() if isinstance(names[k], str) else names[k])
            rank[order] = np.arange(len(names))
            rank[-1] = len(names)  # null only where there is no other
            least = np.full(len(at), len(names))
            np.minimum.at(least, whose, rank[kind])
            out[center] = taken(kinds, np.array([*order, -1])[least[cell]])
        yield out

    return by_group(rows, [image], work, schema)


def roi_counts(rows: DataFrame, roi: list[str], radius: float, by_number: bool) -> DataFrame:
    """Of ROIs that fit a task, for each (roi, center, neighbor): n_valid, n_neighbor, width, height and, with ``by_number``, how many centers (``centers``) have n neighbours, themselves left out, else all neighbours k.

    ``rows``: roi..., id, x, y, species. Centers lie ``radius`` inside their
    ROI's extent, neighbours nearer than that. Counts of centers are of
    different ids, n_valid of rows; a center's own row is in k.
    """
    kinds = dict(rows.dtypes)
    counted = "n bigint, centers bigint" if by_number else "k bigint"
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in roi) + f", center {kinds['species']}, neighbor {kinds['species']}, n_valid bigint, n_neighbor bigint, width double, height double, {counted}"

    def work(table: pa.Table, group: np.ndarray):
        x, y = floats(table, "x", "y")
        kind, names = codes(table.column("species"))
        number, _ = codes(table.column("id"))
        known = [~table.column(c).is_null().to_numpy(zero_copy_only=False) for c in ("x", "y")]
        groups, s = int(group[-1]) + 1, len(names) + 1
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        x0, y0 = (np.fmin.reduceat(np.where(ok, v, np.inf), first) for ok, v in zip(known, (x, y)))
        x1, y1 = (np.maximum.reduceat(np.where(ok, v, -np.inf), first) for ok, v in zip(known, (x, y)))  # NaN is above all numbers
        right, top = (np.where(np.isnan(v), np.inf, v)[group] for v in (x1, y1))
        with np.errstate(invalid="ignore"):
            valid = (x >= x0[group] + radius) & (x < right - radius) & (y >= y0[group] + radius) & (y < top - radius)
        there = np.bincount(group * s + kind + 1, minlength=groups * s).reshape(groups, s)
        centered = np.bincount(group[valid] * s + kind[valid] + 1, minlength=groups * s).reshape(groups, s)
        fine = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        p = Places(group[fine], x[fine], y[fine], radius)
        at = fine[p.order]
        ok_, kind_, number_ = valid[at], kind[at] + 1, number[at]
        # species of center and neighbor, and where they are counted by number the center's id too
        _, cell = np.unique((group * s + kind + 1) * (number.max() + 2) + number + 1, return_inverse=True)
        own = cell[at] if by_number else p.group * s + kind_
        tally = Tally((int(cell.max()) + 1 if by_number else groups * s) * s)
        if not by_number:
            tally.add((own * s + kind_)[ok_])
        for i, j in p.pairs():
            dx, dy = p.x[i] - p.x[j], p.y[i] - p.y[j]
            near = (dx * dx + dy * dy < radius * radius) & (ok_[i] | ok_[j])
            if by_number:
                near &= (number_[i] != number_[j]) & (number_[i] >= 0) & (number_[j] >= 0)
            i, j = i[near], j[near]
            tally.add((own[i] * s + kind_[j])[ok_[i]])
            tally.add((own[j] * s + kind_[i])[ok_[j]])
        key, n = tally.found()
        of, other = key // s, key % s
        if by_number:
            whose = np.zeros(int(cell.max()) + 1, np.int64)
            whose[cell] = group * s + kind + 1
            of = whose[of]
        pair = of * s + other
        a, b = np.flatnonzero(centered), np.flatnonzero(there)  # by group and species
        found = list(ranges(np.searchsorted(b // s, a // s, "left"), np.searchsorted(b // s, a // s, "right")))
        every = np.concatenate([a[i] * s + b[j] % s for i, j in found]) if found else np.zeros(0, np.int64)
        if by_number:  # species that are not known have no expectation
            every = every[(every // s % s > 0) & (every % s > 0)]
        if by_number:
            most = int(n.max()) + 1 if len(n) else 1
            seen, centers = summed([pair * most + n])
            pair, n = seen // most, seen % most
            keep = np.isin(pair, every)
            pair, n, centers = pair[keep], n[keep], centers[keep]
            some = np.bincount(np.searchsorted(every, pair), centers, len(every)).astype(np.int64)
            pair, n = np.r_[pair, every], np.r_[n, np.zeros(len(every), np.int64)]
            centers = np.r_[centers, centered.ravel()[every // s] - some]
        else:
            k = np.zeros(len(every), np.int64)
            hit = np.isin(pair, every) & (pair // s % s > 0) & (pair % s > 0)  # what is not known equals nothing
            k[np.searchsorted(every, pair[hit])] = n[hit]
            pair = every
        g, a, b = pair // s // s, pair // s % s, pair % s
        with np.errstate(invalid="ignore"):
            width, height = x1 - x0, y1 - y0
        out = {c: table.column(c).take(pa.array(first[g])) for c in roi}
        out |= {"center": taken(names, a - 1), "neighbor": taken(names, b - 1), "n_valid": centered[g, a].astype(np.int64), "n_neighbor": there[g, b].astype(np.int64), "width": width[g], "height": height[g]}
        yield out | ({"n": n, "centers": centers} if by_number else {"k": k})

    return by_group(rows, roi, work, schema)


def nearest(rows: DataFrame, k: int, image: str, schema: str) -> DataFrame:
    """``spatial.nearest`` of images that fit a task: rows image, id, x, y; none of them null, places finite.

    Circles begin where few others are in them even at an image's densest
    place and double for cells that lack k others, until they hold the image.
    """

    def work(table: pa.Table, group: np.ndarray):
        x, y = floats(table, "x", "y")
        number, ids = codes(table.column("id"))
        rank = np.empty(len(ids), np.int64)
        rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        number = rank[number]  # in the order of the ids
        _, cell = np.unique(group * (len(ids) + 1) + number, return_inverse=True)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        wide, high = (np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) for v in (x, y))
        across = np.hypot(wide, high) * (1 + 1e-9)
        radius = np.maximum(np.sqrt((k + 3) * wide * high / (math.pi * size)), np.maximum(wide, high) * (k + 3) / (2 * size))
        radius = np.where(radius > 0, radius, 1.0)
        for _ in range(24):
            p = Places(group, x, y, radius)
            new = np.flatnonzero(np.r_[True, (p.key[1:] != p.key[:-1])])
            full = np.zeros(len(size), np.int64)
            np.maximum.at(full, p.group[new], np.diff(np.r_[new, len(group)]))
            crowded = full > 8 * (k + 4)
            if not crowded.any():
                break
            radius = np.where(crowded, radius / 2, radius)
        todo = np.ones(len(group), bool)
        found: list[tuple] = []
        while todo.any():
            taken_ = todo | np.isin(group, np.unique(group[todo]))
            at = np.flatnonzero(taken_)
            p = Places(group[at], x[at], y[at], radius)
            place = at[p.order]
            of, d_, to, held = [], [], [], 0
            for i, j in p.around(np.flatnonzero(todo[place])):
                dx, dy = p.x[i] - p.x[j], p.y[i] - p.y[j]
                d2 = dx * dx + dy * dy
                i_, j_ = place[i], place[j]
                near = (d2 <= (radius * radius)[p.group[i]]) & (number[i_] != number[j_])
                of.append(cell[i_[near]])
                d_.append(d2[near])
                to.append(j_[near])
                held += len(of[-1])
                if held > 1 << 22:
                    of, d_, to = ([v] for v in least(k, *map(np.concatenate, (of, d_, to)), number))
                    held = len(of[0])
            empty = [np.zeros(0, np.int64)]
            of, d_, to = least(k, np.concatenate(of or empty), np.concatenate(d_ or [np.zeros(0)]), np.concatenate(to or empty), number)
            enough = np.bincount(of, minlength=cell.max() + 1) >= k
            done = todo & (enough[cell] | (radius >= across)[group])
            ends = np.zeros(cell.max() + 1, bool)
            ends[cell[done]] = True
            found.append(tuple(v[ends[of]] for v in (of, d_, to)))
            todo &= ~done
            radius = radius * 2
        of, d_, to = (np.concatenate(v) for v in zip(*found))
        whose = np.zeros(cell.max() + 1, np.int64)
        whose[cell] = np.arange(len(cell))
        order = np.argsort(of, kind="stable")
        of, d_, to = of[order], d_[order], to[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of, "left") + 1
        src = pa.array(whose[of])
        yield {image: table.column(image).take(src), "src": table.column("id").take(src), "dst": table.column("id").take(pa.array(to)), "distance": np.sqrt(d_), "rank": nth.astype(np.int32)}

    return by_group(rows, [image], work, schema)


def least(k: int, of: np.ndarray, d2: np.ndarray, to: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least pairs of each cell in order, ties by the neighbour's number."""
    order = np.lexsort((number[to], d2, of))
    of, d2, to = of[order], d2[order], to[order]
    some = np.arange(len(of)) - np.searchsorted(of, of, "left") < k
    return of[some], d2[some], to[some]


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def turned(v: np.ndarray, n: int) -> np.ndarray:
    return (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def hashed(v: np.ndarray | int, seed: np.ndarray, bits: int) -> np.ndarray:
    """Spark's xxhash64 of an integer of 32 or 64 bits, from hashes so far."""
    v = np.asarray(v).astype(np.int64).astype(np.uint64)
    if bits == 32:
        h = seed + P5 + np.uint64(4)
        h = turned(h ^ ((v & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    else:
        h = seed + P5 + np.uint64(8)
        h = turned(h ^ (turned(v * P2, 31) * P1), 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def shuffled_counts(rows: DataFrame, roi: list[str], radius: float, permutations: int, seed: int) -> DataFrame:
    """roi..., center, neighbor, edges, __s, __q: edges by species, and the sum and sum of squares of those of shuffled labels, of ROIs that fit a task.

    rows: roi..., __hash (of the ROI), id (int or bigint), x, y, species (string).
    Labels are permuted as ``interaction.permutation_test`` says, by the same
    hashes as its join does.
    """
    kinds = dict(rows.dtypes)
    bits = 64 if kinds["id"] == "bigint" else 32
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in roi) + ", center string, neighbor string, edges bigint, __s double, __q double"

    def work(table: pa.Table, group: np.ndarray):
        ids = table.column("id")
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy().astype(np.int64)
        x, y = floats(table, "x", "y")
        low = [np.where(table.column(c).is_null().to_numpy(zero_copy_only=False), -np.inf, v) for c, v in (("x", x), ("y", y))]
        kind, names = codes(table.column("species"))
        rank = np.zeros(len(names) + 1, np.int64)
        rank[pc.array_sort_indices(names).to_numpy()] = np.arange(1, len(names) + 1)
        rank[-1] = 0  # null first
        order = np.lexsort((rank[kind], low[1], low[0], number, known, group))
        g, n, ok = group[order], number[order], known[order]
        order = order[np.r_[True, (g[1:] != g[:-1]) | (n[1:] != n[:-1]) | (ok[1:] != ok[:-1])]]  # a row an id
        s, groups = len(names) + 1, int(group[-1]) + 1
        there = np.bincount(group[order] * s + kind[order] + 1, minlength=groups * s).reshape(groups, s) > 0
        usable = (np.bincount(group[order], minlength=groups) > 2) & (there[:, 1:].sum(axis=1) > 1)
        order = order[usable[group[order]]]
        if not len(order):
            return
        g, label, number, known, x, y = group[order], (kind + 1)[order], number[order], known[order], x[order], y[order]
        start = table.column("__hash").to_numpy().astype(np.int64).astype(np.uint64)[order]
        labels = np.empty((permutations + 1, len(order)), np.int32)
        labels[0] = label
        for t in range(1, permutations + 1):
            h = hashed(t, start, 32)
            h = hashed(seed, np.where(known, hashed(number, h, bits), h), 32)
            giving, taking = (ordered(g, hashed(k, h, 32).astype(np.int64), known, number) for k in (0, 1))
            labels[t][taking] = label[giving]
        fine = np.flatnonzero(known & np.isfinite(x) & np.isfinite(y))
        p = Places(g[fine], x[fine], y[fine], radius)
        at = fine[p.order]
        tally, edged = Tally((permutations + 1) * groups * s * s), np.zeros(groups, bool)
        turn = np.arange(permutations + 1)[:, None] * groups
        for i, j in p.pairs(1 << 15):
            dx, dy = p.x[i] - p.x[j], p.y[i] - p.y[j]
            near = dx * dx + dy * dy <= radius * radius
            i, j = at[i[near]], at[j[near]]
            edged[g[i]] = True
            a, b, base = labels[:, i].astype(np.int64), labels[:, j].astype(np.int64), (turn + g[i]) * (s * s)
            tally.add((base + a * s + b).ravel())
            tally.add((base + b * s + a).ravel())
        key, n = tally.found()
        t, pair = key // (groups * s * s), key % (groups * s * s)
        kinds_ = np.flatnonzero(there.ravel() & np.repeat(usable & edged, s) & (np.arange(groups * s) % s > 0))
        met = list(ranges(np.searchsorted(kinds_ // s, kinds_ // s, "left"), np.searchsorted(kinds_ // s, kinds_ // s, "right")))
        every = np.concatenate([kinds_[a] * s + kinds_[b] % s for a, b in met]) if met else np.zeros(0, np.int64)
        hit = np.isin(pair, every)
        where, t, n = np.searchsorted(every, pair[hit]), t[hit], n[hit].astype(float)
        edges, total, squares = (np.bincount(where[w], v[w], len(every)) for w, v in ((t == 0, n), (t > 0, n), (t > 0, n * n)))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        out = {c: table.column(c).take(pa.array(first[every // s // s])) for c in roi}
        yield out | {"center": taken(names, every // s % s - 1), "neighbor": taken(names, every % s - 1), "edges": edges.astype(np.int64), "__s": total, "__q": squares}

    return by_group(rows, roi, work, schema)


def ordered(group: np.ndarray, lot: np.ndarray, known: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Rows by group, which ascends, then lot, then number."""
    order = np.argsort(lot)
    small = group - group[0]
    order = order[np.argsort(small[order].astype(np.int16) if small[-1] < 1 << 15 else small[order], kind="stable")]
    same = (lot[order][1:] == lot[order][:-1]) & (group[order][1:] == group[order][:-1])
    return np.lexsort((number, known, lot, group)) if same.any() else order
