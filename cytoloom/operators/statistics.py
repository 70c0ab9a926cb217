"""Kernel densities, rank tests, bootstraps, accuracy of clusterings."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..session import written


#: Terms of the series that stands for a bin, whose bins are half a bandwidth wide: what is left out is below 1e-11 of a kernel.
TERMS = 13


def hermite(terms: int) -> list[list[float]]:
    """Coefficients, by rising powers, of He_j(t) / j! for j below ``terms``: exp(-(t - u)^2 / 2) = exp(-t^2 / 2) sum_j u^j He_j(t) / j!."""
    out = [[1.0], [0.0, 1.0]]
    for j in range(1, terms - 1):
        up, low = [0.0, *out[j]], [j * c for c in out[j - 1]] + [0.0, 0.0]
        out.append([a - b for a, b in zip(up, low)])
    return [[c / math.factorial(j) for c in row] for j, row in enumerate(out[:terms])]


def kernel_density(df: DataFrame, value: str, by: list[str], points: int = 500) -> DataFrame:
    """Gaussian density of each group on a grid over the whole table's range: by..., x, density; Scott's bandwidth n^(-1/5) std.

    Rows are binned at half a bandwidth and leave a bin their number and the
    sums of twelve powers of their place in it, in one aggregate; a bin meets
    the grid's points within ten bandwidths, where a Hermite series of those
    sums gives what its rows' kernels add up to. So what meets the grid are
    bins, not rows.
    """
    known = df.where(F.col(value).isNotNull())
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    stats = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("std")).where("std > 0")
    stats = stats.crossJoin(F.broadcast(ends)).withColumn("h", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("std"))  # one row
    rows = known.join(stats, by) if by else known.crossJoin(F.broadcast(stats))
    rows = rows.withColumn("bin", F.round(2 * (F.col(value) - F.col("lo")) / F.col("h")))
    u = (F.col(value) - F.col("lo")) / F.col("h") - F.col("bin") / 2
    moments = [F.count(F.lit(1)).cast("double").alias("m0"), *[F.sum(F.pow(u, F.lit(float(j)))).alias(f"m{j}") for j in range(1, TERMS)]]
    bins = rows.groupBy(*by, "bin").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("h").alias("h"), *moments)
    table = hermite(TERMS)
    powers = [sum((F.col(f"m{j}") * table[j][i] for j in range(i + 2, TERMS, 2)), F.col(f"m{i}") * table[i][i]).alias(f"d{i}") for i in range(TERMS)]
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    middle = F.col("lo") + F.col("bin") * F.col("h") / 2
    first = F.greatest(F.lit(0), F.ceil((middle - 10 * F.col("h") - F.col("lo")) / step))
    last = F.least(F.lit(points - 1), F.floor((middle + 10 * F.col("h") - F.col("lo")) / step))
    near = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    met = bins.select(*by, "lo", "h", step.alias("step"), middle.alias("middle"), *powers, F.explode(near).alias("k"))
    t = (F.col("lo") + F.col("k") * F.col("step") - F.col("middle")) / F.col("h")
    series = F.col(f"d{TERMS - 1}")
    for i in reversed(range(TERMS - 1)):
        series = series * F.col("t") + F.col(f"d{i}")
    each = met.withColumn("t", t).groupBy(*by, "k").agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * series).alias("total"))
    every = stats.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = every.join(each, [*by, "k"], "left")
    return out.select(*by, (F.col("lo") + F.col("k") * step).alias("x"), (F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


#: Values of a sketch by which a feature is cut into ranges, and the rows that a range should hold.
SKETCH, RANGE = 10_000, 100_000


def rank_sums(long: DataFrame, feature: str, group: str, value: str, rows: int = RANGE) -> DataFrame:
    """(feature, group, rank_sum, n, total, ties): sums of tie-averaged ranks of each group's values within a feature.

    Equal values are counted first. A feature's distinct values are cut into
    ranges of some ``rows`` by a sketch of their quantiles; ranks are counted
    within a range and lifted by what the ranges below hold, so that no task
    sees more of a feature than a range. Ranks do not depend on the cuts.
    """
    cells = long.groupBy(feature, value, group).agg(F.count(F.lit(1)).alias("m"))
    tied = written(cells.groupBy(feature, value).agg(F.sum("m").alias("t")))
    most = tied.groupBy(feature).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = min(SKETCH, most // rows)
    own = tied.select(feature, value, "t")
    if cuts:
        shares = F.array(*[F.lit((k + 1) / (cuts + 1)) for k in range(cuts)])
        ends = written(tied.groupBy(feature).agg(F.percentile_approx(value, shares, SKETCH).alias("ends")))  # a row a feature
        own = own.join(ends, feature).withColumn("part", F.size(F.filter("ends", lambda e: e < F.col(value)))).drop("ends")
    else:
        own = own.withColumn("part", F.lit(0))
    held = own.groupBy(feature, "part").agg(F.sum("t").alias("held"))
    before = held.withColumn("before", F.sum("held").over(Window.partitionBy(feature).orderBy("part")) - F.col("held")).drop("held")  # of ranges
    below = F.sum("t").over(Window.partitionBy(feature, "part").orderBy(value)) - F.col("t")
    ranked = own.join(before, [feature, "part"]).withColumn("rank", F.col("before") + below + (F.col("t") + 1) / 2)
    per = tied.groupBy(feature).agg(F.sum("t").alias("total"), F.sum(F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t")).alias("ties"))
    sums = cells.join(ranked.select(feature, value, "rank"), [feature, value]).groupBy(feature, group).agg(F.sum(F.col("rank") * F.col("m")).alias("rank_sum"), F.sum("m").alias("n"))
    return sums.join(per, feature)


def wilcoxon(long: DataFrame, feature: str, group: str, value: str, positive_only: bool = False) -> DataFrame:
    """Each group against the rest by feature: z, two-sided p, Benjamini-Hochberg p within the group, log2 fold change of means."""
    sums = rank_sums(long, feature, group, value)
    rest = F.col("total") - F.col("n")
    mean = F.col("n") * (F.col("total") + 1) / 2
    var = F.col("n") * rest / 12 * (F.col("total") + 1)
    out = sums.withColumn("z", F.try_divide(F.col("rank_sum") - mean, F.sqrt(var)))
    out = out.withColumn("p", F.least(F.lit(1.0), 2 * numeric.normal_cdf(-F.abs("z"))))
    means = long.groupBy(feature, group).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    own = Window.partitionBy(feature)
    means = means.withColumns({"__sr": F.sum("__s").over(own) - F.col("__s"), "__cr": F.sum("__c").over(own) - F.col("__c")})
    fold = F.log2((F.try_divide(F.col("__s"), F.col("__c")) + 1e-9) / (F.try_divide(F.col("__sr"), F.col("__cr")) + 1e-9))
    out = out.join(means.select(feature, group, fold.alias("log2_fold")), [feature, group])
    if positive_only:
        out = out.where(F.col("log2_fold") > 0)
    g = Window.partitionBy(group)
    step = F.col("p") * F.count("p").over(g) / F.row_number().over(g.orderBy("p", feature))
    out = out.withColumn("__q", step)
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("__q").over(g.orderBy(F.desc("p"), F.desc(feature))))).drop("__q", "total", "ties")


def resampled(df: DataFrame, by: list[str], value: str, resamples: int, row: list[str], seed: int = 0) -> DataFrame:
    """(by..., resample, weight, total): Poisson bootstrap of each group's rows with a value.

    A row weighs a Poisson(1) number in each resample, drawn from a hash of
    the columns ``row`` that name it. Batches are summed as they come, so a
    group of any size is only added up, and no plan changes a draw.
    """
    from pyspark.sql import types as T

    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    salts = np.array([(seed * 0x9E3779B97F4A7C15 + r * 0xBF58476D1CE4E5B9 + 1) % (1 << 64) for r in range(resamples)], np.uint64)
    keys = [f"g{k}" for k in range(len(by))]
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).cast("double").alias("v"), F.xxhash64(*row).alias("h"))
    out = T.StructType([*[f for f in rows.schema.fields if f.name in keys], T.StructField("resample", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("total", T.DoubleType())])

    def draw(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = h.view(np.uint64)[:, None] ^ salts[None, :]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
        return np.searchsorted(steps, (x >> np.uint64(11)).astype(float) / (1 << 53), "right").astype(float)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), max(1, (1 << 21) // resamples)):
                part = batch.iloc[at : at + max(1, (1 << 21) // resamples)]
                if keys:
                    number = part.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
                else:
                    number = np.zeros(len(part), int)
                order = np.argsort(number, kind="stable")
                weights, values = draw(part["h"].to_numpy(np.int64)[order]), part["v"].to_numpy(float)[order]
                first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
                weight, total = np.add.reduceat(weights, first), np.add.reduceat(weights * values[:, None], first)
                found = part.iloc[order[first]][keys].loc[lambda x: x.index.repeat(resamples)]
                yield found.reset_index(drop=True).assign(resample=np.tile(np.arange(resamples, dtype=np.int32), len(first)), weight=weight.ravel(), total=total.ravel())

    sums = rows.mapInPandas(run, out).groupBy(*keys, "resample").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))
    return sums.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "resample", "weight", "total")


def bootstrap_interval(df: DataFrame, by: list[str], value: str, resamples: int = 1000, row: list[str] = (), level: float = 0.95, seed: int = 0) -> DataFrame:
    """mean and percentile bootstrap interval (low, high) of each group; a lone value is its own interval. ``row`` names a row."""
    means = resampled(df, by, value, resamples, list(row) or df.columns, seed).withColumn("m", F.try_divide("total", "weight"))
    ends = means.groupBy(*by).agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    own = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    same = F.lit(True)
    for b in by:
        same &= own[b].eqNullSafe(ends[b])
    return own.join(ends, same, "left").select(*[own[b] for b in by], "mean", "low", "high")


def difference_flags(df: DataFrame, by: list[str], value: str, group: str, first: object, second: object, resamples: int = 1000, row: list[str] = (), seed: int = 0) -> DataFrame:
    """1, -1 or 0 as the bootstrap interval of mean(first) - mean(second) is above, below or around 0; null without two values each. ``row`` names a row."""
    two = df.where(F.col(group).isin(first, second))
    means = resampled(two, [*by, group], value, resamples, list(row) or df.columns, seed).withColumn("m", F.try_divide("total", "weight"))
    pick = lambda g: F.max(F.when(F.col(group) == F.lit(g), F.col("m")))
    gaps = means.groupBy(*by, "resample").agg((pick(first) - pick(second)).alias("gap"))
    ends = gaps.groupBy(*by).agg(F.percentile("gap", 0.025).alias("low"), F.percentile("gap", 0.975).alias("high"))
    there = df.groupBy(*by).agg(*[F.count(F.when(F.col(group) == F.lit(g), F.col(value))).alias(n) for g, n in ((first, "__a"), (second, "__b"))])
    same = F.lit(True)
    for b in by:
        same &= there[b].eqNullSafe(ends[b])
    flag = F.when((F.col("__a") > 1) & (F.col("__b") > 1), F.when(F.col("low") > 0, 1.0).when(F.col("high") < 0, -1.0).otherwise(0.0))
    return there.join(ends, same, "left").select(*[there[b] for b in by], flag.alias("flag"))


def one_vs_all(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Of each actual label: tp, fp, fn, tn, precision, recall, f1, accuracy, from the confusion counts."""
    c = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows = c.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("actual_n"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted_n"))
    total = c.agg(F.sum("n").alias("total"))
    out = rows.join(cols, "label", "left").na.fill(0, ["predicted_n"]).crossJoin(F.broadcast(total))  # one row
    fp, fn = F.col("predicted_n") - F.col("tp"), F.col("actual_n") - F.col("tp")
    return out.select(
        "label", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("total") - F.col("tp") - fp - fn).alias("tn"),
        F.try_divide(F.col("tp"), F.col("predicted_n")).alias("precision"), F.try_divide(F.col("tp"), F.col("actual_n")).alias("recall"),
        F.try_divide(2 * F.col("tp"), F.col("predicted_n") + F.col("actual_n")).alias("f1"), ((F.col("total") - fp - fn) / F.col("total")).alias("accuracy"),
    )


def softmax_membership(df: DataFrame, row: str, features: list[str], cluster: str) -> DataFrame:
    """(row, cluster, probability): softmax over clusters of a row's dot product with their mean features; clusters are few and broadcast."""
    means = df.groupBy(F.col(cluster).alias("cluster")).agg(*[F.avg(f).alias("__" + f) for f in features])
    n = means.count()
    if n > 10_000:
        raise ValueError("too many clusters to broadcast")
    dots = df.select(row, *features).crossJoin(F.broadcast(means))
    dot: Column = F.lit(0.0)
    for f in features:
        dot = dot + F.col(f) * F.col("__" + f)
    dots = dots.select(row, "cluster", dot.alias("dot"))
    own = Window.partitionBy(row)
    e = dots.withColumn("e", F.exp(F.col("dot") - F.max("dot").over(own)))
    return e.select(row, "cluster", (F.col("e") / F.sum("e").over(own)).alias("probability"))
