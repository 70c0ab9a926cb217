"""Counts, shares, standard scores, samples and other group-wise work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, truncate: bool = False) -> DataFrame:
    """value, n and percent of all rows; percents may be cut to whole ones."""
    each = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    out = each.crossJoin(F.broadcast(total))  # one row
    percent = 100 * F.col("n") / F.col("total")
    return out.select("value", "n", (percent.cast("int") if truncate else percent).alias("percent"))


def null_census(df: DataFrame) -> DataFrame:
    """column, nulls: in one pass."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "nulls")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct values without null: each column's distinct values are counted before they meet."""
    parts = [df.select(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")).distinct() for c in columns]
    return reduce(DataFrame.unionByName, parts).groupBy("column").agg(F.count("v").alias("n_distinct"))


def eligible_columns(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Columns with at least one and at most ``most`` distinct values."""
    return distinct_counts(df, columns).where(F.col("n_distinct").between(1, most))


def equal_filter(df: DataFrame, wanted: dict[str, object], true_only: list[str] = ()) -> DataFrame:
    for c, v in wanted.items():
        df = df.where(F.col(f"`{c}`") == F.lit(v))
    for c in true_only:
        df = df.where(F.col(f"`{c}`") == F.lit(True))
    return df


def image_filter(df: DataFrame, image: str, chosen: dict[str, list]) -> DataFrame:
    """Distinct images whose columns are among the chosen values; no choice is no constraint."""
    for c, values in chosen.items():
        if values:
            df = df.where(F.col(f"`{c}`").isin(list(values)))
    return df.select(image, *chosen).distinct()


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, number: 1, 2, ... by the earliest place of each key; ranks keys, never rows."""
    firsts = df.groupBy(key).agg(F.min(order).alias("__first"))
    return firsts.select(key, F.row_number().over(Window.orderBy("__first", key)).alias("number"))


def slide_ids(df: DataFrame, image: str, order: str) -> DataFrame:
    """Adds slide_id ``<k>A-<image>``, k the image's number by first appearance."""
    return df.join(first_seen(df, image, order), image).withColumn("slide_id", F.concat(F.col("number").cast("string"), F.lit("A-"), F.col(image).cast("string"))).drop("number")


def case_slide_ids(df: DataFrame, case: str, sample: str) -> DataFrame:
    """case, sample, slide_id ``<case number><A-Z>-<sample>``; a case of over 26 samples raises when it is evaluated."""
    pairs = df.select(case, sample).distinct()
    nth = F.row_number().over(Window.partitionBy(case).orderBy(sample))
    letter = F.when(F.col("nth") <= 26, F.char(F.lit(64) + F.col("nth"))).otherwise(F.raise_error(F.lit("a case has over 26 samples")))
    cases = pairs.select(case).distinct().withColumn("case_number", F.row_number().over(Window.orderBy(case)))
    return pairs.withColumn("nth", nth).join(cases, case).select(case, sample, F.concat(F.col("case_number").cast("string"), letter, F.lit("-"), F.col(sample).cast("string")).alias("slide_id"))


def share_of_total(df: DataFrame, n: str) -> Column:
    return F.col(n) / F.sum(n).over(Window.partitionBy())


def z_score(column: str, by: list[str], sample: bool = True) -> Column:
    """(v - mean) / standard deviation within the group, of a sample (ddof 1) or population (ddof 0); null where it is 0."""
    own = Window.partitionBy(*by)
    spread = F.stddev_samp(column) if sample else F.stddev_pop(column)
    return (F.col(column) - F.avg(column).over(own)) / F.nullif(spread.over(own), F.lit(0.0))


def z_scores(df: DataFrame, columns: list[str], by: list[str], sample: bool = True) -> DataFrame:
    """Adds ``<column>_z``. Group statistics are aggregated and joined, so a large group is never gathered."""
    spread = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*by).agg(*[f for c in columns for f in (F.avg(c).alias(f"__m_{c}"), spread(c).alias(f"__s_{c}"))])
    out = df.join(stats, by).withColumns({f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in columns})
    return out.drop(*[x for c in columns for x in (f"__m_{c}", f"__s_{c}")])


def within_z(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Rows whose absolute z is below the limit in all columns; null fails."""
    return df.where(reduce(Column.__and__, [F.abs(F.col(c)) < limit for c in columns]))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def sample_per_group(df: DataFrame, by: list[str], key: list[str], n: int, seed: int = 0, skip: int = 0) -> DataFrame:
    """n rows a group without replacement, behind the first ``skip``, in an order that a hash of key and seed fixes."""
    order = Window.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    return df.withColumn("__nth", F.row_number().over(order)).where((F.col("__nth") > skip) & (F.col("__nth") <= skip + n)).drop("__nth")


def train_test(df: DataFrame, by: list[str], key: list[str], train: float, test: float, sets: int = 1, seed: int = 0) -> DataFrame:
    """Adds set: ``train``, or ``test_<k>``, the same number of rows from each group, as fractions of the smallest one.

    Test sets have no row of the training set; they may share rows with each other.
    """
    least = df.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
    n_train, n_test = int(least * train), int(least * test)
    out = sample_per_group(df, by, key, n_train, seed).withColumn("set", F.lit("train"))
    order = Window.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    rest = df.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") > n_train).drop("__nth")
    for k in range(sets):
        out = out.unionByName(sample_per_group(rest, by, key, n_test, seed + 1 + k).withColumn("set", F.lit(f"test_{k}")))
    return out


def gated_train_test(df: DataFrame, by: list[str], key: list[str], passes: Column, n_fit: int, n_all: int | None = None, seed: int = 0) -> DataFrame:
    """Groups of at least 2 n_fit passing rows give n_fit passing rows to ``fit`` and the next (up to n_all, or all) to ``test``."""
    ok = df.where(passes)
    groups = ok.groupBy(*by).count().where(F.col("count") >= 2 * n_fit).select(*by)
    ok = ok.join(groups, by, "left_semi")
    order = Window.partitionBy(*by).orderBy(F.xxhash64(*key, F.lit(seed)), *key)
    out = ok.withColumn("__nth", F.row_number().over(order)).withColumn("set", F.when(F.col("__nth") <= n_fit, "fit").otherwise("test"))
    return (out if n_all is None else out.where(F.col("__nth") <= n_all)).drop("__nth")


def decimate_top(df: DataFrame, column: str, key: list[str], share: float = 0.9, seed: int = 42) -> DataFrame:
    """Drops a share of the rows of the commonest value, chosen by hash."""
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(F.col(column).alias("__top"))
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) / 1e6
    out = df.join(F.broadcast(top), F.col(column) == F.col("__top"), "left")  # one row
    return out.where(F.col("__top").isNull() | (u >= share)).drop("__top")


def capped_sample(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows, those of the smallest hashes."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def intersection_union(frames: list[DataFrame]) -> DataFrame:
    """All rows over the columns that all frames have, in the first one's order."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    return reduce(DataFrame.unionByName, [f.select(*[F.col(f"`{c}`") for c in common]) for f in frames])


def crosstab(df: DataFrame, row: str, column: str, normalise: str | None = None) -> DataFrame:
    """Long contingency table: row, column, n, and with ``row`` or ``column`` a share rounded to 3."""
    each = df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(F.count(F.lit(1)).alias("n"))
    if normalise is None:
        return each
    return each.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(normalise)), 3))


def incidence(df: DataFrame, cluster: str, feature: Column) -> DataFrame:
    """For each cluster, rows with and without a feature: counts, difference, percents, and the log10 ratio with pseudo-counts.

    The adjusted percents divide by the totals plus the number of clusters.
    """
    f = F.coalesce(feature, F.lit(False))
    each = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count_if(f).alias("n_with"), F.count_if(~f).alias("n_without"))
    totals = each.agg(F.sum("n_with").alias("all_with"), F.sum("n_without").alias("all_without"), F.count(F.lit(1)).alias("clusters"))
    out = each.crossJoin(F.broadcast(totals))  # one row
    share = lambda n, all_: 100 * F.try_divide(F.col(n), F.col(all_))
    adjusted = lambda n, all_: 100 * F.try_divide(F.col(n) + 1, F.col(all_) + F.col("clusters"))
    return out.select(
        "cluster", "n_with", "n_without", (F.col("n_with") - F.col("n_without")).alias("difference"), share("n_with", "all_with").alias("percent_with"), share("n_without", "all_without").alias("percent_without"),
        F.log10(adjusted("n_with", "all_with") / adjusted("n_without", "all_without")).alias("log10_ratio"),
    )


def group_thresholds(df: DataFrame, value: str, by: list[str], low: int, high: int) -> DataFrame:
    """mean + z * standard deviation (ddof 1) of each group for whole z from low to high."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return stats.withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("threshold", F.col("mean") + F.col("z") * F.col("std"))


def threshold_curve(df: DataFrame, value: str, group: str, image: str | None = None, low: int = -1, high: int = 10) -> DataFrame:
    """Percent of values at or above each whole threshold by group: pooled, or of each image and then averaged (none is 0 percent)."""
    marks = df.where(F.col(value).isNotNull()).withColumn("threshold", F.explode(F.sequence(F.lit(low), F.lit(high))))
    hit = (F.col(value) >= F.col("threshold")).cast("double") * 100
    if image is None:
        return marks.groupBy(group, "threshold").agg(F.avg(hit).alias("percent"))
    return marks.groupBy(group, image, "threshold").agg(F.avg(hit).alias("p")).groupBy(group, "threshold").agg(F.avg("p").alias("percent"))


def z_threshold_curve(df: DataFrame, value: str, group: str, first: object, image: str | None = None, low: int = -1, high: int = 10) -> DataFrame:
    """(group, z, threshold, percent): percent of values at or above the first group's mean + z * standard deviation (ddof 1).

    Pooled by group, or of each image and then averaged. Null values are passed over.
    """
    stats = df.where(F.col(group) == F.lit(first)).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__std"))
    marks = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(stats)).withColumn("z", F.explode(F.sequence(F.lit(low), F.lit(high))))  # one row
    marks = marks.withColumn("threshold", F.col("__mean") + F.col("z") * F.col("__std"))
    hit = (F.col(value) >= F.col("threshold")).cast("double") * 100
    if image is None:
        return marks.groupBy(group, "z", "threshold").agg(F.avg(hit).alias("percent"))
    return marks.groupBy(group, image, "z", "threshold").agg(F.avg(hit).alias("__p")).groupBy(group, "z", "threshold").agg(F.avg("__p").alias("percent"))


def averages_of_sides(profile: DataFrame, label: str, by: list[str], values: list[str], sides: tuple[str, ...] = ("Left", "Right")) -> DataFrame:
    """A profile with a further label ``Average <side>`` for each side: means, by the other keys, over the labels that contain its name."""
    out = profile.select(label, *by, *values)
    for side in sides:
        part = profile.where(F.contains(F.col(f"`{label}`"), F.lit(side)))
        out = out.unionByName(part.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values]).withColumn(label, F.lit(f"Average {side}")).select(label, *by, *values))
    return out


def running_indices(df: DataFrame, case: str, slide: str, roi: str, order: str) -> DataFrame:
    """(case, slide, roi, i_case, i_slide, i_roi): distinct ROIs with numbers from 0 by first appearance: of cases, of slides within a case, of ROIs within a slide."""
    seen = df.groupBy(case, slide, roi).agg(F.min(order).alias("__r"))
    seen = seen.withColumn("__s", F.min("__r").over(Window.partitionBy(case, slide))).withColumn("__c", F.min("__r").over(Window.partitionBy(case)))
    cases = seen.select(case, "__c").distinct().withColumn("i_case", F.row_number().over(Window.orderBy("__c", case)) - 1)  # of cases
    out = seen.join(cases.select(case, "i_case"), case)
    out = out.withColumn("i_slide", F.dense_rank().over(Window.partitionBy(case).orderBy("__s", slide)) - 1)
    out = out.withColumn("i_roi", F.row_number().over(Window.partitionBy(case, slide).orderBy("__r", roi)) - 1)
    return out.select(case, slide, roi, "i_case", "i_slide", "i_roi")


def sample_fraction(df: DataFrame, ids: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """About a fraction of the rows, chosen by a hash of their ids, so that no plan changes the choice."""
    return df.where(F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(1 << 40)) < F.lit(int(fraction * (1 << 40))))


def mean_sem(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def confidence_normal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, low, high: 1.96 standard errors around the mean; a lone value is its own interval."""
    out = mean_sem(df, by, value)
    half = 1.96 * F.coalesce("sem", F.lit(0.0))
    return out.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def unique_label(df: DataFrame, by: str, label: str) -> DataFrame:
    """by, label; a group with several labels raises when it is evaluated."""
    each = df.groupBy(by).agg(F.collect_set(label).alias("labels"))
    return each.select(by, F.when(F.size("labels") == 1, F.col("labels")[0]).otherwise(F.raise_error(F.concat(F.lit("several labels: "), F.col(by).cast("string")))).alias(label))


def majority_vote(df: DataFrame, by: str, label: str, actual: str) -> DataFrame:
    """Commonest label of each group (ties: the least), and the share of votes for its actual one as the score."""
    each = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(by)  # of a group's labels, already counted
    votes = each.withColumns({"r": F.row_number().over(own.orderBy(F.desc("n"), label)), "total": F.sum("n").over(own)})
    votes = votes.where("r = 1").select(by, F.col(label).alias("vote"), "total")
    truth = df.groupBy(by).agg(F.min(actual).alias("actual"), F.count_if(F.col(label) == F.col(actual)).alias("right"))
    return votes.join(truth, by).select(by, "vote", "actual", (F.col("right") / F.col("total")).alias("score"))


def scores_by_cutoff(df: DataFrame, cutoff: str, test_set: str, score: str) -> DataFrame:
    """Mean score of each test set, then mean and standard error over the sets, by cutoff."""
    return mean_sem(df.groupBy(cutoff, test_set).agg(F.avg(score).alias("s")), [cutoff], "s")


def pivot_first(df: DataFrame, row: list[str], channel: str, values: list[str], channels: list) -> DataFrame:
    """Channel rows to columns ``<value><channel>``, the first non-null value of each."""
    wide = [F.first(F.when(F.col(channel) == F.lit(c), F.col(f"`{v}`")), ignorenulls=True).alias(f"{v}{c}") for v in values for c in channels]
    return df.groupBy(*row).agg(*wide)


def repeated_columns(df: DataFrame, row: list[str], columns: list[str]) -> DataFrame:
    """column, repeated: whether its values never differ within a row id; null counts as a value."""
    each = df.groupBy(*row).agg(*[(F.count_distinct(F.col(f"`{c}`")) + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(c) for c in columns])
    one = each.agg(*[(F.max(F.col(f"`{c}`")) <= 1).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "repeated")


def duplicate_columns(df: DataFrame) -> list[tuple[str, str]]:
    """Pairs of columns that hold the same values row by row, by their hash sums."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    first = df.withColumn("__row", row).agg(*[F.sum(F.xxhash64(F.col(f"`{c}`").cast("string"), F.col("__row")).cast("decimal(38,0)")).alias(c) for c in df.columns]).first()
    return [(a, b) for k, a in enumerate(df.columns) for b in df.columns[k + 1 :] if first[a] == first[b]]


def unique_ids(df: DataFrame, row: str, channel: str, channels: int, order: str) -> DataFrame:
    """Ids that occur more than once a channel get a number of four digits or more appended, by order of appearance."""
    nth = F.row_number().over(Window.partitionBy(row, channel).orderBy(order)) - 1
    many = F.count(F.lit(1)).over(Window.partitionBy(row)) > channels
    return df.withColumn("__id", F.when(many, F.concat(F.col(row), F.lit("_"), F.lpad(nth.cast("string"), F.greatest(F.lit(4), F.char_length(nth.cast("string"))), F.lit("0")))).otherwise(F.col(row))).drop(row).withColumnRenamed("__id", row)


def split_by_feature(df: DataFrame, column: str, values: tuple | None = None) -> DataFrame:
    """Adds side: by equality with two given values, or ``<=`` and ``>`` the exact median rounded to 2."""
    c = F.col(f"`{column}`")
    if values is not None:
        return df.withColumn("side", F.when(c == F.lit(values[0]), str(values[0])).when(c == F.lit(values[1]), str(values[1])))
    middle = df.agg(F.round(F.median(c), 2).alias("__median"))
    out = df.crossJoin(F.broadcast(middle))  # one row
    return out.withColumn("side", F.when(c <= F.col("__median"), "low").when(c > F.col("__median"), "high")).drop("__median")


def merge_edits(table: DataFrame, key: str, edited: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """A table after edits: rows of edited keys replaced, deleted keys gone, new rows appended."""
    kept = table.join(edited.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti")
    return kept.unionByName(edited.join(deleted.select(key), key, "left_anti")).unionByName(added)


def one_hot(df: DataFrame, column: str, values: list, prefix: str = "") -> DataFrame:
    """A 0/1 column a value."""
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(f"`{column}`") == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def class_one_hot(df: DataFrame, column: str, prefix: str = "Phenotype ", drop: str = "Other", sep: str = ": ") -> DataFrame:
    """``A: B: Other`` strings as a +/- column for each part that occurs, ``drop`` left out."""
    parts = F.split(F.col(f"`{column}`"), sep)
    names = sorted(r[0] for r in df.select(F.explode(parts)).distinct().collect() if r[0] and r[0] != drop)  # marker names
    return df.withColumns({prefix + n: F.when(F.coalesce(F.array_contains(parts, n), F.lit(False)), "+").otherwise("-") for n in names})
