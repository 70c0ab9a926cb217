"""Phenotypes from marker calls: species numbers, names, summaries, mappings, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER, UNASSIGNED = "Other", "unassigned"


def markers(df: DataFrame, prefix: str) -> list[str]:
    """Marker columns, in order, by their prefix."""
    return [c for c in df.columns if c.startswith(prefix)]


def positive(column: str) -> Column:
    """Whether a call's last character is ``+``; null is negative."""
    return F.coalesce(F.right(F.col(f"`{column}`").cast("string"), F.lit(1)) == "+", F.lit(False))


def species_int(columns: list[str]) -> Column:
    """Bits of the markers as one number, the first column the most significant; at most 63 markers."""
    if not 0 < len(columns) < 64:
        raise ValueError("from 1 to 63 markers")
    top = len(columns) - 1
    return reduce(Column.__add__, [positive(c).cast("bigint") * F.lit(1 << top - k).cast("bigint") for k, c in enumerate(columns)])


def species_names(columns: list[str], prefix: str) -> tuple[Column, Column]:
    """Short name (positive markers, ``A+ B+``, Other if none) and long name (every marker with its sign)."""
    short = F.concat_ws(" ", *[F.when(positive(c), F.lit(c[len(prefix) :] + "+")) for c in columns])
    long = F.concat_ws(" ", *[F.concat(F.lit(c[len(prefix) :]), F.when(positive(c), "+").otherwise("-")) for c in columns])
    return F.when(short == "", F.lit(OTHER)).otherwise(short), long


def with_species(df: DataFrame, prefix: str = "Phenotype ") -> DataFrame:
    """Adds species_int, species_name_short, species_name_long and has_pos_mark."""
    found = markers(df, prefix)
    short, long = species_names(found, prefix)
    return df.withColumns({"species_int": species_int(found), "species_name_short": short, "species_name_long": long}).withColumn("has_pos_mark", F.col("species_int") != 0)


def decode_species(number: Column, names: list[str]) -> Column:
    """Names of the set bits, the first name the most significant bit."""
    top = len(names) - 1
    parts = [F.when(number.bitwiseAND(F.lit(1 << top - k).cast("bigint")) != 0, F.lit(n)) for k, n in enumerate(names)]
    return F.array_compact(F.array(*parts))


def drop_negative(df: DataFrame) -> DataFrame:
    return df.where(F.col("species_int") != 0)


def explode_markers(df: DataFrame, names: list[str]) -> DataFrame:
    """A row for each positive marker of a cell, which becomes its phenotype; all-negative cells go."""
    return df.withColumn("phenotype", F.explode(decode_species(F.col("species_int"), names)))


def species_summary(df: DataFrame) -> DataFrame:
    """Species with counts of their short names and percents of all cells, rounded to 2."""
    by = ["species_name_short", "phenotype", "species_name_long"]
    each = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    short = Window.partitionBy("species_name_short")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    each = each.withColumn("species_count", F.sum("n").over(short)).crossJoin(F.broadcast(total))  # one row
    return each.select(*by, "species_count", F.round(100 * F.col("species_count") / F.col("total"), 2).alias("species_percent"))


def species_map(df: DataFrame, names: list[str]) -> DataFrame:
    """(species_int, n, markers): species from the most frequent, with the list of their positive markers."""
    each = df.groupBy("species_int").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("markers", decode_species(F.col("species_int"), names)).orderBy(F.desc("n"), "species_int")


def phenotype_summary(df: DataFrame) -> DataFrame:
    """Phenotypes with count, percent and the sorted species that make them up."""
    each = df.groupBy("phenotype").agg(F.count(F.lit(1)).alias("phenotype_count"), F.array_join(F.array_sort(F.collect_set("species_name_short")), ", ").alias("species_set"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    each = each.crossJoin(F.broadcast(total))  # one row
    return each.select("phenotype", "phenotype_count", F.round(100 * F.col("phenotype_count") / F.col("total"), 2).alias("phenotype_percent"), "species_set")


def assign(df: DataFrame, table: DataFrame, on: str = "species_name_short", to: str = "phenotype") -> DataFrame:
    """Phenotypes from an assignment table of one row a species; species it lacks are ``unassigned``."""
    table = table.select(F.col(on), F.col(to).alias("__to"))
    return df.drop(to).join(table, on, "left").withColumn(to, F.coalesce("__to", F.lit(UNASSIGNED))).drop("__to")


def custom_phenotypes(df: DataFrame, table: DataFrame) -> DataFrame:
    """Maps species_int by a table (species_int, phenotype); ``A-B`` makes a row for each part, species it lacks go.

    Each phenotype is numbered by the smallest species that maps to it (canonical).
    """
    parts = table.select("species_int", F.explode(F.split("phenotype", "-")).alias("phenotype"))
    canonical = parts.withColumn("canonical", F.min("species_int").over(Window.partitionBy("phenotype")))
    return df.drop("phenotype").join(canonical, "species_int")


def mapping_is_one_to_one(df: DataFrame) -> DataFrame:
    """Rows that break it: numbers with several names or names with several numbers; none is right."""
    pairs = df.select("species_int", "species_name_long").distinct()
    a = pairs.groupBy(F.col("species_int").cast("string").alias("key")).count().where("count > 1")
    b = pairs.groupBy(F.col("species_name_long").alias("key")).count().where("count > 1")
    return a.unionByName(b)


def identification(df: DataFrame, total: int | None = None) -> DataFrame:
    """Index, count, percent and markers of species as written for assignment: all-negative dropped, ``-`` in names as ``(dash)``."""
    rows = df.where(F.col("species_name_short") != OTHER)
    order = Window.orderBy(F.desc("species_count"), "species_name_short")  # of species, not of cells
    return rows.withColumn("idx", F.row_number().over(order) - 1).withColumn("phenotype", F.replace("phenotype", F.lit("-"), F.lit("(dash)")))


def gate(df: DataFrame, rules: list[dict], image_col: str | None = None, prefix: str = "Phenotype ") -> DataFrame:
    """Adds a ``+``/``-`` column a rule.

    A rule is {"phenotype", "columns": {name: {"min", "max", "items"}}, "images"}:
    all columns must be within min and max, both inclusive, or among items;
    null bounds do not constrain and null values fail. With images, the rule
    only calls cells of those.
    """
    out = {}
    for rule in rules:
        call = F.lit(True)
        for name, limit in rule["columns"].items():
            value = F.col(f"`{name}`")
            if limit.get("items"):
                call &= value.isin(list(limit["items"]))
            if limit.get("min") is not None:
                call &= value >= F.lit(limit["min"])
            if limit.get("max") is not None:
                call &= value <= F.lit(limit["max"])
        if image_col and rule.get("images"):
            call &= F.col(f"`{image_col}`").isin(list(rule["images"]))
        out[prefix + rule["phenotype"]] = F.when(F.coalesce(call, F.lit(False)), "+").otherwise("-")
    return df.withColumns(out)


def rules_of(table: list[dict]) -> list[dict]:
    """Rules from rows of a gating table: columns ``<name> [[min]]``, ``[[max]]``, ``[[items]]``; null is no limit."""
    rules = []
    for row in table:
        columns: dict[str, dict] = {}
        for name, value in row.items():
            for kind in ("min", "max", "items"):
                if name.endswith(f" [[{kind}]]") and value is not None and value == value:
                    columns.setdefault(name[: -len(f" [[{kind}]]")], {})[kind] = value
        rules.append({"phenotype": row["Phenotype"], "columns": columns})
    return rules


def min_positive_intensity(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """For intensity column -> call column, the least intensity among positive cells: field, min_intensity."""
    row = df.agg(*[F.min(F.when(positive(call), F.col(f"`{value}`"))).alias(value) for value, call in pairs.items()])
    return row.unpivot([], list(pairs), "field", "min_intensity")
