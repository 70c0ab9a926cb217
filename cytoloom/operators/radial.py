"""Radial and time profiles: labels, channels, percent positive by well, time and ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from . import summaries


#: Fixed value: image, ``T=<time>:<cell>:c:<channel>/<channels> t:<time>/<times>`` and name of a measurement's label.
LABEL = r"^(.*?) - (T=.*?:c:.*/.*? t:.*/.*?) - (.*)$"


def parse_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    """tif_name, T, cell_id and last_name of labels; null where a label has another form."""
    part = lambda k: F.nullif(F.regexp_extract(F.col(f"`{label}`"), LABEL, k), F.lit(""))
    fields = F.split(part(2), ":")
    time = F.regexp_replace(F.get(fields, F.lit(0)), "^T=", "")
    return df.withColumns({"tif_name": part(1), "T": time.try_cast("int"), "cell_id": F.get(fields, F.lit(1)), "last_name": part(3)})


def without_common_suffix(df: DataFrame, column: str) -> DataFrame:
    """The column without what all its values end with; from the least and the greatest of them reversed."""
    low, high = df.agg(F.min(F.reverse(column)), F.max(F.reverse(column))).first()
    n = len(naming.common_prefix([low or "", high or ""]))
    return df.withColumn(column, F.expr(f"left(`{column}`, char_length(`{column}`) - {n})"))


def parse_filenames(df: DataFrame, column: str = "input_filename") -> DataFrame:
    """REEC, well_id and cell_type from names ``<well>_<cell type>[_REEC]<common>=<T><common>``.

    What all names end with goes, then the time from the first equals sign on,
    then what all rests end with; an ``_REEC`` at the end of what is left is
    told and cut, and its first two parts are the well and the cell type. So
    the table must hold names that differ in what is to be read. Null names
    give nulls.
    """
    out = df.withColumn("__rest", F.col(f"`{column}`"))
    out = without_common_suffix(out, "__rest").withColumn("__rest", F.substring_index("__rest", "=", 1))
    out = without_common_suffix(out, "__rest").withColumn("REEC", F.endswith("__rest", F.lit("_REEC")))
    parts = F.split(F.regexp_replace("__rest", "_REEC$", ""), "_")
    return out.withColumns({"well_id": F.get(parts, F.lit(0)), "cell_type": F.get(parts, F.lit(1))}).drop("__rest")


def normalised_intensity(df: DataFrame) -> DataFrame:
    return df.withColumn("RawIntNorm", F.try_divide(F.col("RawIntDen").cast("double"), F.col("Area").cast("double")))


def preprocess(df: DataFrame, row: str, channel: str, values: list[str], channels: list, attributes: list[str], image: str, limit: float = 3.0) -> DataFrame:
    """Channel rows to one row a cell, population z-scores of all signals by image, outliers dropped."""
    wide = summaries.pivot_first(df, [row, image, *attributes], channel, values, channels)
    signals = [f"{v}{c}" for v in values for c in channels]
    return summaries.within_z(summaries.z_scores(wide, signals, [image], sample=False), [f"{s}_z" for s in signals], limit)


def percent_positive(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """Percent of rows that are hits; a null is no hit."""
    return df.groupBy(*by).agg((F.avg(F.coalesce(hit, F.lit(False)).cast("double")) * 100).alias("percent"), F.count(F.lit(1)).alias("n"))


def dense_percent(df: DataFrame, wells: str, time: str, ring: str, hit: Column) -> DataFrame:
    """Percent positive for every (well, time, ring) of the values that occur, null where there are no cells."""
    each = percent_positive(df, [wells, time, ring], hit)
    axes = each.select(wells).distinct().crossJoin(each.select(time).distinct()).crossJoin(each.select(ring).distinct())  # design values, not rows
    return axes.join(each, [wells, time, ring], "left")


def percent_by_whole_ring(cells: DataFrame, hit: Column, image: str = "slide_id", width: float = 250.0) -> DataFrame:
    """Percent positive by ring (of ``spatial.radial_rings``), rings that the image does not hold whole left out."""
    return percent_positive(cells.where(F.col("ring") <= F.col("whole_rings") * width), [image, "ring"], hit)
