"""Vendor formats of cell tables: detected from column names, standardised by one projection.

A format says which column names the images, where the coordinates are, and
how marker calls are found; standardising is a ``select`` that Catalyst prunes
and pushes down like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming, numeric
from ..operators import spatial, summaries
from .schema import PREFIX, call_of

MICRO = "µm"


@dataclass(frozen=True)
class Format:
    name: str
    detect: Callable[[list[str]], bool]
    image: Callable[[], Column]
    coordinates: tuple[str, ...]
    calls: Callable[[list[str]], dict[str, str]]  # marker -> column
    positive: Callable[[str, str], Column]  # (column, marker) -> whether positive
    snap: float | None = None
    roi: str | None = None


def _prefixed(prefix: str) -> Callable[[list[str]], dict[str, str]]:
    return lambda columns: {c[len(prefix) :]: c for c in columns if c.startswith(prefix)}


def _halo(columns: list[str]) -> dict[str, str]:
    start = columns.index("YMax") + 1
    end = next(k for k, c in enumerate(columns) if re.search("DAPI.* Positive Classification", c))
    return {c: c for c in columns[start:end]}


def _reec(columns: list[str]) -> dict[str, str]:
    high = [c for c in columns if c.endswith("_HI")]
    stop = next((k for k, c in enumerate(high) if c.startswith("NUC_")), len(high))
    return {c.removesuffix("_HI"): c for c in high[:stop]}


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _signed(column: str, marker: str) -> Column:
    return F.right(_col(column).cast("string"), F.lit(1)) == "+"


def _one(column: str, marker: str) -> Column:
    return _col(column).cast("double") == 1


def _under(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


#: The formats' telling columns, markers and units, in the order in which they are tried.
FORMATS = [
    Format("Standardized", lambda c: "Image ID_(standardized)" in c, lambda: _col("Image ID_(standardized)"), (f"Centroid X ({MICRO})_(standardized)", f"Centroid Y ({MICRO})_(standardized)"), _prefixed("Phenotype_(standardized) "), _signed, None, "ROI ID_(standardized)"),
    Format("HALO", lambda c: "Image Location" in c, lambda: naming.image_name(_col("Image Location")), ("XMin", "XMax", "YMin", "YMax"), _halo, _one),
    Format("Native", lambda c: "tag" in c, lambda: F.lpad(F.split(_col("Slide ID"), "-")[0], F.greatest(F.lit(3), F.char_length(F.split(_col("Slide ID"), "-")[0])), F.lit(" ")), ("Cell X Position", "Cell Y Position"), _prefixed(PREFIX), _signed, None, "tag"),
    Format("GMBSecondGeneration", lambda c: "tag.x" in c, lambda: F.regexp_replace(_col("Slide ID"), "-MACRO-POS$", ""), ("Cell X Position", "Cell Y Position"), _prefixed(PREFIX), _signed, None, "tag.x"),
    Format("REEC", lambda c: "HYPOXICIN" in c, lambda: F.concat_ws("__", _under(F.regexp_replace(F.regexp_extract(_col("ImageFile"), r"([^/]*)$", 1), r"\.tif$", "")), _under(_col("tNt"))), ("CentroidX", "CentroidY"), _reec, _one),
    Format("Ultivue", lambda c: "Ultivue_DAPIPositiveClassification" in c, lambda: _col("ShortName"), ("CentroidX", "CentroidY"), lambda c: dict.fromkeys(("CD8", "COX2", "NOS2"), "pheno_20230327_152849"), lambda column, marker: F.contains(_col(column), F.lit(marker + "+")), 0.15),
    Format("QuPath", lambda c: c[:4] == ["Image", "Class", f"Centroid X {MICRO}", f"Centroid Y {MICRO}"], lambda: _under(F.substring_index(_col("Image"), ".qptiff - ", -1)), (f"Centroid X {MICRO}", f"Centroid Y {MICRO}"), lambda c: {}, _signed, 0.15),
    Format("Steinbock", lambda c: "centroid-1" in c, lambda: F.lower(F.regexp_replace(_col("Image"), r"\.tiff$", "")), ("centroid-0", "centroid-1"), _prefixed(PREFIX), _signed, 0.15),
]


def detect(columns: list[str]) -> Format | None:
    """The first format whose telling columns are there; None if none is."""
    return next((f for f in FORMATS if f.detect(list(columns))), None)


def metadata(columns: list[str]) -> dict | None:
    """Format name, coordinate columns and markers, from column names alone."""
    found = detect(columns)
    if found is None:
        return None
    return {"format": found.name, "coordinates": list(found.coordinates), "markers": list(found.calls(list(columns)))}


def standardise(df: DataFrame, units: float = 1.0, pixel: float | Column | None = None, keep: list[str] = ()) -> DataFrame:
    """Any registered format as slide_id, roi_id, x, y and ``Phenotype <marker>`` calls, plus kept columns.

    Coordinates are multiplied by ``units`` and, where the format has a pixel
    size, cut to its grid. QuPath's class column is split into the markers that
    occur in it. An unknown format raises ValueError.
    """
    found = detect(df.columns)
    if found is None:
        raise ValueError("unknown format")
    if found.name == "QuPath":
        df = summaries.class_one_hot(df, "Class", "__call ")
        calls = {c.removeprefix("__call "): c for c in df.columns if c.startswith("__call ")}
    else:
        calls = found.calls(df.columns)
    if len(found.coordinates) == 4:
        df = spatial.centroid(df)
        x, y = F.col("x"), F.col("y")
    else:
        x, y = (_col(c).cast("double") for c in found.coordinates)
    step = pixel if pixel is not None else found.snap
    x, y = x * units, y * units
    if step is not None:
        x, y = numeric.truncate_to(x, step), numeric.truncate_to(y, step)
    image = found.image()
    roi = _col(found.roi) if found.roi and found.roi in df.columns else image
    marks = [F.when(F.coalesce(found.positive(c, m), F.lit(False)), "+").otherwise("-").alias(PREFIX + m) for m, c in calls.items()]
    return df.select(image.alias("slide_id"), roi.cast("string").alias("roi_id"), x.alias("x"), y.alias("y"), *marks, *[_col(c) for c in keep])


def calls_from_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({PREFIX + c: call_of(_col(c)) for c in columns})


def unify(df: DataFrame, image: list[str], x: str, y: str, phenotypes: dict[str, Column], units: float = 1.0, roi: list[str] | None = None, strip_path: bool = False) -> DataFrame:
    """The standardised file's columns: composite image (and ROI) ids, coordinates rounded to 0.2, phenotype calls."""
    out = [naming.composite_id(image, strip_path).alias("Image ID_(standardized)")]
    if roi:
        out.append(naming.composite_id(roi).alias("ROI ID_(standardized)"))
    for axis, c in (("X", x), ("Y", y)):
        out.append(numeric.round_to(_col(c) * units, 0.2).alias(f"Centroid {axis} ({MICRO})_(standardized)"))
    for name, call in phenotypes.items():
        clean = name.replace("+", "(plus)").replace("-", "(dash)")
        out.append(F.when(F.coalesce(call, F.lit(False)), "+").otherwise("-").alias("Phenotype_(standardized) " + clean))
    return df.select(*out)
