"""Substring deduplication by hashing lines and their sentences.

Units are lines, cut further where sentences end, so that a passage repeats
even where the rest of its line differs. Their white space is
collapsed and their letters lowered, 128 bits of hash stand for what is left,
and of all units with one digest the earliest, by document id and place, stays.
Further ones go if the run of consecutive repeated units they belong to has at
least ``LEAST`` words in units of ``TELLING`` words or more: a short sentence
amid a long repeated passage goes with it, and no number of short sentences
that many documents happen to share makes a passage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import map_lists
from .shared import Stored, beside, result, scratch

#: Words of a run of repeated units from which it goes, and words from which a unit counts towards them.
LEAST, TELLING = 25, 5
#: White space within lines; what ends a sentence where white space follows, and where nothing need.
BLANKS, ENDS, WIDE_ENDS = " \t\r\f\x0b\xa0", ".!?…", "。！？"
#: Stands between units; where a text holds it itself, a unit ends too.
MARK = "\x01"
#: Scripts without spaces between words, whose characters count as words.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]"
#: A unit in a text as it is; joined, units are the text.
UNIT = re.compile(rf"(?s).*?(?:[{ENDS}](?=[{BLANKS}])|[\n{WIDE_ENDS}{MARK}])|.+")


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:  # byte by byte in UTF-8, many times faster than a regular expression
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def split(text: Column) -> Column:
    """The units of a text, in lower case and with one space for white space."""
    text = replaced(F.lower(text), [(c, " ") for c in BLANKS[1:]])
    text = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    marked = replaced(text, [(f"{c} ", f"{c}{MARK} ") for c in ENDS] + [(c, f"{c}{MARK}") for c in "\n" + WIDE_ENDS])
    return F.transform(F.split(marked, MARK), lambda unit: F.trim(unit, F.lit(" \n")))


def words(unit: Column) -> Column:
    """Words between spaces, and characters of scripts that have none."""
    characters = F.when(F.octet_length(unit) > F.char_length(unit), F.regexp_count(unit, F.lit(UNSPACED))).otherwise(0)
    return F.char_length(unit) - F.char_length(F.replace(unit, F.lit(" "), F.lit(""))) + 1 + characters


def units(docs: DataFrame) -> DataFrame:
    """doc_id, version, pos (among the units with words), at (among all), words, a, b of the units of doc_id, text, version that hold words."""
    found = F.transform(split(F.col("text")), lambda unit, at: F.struct(at.alias("at"), unit.alias("unit")))
    rows = docs.select("doc_id", "version", F.posexplode(F.filter(found, lambda x: x["unit"] != "")).alias("pos", "x"))
    rows = rows.select("doc_id", "version", "pos", "x.at", "x.unit")
    return rows.select("doc_id", "version", "pos", "at", words(F.col("unit")).alias("words"), F.xxhash64("unit").alias("a"), F.xxhash64(F.lit(1), "unit").alias("b"))


def repeated(units: DataFrame, least: int = LEAST, telling: int = TELLING) -> DataFrame:
    """doc_id, version, removed: places of the units that go, for documents that lose any."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "pos")
    firsts = units.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = Stored(firsts.select("a", "b", "first"), "firsts").df  # so that the join can split a very common unit
    later = units.withColumn("place", place).join(firsts, ["a", "b"]).where("place <> first")
    later = later.select("doc_id", "version", "pos", "at", "words").distinct()
    own = Window.partitionBy("doc_id", "version")
    later = later.withColumn("run", F.col("pos") - F.row_number().over(own.orderBy("pos")))
    weight = F.when(F.col("words") >= telling, F.col("words")).otherwise(0)
    later = later.withColumn("in_run", F.sum(weight).over(Window.partitionBy("doc_id", "version", "run"))).where(F.col("in_run") >= least)
    return later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list("at")).alias("removed"))


def cut(text: str, removed: list[int] | None) -> tuple[str, list[dict]]:
    """The text without those units, and where they stood in it: code points from start up to end."""
    if not removed:
        return text, []
    gone, kept, spans, at = set(removed), [], [], 0
    for k, unit in enumerate(UNIT.findall(text)):
        if k not in gone:
            kept.append(unit)
        elif spans and spans[-1]["end"] == at:
            spans[-1]["end"] = at + len(unit)
        else:
            spans.append({"start": at, "end": at + len(unit)})
        at += len(unit)
    return "".join(kept), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, spans: str = "removed_spans") -> DataFrame:
    """``docs`` with repeated passages removed from their texts, and where they were as array<struct<start,end>>.

    All columns are carried, whatever their names. Null text stays null and
    loses nothing. Null ids rank last. Rows of one id with different texts are
    ranked by a hash of those; rows that repeat id and text are one document
    and lose the same. Documents that lose all stay, with empty text. Units
    without words are passed over: they neither repeat nor end a run, and
    stay. An empty table gives an empty result. ``spans`` must not be a column
    already.
    """
    if spans in docs.columns:
        raise ValueError(f"there is a column {spans}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    with scratch():
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
        found = repeated(Stored(units(rows.withColumn("version", F.xxhash64("text"))), "units").df, least)
        found = beside(result(found.select(F.col("doc_id").alias("of"), "version", "removed"), "repeats"), F.size("removed"))
    # columns go by number meanwhile, so that no name clashes with what is joined
    numbered = docs.select(*[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(docs.columns)], F.xxhash64(text).alias("key"))
    at, of = docs.columns.index(text_col), docs.columns.index(id_col)
    joined = numbered.join(found, F.col(f"`{of}`").eqNullSafe(F.col("of")) & (F.col("key") == F.col("version")), "left").drop("key", "of", "version")

    def make():
        def step(*columns):
            done = [(t, []) if t is None else cut(t, r) for t, r in zip(columns[at], columns[-1])]
            return *columns[:at], [t for t, _ in done], *columns[at + 1 : -1], [s for _, s in done]

        return step

    return map_lists(joined, make, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes) + f", `{spans}` array<struct<start:int,end:int>>")
