"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is reduced to its recipe: it is cut where its own content says so, every
chunk becomes an identifier, and two texts are equal when their ordered lists
of identifiers are. Identifiers are hashes that one distributed pass over the
distinct chunks has verified: no two different chunks carry the same. If some
did, the identifiers are widened and verified again. So texts are moved once,
as distinct chunks; later steps move 16 bytes a chunk, and of the documents
that go only the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stored, result, scratch, without

#: White space that equality ignores.
SPACE = " \t\n\x0b\x0c\r"

#: Chunks are cut in the bytes of UTF-8, so that texts of any script are cut by their content: a chunk ends behind a
#: byte of ``HEAD``, one to three others and a byte of ``TAIL`` that stand at least ``LEAST`` bytes into it, one place in
#: 21 where bytes are random, and after ``MOST`` bytes at the latest.
LEAST, MOST = 224, 4096
HEAD, TAIL = ("".join(rf"\x{b:02x}" for b in range(256) if b % 8 == rest) for rest in (5, 3))
CHUNKS = rf"(?s).{{{LEAST},{MOST - 5}}}?[{HEAD}].{{1,3}}[{TAIL}]|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:  # byte by byte in UTF-8; half the time of a regular expression
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def chunks(text: Column) -> Column:
    """Array of consecutive chunks, a character for each byte; joined, they are the bytes of the text."""
    return F.regexp_extract_all(F.decode(text.cast("binary"), "ISO-8859-1"), F.lit(CHUNKS), 0)


def identifier(chunk: Column, width: int, bits: int = 64) -> Column:
    """Array of ``width`` hashes. ``bits`` below 64 is for tests of the verification."""
    parts = [F.xxhash64(chunk) if k == 0 else F.xxhash64(F.lit(k), chunk) for k in range(width)]
    return F.array(*[p if bits >= 64 else F.pmod(p, F.lit(1 << bits)) for p in parts])


def collides(texts: DataFrame, width: int, bits: int = 64) -> bool:
    """Whether two different chunks of ``texts.norm`` share an identifier."""
    each = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    each = each.select(F.encode("chunk", "ISO-8859-1").alias("chunk"))
    distinct = each.select(identifier(F.col("chunk"), width, bits).alias("id"), "chunk").distinct()
    return not distinct.groupBy("id").count().where("count > 1").isEmpty()


def verified_width(texts: DataFrame, width: int = 2, bits: int = 64) -> int:
    """The smallest width, from ``width`` on, at which identifiers tell all chunks apart."""
    while collides(texts, width, bits):
        width += 1
    return width


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, bits: int = 64
) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after deleting ASCII white space. Of equal texts the
    row with the most code points stays, of those the one with the smallest id.
    Null text is empty text; all empty texts form one group. A null id sorts
    before others and is told from them. Repeated rows of the same id and text
    count each towards group_size and have the same verdict. Other columns,
    whatever their names, are not read. An empty table gives an empty result.
    """
    with scratch():
        return result(grouped(docs, id_col, text_col, width, bits), "exact")


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("raw"))
    rows = rows.withColumn("norm", normalised(F.col("raw")))
    width = verified_width(rows.select("norm"), width, bits)
    recipes = rows.select(
        "doc_id",
        F.coalesce(F.char_length("raw"), F.lit(0)).alias("points"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.flatten(F.transform(chunks(F.col("norm")), lambda c: identifier(F.encode(c, "ISO-8859-1"), width, bits))).alias("recipe"),
    )
    recipes = Stored(recipes, "recipes").df
    groups = recipes.groupBy("recipe").agg(
        F.min(F.struct((-F.col("points")).alias("fewer"), F.col("doc_id").alias("keep_id"))).alias("first"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # written, so that both sides of the join are shuffled for it and a group of very many copies can be split
    groups = Stored(groups.select(F.col("recipe").alias("of"), "first.keep_id", "group_size"), "groups").df
    return recipes.join(groups, F.col("recipe") == F.col("of")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whatever their columns are called; rows of one id are one document."""
    with scratch():
        return without(docs, grouped(docs, id_col, text_col, 2, 64), id_col)
