"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .arrowmap import map_lists
from .shared import Stored, beside, exists, result, scratch


def tokenizer_digest(path: str) -> str:
    """Names the version of a tokenizer by the bytes of its vocabulary file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens known for this tokenizer version; one row a digest."""
    if not exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    rows = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, path: str, cache: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, encoding only texts the cache lacks.

    The content is normalised by reading null as empty text and taking UTF-8
    bytes; anything further would change counts. Its SHA-256 and that of the
    vocabulary file are the cache's key. Of rows that share a missing digest
    the one of the smallest id is encoded, and its count appended to the
    Parquet folder ``cache``. Rows to encode, or where those are fewer the
    others, are joined to the texts by digest and id: while they are few the
    texts stay where they are, else texts are shuffled by both, so that a text
    with any number of copies makes no large task. Rows that repeat id and
    text are brought together first and encoded once. Two runs that append
    the same digest do no harm. Null ids are ids; repeated rows give repeated
    rows; other columns are not read; an empty table gives an empty result.
    """
    with scratch():
        return result(counted(docs, path, cache, limit, id_col, text_col), "token-counts")


def counted(docs: DataFrame, path: str, cache: str, limit: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keyed = Stored(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests").df
    pairs = Stored(keyed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "pairs").df
    firsts = pairs.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first"))
    misses = firsts.join(cached(spark, cache, version), "digest", "left_anti")
    misses = Stored(misses.select(F.col("digest").alias("missing"), F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("n")), "misses").df
    there, wanted, several = pairs.count(), *misses.agg(F.count(F.lit(1)), F.count_if(F.col("n") > 1)).first()
    here = (F.col("digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    if wanted <= there - wanted or several:
        texts = rows.join(beside(misses.where("n = 1")), here, "left_semi")
        if several:
            texts = texts.unionByName(rows.join(beside(misses.where("n > 1")), here, "left_semi").dropDuplicates(["digest"]))
    else:
        others = Stored(pairs.join(misses, here, "left_anti").select(F.col("digest").alias("missing"), F.col("doc_id").alias("first_id")), "others").df
        texts = rows.join(beside(others), here, "left_anti")
    texts = texts.select("digest", "text")

    def make():
        encoder = bpe.load(path)
        return lambda digests, texts: (digests, [encoder.count(t) for t in texts])

    new = map_lists(texts, make, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = Stored(cached(spark, cache, version), "counts").df  # so that the join can split a text of very many copies
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
