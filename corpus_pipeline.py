"""A corpus pipeline of the text operators: toxic documents, exact and near copies and repeated passages go, what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.llm import exact, lines, packing, similar, toxicity
from cytoloom.llm.queries import vocabulary
from cytoloom.llm.shared import Stored, scratch


#: Bytes of words that a packing task keeps in each of two generations, half of the operator's own: the heaps of the stages before stand beside it.
WORDS_KEPT = 24 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 or more of their shingles of five words."""
    return similar.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has; n_chars follows the text."""
    cut = lines.remove_repeats(docs, spans="__spans")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 2048, kept=WORDS_KEPT)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents, each written to the shared folder and read again; only the last one's table stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch():
        for name, stage in STAGES:
            docs = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), lasting=name == STAGES[-1][0]).df
    return docs
