"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, htmltext, langid, lines, media, negatives, packing, quality, runs, simhash, tokencount, toxicity
from .arrowmap import map_lists
from .shared import delete, new_path


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file: in ``CYTOLOOM_TOKENIZERS``, or of the installed ``public_tokenizers``."""
    folder = os.environ.get("CYTOLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that what ran before does not change what it does."""
    cache = new_path(spark, "token-counts")
    try:
        return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), cache)
    finally:
        delete(spark, cache)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed (characters), removed ("start-end" joined by ";"), n_chars and text of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = lines.remove_repeats(docs)
    span = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    size = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", size.alias("n_removed"), F.concat_ws(";", span).alias("removed"), F.char_length("text").cast("long").alias("n_chars"), "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the texts, by h = crc32(doc_id), the words from one on repeat the first of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]))")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the texts, a tenth of them made periodic; the longest run, and digests of all runs and of what is left of the text."""
    found = runs.periodic_runs(made_periodic(table(spark, sf_dir, "documents")))
    longest = F.expr("reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (best, r) -> if(best is null or r.length > best.length, r, best))")
    lines_ = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines_, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the vectors whose id is divisible by 50; every seventh vector is relabelled first."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, F.pmod("id", F.lit(50)) == 0)


def queries() -> dict:
    every = [op1_exact_dedup, op2_bpe, op3_language_id, op4_html_extraction, op5_token_counts, op6_toxicity, op7_line_dedup, op8_packing, op9_media_columns, op10_simhash, op11_quality, op12_periodic_runs, op13_hard_negatives]
    return {f.__name__: f for f in every}


#: DuckDB SQL for a text with chr(1) where its units end.
MARKED = r"regexp_replace(regexp_replace(coalesce(text, ''), '([.!?…])([ \t\r\f\x{0B}\x{A0}])', '\1' || chr(1) || '\2', 'g'), '[\n。！？]', '\0' || chr(1), 'g')"

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, coalesce(length(text), 0) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
            FROM documents),
        groups AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM rows)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM groups""",
    "op7_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(%MARKED%, chr(1)) AS units FROM documents),
        units AS (
            SELECT doc_id, pos, units[pos] AS unit_text,
                   trim(regexp_replace(lower(units[pos]), '[\s\x{A0}\x{0B}]+', ' ', 'g')) AS unit,
                   coalesce(sum(length(units[pos])) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM (SELECT doc_id, units, unnest(range(1, len(units) + 1)) AS pos FROM docs)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 AS later,
                   row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, len(string_split(unit, ' ')) + len(regexp_extract_all(unit, '%UNSPACED%')) AS words
            FROM units WHERE unit <> ''),
        islands AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id, later ORDER BY nth) AS run FROM ranked),
        sized AS (SELECT *, sum(CASE WHEN words >= 5 THEN words ELSE 0 END) OVER (PARTITION BY doc_id, later, run) AS in_run FROM islands),
        gone AS (SELECT doc_id, pos, start, start + length(unit_text) AS stop FROM sized WHERE later AND in_run >= 25),
        edges AS (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY doc_id ORDER BY start) = start THEN 0 ELSE 1 END AS opens FROM gone),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM edges),
        spans AS (SELECT doc_id, span, min(start) AS a, max(stop) AS b FROM numbered GROUP BY doc_id, span),
        lost AS (SELECT doc_id, sum(b - a) AS n_removed, string_agg(a::BIGINT || '-' || b::BIGINT, ';' ORDER BY a) AS removed FROM spans GROUP BY doc_id),
        kept AS (
            SELECT doc_id, string_agg(unit_text, '' ORDER BY pos) AS text
            FROM units WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM gone) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, length(coalesce(text, ''))::BIGINT AS n_chars, coalesce(text, '') AS text
        FROM (SELECT doc_id FROM documents) LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)""".replace("%MARKED%", MARKED).replace("%UNSPACED%", lines.UNSPACED),
    "op12_periodic_runs": r"""
        WITH given AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS said,
                   xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
                       lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295) AS h
            FROM documents),
        placed AS (SELECT *, len(said) AS n, h // 10 AS g, CASE WHEN len(said) > 0 THEN (h // 10) % len(said) END AS a FROM given),
        periodic AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        docs AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: said[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE said END AS words FROM periodic),
        words AS (SELECT doc_id, i, words[i + 1] AS word FROM (SELECT doc_id, words, unnest(range(0, len(words))) AS i FROM docs)),
        equal_ AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
        islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal_),
        periods AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q),
        found AS (
            SELECT doc_id, start, length, q AS period FROM periods r
            WHERE length >= 12 AND NOT EXISTS (SELECT 1 FROM periods s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM found),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_ FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        best AS (
            SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS runs,
                   first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS b
            FROM found GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
               (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(left_, '')) AS collapsed_sha256
        FROM docs LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_hard_negatives": r"""
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
        pairs AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN pairs USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
