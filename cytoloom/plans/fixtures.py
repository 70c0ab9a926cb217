"""Views of the driver's tables as tables of the domain; in Spark and as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = ["R", "O", "D", "T"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells: whole-number coordinates in slides of suppliers, so that distances are exact."""
    c = table(spark, sf_dir, "lineitem")
    call = lambda test: F.when(F.expr(test), "+").otherwise("-")
    return c.select(
        F.col("l_suppkey").alias("slide_id"),
        F.expr("(l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey").alias("cell_id"),
        F.expr("cast((l_orderkey * 31 + l_linenumber * 17) % 1000 as double)").alias("x"),
        F.expr("cast((l_partkey * 13 + l_linenumber * 7) % 1000 as double)").alias("y"),
        F.concat("l_returnflag", "l_linestatus").alias("phenotype"),
        call("l_returnflag = 'R'").alias("Phenotype R"), call("l_linestatus = 'O'").alias("Phenotype O"), call("l_discount >= 0.05").alias("Phenotype D"), call("l_tax >= 0.04").alias("Phenotype T"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_linenumber").alias("line"),
    )


CELLS = """cells AS (
    SELECT l_suppkey AS slide_id, (l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey AS cell_id,
           CAST((l_orderkey * 31 + l_linenumber * 17) % 1000 AS DOUBLE) AS x, CAST((l_partkey * 13 + l_linenumber * 7) % 1000 AS DOUBLE) AS y,
           concat(l_returnflag, l_linestatus) AS phenotype,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS mr, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS mo,
           CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS md, CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS mt,
           l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_linenumber AS line
    FROM lineitem)"""

SPECIES = (
    CELLS
    + """, species AS (
    SELECT *, CAST(mr * 8 + mo * 4 + md * 2 + mt AS BIGINT) AS species_int,
           CASE WHEN mr + mo + md + mt = 0 THEN 'Other' ELSE concat_ws(' ', CASE WHEN mr = 1 THEN 'R+' END, CASE WHEN mo = 1 THEN 'O+' END, CASE WHEN md = 1 THEN 'D+' END, CASE WHEN mt = 1 THEN 'T+' END) END AS species_name_short,
           concat_ws(' ', CASE WHEN mr = 1 THEN 'R+' ELSE 'R-' END, CASE WHEN mo = 1 THEN 'O+' ELSE 'O-' END, CASE WHEN md = 1 THEN 'D+' ELSE 'D-' END, CASE WHEN mt = 1 THEN 'T+' ELSE 'T-' END) AS species_name_long
    FROM cells)"""
)
