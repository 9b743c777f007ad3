"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that DuckDB can run for it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def codes(flag: Column) -> Column:
    """Classes of the flag columns: A, F: 0; N, O: 1; R, P: 2."""
    return F.when(flag.isin("A", "F"), 0).when(flag.isin("N", "O"), 1).otherwise(2)


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels: gt is the return flag's class, pred the line status'; x, y, image and a value."""
    df = table(spark, sf_dir, "lineitem")
    return df.select(F.col("l_orderkey").alias("image"), codes(F.col("l_returnflag")).alias("gt"), codes(F.col("l_linestatus")).alias("pred"), F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"))


LINES = """
lines AS (
    SELECT l_orderkey AS image, CASE WHEN l_returnflag IN ('A', 'F') THEN 0 WHEN l_returnflag IN ('N', 'O') THEN 1 ELSE 2 END AS gt,
           CASE WHEN l_linestatus IN ('A', 'F') THEN 0 WHEN l_linestatus IN ('N', 'O') THEN 1 ELSE 2 END AS pred,
           l_quantity AS x, round(l_discount * 100) AS y
    FROM lineitem
)"""

COUNTS = """
sides AS (
    SELECT *, pred AS cls, 1 AS p, 0 AS g FROM lines UNION ALL SELECT *, gt AS cls, 0 AS p, 1 AS g FROM lines
)"""
SUMS = "CAST(sum(CASE WHEN p = 1 AND pred = gt THEN 1 ELSE 0 END) AS BIGINT) AS inter, CAST(sum(p) AS BIGINT) AS pred_sum, CAST(sum(g) AS BIGINT) AS gt_sum"


def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, v) with v from 0 to 255: three images made of lineitem, with holes and different contents."""
    img, x = (F.col("l_suppkey") % 3).cast("int").alias("img"), F.col("l_quantity").cast("int").alias("x")
    cells = table(spark, sf_dir, "lineitem").groupBy(img, x, F.col("l_linenumber").alias("y")).agg(F.sum("l_extendedprice").alias("s"))
    return cells.select("img", "x", "y", F.pmod(F.floor(F.round("s", 2)), F.lit(256)).cast("bigint").alias("v"))


GRID = """
grid AS (
    SELECT CAST(l_suppkey % 3 AS INTEGER) AS img, CAST(l_quantity AS INTEGER) AS x, l_linenumber AS y, CAST(floor(round(sum(l_extendedprice), 2)) AS BIGINT) % 256 AS v
    FROM lineitem GROUP BY 1, 2, 3
)"""
WIDTH, HEIGHT = 51, 8
