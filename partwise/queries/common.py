"""Shared inputs of the queries and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARMS = ("joint", "random")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Doubles rounded, since engines add in different orders; negative zero becomes zero."""
    return df.withColumns({c: F.round(c, decimals) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def sql_round(columns: Sequence[str], decimals: int = 6) -> str:
    return "REPLACE (" + ", ".join(f"round({c}, {decimals}) AS {c}" for c in columns) + ")"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A long prediction table from the star schema: lines are records, nations sources, regions blocks, and two expressions the arms."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    nations = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed tables
    places = table(spark, sf, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("source"), F.col("r_name").alias("block"), (F.col("n_regionkey") + 1).alias("fold"))
    arms = F.array(F.struct(F.lit(ARMS[0]).alias("arm"), (F.col("l_extendedprice") / 20000).alias("prediction")), F.struct(F.lit(ARMS[1]).alias("arm"), (F.col("l_extendedprice") / 40000 + F.col("l_quantity") * 0.05).alias("prediction")))
    j = li.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_id"), F.explode(arms).alias("a"), (F.col("l_linenumber") % 5).alias("seed"), "fold", "block", "source",
        (F.col("l_quantity") / 10).alias("observed"), (1 - F.col("l_discount")).alias("confidence"),
    ).select("record_id", "a.arm", "seed", "fold", "block", "source", "a.prediction", "observed", "confidence")


PREDICTIONS = """p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id, x.arm, l_linenumber % 5 AS seed, n_regionkey + 1 AS fold, r_name AS block, n_name AS source,
  CASE x.arm WHEN 'joint' THEN l_extendedprice / 20000 ELSE l_extendedprice / 40000 + l_quantity * 0.05 END AS prediction, l_quantity / 10 AS observed, 1 - l_discount AS confidence
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('joint'), ('random')) x(arm)),
e AS (SELECT *, prediction - observed AS signed_error, abs(prediction - observed) AS absolute_error FROM p),
cube AS (SELECT arm, seed, block, fold, source, count(*) AS n_rows, avg(absolute_error) AS source_mae FROM e GROUP BY ALL)"""


def sql_gap(table: str, value: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"SELECT {k}max(CASE WHEN arm = 'joint' THEN {value} END) AS joint_mae, max(CASE WHEN arm = 'random' THEN {value} END) AS random_mae, max(CASE WHEN arm = 'joint' THEN {value} END) - max(CASE WHEN arm = 'random' THEN {value} END) AS gap FROM {table}{g}"
