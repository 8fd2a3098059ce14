"""Per-key results when a few keys hold most rows.

A sample names the heavy keys. Their rows meet the (small) heavy-key table in a
broadcast join that replaces the key by a slot number, and are reduced by
(slot, item) so that one key spreads over all tasks. All other keys take one
ordinary shuffle on the key. The two parts are then united. The sample decides
only which way a key takes, so results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: There are this many heavy keys at least before a key counts as light, and twice as many as shuffle partitions.
LEAST_HEAVY = 256
SAMPLE_FRACTION = 0.05
#: A key that is sampled less often is light: with so few rows it can't lengthen a task.
LEAST_SAMPLED = 20


def heavy_share(spark: SparkSession) -> float:
    """A key is heavy when it holds this share of the sampled rows: half a task's even share, so no light key makes a task much longer than the others."""
    return 1 / max(LEAST_HEAVY, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float | None = None, fraction: float = SAMPLE_FRACTION, seed: int = 17) -> DataFrame:
    """The keys that hold at least ``share`` (default ``heavy_share``) of a sample and LEAST_SAMPLED of its rows, each with an int ``_slot``: at most 1 / share rows.

    Only that bounded list is gathered. Rows with a null key are left out.
    """
    spark = df.sparkSession
    share = share or heavy_share(spark)
    seen = Observation()
    counts = df.select(*keys).dropna().sample(False, fraction, seed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("all"))
    top = counts.orderBy(F.desc("_n"), *keys).limit(max(1, int(1 / share))).collect()
    found = [r[:-1] for r in top if r["_n"] >= max(LEAST_SAMPLED, share * seen.get["all"])]
    schema = df.select(*keys).schema
    for f in schema.fields:
        f.nullable = True
    rows = sorted(found, key=lambda r: tuple(map(str, r)))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema.add("_slot", T.IntegerType()))


def distinct_counts(df: DataFrame, keys: Sequence[str], items: Mapping[str, str], rows: str | None = None, share: float | None = None, fraction: float = SAMPLE_FRACTION) -> DataFrame:
    """For each key the number of different non-null values of each item column.

    ``items`` maps result columns to item columns; ``rows`` names an optional
    column for the number of rows. Rows with a null in a key are left out. Other
    columns of ``df`` are ignored. An empty input gives an empty result.
    """
    used = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_i{i}") for i, c in enumerate(items.values())]).dropna(subset=[f"_k{i}" for i in range(len(keys))])
    ks = [f"_k{i}" for i in range(len(keys))]
    aggs = [F.count_distinct(f"_i{i}").alias(name) for i, name in enumerate(items)] + ([F.count(F.lit(1)).alias(rows)] if rows else [])
    heavy = heavy_keys(used, ks, share, fraction)
    spread = used.join(F.broadcast(heavy), ks).drop(*ks).groupBy("_slot").agg(*aggs)  # planned by Spark as (slot, item), then slot
    spread = spread.join(F.broadcast(heavy), "_slot")
    rest = used.join(F.broadcast(heavy.select(*ks)), ks, "left_anti").repartition(*ks).groupBy(*ks).agg(*aggs)
    out = [*[F.col(k).alias(name) for k, name in zip(ks, keys)], *items, *([rows] if rows else [])]
    return spread.select(*out).unionByName(rest.select(*out))
