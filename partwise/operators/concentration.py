"""Ranked group sizes with shares, whatever the group sizes are, and their audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.plans.ranking import running_totals
from partwise.plans.skew import distinct_counts


def ranked_sizes(df: DataFrame, scope: Sequence[str], key: str, item: str, extra: Mapping[str, str] | None = None, size: str = "n_records") -> DataFrame:
    """For each scope and key the number of different items, its rank, its share and the cumulative share.

    Keys rank by size downwards, then by key upwards; shares refer to the sum of
    sizes in the scope. ``extra`` maps further result columns to columns whose
    different values are counted. Rows with a null item, key or scope are left
    out, so a key without items has no row. Repeated rows count once. An empty
    input gives an empty result; other columns are ignored.
    """
    counted = distinct_counts(df.filter(F.col(item).isNotNull()), [*scope, key], {size: item, **(extra or {})})
    ranked = running_totals(counted, scope, [F.desc(size), F.asc(key)], [size], "block_rank")
    return ranked.select(
        *scope, key, size, *(extra or {}), F.col("block_rank"),
        (F.col(size) / F.col(f"{size}_total")).alias("record_share"),
        (F.col(f"{size}_running") / F.col(f"{size}_total")).alias("cumulative_record_share"),
    )


def size_conflicts(expected: DataFrame, stored: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys whose stored size or cumulative share is absent, unfounded or wrong; every key once.

    ``stored`` may hold a key several times; one wrong row is enough. Stored rows
    with a null in a key name no block and are ignored.
    """
    s = stored.select(*keys, F.col("n_records").alias("_n"), F.col("cumulative_record_share").alias("_c")).dropna(subset=list(keys))
    e = expected.select(*keys, F.col("n_records").alias("_en"), F.col("cumulative_record_share").alias("_ec"))
    both = e.join(s, list(keys), "full")
    wrong = F.col("_en").isNull() | F.col("_n").isNull() | F.col("_c").isNull() | (F.col("_n") != F.col("_en")) | F.isnan("_c") | (F.abs(F.col("_c") - F.col("_ec")) > tolerance)
    return both.filter(wrong).select(*keys).distinct()
