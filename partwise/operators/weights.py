"""Group-balanced weights and scalers whose statistics come from training rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.cleaning import is_finite
from partwise.plans.quantiles import exact_quantiles


def balanced_weights(rows: DataFrame, record: str, source: str, component: str) -> DataFrame:
    """(record, source, component, weight): n / (S C_s n_sc), so that the mean is 1 and every source has the same total, split evenly over its components."""
    r = rows.select(record, source, component).dropna()
    cell = r.groupBy(source, component).agg(F.count(F.lit(1)).alias("n_sc"))
    per = cell.groupBy(source).agg(F.count(F.lit(1)).alias("c_s"), F.sum("n_sc").alias("n_s"))
    n, s = per.agg(F.sum("n_s")).scalar(), per.agg(F.count(F.lit(1))).scalar()
    w = cell.join(per, source).select(source, component, (n / (s * F.col("c_s") * F.col("n_sc"))).alias("weight"))
    return r.join(w, [source, component]).select(record, source, component, "weight")


def weight_checks(weighted: DataFrame, source: str, weight: str, tolerance: float = 1e-9) -> DataFrame:
    """(has_mean_one, n_sources_off): whether weights average 1, and how many sources' totals differ from an even share; relative to the tolerance."""
    per = weighted.groupBy(source).agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_n"))
    whole = per.agg(F.sum("_t").alias("_all"), F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_s"))
    share = F.col("_all") / F.col("_s")
    return per.join(whole).agg((F.abs(F.max("_all") / F.max("_rows") - 1) <= tolerance).alias("has_mean_one"), F.count_if(F.abs(F.col("_t") - share) > share * tolerance).alias("n_sources_off"))


def fit_scaler(train: DataFrame, columns: Sequence[str], infinite_is_missing: bool = True, most_missing: float = 0.5) -> DataFrame:
    """(column, n, missing_share, median, mean, sd, active): statistics of the training rows after median imputation.

    A column is inactive when more than ``most_missing`` of it is missing or its
    population variance is not above 0. Two passes: medians, then moments.
    """
    ok = (lambda c: is_finite(c)) if infinite_is_missing else (lambda c: F.col(c).isNotNull() & ~F.isnan(c))
    x = train.select(*[F.when(ok(c), F.col(c).cast("double")).alias(c) for c in columns])
    long = x.unpivot([], list(columns), "column", "x")
    medians = exact_quantiles(long, ["column"], "x", [0.5]).select("column", F.col("q")[0].alias("median"))
    first = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), (1 - F.count("x") / F.count(F.lit(1))).alias("missing_share")).join(medians, "column", "left")
    filled = long.join(F.broadcast(first.select("column", "median")), "column").withColumn("x", F.coalesce("x", "median"))  # one row per column
    second = filled.groupBy("column").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    active = F.coalesce((F.col("missing_share") <= most_missing) & (F.col("sd") > 0), F.lit(False))
    return first.join(second, "column").withColumn("active", active).select("column", "n", "missing_share", "median", "mean", "sd", "active")


def apply_scaler(rows: DataFrame, keys: Sequence[str], scaler: DataFrame, policy: str = "keep", infinite_is_missing: bool = True, unscaled: Sequence[str] = ()) -> DataFrame:
    """z scores with training statistics; inactive columns are 0 under ``keep`` and absent under ``drop``; ``unscaled`` (binary) columns pass as they are.

    Statistics are gathered: one row per column.
    """
    if policy not in ("keep", "drop"):
        raise ValueError("policy is keep or drop")
    ok = (lambda c: is_finite(c)) if infinite_is_missing else (lambda c: F.col(c).isNotNull() & ~F.isnan(c))
    out = []
    for r in sorted(scaler.collect(), key=lambda r: r["column"]):
        c = r["column"]
        if c in unscaled:
            out.append(F.col(c).cast("double").alias(c))
        elif r["active"]:
            out.append(((F.when(ok(c), F.col(c).cast("double")).otherwise(F.lit(r["median"])) - r["mean"]) / r["sd"]).alias(c))
        elif policy == "keep":
            out.append(F.lit(0.0).alias(c))
    return rows.select(*keys, *out)
