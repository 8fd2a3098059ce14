"""Calibration curves and empirical interval coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.plans.quantiles import exact_quantiles
from partwise.plans.ranking import running_totals


def quantile_bins(df: DataFrame, scope: Sequence[str], value: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """``df`` with the 1-based bin of ``value`` between exact quantiles of its scope; bins are closed on the right, the least value is in the first. Repeated edges, ends included, are an error."""
    edges = exact_quantiles(df, scope, value, [i / bins for i in range(bins + 1)], "_all")
    differ = F.size(F.array_distinct("_all")) == F.size("_all")
    edges = edges.select(*scope, F.when(differ, F.slice("_all", 2, bins - 1)).otherwise(F.raise_error(F.lit(f"quantile edges of {value} repeat"))).alias("_edges"))
    return df.join(edges, list(scope)).withColumn(out, F.size(F.filter("_edges", lambda e: e < F.col(value))) + 1).drop("_edges")


def calibration_curve(per_record: DataFrame, bins: int = 10) -> DataFrame:
    """Per arm and bin of the prediction: records, mean and range of predictions, mean observation and bias."""
    b = quantile_bins(per_record, ["arm"], "prediction", bins, "decile")
    return b.groupBy("arm", "decile").agg(
        F.count(F.lit(1)).alias("n_records"), F.avg("prediction").alias("mean_prediction"), F.avg("observed").alias("mean_observed"), F.min("prediction").alias("least_prediction"), F.max("prediction").alias("largest_prediction"),
    ).withColumn("bias", F.col("mean_prediction") - F.col("mean_observed"))


def calibration_summary(per_record: DataFrame, bins: int = 10) -> DataFrame:
    """Per arm the regression of observation on prediction, their correlation, the bias, and the weighted absolute bias of the bins."""
    curve = calibration_curve(per_record, bins).groupBy("arm").agg((F.sum(F.abs("bias") * F.col("n_records")) / F.sum("n_records")).alias("weighted_absolute_bias"))
    fit = per_record.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_records"), F.regr_slope("observed", "prediction").alias("slope"), F.regr_intercept("observed", "prediction").alias("intercept"),
        F.corr("prediction", "observed").alias("pearson"), (F.avg("prediction") - F.avg("observed")).alias("bias"),
    )
    return fit.join(curve, "arm")


def upper_rank(n: Column, level: Column) -> Column:
    """Rank of the finite-sample upper quantile: the least of n and ceil((n + 1) level)."""
    return F.least(n, F.ceil((n + 1) * level.cast("double")).cast("long"))


def half_widths(residuals: DataFrame, scope: str, residual: str, levels: Sequence[float]) -> DataFrame:
    """(scope, level, n_calibration, half_width): the finite-sample quantile of the absolute residuals of each pool.

    Ranks come from the distributed ranking, so a pool never meets in one task. Pools
    without residuals have no row; null residuals are left out.
    """
    r = residuals.select(scope, F.abs(residual).alias("_r")).dropna().groupBy(scope, "_r").agg(F.count(F.lit(1)).alias("_c"))
    at = running_totals(r, [scope], [F.asc("_r")], ["_c"])  # equal residuals are one row, so order is unique
    per = at.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("_k", upper_rank(F.col("_c_total"), F.col("level")))
    here = per.filter((F.col("_k") <= F.col("_c_running")) & (F.col("_k") > F.col("_c_running") - F.col("_c")))
    return here.select(scope, "level", F.col("_c_total").alias("n_calibration"), F.col("_r").alias("half_width"))


def interval_rows(rows: DataFrame, widths: DataFrame, scope: str, levels: Sequence[float]) -> DataFrame:
    """Every row at every level with its half width, whether its error lies within (the bound included) and the interval's width."""
    each = rows.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("absolute_error", F.abs(F.col("prediction") - F.col("observed")))
    j = each.join(widths, [scope, "level"])
    return j.withColumn("covered", F.col("absolute_error") <= F.col("half_width")).withColumn("width", F.col("half_width") * 2)


def coverage(intervals: DataFrame, keys: Sequence[str] = (), gate: tuple[float, float] = (0.85, 0.95), gate_level: float = 0.9) -> DataFrame:
    """Per level (and keys): slots, coverage, its error against the level and the mean width; a level passes the gate unless it is the gate's and its coverage lies outside (ends are inside)."""
    c = intervals.groupBy("level", *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg("width").alias("mean_width"))
    return c.withColumn("calibration_error", F.col("coverage") - F.col("level")).withColumn("passes_gate", (F.col("level") != gate_level) | F.col("coverage").between(*gate))


def coverage_sensitivity(intervals: DataFrame) -> DataFrame:
    """Per level: pooled coverage, the least and largest of seeds and of blocks, and the means over equally weighted sources and blocks."""
    hit = F.col("covered").cast("double")
    out = intervals.groupBy("level").agg(F.avg(hit).alias("pooled"))
    for key in ("seed", "source", "block"):
        per = intervals.groupBy("level", key).agg(F.avg(hit).alias("c")).groupBy("level")
        out = out.join(per.agg(F.min("c").alias(f"least_{key}"), F.max("c").alias(f"largest_{key}"), F.avg("c").alias(f"equal_{key}")), "level")
    return out
