"""Baseline learners over feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_mean(train: DataFrame, test: DataFrame, scope: Sequence[str], target: str) -> DataFrame:
    """``test`` with the mean training target of its scope as prediction; null where a scope has no training rows."""
    m = train.groupBy(*scope).agg(F.avg(target).alias("prediction"))
    return test.join(m, list(scope), "left")


def ridge(train: DataFrame, features: Sequence[str], target: str, alpha: float):
    """Linear regression with an L2 penalty alpha beside the sum of squares; no standardisation.

    Spark's objective is per row and in units of the target's deviation, so its
    parameter is alpha times that deviation over the number of rows.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train)
    n, deviation = train.agg(F.count(F.lit(1)), F.stddev_pop(target)).first()
    return LinearRegression(featuresCol="_x", labelCol=target, regParam=alpha * (deviation or 1.0) / max(1, n), elasticNetParam=0.0, standardization=False, solver="normal").fit(x)


def forest(train: DataFrame, features: Sequence[str], target: str, trees: int, depth: int, seed: int):
    """A random forest of regression trees. Spark's split search is its own, so numbers differ from other libraries."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train)
    return RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(x)


def boosted(train: DataFrame, features: Sequence[str], target: str, rounds: int, depth: int, step: float, seed: int):
    """Gradient-boosted regression trees. Spark's split search is its own, so numbers differ from other libraries."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = VectorAssembler(inputCols=list(features), outputCol="_x").transform(train)
    return GBTRegressor(featuresCol="_x", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(x)


#: The grid of each family: configuration id to parameters. Penalties are the fixed grid; trees are sized for Spark's learners.
GRID = {
    "ridge": {f"ridge_alpha_{a:g}": {"alpha": a} for a in (0.01, 0.1, 1.0, 10.0, 100.0)},
    "forest": {f"forest_depth_{d}_trees_{n}": {"depth": d, "trees": n} for d in (3, 5) for n in (10, 20)},
    "boosted": {f"boosted_depth_{d}_rounds_{n}": {"depth": d, "rounds": n, "step": 0.1} for d in (2, 3) for n in (5, 10)},
}


def grid_errors(train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, grid: Mapping[str, Mapping[str, Mapping[str, float]]] = GRID, seed: int = 123) -> DataFrame:
    """(family, config_id, cost_rank, mae, rmse): the validation errors of every configuration, fitted to the training rows.

    Configurations are few and fitted one after the other, each by distributed
    learners; ``cost_rank`` is the place in the grid of its family.
    """
    spark = train.sparkSession
    fits = {"ridge": lambda c: ridge(train, features, target, c["alpha"]), "forest": lambda c: forest(train, features, target, int(c["trees"]), int(c["depth"]), seed), "boosted": lambda c: boosted(train, features, target, int(c["rounds"]), int(c["depth"]), c["step"], seed)}
    rows = []
    for family, configs in grid.items():
        for rank, (name, c) in enumerate(configs.items(), 1):
            d = F.col("prediction") - F.col(target)
            mae, mse = predict(fits[family](c), validation, features, [target]).agg(F.avg(F.abs(d)), F.avg(d * d)).first()
            rows.append((family, name, rank, float(mae), float(mse) ** 0.5))
    return spark.createDataFrame(rows, "family string, config_id string, cost_rank int, mae double, rmse double")


def predict(model, rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return model.transform(VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)).select(*keys, "prediction")


def assemble_oof(winners: DataFrame, predictions: DataFrame) -> DataFrame:
    """Out-of-fold rows of the winning (family, config) of each fold. ``winners``: outer_fold, family, config_id; one per fold."""
    return predictions.join(winners.select("outer_fold", "family", "config_id"), ["outer_fold", "family", "config_id"])


def oof_problems(oof: DataFrame, population: DataFrame, record: str, metadata: Sequence[str], observed: str, tolerance: float = 1e-12) -> DataFrame:
    """(problem, n) of assembled out-of-fold rows against the population: records missing, repeated or unknown, metadata that differs, observations that differ. Problems without a case have n 0."""
    p = population.select(record, *[F.col(c).alias(f"_p{i}") for i, c in enumerate(metadata)], F.col(observed).alias("_po"), F.lit(True).alias("_in"))
    o = oof.select(record, *metadata, observed, F.lit(True).alias("_out"))
    j = o.join(p, record, "full")
    both = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    other = F.lit(False)
    for i, c in enumerate(metadata):
        other |= ~F.col(c).eqNullSafe(F.col(f"_p{i}"))
    seen = o.groupBy(record).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("repeated"))
    one = j.agg(
        F.count_if(F.col("_out").isNull()).alias("missing"), F.count_if(F.col("_in").isNull()).alias("unknown"), F.count_if(both & other).alias("metadata"),
        F.count_if(both & ~F.coalesce(F.abs(F.col(observed) - F.col("_po")) <= tolerance, F.col(observed).isNull() & F.col("_po").isNull())).alias("observed"),
    ).join(seen)  # one row each
    return one.unpivot([], ["missing", "unknown", "repeated", "metadata", "observed"], "problem", "n")


def best_epochs(losses: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Per scope the rounded-up median of the best epochs of its runs; a run's best epoch has the least loss, ties the earliest."""
    b = losses.groupBy(*keys, *scope).agg(F.min(F.struct("loss", "epoch")).alias("m")).select(*scope, F.col("m.epoch").alias("epoch"))
    return b.groupBy(*scope).agg(F.ceil(F.median("epoch")).alias("epochs"), F.count(F.lit(1)).alias("n_runs"))
