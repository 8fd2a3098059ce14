"""Grouped error metrics over long prediction tables.

Rows: arm, seed, fold, block, source, record_id, prediction, observed. Every
nested mean reads the cube of mean errors per (arm, seed, block, fold, source),
which is orders of magnitude smaller than the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.plans.quantiles import exact_quantiles

CELL = ("arm", "seed", "block", "fold", "source")


def with_errors(rows: DataFrame) -> DataFrame:
    e = F.col("prediction") - F.col("observed")
    return rows.withColumns({"signed_error": e, "absolute_error": F.abs(e), "squared_error": e * e})


def source_cube(rows: DataFrame) -> DataFrame:
    """Mean absolute error of each (arm, seed, block, fold, source)."""
    return with_errors(rows).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("absolute_error").alias("source_mae"))


def nested_mean(df: DataFrame, value: str, *levels: Sequence[str]) -> DataFrame:
    """The mean over each level's groups in turn: the last level is what remains."""
    for level in levels:
        df = df.groupBy(*level).agg(F.avg(value).alias(value))
    return df


def arm_gap(per_arm: DataFrame, value: str, arms: tuple[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """One column per arm and their difference (first less second)."""
    a, b = arms
    of = lambda x: F.max(F.when(F.col("arm") == x, F.col(value)))
    return per_arm.groupBy(*keys).agg(of(a).alias(f"{a}_mae"), of(b).alias(f"{b}_mae")).withColumn("gap", F.col(f"{a}_mae") - F.col(f"{b}_mae"))


def estimand_ladder(rows: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """Row, source and block means of the absolute error for each arm, averaged over seeds, and the gap of the arms."""
    cube = source_cube(rows)
    per_seed = ["arm", "seed"]
    whole = cube.groupBy(*per_seed).agg((F.sum(F.col("source_mae") * F.col("n_rows")) / F.sum("n_rows")).alias("mae"))
    steps = {
        "row_micro": whole.groupBy("arm").agg(F.avg("mae").alias("mae")),
        "source_macro": nested_mean(cube.withColumnRenamed("source_mae", "mae"), "mae", per_seed, ["arm"]),
        "block_macro": nested_mean(cube.withColumnRenamed("source_mae", "mae"), "mae", [*per_seed, "block"], per_seed, ["arm"]),
    }
    out = [arm_gap(df, "mae", arms).withColumn("estimand", F.lit(name)) for name, df in steps.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def by_seed(rows: DataFrame) -> DataFrame:
    """Per arm and seed: source-macro MAE and RMSE (root inside the source), row-micro MAE and RMSE, and median and quartile range of block MAEs."""
    e = with_errors(rows)
    s = e.groupBy("arm", "seed", "block", "source").agg(F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"))
    macro = s.groupBy("arm", "seed").agg(F.avg("mae").alias("source_macro_mae"), F.avg("rmse").alias("source_macro_rmse"))
    micro = e.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("absolute_error").alias("row_micro_mae"), F.sqrt(F.avg("squared_error")).alias("row_micro_rmse"))
    b = e.groupBy("arm", "seed", "block").agg(F.avg("absolute_error").alias("mae"))
    blocks = b.groupBy("arm", "seed").agg(F.median("mae").alias("block_median_mae"), (F.percentile("mae", 0.75) - F.percentile("mae", 0.25)).alias("block_iqr_mae"))
    return macro.join(micro, ["arm", "seed"]).join(blocks, ["arm", "seed"])


def per_group(rows: DataFrame, group: str) -> DataFrame:
    return with_errors(rows).groupBy("arm", group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"))


def stratified_arms(rows: DataFrame, keys: Sequence[str], arms: tuple[str, str]) -> DataFrame:
    """Per stratum and arm: records, MAE, bias and RMSE per seed and averaged over seeds, side by side, with the gap and absolute biases."""
    per_seed = with_errors(rows).groupBy("arm", "seed", *keys).agg(F.count_distinct("record_id").alias("n"), F.avg("absolute_error").alias("mae"), F.avg("signed_error").alias("bias"), F.sqrt(F.avg("squared_error")).alias("rmse"))
    mean = per_seed.groupBy("arm", *keys).agg(F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("mae", "bias", "rmse")])
    of = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}")
    wide = mean.groupBy(*keys).agg(*[of(c, a) for c in ("n", "mae", "bias", "rmse") for a in arms])
    a, b = arms
    return wide.withColumn("gap", F.col(f"mae_{a}") - F.col(f"mae_{b}")).withColumns({f"absolute_bias_{x}": F.abs(f"bias_{x}") for x in arms})


def seed_stability(rows: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """Per source the mean and sample deviation of the gap over seeds, and how many seeds are positive and negative."""
    gaps = arm_gap(source_cube(rows).groupBy("arm", "seed", "source").agg(F.avg("source_mae").alias("m")), "m", arms, ["source", "seed"])
    return gaps.groupBy("source").agg(F.avg("gap").alias("gap_mean"), F.stddev_samp("gap").alias("gap_sd"), F.count_if(F.col("gap") > 0).alias("n_positive"), F.count_if(F.col("gap") < 0).alias("n_negative"))


def paired_effects(rows: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """Seed-mean error of each (block, source) in both arms and their gap; sources that lack an arm are left out."""
    mean = source_cube(rows).groupBy("arm", "block", "source").agg(F.avg("source_mae").alias("m"))
    return arm_gap(mean, "m", arms, ["block", "source"]).filter("gap IS NOT NULL")


def block_contributions(effects: DataFrame) -> DataFrame:
    """Per block its sources, mean and summed gap, its share in the overall mean and whether its mean is positive."""
    per = effects.groupBy("block").agg(F.count(F.lit(1)).alias("n_sources"), F.avg("gap").alias("mean_gap"), F.sum("gap").alias("sum_gap"))
    total = effects.agg(F.count(F.lit(1))).scalar()
    return per.select("block", "n_sources", "mean_gap", "sum_gap", (F.col("sum_gap") / total).alias("contribution"), (F.col("mean_gap") > 0).alias("is_positive"))


def seed_means(rows: DataFrame, keys: Sequence[str], n_seeds: int) -> DataFrame:
    """Mean prediction over seeds per record, and whether all seeds are there."""
    return rows.groupBy(*keys).agg(F.avg("prediction").alias("prediction"), F.min("observed").alias("observed"), (F.count_distinct("seed") == n_seeds).alias("is_complete"))


def leave_one_out(cube: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """The source-macro gap without each block in turn, from sums: (total - block) / (n - n of block), never by re-aggregation."""
    cells = cube.groupBy("arm", "seed", "block").agg(F.sum("source_mae").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("arm", "seed")  # one row per block
    blocks = cells.select("*", (F.sum("s").over(w) - F.col("s")).alias("_s"), (F.sum("n").over(w) - F.col("n")).alias("_n"))
    left = blocks.filter("_n > 0").groupBy("arm", F.col("block").alias("omitted_block")).agg(F.avg(F.col("_s") / F.col("_n")).alias("m"))
    return arm_gap(left, "m", arms, ["omitted_block"])


def omit_largest(rows: DataFrame, arms: tuple[str, str], k: int = 3) -> DataFrame:
    """The source-macro gap without the k blocks of most rows (ties: the smaller block), with what remains."""
    cube = source_cube(rows)
    top = cube.groupBy("block").agg(F.sum("n_rows").alias("_n")).orderBy(F.desc("_n"), "block").limit(k).select("block")
    kept = cube.join(F.broadcast(top), "block", "left_anti")  # k rows
    gap = arm_gap(nested_mean(kept, "source_mae", ["arm", "seed"], ["arm"]), "source_mae", arms)
    rest = {"n_sources": F.count_distinct("source"), "n_blocks": F.count_distinct("block"), "n_rows": F.sum("n_rows")}
    return gap.withColumns({name: kept.agg(value).scalar() for name, value in rest.items()})


def concentration(sizes: DataFrame, scope: Sequence[str], size: str) -> DataFrame:
    """Per scope the number of groups, the largest and the three largest shares, the effective number of groups and the median size."""
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc(size)))
    top = sizes.select(*scope, size).withColumn("_r", rank).filter("_r <= 3").groupBy(*scope).agg(F.max(size).alias("_one"), F.sum(size).alias("_three"))
    all_ = sizes.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(size).alias("_s"), F.sum(F.col(size).cast("double") * F.col(size)).alias("_q"))
    all_ = all_.join(exact_quantiles(sizes, scope, size, [0.5]).select(*scope, F.col("q")[0].alias("median_size")), list(scope))
    return all_.join(top, list(scope)).select(*scope, "n_groups", (F.col("_one") / F.col("_s")).alias("largest_share"), (F.col("_three") / F.col("_s")).alias("top_three_share"), (F.col("_s") * F.col("_s") / F.col("_q")).alias("effective_groups"), "median_size")


def partition_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and pairwise Jaccard of two groupings of the same items, and how groups split and merge; from the contingency table alone."""
    c = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda x: F.sum(x * (x - 1) / 2)

    def side(key: str, p: str) -> DataFrame:
        groups = c.groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
        return groups.agg(two(F.col("n")).alias(f"pairs_{p}"), F.count_if(F.col("parts") > 1).alias(f"divided_{p}"), F.max("parts").alias(f"most_parts_{p}")).withColumn("_one", F.lit(1))

    all_ = c.agg(two(F.col("n")).alias("both"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("pairs")).withColumn("_one", F.lit(1))
    j = all_.join(side(a, "a"), "_one").join(side(b, "b"), "_one")  # three single rows
    expected, most = F.col("pairs_a") * F.col("pairs_b") / F.col("pairs"), (F.col("pairs_a") + F.col("pairs_b")) / 2
    union = F.col("pairs_a") + F.col("pairs_b") - F.col("both")
    return j.select(
        F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("adjusted_rand"), F.when(union == 0, 1.0).otherwise(F.col("both") / union).alias("pairwise_jaccard"),
        "divided_a", "most_parts_a", "divided_b", "most_parts_b",
    )


def best(df: DataFrame, group: Sequence[str], order: Sequence[Column], flag: str = "selected") -> DataFrame:
    """``df`` with a flag on the first row of each group in the given order (which must end in a unique key)."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def variant_deltas(df: DataFrame, keys: Sequence[str], variant: str, value: str, base: str, variants: Sequence[str]) -> DataFrame:
    """One column per variant, and the difference of each to the base variant; keys that lack a variant are left out."""
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(variant) == v, F.col(value))).alias(v) for v in variants]).dropna(subset=list(variants))
    return wide.withColumns({f"{v}_minus_{base}": F.col(v) - F.col(base) for v in variants if v != base})


def replicate_seeds(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Rows of a deterministic model once per seed."""
    return rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
