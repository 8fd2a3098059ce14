"""Resampling and cluster-robust inference over the cube of source errors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.functions.hashing import rng_seed
from partwise.operators.metrics import arm_gap
from partwise.plans.lineage import Scratch
from partwise.plans.quantiles import average_ranks, exact_quantiles


def student_t(p: float, df: int) -> float:
    """The p-quantile of Student's t, by bisection on the regularised incomplete beta function."""

    def cdf(t: float) -> float:
        x, a, b = df / (df + t * t), df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
        if x < (a + 1) / (a + b + 2):
            tail = front * _beta_fraction(x, a, b) / a
        else:
            tail = 1 - front * _beta_fraction(1 - x, b, a) / b
        return 1 - tail / 2 if t > 0 else tail / 2

    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def cells(cube: DataFrame) -> DataFrame:
    """Sum and number of source errors per (arm, seed, block): all that the bootstrap needs."""
    return cube.groupBy("arm", "seed", "block").agg(F.sum("source_mae").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))


def _draw(kind: str, salt: str):
    """A hash-based draw of one of ``m`` positions for (replicate, slot): the same in any engine with SHA-256."""
    key = F.concat(F.lit(f"{salt}|{kind}|"), F.col("replicate").cast("string"), F.lit("|"), F.col("slot").cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def bootstrap(cube: DataFrame, arms: tuple[str, str], replicates: int, salt: str = "bootstrap") -> DataFrame:
    """(replicate, one mean per arm, gap): blocks and seeds drawn with replacement, all pairs of draws, the mean over all source copies; arms share draws.

    A replicate is sums of S and N weighted by how often block and seed were drawn,
    so its cost is the number of cells, not of rows. Replicates are independent rows.
    """
    c = cells(cube)
    blocks = c.select("block").distinct().withColumn("i", F.row_number().over(Window.orderBy("block")) - 1)  # one row per block
    seeds = c.select("seed").distinct().withColumn("i", F.row_number().over(Window.orderBy("seed")) - 1)
    spark = cube.sparkSession

    def weights(kind: str, named: DataFrame, name: str) -> DataFrame:
        m = named.count()
        slots = spark.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot"))
        drawn = slots.select("replicate", (_draw(kind, salt) % m).cast("int").alias("i")).groupBy("replicate", "i").agg(F.count(F.lit(1)).alias(f"w_{name}"))
        return drawn.join(named, "i").drop("i")

    wb, ws = weights("block", blocks, "block"), weights("seed", seeds, "seed")
    w = F.col("w_block") * F.col("w_seed")
    per = wb.join(ws, "replicate").join(c, ["block", "seed"]).groupBy("replicate", "arm").agg((F.sum(w * F.col("s")) / F.sum(w * F.col("n"))).alias("m"))
    return arm_gap(per, "m", arms, ["replicate"])


def bootstrap_pcg(cube: DataFrame, arms: tuple[str, str], replicates: int, seed_material: object) -> pd.DataFrame:
    """The same with NumPy's PCG64 draws, on the driver: cells are gathered (arms x seeds x blocks) and replicates are vectorised."""
    c = cells(cube).toPandas()
    blocks, seeds = sorted(c["block"].unique()), sorted(c["seed"].unique())
    rng = np.random.Generator(np.random.PCG64(rng_seed(seed_material)))
    drawn = [(rng.choice(len(blocks), len(blocks)), rng.choice(len(seeds), len(seeds))) for _ in range(replicates)]
    wb = np.array([np.bincount(b, minlength=len(blocks)) for b, _ in drawn], float)
    ws = np.array([np.bincount(s, minlength=len(seeds)) for _, s in drawn], float)
    out = {"replicate": np.arange(replicates)}
    for arm in arms:
        t = c[c["arm"] == arm]
        grid = lambda v: t.pivot(index="block", columns="seed", values=v).reindex(index=blocks, columns=seeds).fillna(0).to_numpy()  # noqa: B023, E731
        out[f"{arm}_mae"] = np.einsum("rb,bs,rs->r", wb, grid("s"), ws) / np.einsum("rb,bs,rs->r", wb, grid("n"), ws)
    out["gap"] = out[f"{arms[0]}_mae"] - out[f"{arms[1]}_mae"]
    return pd.DataFrame(out)


def percentile_interval(replicates: DataFrame, value: str = "gap", threshold: float = 0.10) -> DataFrame:
    """Two-sided 95 % percentile interval, and whether the mean reaches the threshold and the lower end is above zero."""
    q = replicates.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.avg(value).alias("mean"))
    return q.withColumn("reaches_threshold", F.col("mean") >= threshold).withColumn("is_above_zero", F.col("low") > 0)


def cluster_robust(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean gap with its CR1 standard error over blocks, t statistic and interval with G - 1 degrees of freedom."""
    mean = effects.agg(F.avg("gap")).scalar()
    scores = effects.groupBy("block").agg(F.sum("gap").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("score", F.col("s") - F.col("n") * mean)
    t = scores.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("estimate"), F.sum(F.col("score") * F.col("score")).alias("ss"))
    se = F.sqrt(F.col("g") / (F.col("g") - 1) * F.col("ss") / (F.col("n") * F.col("n")))
    critical = _critical(alpha)(F.col("g"))
    out = t.select("estimate", se.alias("standard_error"), (F.col("g") - 1).alias("degrees_of_freedom"), critical.alias("critical_value"))
    return _with_interval(out).withColumn("t_statistic", F.col("estimate") / F.col("standard_error"))


def _critical(alpha: float):
    @F.pandas_udf("double")
    def critical(g: pd.Series) -> pd.Series:
        return g.map(lambda x: student_t(1 - alpha / 2, int(x) - 1) if x > 1 else float("nan"))

    return critical


def _with_interval(df: DataFrame) -> DataFrame:
    half = F.col("critical_value") * F.col("standard_error")
    return df.withColumn("low", F.col("estimate") - half).withColumn("high", F.col("estimate") + half)


def jackknife(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Delete-one-block estimate, error and interval, with the least and largest deletion; from block sums."""
    w = Window.partitionBy()  # one row per block
    b = effects.groupBy("block").agg(F.sum("gap").alias("s"), F.count(F.lit(1)).alias("n"))
    d = b.select(F.sum("s").over(w).alias("t"), F.sum("n").over(w).alias("m"), "s", "n").withColumn("theta", (F.col("t") - F.col("s")) / (F.col("m") - F.col("n")))
    out = d.agg(F.count(F.lit(1)).alias("g"), (F.max("t") / F.max("m")).alias("estimate"), F.sqrt((F.count(F.lit(1)) - 1) * F.var_pop("theta")).alias("standard_error"), F.min("theta").alias("least"), F.max("theta").alias("largest"))
    return _with_interval(out.withColumn("critical_value", _critical(alpha)(F.col("g")))).withColumn("degrees_of_freedom", F.col("g") - 1).drop("g")


def _half_sums(values: list[float]) -> np.ndarray:
    sums = np.zeros(1)
    for x in values:
        sums = np.concatenate([sums - x, sums + x])
    return np.sort(sums)


def sign_flip(contributions: DataFrame, tolerance: float = 1e-14, direct: int = 24, most: int = 50) -> DataFrame:
    """Exhaustive two-sided sign-flip test over block contributions: (observed, n_blocks, n_assignments, n_exceedances, p_value).

    Up to ``direct`` blocks the 2^G assignments are a range that tasks split, with the
    contributions (one per block) folded into the expression. Beyond that all sums of
    each half of the blocks are sorted, and each sum of the first half counts those of
    the second that carry it far enough: exact too, in 2^(G/2) numbers on the driver.
    """
    c = [r[0] for r in contributions.select("contribution").orderBy("block").collect()]  # one number per block
    if len(c) > most:
        raise ValueError(f"2^{len(c)} assignments are too many")
    total, observed = 1 << len(c), math.fsum(c)
    least = abs(observed) - tolerance
    spark = contributions.sparkSession
    if len(c) > direct:
        a, b = _half_sums(c[: len(c) // 2]), _half_sums(c[len(c) // 2 :])
        above = len(b) - np.searchsorted(b, least - a, "left")
        below = np.searchsorted(b, -least - a, "right")
        n = total if least <= 0 else int(above.sum() + below.sum())
        return spark.createDataFrame([(observed, len(c), total, n, n / total)], "observed double, n_blocks int, n_assignments long, n_exceedances long, p_value double")
    stat = F.lit(0.0)
    for i, x in enumerate(c):
        stat = stat + F.when(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1, F.lit(x)).otherwise(F.lit(-x))
    hits = spark.range(total).agg(F.count_if(F.abs(stat) >= least).alias("n_exceedances"))
    return hits.select(F.lit(observed).alias("observed"), F.lit(len(c)).alias("n_blocks"), F.lit(total).cast("long").alias("n_assignments"), "n_exceedances", (F.col("n_exceedances") / total).alias("p_value"))


def source_spearman(rows: DataFrame, least: int = 10) -> DataFrame:
    """Per arm the rank correlation of prediction and observation within each (seed, source) of at least ``least`` rows, averaged over sources, then seeds."""
    cell = ["arm", "seed", "source"]
    base = Scratch(rows.sparkSession, "spearman").write(rows.select(*cell, "prediction", "observed"))  # read five times
    r = average_ranks(average_ranks(base, cell, "prediction", "_rp"), cell, "observed", "_ro", base)
    per = r.groupBy("arm", "seed", "source").agg(F.count(F.lit(1)).alias("n"), F.corr("_rp", "_ro").alias("rho")).filter(F.col("n") >= least)
    return per.groupBy("arm", "seed").agg(F.avg("rho").alias("rho"), F.count("rho").alias("n_sources")).groupBy("arm").agg(F.avg("rho").alias("spearman"), F.max("n_sources").alias("n_sources"))


def risk_coverage(rows: DataFrame, scope: str, confidence: str, error: str, steps: int = 10) -> DataFrame:
    """(scope, coverage, risk): the mean error of the most confident tenth, two tenths, ... of each scope, from exact confidence quantiles."""
    cuts = exact_quantiles(rows, [scope], confidence, [i / steps for i in range(1, steps)], "_q")
    tagged = rows.join(cuts, scope).withColumn("_step", F.lit(steps) - F.size(F.filter("_q", lambda x: x < F.col(confidence))))
    per = tagged.groupBy(scope, "_step").agg(F.sum(error).alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(scope).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)  # `steps` rows
    whole = Window.partitionBy(scope)
    return per.select(scope, (F.sum("n").over(w) / F.sum("n").over(whole)).alias("coverage"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("risk"))


def holm(tests: DataFrame, p: str, family: str) -> DataFrame:
    """Holm-adjusted p values within each family: running maximum of (m - rank + 1) p, at most 1. A family is one set of hypotheses."""
    w = Window.partitionBy(family).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(family))
    step = tests.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn("p_holm", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_a")
