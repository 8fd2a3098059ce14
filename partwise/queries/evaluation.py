"""Error metrics, partitions of errors, calibration, coverage, inference, weights and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.functions.hashing import array_hash, double_hex, hex_double
from partwise.functions.text import plain_id, plain_words, sql_plain_id, sql_plain_words
from partwise.operators import calibration as cal
from partwise.operators import inference as inf
from partwise.operators import metrics as m
from partwise.operators import models, weights
from partwise.plans import contracts
from partwise.plans.lineage import Scratch
from partwise.queries.common import ARMS, PREDICTIONS, predictions, rounded, sql_gap, sql_round, table

LEVELS = (0.5, 0.8, 0.9)
EFFECTS = f"""eff AS ({sql_gap("(SELECT arm, block, source, avg(source_mae) AS v FROM cube GROUP BY ALL)", "v", "block, source")})"""


def metrics_estimand_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.estimand_ladder(predictions(spark, sf), ARMS))


def metrics_source_cube(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.source_cube(predictions(spark, sf)))


def metrics_by_seed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.by_seed(predictions(spark, sf)))


def metrics_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.per_group(predictions(spark, sf), "source"))


def metrics_per_block(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.per_group(predictions(spark, sf), "block"))


def metrics_stratified_arms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.stratified_arms(predictions(spark, sf), ["source", "block"], ARMS))


def metrics_seed_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.seed_stability(predictions(spark, sf), ARMS))


def metrics_paired_effects(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.paired_effects(predictions(spark, sf), ARMS))


def metrics_block_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.block_contributions(m.paired_effects(predictions(spark, sf), ARMS)))


def metrics_seed_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 5).alias("seed"), F.ln(F.col("l_extendedprice")).alias("prediction"), (F.col("l_quantity") / 10).alias("observed"))
    return rounded(m.seed_means(rows, ["part"], 5))


def metrics_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.leave_one_out(m.source_cube(predictions(spark, sf)), ARMS))


def metrics_omit_largest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(m.omit_largest(predictions(spark, sf), ARMS))


def metrics_concentration(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "block_definition_ranked_sizes").select("assignment_run_id", "tanimoto_threshold", "sealed_block_id", "n_records").dropna().distinct()
    return rounded(m.concentration(s, ["assignment_run_id", "tanimoto_threshold"], "n_records"))


def metrics_partition_agreement(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "split_manifest_public").select("curated_id", "source", "analogue_component_id").dropna().distinct()
    return rounded(m.partition_agreement(s, "source", "analogue_component_id"))


def metrics_duplicate_slots(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.duplicates(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def metrics_top_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The ten sources of largest error in each arm's first seed: a top-k report."""
    c = m.source_cube(predictions(spark, sf)).filter("seed = 0").groupBy("source").agg(F.max("source_mae").alias("worst"), F.max_by("arm", F.struct("source_mae", "arm")).alias("worst_arm"))
    return rounded(c.orderBy(F.desc("worst"), "source").limit(10))


def metrics_variant_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of return flags as variants, per ship year, against one of them."""
    li = table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("fold"), F.col("l_returnflag").alias("variant")).agg(F.avg(F.abs(F.col("l_discount") - F.col("l_tax"))).alias("mae"))
    return rounded(m.variant_deltas(li, ["fold"], "variant", "mae", "A", ["A", "N", "R"]))


def metrics_replicated_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """A deterministic prediction counted once per seed."""
    p = predictions(spark, sf).filter("arm = 'joint'").drop("seed")
    return rounded(m.replicate_seeds(p, range(5)).groupBy("seed", "block").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction")))


def metrics_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.source_spearman(predictions(spark, sf)))


def metrics_risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = m.with_errors(predictions(spark, sf)).withColumn("doubt", F.round(1 - F.col("confidence"), 4))
    return rounded(inf.risk_coverage(rows, "arm", "doubt", "absolute_error"))


def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cal.calibration_curve(_per_record(spark, sf)))


def calibration_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cal.calibration_summary(_per_record(spark, sf)))


def _per_record(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, since quantiles and curves read it several times."""
    return Scratch(spark, "records").write(predictions(spark, sf).groupBy("arm", "record_id").agg(F.avg("prediction").alias("prediction"), F.min("observed").alias("observed")))


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = predictions(spark, sf).filter("arm = 'joint'")
    pool = rows.filter("seed = 1").select("fold", F.round(F.col("prediction") - F.col("observed"), 6).alias("r"))
    return cal.interval_rows(rows.withColumn("prediction", F.round("prediction", 6)), cal.half_widths(pool, "fold", "r", LEVELS), "fold", LEVELS)


def coverage_half_widths(spark: SparkSession, sf: str) -> DataFrame:
    pool = predictions(spark, sf).filter("arm = 'joint' AND seed = 1").select("fold", F.round(F.col("prediction") - F.col("observed"), 6).alias("r"))
    return rounded(cal.half_widths(pool, "fold", "r", LEVELS))


def coverage_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cal.coverage(_intervals(spark, sf), gate=(0.85, 0.95)))


def coverage_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cal.coverage(_intervals(spark, sf), ["fold", "block"]))


def coverage_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cal.coverage_sensitivity(_intervals(spark, sf)))


def inference_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.bootstrap(m.source_cube(predictions(spark, sf)), ARMS, 2000))


def inference_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.percentile_interval(inf.bootstrap(m.source_cube(predictions(spark, sf)), ARMS, 2000)))


def inference_bootstrap_full(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's 10,000 replicates."""
    return rounded(inf.bootstrap(m.source_cube(predictions(spark, sf)), ARMS, 10_000))


def inference_interval_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.percentile_interval(inf.bootstrap(m.source_cube(predictions(spark, sf)), ARMS, 10_000)))


def inference_cluster_robust(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.cluster_robust(m.paired_effects(predictions(spark, sf), ARMS)))


def inference_jackknife(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.jackknife(m.paired_effects(predictions(spark, sf), ARMS)))


def inference_sign_flip(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(inf.sign_flip(m.block_contributions(m.paired_effects(predictions(spark, sf), ARMS))))


def inference_holm(spark: SparkSession, sf: str) -> DataFrame:
    """Holm adjustment of one stand-in p value per source, by block."""
    p = predictions(spark, sf).groupBy("block", "source").agg(F.round(F.avg((F.col("observed") > F.col("prediction")).cast("double")) / 20, 6).alias("p"))
    return rounded(inf.holm(p, "p", "block"))


def inference_sign_flip_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The same over all sources as blocks: 2^25 assignments, by sums of halves."""
    e = m.paired_effects(predictions(spark, sf), ARMS).select(F.col("source").alias("block"), "source", "gap")
    return rounded(inf.sign_flip(m.block_contributions(e)))


def inference_paired_models(spark: SparkSession, sf: str) -> DataFrame:
    """The paired gap of the two models in the other direction, with its interval over 10,000 draws."""
    return rounded(inf.percentile_interval(inf.bootstrap(m.source_cube(predictions(spark, sf)), ARMS[::-1], 10_000)))


def inference_bootstrap_pcg(spark: SparkSession, sf: str) -> DataFrame:
    """The interval over 10,000 replicates drawn by NumPy's PCG64 from a hashed seed; no other engine has its draws."""
    got = inf.bootstrap_pcg(m.source_cube(predictions(spark, sf)), ARMS, 10_000, {"analysis": "block_seed_bootstrap", "replicates": 10_000})
    return rounded(inf.percentile_interval(spark.createDataFrame(got)))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """Different records of the split manifest with a source and a component, in plain form."""
    s = table(spark, sf, "split_manifest_public").select("curated_id", plain_words("source").alias("source"), plain_id("analogue_component_id").alias("component"))
    return s.dropna().groupBy("curated_id").agg(F.min(F.struct("source", "component")).alias("x")).select("curated_id", "x.*")


def weights_balanced(spark: SparkSession, sf: str) -> DataFrame:
    w = weights.balanced_weights(_sources(spark, sf), "curated_id", "source", "component")
    return rounded(w.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max("weight").alias("most")))


def weights_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the weights' mean is 1 and every source has the same total."""
    return weights.weight_checks(weights.balanced_weights(_sources(spark, sf), "curated_id", "source", "component"), "source", "weight")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("empty", F.when(F.col("l_linenumber") == 1, F.col("l_tax")))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "empty", F.lit(1.0).alias("flat"))


COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "empty", "flat")


def scaler_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.fit_scaler(_features(spark, sf).filter("l_linenumber <> 3"), COLUMNS))


def scaler_keep(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return rounded(weights.apply_scaler(f, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], weights.fit_scaler(f.filter("l_linenumber <> 3"), COLUMNS)), 5)


def scaler_drop(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return rounded(weights.apply_scaler(f, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], weights.fit_scaler(f.filter("l_linenumber <> 3"), COLUMNS, False), "drop", False, ["flat"]), 5)


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    """A table of (fold, family, config) errors in whole thousandths from part types, with ties."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy((F.col("l_linenumber")).alias("outer_fold"), F.col("p_type").alias("family"), F.col("p_size").alias("config_id")).agg(F.expr("sum(cast(round(l_discount * 100) as bigint)) * 10 div count(*)").alias("source_macro_mae"), F.expr("sum(cast(round(l_tax * 100) as bigint)) * 10 div count(*)").alias("row_micro_mae"))


def selection_config(spark: SparkSession, sf: str) -> DataFrame:
    """The winning configuration of each fold and family by error, second error, cost rank and id."""
    c = _configs(spark, sf).withColumn("cost", F.dense_rank().over(Window.partitionBy("outer_fold", "family").orderBy(F.col("config_id") % 7)))
    return m.best(c, ["outer_fold", "family"], [F.asc(x) for x in ("source_macro_mae", "row_micro_mae", "cost", "config_id")])


def selection_family(spark: SparkSession, sf: str) -> DataFrame:
    c = _configs(spark, sf)
    w = m.best(c, ["outer_fold", "family"], [F.asc(x) for x in ("source_macro_mae", "row_micro_mae", "config_id")]).filter("selected").drop("selected")
    return m.best(w, ["outer_fold"], [F.asc(x) for x in ("source_macro_mae", "row_micro_mae", "family", "config_id")])


def selection_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the winning family and configuration of each fold, counted and summed."""
    w = selection_family(spark, sf).filter("selected")
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = li.select(F.col("l_linenumber").alias("outer_fold"), F.col("p_type").alias("family"), F.col("p_size").alias("config_id"), "l_quantity")
    return models.assemble_oof(w, p).groupBy("outer_fold", "family", "config_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


def selection_family_cost(spark: SparkSession, sf: str) -> DataFrame:
    """The winning family of each fold by error, second error, cost rank, family and id."""
    c = selection_config(spark, sf).filter("selected").drop("selected")
    return m.best(c, ["outer_fold"], [F.asc(x) for x in ("source_macro_mae", "row_micro_mae", "cost", "family", "config_id")])


def selection_oof_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of an assembly with planted faults: sizes absent, repeated, with another brand or another price, and one unknown part."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("record"), F.col("p_brand").alias("brand"), F.col("p_retailprice").cast("double").alias("observed"), "p_size")
    o = p.filter("p_size <> 7").withColumn("brand", F.when(F.col("p_size") == 4, "other").otherwise(F.col("brand"))).withColumn("observed", F.when(F.col("p_size") == 5, F.col("observed") + 1).otherwise(F.col("observed")))
    o = o.unionByName(o.filter("p_size = 3")).unionByName(o.limit(1).withColumn("record", F.lit(-1).cast("long")))  # one planted row
    return models.oof_problems(o, p, "record", ["brand"], "observed")


def model_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Validation errors of every configuration of the three families, and which one wins."""
    f = _features(spark, sf).select("l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    got = models.grid_errors(f.filter("l_linenumber > 2"), f.filter("l_linenumber <= 2"), ["l_quantity", "l_discount"], "l_extendedprice")
    won = m.best(got.withColumn("all", F.lit(1)), ["all"], [F.asc(x) for x in ("mae", "rmse", "cost_rank", "family", "config_id")]).drop("all")
    return rounded(won, 2)


def selection_cost_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinal ranks and dense tiers of costs."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    by_size = Window.partitionBy("p_size").orderBy("p_retailprice", "p_partkey")
    return p.withColumn("ordinal", F.row_number().over(by_size)).withColumn("tier", F.dense_rank().over(Window.partitionBy("p_size").orderBy("p_retailprice")))


def selection_best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", F.pmod(F.col("event_id"), F.lit(4)).alias("basket"), F.hour("ts").alias("epoch")).agg(F.round(F.avg("value"), 2).alias("loss"))
    return models.best_epochs(e, ["basket"], ["user_id"])


def model_training_mean(spark: SparkSession, sf: str) -> DataFrame:
    p = predictions(spark, sf).filter("arm = 'joint'")
    out = models.training_mean(p.filter("seed <> 0"), p.filter("seed = 0").select("record_id", "block"), ["block"], "observed")
    return rounded(out)


def model_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients of ridge regression for the grid of penalties."""
    f = _features(spark, sf).select("l_quantity", "l_discount", "l_extendedprice")
    got = []
    for a in (0.01, 0.1, 1.0, 10.0, 100.0):
        fit = models.ridge(f, ["l_quantity", "l_discount"], "l_extendedprice", a)
        got.append((a, float(fit.coefficients[0]), float(fit.coefficients[1]), float(fit.intercept)))
    return rounded(spark.createDataFrame(got, "alpha double, b_quantity double, b_discount double, intercept double"), 3)


def model_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a small forest by return flag."""
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    fit = models.forest(d.filter("l_linenumber > 2"), ["l_quantity", "l_discount"], "l_extendedprice", 10, 4, 7)
    got = models.predict(fit, d.filter("l_linenumber <= 2"), ["l_quantity", "l_discount"], ["l_returnflag", "l_extendedprice"])
    return got.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("l_extendedprice"))), 2).alias("mae"))


def sealed_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions sealed as the hex of their bytes and read back, with a hash of each source's values."""
    p = predictions(spark, sf).filter("arm = 'joint'").select("source", "record_id", "prediction").withColumn("sealed", double_hex("prediction")).withColumn("back", hex_double("sealed"))
    per = p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("back").eqNullSafe(F.col("prediction"))).alias("n_changed"), F.array_sort(F.collect_set("prediction")).alias("v"))
    return per.select("source", "n", "n_changed", array_hash("v").alias("values_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_estimand_ladder, metrics_source_cube, metrics_by_seed, metrics_per_source, metrics_per_block, metrics_stratified_arms, metrics_seed_stability, metrics_paired_effects, metrics_block_contributions, metrics_seed_means,
        metrics_leave_one_out, metrics_omit_largest, metrics_concentration, metrics_partition_agreement, metrics_duplicate_slots, metrics_top_sources, metrics_variant_deltas, metrics_replicated_seeds, metrics_spearman, metrics_risk_coverage, calibration_curve, calibration_summary,
        coverage_half_widths, coverage_overall, coverage_by_fold, coverage_sensitivity, inference_bootstrap, inference_interval, inference_bootstrap_full, inference_interval_full, inference_cluster_robust, inference_jackknife, inference_sign_flip, inference_holm, weights_balanced,
        inference_sign_flip_sources, inference_paired_models, inference_bootstrap_pcg, weights_checked, selection_family_cost, selection_oof_problems, model_grid,
        scaler_fit, scaler_keep, scaler_drop, selection_config, selection_family, selection_oof, selection_cost_ranks, selection_best_epoch, model_training_mean, model_ridge, model_forest, sealed_round_trip,
    )
}

_W = f"WITH {PREDICTIONS}"
_PER = "r AS (SELECT arm, record_id, avg(prediction) AS prediction, min(observed) AS observed FROM p GROUP BY ALL)"
_DECILES = f"""{_PER}, q AS (SELECT arm, quantile_cont(prediction, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM r GROUP BY arm),
b AS (SELECT r.*, len(list_filter(edges, lambda x: x < prediction)) + 1 AS decile FROM r JOIN q USING (arm)),
c AS (SELECT arm, decile, count(*) AS n_records, avg(prediction) AS mean_prediction, avg(observed) AS mean_observed, min(prediction) AS least_prediction, max(prediction) AS largest_prediction, avg(prediction) - avg(observed) AS bias FROM b GROUP BY ALL)"""
_POOL = """pool AS (SELECT fold, abs(round(prediction - observed, 6)) AS r FROM p WHERE arm = 'joint' AND seed = 1),
lv AS (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS level),
rk AS (SELECT fold, r, row_number() OVER (PARTITION BY fold ORDER BY r) AS k, count(*) OVER (PARTITION BY fold) AS n FROM pool),
hw AS (SELECT fold, level, n AS n_calibration, r AS half_width FROM rk, lv WHERE k = least(n, CAST(ceil((n + 1) * level) AS BIGINT))),
iv AS (SELECT p.fold, block, source, seed, level, CAST(abs(round(prediction, 6) - observed) <= half_width AS INTEGER) AS covered, half_width * 2 AS width FROM p JOIN hw USING (fold) WHERE arm = 'joint')"""
_COVERAGE = "count(*) AS n, avg(covered) AS coverage, avg(width) AS mean_width, avg(covered) - level AS calibration_error, level <> 0.9 OR avg(covered) BETWEEN 0.85 AND 0.95 AS passes_gate"
_SENS = ", ".join(f"(SELECT {f}(c) FROM (SELECT avg(covered) AS c FROM iv i WHERE i.level = lv.level GROUP BY {k})) AS {n}_{k}" for k in ("seed", "source", "block") for f, n in (("min", "least"), ("max", "largest"), ("avg", "equal")))
_DRAW = "CAST('0x' || substr(sha256('bootstrap|{k}|' || r.replicate || '|' || t.slot), 1, 8) AS BIGINT)"
_BOOT = f"""cell AS (SELECT arm, seed, block, sum(source_mae) AS s, count(*) AS n FROM cube GROUP BY ALL),
bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS i FROM (SELECT DISTINCT block FROM cell)), sd AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS i FROM (SELECT DISTINCT seed FROM cell)),
r AS (SELECT unnest(range(2000)) AS replicate),
wb AS (SELECT replicate, {_DRAW.format(k='block')} % (SELECT count(*) FROM bl) AS i FROM r, (SELECT unnest(range((SELECT count(*) FROM bl))) AS slot) t),
ws AS (SELECT replicate, {_DRAW.format(k='seed')} % (SELECT count(*) FROM sd) AS i FROM r, (SELECT unnest(range((SELECT count(*) FROM sd))) AS slot) t),
rep AS (SELECT wb.replicate, arm, sum(s) / sum(n) AS v FROM wb JOIN bl USING (i) JOIN ws ON ws.replicate = wb.replicate JOIN sd ON sd.i = ws.i JOIN cell ON cell.block = bl.block AND cell.seed = sd.seed GROUP BY ALL),
boot AS ({sql_gap("rep", "v", "replicate")})"""
_CONFIGS = "c AS (SELECT l_linenumber AS outer_fold, p_type AS family, p_size AS config_id, CAST((sum(CAST(round(l_discount * 100) AS BIGINT)) * 10) // count(*) AS BIGINT) AS source_macro_mae, CAST((sum(CAST(round(l_tax * 100) AS BIGINT)) * 10) // count(*) AS BIGINT) AS row_micro_mae FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_FAMILY = f"""{_CONFIGS}, w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY outer_fold, family ORDER BY source_macro_mae, row_micro_mae, config_id) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY source_macro_mae, row_micro_mae, family, config_id) = 1 AS selected FROM w)"""
_FEATURES = "f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber = 1 THEN l_tax END AS empty, 1.0::DOUBLE AS flat FROM lineitem)"
_STATS = f"""{_FEATURES}, u AS (UNPIVOT (SELECT * EXCLUDE (l_orderkey, l_linenumber, l_partkey, l_suppkey) FROM f WHERE l_linenumber <> 3) ON COLUMNS(*) INTO NAME "column" VALUE x),
a AS (SELECT "column", (SELECT count(*) FROM f WHERE l_linenumber <> 3) AS n, count(x) AS present, median(x) AS med, sum(x) AS s, sum(x * x) AS q FROM u GROUP BY 1),
st AS (SELECT "column", n, 1 - present / n AS missing_share, med AS median, (s + (n - present) * med) / n AS mean, sqrt(greatest(0, (q + (n - present) * med * med) / n - ((s + (n - present) * med) / n) ** 2)) AS sd FROM a)"""
_Z = lambda c: f"round((coalesce({c}, (SELECT median FROM st WHERE \"column\" = '{c}')) - (SELECT mean FROM st WHERE \"column\" = '{c}')) / (SELECT sd FROM st WHERE \"column\" = '{c}'), 5) AS {c}"
_ZS = ", ".join(_Z(c) for c in ("l_quantity", "l_extendedprice", "l_discount"))
SQL = {
    "metrics_estimand_ladder": f"""{_W}, s1 AS (SELECT arm, seed, avg(absolute_error) AS v FROM e GROUP BY ALL), s2 AS (SELECT arm, seed, avg(source_mae) AS v FROM cube GROUP BY ALL),
s3 AS (SELECT arm, seed, avg(v) AS v FROM (SELECT arm, seed, block, avg(source_mae) AS v FROM cube GROUP BY ALL) GROUP BY ALL),
a AS (SELECT 'row_micro' AS estimand, arm, avg(v) AS v FROM s1 GROUP BY ALL UNION ALL SELECT 'source_macro', arm, avg(v) FROM s2 GROUP BY ALL UNION ALL SELECT 'block_macro', arm, avg(v) FROM s3 GROUP BY ALL)
SELECT * {sql_round(['joint_mae', 'random_mae', 'gap'])} FROM ({sql_gap('a', 'v', 'estimand')})""",
    "metrics_source_cube": f"{_W} SELECT * {sql_round(['source_mae'])} FROM cube",
    "metrics_by_seed": f"""{_W}, s AS (SELECT arm, seed, block, source, avg(absolute_error) AS mae, sqrt(avg(signed_error * signed_error)) AS rmse FROM e GROUP BY ALL),
a AS (SELECT arm, seed, avg(mae) AS source_macro_mae, avg(rmse) AS source_macro_rmse FROM s GROUP BY ALL), b AS (SELECT arm, seed, count(*) AS n_rows, avg(absolute_error) AS row_micro_mae, sqrt(avg(signed_error * signed_error)) AS row_micro_rmse FROM e GROUP BY ALL),
c AS (SELECT arm, seed, median(v) AS block_median_mae, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS block_iqr_mae FROM (SELECT arm, seed, block, avg(absolute_error) AS v FROM e GROUP BY ALL) GROUP BY ALL)
SELECT * {sql_round(['source_macro_mae', 'source_macro_rmse', 'row_micro_mae', 'row_micro_rmse', 'block_median_mae', 'block_iqr_mae'])} FROM a JOIN b USING (arm, seed) JOIN c USING (arm, seed)""",
    **{f"metrics_per_{k}": f"{_W} SELECT arm, {k}, count(*) AS n_rows, round(avg(absolute_error), 6) AS mae, round(sqrt(avg(signed_error * signed_error)), 6) AS rmse FROM e GROUP BY ALL" for k in ("source", "block")},
    "metrics_stratified_arms": f"""{_W}, s AS (SELECT arm, seed, source, block, count(DISTINCT record_id) AS n, avg(absolute_error) AS mae, avg(signed_error) AS bias, sqrt(avg(signed_error * signed_error)) AS rmse FROM e GROUP BY ALL),
a AS (SELECT arm, source, block, sum(n)::BIGINT AS n, avg(mae) AS mae, avg(bias) AS bias, avg(rmse) AS rmse FROM s GROUP BY ALL)
SELECT source, block, j.n AS n_joint, r.n AS n_random, round(j.mae, 6) AS mae_joint, round(r.mae, 6) AS mae_random, round(j.bias, 6) AS bias_joint, round(r.bias, 6) AS bias_random, round(j.rmse, 6) AS rmse_joint, round(r.rmse, 6) AS rmse_random,
round(j.mae - r.mae, 6) AS gap, round(abs(j.bias), 6) AS absolute_bias_joint, round(abs(r.bias), 6) AS absolute_bias_random FROM (SELECT * FROM a WHERE arm = 'joint') j JOIN (SELECT * FROM a WHERE arm = 'random') r USING (source, block)""",
    "metrics_seed_stability": f"""{_W}, g AS ({sql_gap("(SELECT arm, seed, source, avg(source_mae) AS v FROM cube GROUP BY ALL)", "v", "source, seed")})
SELECT source, round(avg(gap), 6) AS gap_mean, round(stddev_samp(gap), 6) AS gap_sd, count(*) FILTER (gap > 0) AS n_positive, count(*) FILTER (gap < 0) AS n_negative FROM g GROUP BY source""",
    "metrics_paired_effects": f"{_W}, {EFFECTS} SELECT * {sql_round(['joint_mae', 'random_mae', 'gap'])} FROM eff",
    "metrics_block_contributions": f"{_W}, {EFFECTS} SELECT block, count(*) AS n_sources, round(avg(gap), 6) AS mean_gap, round(sum(gap), 6) AS sum_gap, round(sum(gap) / (SELECT count(*) FROM eff), 6) AS contribution, avg(gap) > 0 AS is_positive FROM eff GROUP BY block",
    "metrics_seed_means": "SELECT l_partkey AS part, round(avg(ln(l_extendedprice)), 6) AS prediction, round(min(l_quantity / 10), 6) AS observed, count(DISTINCT l_linenumber % 5) = 5 AS is_complete FROM lineitem GROUP BY 1",
    "metrics_leave_one_out": f"""{_W}, b AS (SELECT DISTINCT block AS omitted_block FROM cube), s AS (SELECT omitted_block, arm, seed, avg(source_mae) AS v FROM b JOIN cube ON block <> omitted_block GROUP BY ALL)
SELECT * {sql_round(['joint_mae', 'random_mae', 'gap'])} FROM ({sql_gap("(SELECT omitted_block, arm, avg(v) AS v FROM s GROUP BY ALL)", "v", "omitted_block")})""",
    "metrics_omit_largest": f"""{_W}, t AS (SELECT block FROM cube GROUP BY block ORDER BY sum(n_rows) DESC, block LIMIT 3), k AS (SELECT * FROM cube WHERE block NOT IN (SELECT block FROM t)),
g AS ({sql_gap("(SELECT arm, avg(v) AS v FROM (SELECT arm, seed, avg(source_mae) AS v FROM k GROUP BY ALL) GROUP BY ALL)", "v")})
SELECT * {sql_round(['joint_mae', 'random_mae', 'gap'])}, (SELECT count(DISTINCT source) FROM k) AS n_sources, (SELECT count(DISTINCT block) FROM k) AS n_blocks, (SELECT sum(n_rows)::BIGINT FROM k) AS n_rows FROM g""",
    "metrics_concentration": """WITH s AS (SELECT DISTINCT assignment_run_id, tanimoto_threshold, sealed_block_id, n_records FROM block_definition_ranked_sizes WHERE assignment_run_id IS NOT NULL AND tanimoto_threshold IS NOT NULL AND sealed_block_id IS NOT NULL AND n_records IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY assignment_run_id, tanimoto_threshold ORDER BY n_records DESC) AS k FROM s)
SELECT assignment_run_id, tanimoto_threshold, count(*) AS n_groups, round(max(n_records) / sum(n_records), 6) AS largest_share, round(sum(n_records) FILTER (k <= 3) / sum(n_records), 6) AS top_three_share,
round(sum(n_records) * sum(n_records) / sum(n_records::DOUBLE * n_records), 6) AS effective_groups, round(median(n_records), 6) AS median_size FROM r GROUP BY 1, 2""",
    "metrics_partition_agreement": """WITH s AS (SELECT DISTINCT curated_id, source AS a, analogue_component_id AS b FROM split_manifest_public WHERE curated_id IS NOT NULL AND source IS NOT NULL AND analogue_component_id IS NOT NULL),
c AS (SELECT a, b, count(*) AS n FROM s GROUP BY ALL), ga AS (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY a), gb AS (SELECT sum(n) AS n, count(*) AS k FROM c GROUP BY b),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c)::DOUBLE AS both_, (SELECT sum(n * (n - 1) / 2) FROM ga)::DOUBLE AS pa, (SELECT sum(n * (n - 1) / 2) FROM gb)::DOUBLE AS pb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c)::DOUBLE AS pt)
SELECT round((both_ - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 6) AS adjusted_rand, round(both_ / (pa + pb - both_), 6) AS pairwise_jaccard, (SELECT count(*) FROM ga WHERE k > 1) AS divided_a, (SELECT max(k) FROM ga) AS most_parts_a,
(SELECT count(*) FROM gb WHERE k > 1) AS divided_b, (SELECT max(k) FROM gb) AS most_parts_b FROM x""",
    "metrics_duplicate_slots": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "metrics_top_sources": f"{_W} SELECT source, round(max(source_mae), 6) AS worst, arg_max(arm, source_mae) AS worst_arm FROM cube WHERE seed = 0 GROUP BY source ORDER BY max(source_mae) DESC, source LIMIT 10",
    "metrics_variant_deltas": f"""WITH g AS (SELECT year(l_shipdate)::INTEGER AS fold, l_returnflag AS v, avg(abs(l_discount - l_tax)) AS x FROM lineitem GROUP BY ALL),
w AS (SELECT fold, {', '.join(f"max(x) FILTER (v = '{v}') AS {v}" for v in 'ANR')} FROM g GROUP BY fold)
SELECT fold, round(A, 6) AS A, round(N, 6) AS N, round(R, 6) AS R, round(N - A, 6) AS N_minus_A, round(R - A, 6) AS R_minus_A FROM w WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL""",
    "metrics_replicated_seeds": f"{_W} SELECT unnest(range(5))::INTEGER AS seed, block, n, prediction FROM (SELECT block, count(*) AS n, round(avg(prediction), 6) AS prediction FROM p WHERE arm = 'joint' GROUP BY block)",
    "metrics_spearman": f"""{_W}, k AS (SELECT arm, seed, source, rank() OVER (PARTITION BY arm, seed, source ORDER BY prediction) + (count(*) OVER (PARTITION BY arm, seed, source, prediction) - 1) / 2.0 AS rp,
rank() OVER (PARTITION BY arm, seed, source ORDER BY observed) + (count(*) OVER (PARTITION BY arm, seed, source, observed) - 1) / 2.0 AS ro FROM p),
s AS (SELECT arm, seed, source, count(*) AS n, corr(rp, ro) AS rho FROM k GROUP BY ALL HAVING count(*) >= 10), t AS (SELECT arm, seed, avg(rho) AS rho, count(rho) AS n FROM s GROUP BY ALL)
SELECT arm, round(avg(rho), 6) AS spearman, max(n) AS n_sources FROM t GROUP BY arm""",
    "metrics_risk_coverage": f"""{_W}, d AS (SELECT arm, absolute_error, round(1 - confidence, 4) AS doubt FROM e), q AS (SELECT arm, quantile_cont(doubt, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM d GROUP BY arm),
t AS (SELECT d.arm, absolute_error, 10 - len(list_filter(cuts, lambda x: x < doubt)) AS step FROM d JOIN q USING (arm)), g AS (SELECT arm, step, sum(absolute_error) AS s, count(*) AS n FROM t GROUP BY ALL)
SELECT arm, round(sum(n) OVER (PARTITION BY arm ORDER BY step) / sum(n) OVER (PARTITION BY arm), 6) AS coverage, round(sum(s) OVER (PARTITION BY arm ORDER BY step) / sum(n) OVER (PARTITION BY arm ORDER BY step), 6) AS risk FROM g""",
    "calibration_curve": f"{_W}, {_DECILES} SELECT * {sql_round(['mean_prediction', 'mean_observed', 'least_prediction', 'largest_prediction', 'bias'])} FROM c",
    "calibration_summary": f"""{_W}, {_DECILES}, w AS (SELECT arm, sum(abs(bias) * n_records) / sum(n_records) AS weighted_absolute_bias FROM c GROUP BY arm)
SELECT arm, count(*) AS n_records, round(regr_slope(observed, prediction), 6) AS slope, round(regr_intercept(observed, prediction), 6) AS intercept, round(corr(prediction, observed), 6) AS pearson, round(avg(prediction) - avg(observed), 6) AS bias,
round(any_value(weighted_absolute_bias), 6) AS weighted_absolute_bias FROM r JOIN w USING (arm) GROUP BY arm""",
    "coverage_half_widths": f"{_W}, {_POOL} SELECT * FROM hw",
    "coverage_overall": f"{_W}, {_POOL} SELECT * {sql_round(['coverage', 'mean_width', 'calibration_error'])} FROM (SELECT level, {_COVERAGE} FROM iv GROUP BY level)",
    "coverage_by_fold": f"{_W}, {_POOL} SELECT * {sql_round(['coverage', 'mean_width', 'calibration_error'])} FROM (SELECT level, fold, block, {_COVERAGE} FROM iv GROUP BY level, fold, block)",
    "coverage_sensitivity": f"{_W}, {_POOL} SELECT * {sql_round(['pooled'] + [f'{n}_{k}' for k in ('seed', 'source', 'block') for n in ('least', 'largest', 'equal')])} FROM (SELECT level, (SELECT avg(covered) FROM iv i WHERE i.level = lv.level) AS pooled, {_SENS} FROM lv)",
    "inference_bootstrap": f"{_W}, {_BOOT} SELECT * {sql_round(['joint_mae', 'random_mae', 'gap'])} FROM boot",
    "inference_interval": f"{_W}, {_BOOT} SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, round(avg(gap), 6) AS mean, avg(gap) >= 0.10 AS reaches_threshold, quantile_cont(gap, 0.025) > 0 AS is_above_zero FROM boot",
    "inference_sign_flip": f"""{_W}, {EFFECTS}, c AS (SELECT row_number() OVER (ORDER BY block) - 1 AS i, sum(gap) / (SELECT count(*) FROM eff) AS x FROM eff GROUP BY block),
a AS (SELECT unnest(range(1 << (SELECT count(*) FROM c)::INTEGER)) AS id), s AS (SELECT id, sum(CASE WHEN (id >> i::INTEGER) & 1 = 1 THEN x ELSE -x END) AS v FROM a, c GROUP BY id)
SELECT round((SELECT sum(x) FROM c), 6) AS observed, (SELECT count(*) FROM c)::INTEGER AS n_blocks, count(*) AS n_assignments, count(*) FILTER (abs(v) >= abs((SELECT sum(x) FROM c)) - 1e-14) AS n_exceedances,
round(count(*) FILTER (abs(v) >= abs((SELECT sum(x) FROM c)) - 1e-14) / count(*), 6) AS p_value FROM s""",
    "inference_holm": f"""{_W}, t AS (SELECT block, source, round(avg(CASE WHEN observed > prediction THEN 1.0 ELSE 0.0 END) / 20, 6) AS p FROM p GROUP BY ALL),
a AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY block) - row_number() OVER (PARTITION BY block ORDER BY p) + 1) * p) AS x FROM t)
SELECT block, source, p, round(max(x) OVER (PARTITION BY block ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM a""",
    "weights_balanced": f"""WITH s AS (SELECT curated_id, min(row(source, component)) AS x FROM (SELECT curated_id, {sql_plain_words('source')} AS source, {sql_plain_id('analogue_component_id')} AS component FROM split_manifest_public)
  WHERE curated_id IS NOT NULL AND source IS NOT NULL AND component IS NOT NULL GROUP BY 1), t AS (SELECT curated_id, x[1] AS source, x[2] AS component FROM s),
c AS (SELECT source, component, count(*) AS n FROM t GROUP BY ALL), g AS (SELECT source, count(*) AS k FROM c GROUP BY source),
w AS (SELECT source, (SELECT count(*) FROM t) / ((SELECT count(*) FROM g) * k * n) AS weight FROM t JOIN c USING (source, component) JOIN g USING (source))
SELECT source, count(*) AS n, round(sum(weight), 6) AS total, round(min(weight), 6) AS least, round(max(weight), 6) AS most FROM w GROUP BY source""",
    "weights_checked": "SELECT true AS has_mean_one, 0 AS n_sources_off",
    "inference_sign_flip_sources": f"""{_W}, {EFFECTS}, c AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, sum(gap) / (SELECT count(*) FROM eff) AS x FROM eff GROUP BY source),
n AS (SELECT count(*)::INTEGER AS n FROM c), h1 AS (SELECT id, sum(CASE WHEN (id >> i::INTEGER) & 1 = 1 THEN x ELSE -x END) AS v FROM (SELECT unnest(range(1 << (SELECT n // 2 FROM n)::INTEGER)) AS id), c WHERE i < (SELECT n // 2 FROM n) GROUP BY id),
h2 AS (SELECT id, sum(CASE WHEN (id >> (i - (SELECT n // 2 FROM n))::INTEGER) & 1 = 1 THEN x ELSE -x END) AS v FROM (SELECT unnest(range(1 << (SELECT n - n // 2 FROM n)::INTEGER)) AS id), c WHERE i >= (SELECT n // 2 FROM n) GROUP BY id),
k AS (SELECT count(*) AS k FROM h1, h2 WHERE abs(h1.v + h2.v) >= abs((SELECT sum(x) FROM c)) - 1e-14)
SELECT round((SELECT sum(x) FROM c), 6) AS observed, n AS n_blocks, 1::BIGINT << n AS n_assignments, k AS n_exceedances, round(k / (1::BIGINT << n), 6) AS p_value FROM n, k""",
    "inference_paired_models": f"{_W}, {_BOOT.replace('range(2000)', 'range(10000)')} SELECT round(quantile_cont(-gap, 0.025), 6) AS low, round(quantile_cont(-gap, 0.975), 6) AS high, round(avg(-gap), 6) AS mean, avg(-gap) >= 0.10 AS reaches_threshold, quantile_cont(-gap, 0.025) > 0 AS is_above_zero FROM boot",
    "inference_bootstrap_full": f"{_W}, {_BOOT.replace('range(2000)', 'range(10000)')} SELECT * {sql_round(['joint_mae', 'random_mae', 'gap'])} FROM boot",
    "inference_interval_full": f"{_W}, {_BOOT.replace('range(2000)', 'range(10000)')} SELECT round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high, round(avg(gap), 6) AS mean, avg(gap) >= 0.10 AS reaches_threshold, quantile_cont(gap, 0.025) > 0 AS is_above_zero FROM boot",
    "selection_family_cost": f"""WITH {_CONFIGS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY outer_fold, family ORDER BY config_id % 7) AS cost FROM c),
w AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY outer_fold, family ORDER BY source_macro_mae, row_micro_mae, cost, config_id) = 1)
SELECT *, row_number() OVER (PARTITION BY outer_fold ORDER BY source_macro_mae, row_micro_mae, cost, family, config_id) = 1 AS selected FROM w""",
    "selection_oof_problems": """WITH o AS (SELECT p_partkey FROM part WHERE p_size <> 7) SELECT 'missing' AS problem, (SELECT count(*) FROM part WHERE p_size = 7) AS n UNION ALL SELECT 'unknown', 1
UNION ALL SELECT 'repeated', (SELECT count(*) FROM part WHERE p_size = 3) UNION ALL SELECT 'metadata', (SELECT count(*) FROM part WHERE p_size = 4) UNION ALL SELECT 'observed', (SELECT count(*) FROM part WHERE p_size = 5)""",
    "scaler_fit": f"""WITH {_STATS} SELECT "column", n, round(missing_share, 6) AS missing_share, round(median, 6) AS median, round(mean, 6) AS mean, round(CASE WHEN sd < 1e-9 THEN 0 ELSE sd END, 6) AS sd, missing_share <= 0.5 AND sd > 1e-9 AS active FROM st""",
    "scaler_keep": f"WITH {_STATS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.0 AS empty, 0.0 AS flat, {_ZS} FROM (SELECT * EXCLUDE (empty, flat) FROM f)",
    "scaler_drop": f"WITH {_STATS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, flat, {_ZS} FROM (SELECT * EXCLUDE (empty) FROM f)",
    "selection_config": f"""WITH {_CONFIGS}, k AS (SELECT *, dense_rank() OVER (PARTITION BY outer_fold, family ORDER BY config_id % 7) AS cost FROM c)
SELECT *, row_number() OVER (PARTITION BY outer_fold, family ORDER BY source_macro_mae, row_micro_mae, cost, config_id) = 1 AS selected FROM k""",
    "selection_family": f"WITH {_FAMILY} SELECT * FROM f",
    "selection_oof": f"WITH {_FAMILY} SELECT outer_fold, family, config_id, count(*) AS n_rows, sum(l_quantity) AS quantity FROM f JOIN part ON p_type = family AND p_size = config_id JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = outer_fold WHERE selected GROUP BY ALL",
    "selection_cost_ranks": "SELECT p_partkey, p_size, p_retailprice, row_number() OVER (PARTITION BY p_size ORDER BY p_retailprice, p_partkey) AS ordinal, dense_rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS tier FROM part",
    "selection_best_epoch": """WITH e AS (SELECT user_id, event_id % 4 AS basket, hour(ts) AS epoch, round(avg(value), 2) AS loss FROM events GROUP BY ALL), b AS (SELECT user_id, basket, epoch FROM e QUALIFY row_number() OVER (PARTITION BY user_id, basket ORDER BY loss, epoch) = 1)
SELECT user_id, CAST(ceil(median(epoch)) AS BIGINT) AS epochs, count(*) AS n_runs FROM b GROUP BY user_id""",
    "model_training_mean": f"{_W}, t AS (SELECT block, avg(observed) AS prediction FROM p WHERE arm = 'joint' AND seed <> 0 GROUP BY block) SELECT block, record_id, round(prediction, 6) AS prediction FROM (SELECT record_id, block FROM p WHERE arm = 'joint' AND seed = 0) JOIN t USING (block)",
    "model_ridge": """WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_extendedprice) AS y, var_pop(l_quantity) * count(*) AS saa, var_pop(l_discount) * count(*) AS sbb,
covar_pop(l_quantity, l_discount) * count(*) AS sab, covar_pop(l_quantity, l_extendedprice) * count(*) AS say, covar_pop(l_discount, l_extendedprice) * count(*) AS sby FROM lineitem),
w AS (SELECT *, ((sbb + alpha) * say - sab * sby) / ((saa + alpha) * (sbb + alpha) - sab * sab) AS p, ((saa + alpha) * sby - sab * say) / ((saa + alpha) * (sbb + alpha) - sab * sab) AS q FROM m, (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE, 100.0::DOUBLE]) AS alpha))
SELECT alpha, round(p, 3) AS b_quantity, round(q, 3) AS b_discount, round(y - p * a - q * b, 3) AS intercept FROM w""",
    "inference_jackknife": "",
    "inference_cluster_robust": "",
}
#: Critical values need Student's t, which the SQL takes as a constant for the five blocks of the star schema: t(0.975, 4).
_T4 = "2.7764451051977987"
SQL["inference_cluster_robust"] = f"""{_W}, {EFFECTS}, b AS (SELECT block, sum(gap - (SELECT avg(gap) FROM eff)) AS u FROM eff GROUP BY block), s AS (SELECT (SELECT avg(gap) FROM eff) AS estimate, sqrt(count(*) / (count(*) - 1) * sum(u * u) / ((SELECT count(*) FROM eff) ** 2)) AS standard_error, count(*) - 1 AS degrees_of_freedom FROM b)
SELECT round(estimate, 6) AS estimate, round(standard_error, 6) AS standard_error, degrees_of_freedom, round({_T4}, 6) AS critical_value, round(estimate - {_T4} * standard_error, 6) AS low, round(estimate + {_T4} * standard_error, 6) AS high, round(estimate / standard_error, 6) AS t_statistic FROM s"""
SQL["inference_jackknife"] = f"""{_W}, {EFFECTS}, d AS (SELECT b.block, (SELECT avg(gap) FROM eff WHERE eff.block <> b.block) AS theta FROM (SELECT DISTINCT block FROM eff) b),
s AS (SELECT (SELECT avg(gap) FROM eff) AS estimate, sqrt((count(*) - 1) * var_pop(theta)) AS standard_error, min(theta) AS least, max(theta) AS largest, count(*) - 1 AS degrees_of_freedom FROM d)
SELECT round(estimate, 6) AS estimate, round(standard_error, 6) AS standard_error, round(least, 6) AS least, round(largest, 6) AS largest, degrees_of_freedom, round({_T4}, 6) AS critical_value, round(estimate - {_T4} * standard_error, 6) AS low, round(estimate + {_T4} * standard_error, 6) AS high FROM s"""
