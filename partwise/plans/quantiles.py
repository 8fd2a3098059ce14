"""Exact quantiles and ranks of groups of any size.

Spark's exact percentile holds all different values of a group in one task.
Here an approximate percentile, whose error in rank has a known bound, gives a
bracket around each wanted rank; rows below the brackets are counted, and only the
rows within them (some hundredths) are ranked by the distributed ranking.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.plans.lineage import Scratch
from partwise.plans.ranking import running_totals


def _counted(df: DataFrame, scope: Sequence[str], value: str) -> DataFrame:
    counts = df.select(*scope, F.col(value).alias("_v")).filter("_v IS NOT NULL").groupBy(*scope, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return running_totals(counts, list(scope), [F.asc("_v")], ["_c"], "_p")


#: The approximate percentile's rank is wrong by a part in ACCURACY at most; brackets are three times as wide on either side.
ACCURACY = 1000


def _picked(at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, v): the value at rank p (n - 1), linear between neighbours, from rows (keys, p, n, _v, before, c) that hold the ranks before to before + c - 1."""
    floor, ceil = F.floor(F.col("p") * (F.col("n") - 1)), F.ceil(F.col("p") * (F.col("n") - 1))
    has = lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("c"))
    v = F.col("_v").cast("double")
    got = at.groupBy(*keys).agg(F.max(F.when(has(floor), v)).alias("low"), F.max(F.when(has(ceil), v)).alias("high"), F.max(F.col("p") * (F.col("n") - 1) - floor).alias("part"))
    return got.filter("low IS NOT NULL AND high IS NOT NULL").select(*keys, (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("v"))


def exact_quantiles(df: DataFrame, scope: Sequence[str], value: str, shares: Sequence[float], out: str = "q", accuracy: int = ACCURACY) -> DataFrame:
    """(scope, out): the quantiles of each scope as an array, linear between neighbours.

    Nulls don't count; a scope without values has no row. With no scope there is one row,
    or none for an empty input. The values are written once and scanned twice.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    keys = [f"_k{i}" for i in range(len(scope))] or ["_k"]
    named = [F.col(c).alias(k) for c, k in zip(scope, keys)] or [F.lit(0).alias("_k")]
    x = scratch.write(df.select(*named, F.col(value).alias("_v")).filter("_v IS NOT NULL"))
    around = [(max(0.0, p - 3 / accuracy), min(1.0, p + 3 / accuracy)) for p in shares]
    points = sorted({y for pair in around for y in pair})
    place = {y: i for i, y in enumerate(points)}
    s = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.percentile_approx("_v", points, accuracy).alias("at"))
    few = F.col("n") <= accuracy  # all rows are within
    bracket = lambda i, p, lo, hi: F.struct(
        F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
        (F.col("least") if lo == 0 else F.when(few, F.col("least")).otherwise(F.col("at")[place[lo]])).alias("lo"), (F.col("most") if hi == 1 else F.when(few, F.col("most")).otherwise(F.col("at")[place[hi]])).alias("hi"),
    )
    s = scratch.write(s.select(*keys, "n", F.array(*[bracket(i, p, *around[i]) for i, p in enumerate(shares)]).alias("b")))
    g = s.toDF(*[f"_g{k}" for k in keys], "n", "b")
    same = x[keys[0]].eqNullSafe(g[f"_g{keys[0]}"])
    for k in keys[1:]:
        same &= x[k].eqNullSafe(g[f"_g{k}"])
    tagged = x.join(g, same).select(*keys, "n", "b", "_v")
    below = tagged.groupBy(*keys).agg(*[F.count_if(F.col("_v") < F.col("b")[i]["lo"]).alias(f"b{i}") for i in range(len(shares))])
    below = below.select(*[F.col(k).alias(f"_g{k}") for k in keys], F.array(*[F.col(f"b{i}") for i in range(len(shares))]).alias("below"))
    within = tagged.select(*keys, "n", "_v", F.explode(F.filter("b", lambda y: (F.col("_v") >= y["lo"]) & (F.col("_v") <= y["hi"]))).alias("y"))
    counts = within.groupBy(*keys, F.col("y.i").alias("i"), "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("n").alias("n"), F.first("y.p").alias("p"))
    ranked = running_totals(counts, [*keys, "i"], [F.asc("_v")], ["_c"], "_p", scratch=scratch)
    same = ranked[keys[0]].eqNullSafe(below[f"_g{keys[0]}"])
    for k in keys[1:]:
        same &= ranked[k].eqNullSafe(below[f"_g{k}"])
    rows = ranked.join(below, same).select(*keys, "i", "p", "n", "_v", (F.element_at("below", F.col("i") + 1) + F.col("_c_running") - F.col("_c")).alias("before"), F.col("_c").alias("c"))
    found = scratch.write(_picked(rows, [*keys, "i"]))
    if found.count() < s.count() * len(shares):  # a bracket missed its rank; rank everything
        every = running_totals(x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), keys, [F.asc("_v")], ["_c"], "_p", scratch=scratch)
        wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]))
        rows = every.select(*keys, wanted.alias("y"), "_v", F.col("_c_total").alias("n"), (F.col("_c_running") - F.col("_c")).alias("before"), F.col("_c").alias("c")).select(*keys, "y.*", "n", "_v", "before", "c")
        found = _picked(rows, [*keys, "i"])
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda y: y["v"]).alias(out)).select(*[F.col(k).alias(c) for k, c in zip(keys, scope)], out)


def average_ranks(df: DataFrame, scope: Sequence[str], value: str, out: str, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with the average rank of each value in its scope; rows with a null value have no rank.

    Ranks may be counted over another table with the same values, such as ``df`` before
    costly joins.
    """
    r = _counted(df if counted is None else counted, scope, value).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)], "_v", (F.col("_c_running") - (F.col("_c") - 1) / 2.0).alias(out))
    same = df[value] == r["_v"]
    for i, c in enumerate(scope):
        same &= df[c].eqNullSafe(r[f"_s{i}"])
    return df.join(r, same, "left").drop("_v", *[f"_s{i}" for i in range(len(scope))])
