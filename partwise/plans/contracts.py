"""Checks that hold or raise: schemas, keys, cardinalities, coverage and partition proofs.

Data checks count offending rows in one aggregate and raise ``Violation``; a
check that Catalyst could prune away is never used.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.functions.cleaning import is_finite

#: Names and parts of names that give an outcome away. Fixed values.
OUTCOME_NAMES = frozenset({"permeability", "replicate_min", "replicate_max", "replicate_spread", "label", "target", "outcome", "papp", "y"})
OUTCOME_PARTS = ("permeab", "replicate", "label", "target", "outcome", "papp", "response")
#: Names that a predictor may not have, after reduction to letters and digits. Fixed values.
RESERVED_PREDICTORS = frozenset({"curatedid", "moleculeid", "source", "analoguecomponentid", "sealedblockid", "outertestblock", "outerfold", "innerbasket", "partition", "role", "outerrole", "sampleweight"})
PREDICTOR_PARTS = ("permeab", "papp", "logpapp", "label", "target", "outcome", "replicate")


class Violation(RuntimeError):
    """A contract doesn't hold."""


def names_of(schema: T.StructType) -> list[str]:
    """All column names, nested ones included."""
    out = []
    for f in schema.fields:
        out.append(f.name)
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += names_of(kind)
    return out


def reduced(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with exactly these columns in this order."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Violation(f"missing columns: {missing}")
    return df.select(*columns)


def outcome_columns(df: DataFrame) -> list[str]:
    return [n for n in names_of(df.schema) if n.lower() in OUTCOME_NAMES or any(p in n.lower() for p in OUTCOME_PARTS)]


def require_outcome_blind(df: DataFrame) -> DataFrame:
    if found := outcome_columns(df):
        raise Violation(f"outcome columns: {found}")
    return df


def column_families(names: DataFrame, families: Mapping[str, str], name: str = "column") -> DataFrame:
    """(family, n_columns, n_tables, columns): which column names match the pattern of each family, whatever their case.

    ``names`` has table and column, one row each. Families without a match come out with 0.
    """
    spark = names.sparkSession
    every = spark.createDataFrame(sorted(families.items()), "family string, _p string")  # one row per family
    tags = F.array_compact(F.array(*[F.when(F.lower(name).rlike(p), F.lit(f)) for f, p in sorted(families.items())]))
    hits = names.select("table", F.lower(name).alias("_c"), F.explode(tags).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n_columns"), F.count_distinct("table").alias("n_tables"), F.array_join(F.array_sort(F.collect_set("_c")), "|").alias("columns"))
    return every.select("family").join(hits, "family", "left").fillna({"n_columns": 0, "n_tables": 0, "columns": ""})


def require_predictors(df: DataFrame, features: Sequence[str], target: str) -> list[str]:
    """The feature names, if they are there, differ, and neither name nor reveal target, groups or identities."""
    if not features or len(set(features)) != len(features):
        raise Violation("features must be given once each")
    require_columns(df, [*features, target])
    plain = [reduced(f) for f in features]
    if len(set(plain)) != len(plain):
        raise Violation("features collide once reduced to letters and digits")
    bad = [f for f, n in zip(features, plain) if n == reduced(target) or n in RESERVED_PREDICTORS or any(p in n for p in PREDICTOR_PARTS)]
    if bad:
        raise Violation(f"forbidden predictors: {bad}")
    return list(features)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number; null keys are keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise Violation(f"{list(keys)} isn't unique")
    return df


def require_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = df.agg(*[F.count_if(~is_finite(c)).alias(c) for c in columns]).first().asDict()
    if bad := {c: n for c, n in bad.items() if n}:
        raise Violation(f"values that aren't finite: {bad}")
    return df


def join_one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    require_unique(a, keys)
    require_unique(b, keys)
    return a.join(b, list(keys), how)


def join_many_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], complete: bool = True) -> DataFrame:
    """Each row of ``a`` with its row of ``b``, whose keys must be unique; every row must find one if ``complete``."""
    require_unique(b, keys)
    if complete and not a.join(b, list(keys), "left_anti").isEmpty():
        raise Violation(f"rows without a partner on {list(keys)}")
    return a.join(b, list(keys), "left")


def compare_mappings(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, provenance) where two mappings differ: left_only, right_only or value."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_ib")), list(keys), "full")
    kind = F.when(F.col("_ib").isNull(), "left_only").when(F.col("_ia").isNull(), "right_only").when(~F.col("_a").eqNullSafe(F.col("_b")), "value")
    return both.withColumn("provenance", kind).filter("provenance IS NOT NULL").select(*keys, "provenance")


def coverage_gaps(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, gap): expected keys not observed (missing) and observed ones not expected (extra)."""
    e, o = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    return e.join(o, list(keys), "left_anti").withColumn("gap", F.lit("missing")).unionByName(o.join(e, list(keys), "left_anti").withColumn("gap", F.lit("extra")))


def role_proof(roles: DataFrame, population: DataFrame, item: str, scope: Sequence[str], role: str) -> DataFrame:
    """(scope, n_known, n_several, n_unknown, n_missing, is_partition): whether the roles of each scope divide the population.

    Counts of items with a role that are in the population, have several roles, or
    aren't in it, and of those in the population without one.
    """
    known = population.select(item).distinct().withColumn("_known", F.lit(True))
    n = known.count()
    per = roles.groupBy(*scope, item).agg(F.count_distinct(role).alias("_n")).join(known, item, "left")
    out = per.groupBy(*scope).agg(F.count_if("_known").alias("n_known"), F.count_if(F.col("_n") > 1).alias("n_several"), F.count_if(F.col("_known").isNull()).alias("n_unknown"))
    out = out.withColumn("n_missing", F.lit(n) - F.col("n_known"))
    return out.withColumn("is_partition", (F.col("n_several") == 0) & (F.col("n_unknown") == 0) & (F.col("n_missing") == 0))


def group_constant(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n_values): groups in which ``value`` isn't the same throughout."""
    return df.groupBy(group).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def require_empty(df: DataFrame, what: str) -> None:
    if not df.isEmpty():
        raise Violation(what)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first
