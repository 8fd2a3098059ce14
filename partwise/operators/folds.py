"""Fold construction, contracts and leakage counts."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from partwise.functions.hashing import frame_hash, id_set_hashes
from partwise.plans.contracts import Violation, require_empty, require_finite, require_unique
from partwise.plans.ranking import running_totals


def greedy_folds(sizes: DataFrame, scope: Sequence[str], group: str, size: str, folds: int) -> DataFrame:
    """(scope, group, size, fold): groups by size downwards, then id, each to the smallest fold so far (1-based; ties to the first).

    The rule is sequential, so a scope's groups (not its rows) pass one task in their
    order, in batches; a heap holds the totals, so each group costs the logarithm of
    the number of folds.
    """
    out = T.StructType([*[sizes.schema[c] for c in scope], sizes.schema[group], sizes.schema[size], T.StructField("fold", T.IntegerType())])
    names = [*scope, group, size, "fold"]

    def place(batches):
        heap, last = [], None
        for b in batches:
            at = []
            for *where, _, n in b[[*scope, group, size]].itertuples(index=False, name=None):
                if where != last:
                    heap, last = [(0, f) for f in range(1, folds + 1)], where
                total, f = heap[0]
                heapq.heapreplace(heap, (total + int(n), f))
                at.append(f)
            yield b.assign(fold=np.array(at, np.int32))[names]

    rows = sizes.select(*scope, group, size)
    ordered = (rows.repartition(*scope) if scope else rows.coalesce(1)).sortWithinPartitions(*scope, F.desc(size), F.asc(group))
    return ordered.mapInPandas(place, out)


def outer_folds(records: DataFrame, block: str) -> DataFrame:
    """(block, fold): each block is one fold, numbered in the order of its id."""
    ids = records.select(block).dropna().distinct()
    return ids.withColumn("outer_fold", F.dense_rank().over(Window.orderBy(block)))  # one row per block


def fold_roles(records: DataFrame, block: str) -> DataFrame:
    """Every block's role in every fold (test in its own, else train) with its sizes: blocks squared rows by definition."""
    stats = records.filter(F.col(block).isNotNull()).groupBy(block).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_sources"), F.count_distinct("analogue_component_id").alias("n_components"))
    stats = stats.withColumn("outer_fold", F.dense_rank().over(Window.orderBy(block)))
    tests = F.array_sort(F.collect_list(F.struct(F.col("outer_fold"), F.col(block).alias("test_block"))))
    every = stats.withColumn("t", F.explode(stats.agg(tests).scalar()))
    return every.select(F.col("t.outer_fold").alias("outer_fold"), F.col("t.test_block").alias("test_block"), block, F.when(F.col("t.test_block") == F.col(block), "test").otherwise("train").alias("role"), "n_rows", "n_sources", "n_components")


def inner_baskets(roles: DataFrame, block: str, baskets: int = 4) -> DataFrame:
    """Greedy baskets of the training blocks of each fold."""
    return greedy_folds(roles.filter("role = 'train'"), ["outer_fold", "test_block"], block, "n_rows", baskets).withColumnRenamed("fold", "inner_basket")


def ordinal_baskets(folds: DataFrame, fold: str) -> DataFrame:
    """(outer_fold, fold, inner_basket): the remaining folds of each outer fold in order."""
    f = folds.select(F.col(fold).alias("fold")).distinct()
    others = f.withColumn("outer_fold", F.explode(f.agg(F.array_sort(F.collect_list("fold"))).scalar())).filter("fold <> outer_fold")
    return others.withColumn("inner_basket", F.row_number().over(Window.partitionBy("outer_fold").orderBy("fold"))).select("outer_fold", "fold", "inner_basket")


def group_fold(records: DataFrame, record: str, group: str, folds: int = 5) -> DataFrame:
    """(record, group fold): greedy folds of whole groups by their number of rows."""
    sizes = records.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    f = greedy_folds(sizes, ["_all"], group, "n", folds).select(group, F.col("fold").alias(f"{group}_fold"))
    return records.select(record, group).join(f, group).select(record, group, f"{group}_fold")


def hash_balanced_folds(records: DataFrame, record: str, sizes: DataFrame, fold: str, size: str, salt: str) -> DataFrame:
    """(record, fold) of the given exact sizes, in the order of a salted hash: a matched-size control that needs no generator state."""
    upto, ends = 0, []
    for f, n in sizes.select(fold, size).orderBy(fold).collect():  # one row per fold
        upto += n
        ends.append(F.struct(F.lit(upto).alias("hi"), F.lit(f).alias(fold)))
    ranked = records.select(record).distinct().withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(record)), 256))
    placed = running_totals(ranked, [], [F.asc("_h"), F.asc(record)], position="_p")
    at = F.try_element_at(F.filter(F.array(*ends), lambda x: x["hi"] >= F.col("_p")), F.lit(1))[fold] if ends else F.lit(None).cast(sizes.schema[fold].dataType)
    return placed.select(record, at.alias(fold)).dropna(subset=[fold])


def matched_size_assignment(groups: Sequence[tuple[str, int]], capacities: Sequence[int], seed: int) -> dict[str, int]:
    """Whole groups (id, size) to folds (from 1) of exact capacities, at random: a matched-size control by NumPy's PCG64 draws.

    Groups are shuffled from the order of their ids. Larger ones take, in that order, a
    fold with room, with a chance in proportion to the room left; single records then
    meet the remaining places, both shuffled once more. The order of draws is part of
    the definition, so this runs on the driver, over one entry per group.
    """
    if sum(n for _, n in groups) != sum(capacities):
        raise ValueError("sizes and capacities must have one sum")
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), np.array(capacities, int), {}
    by_id = sorted(groups)
    shuffled = [by_id[i] for i in rng.permutation(len(by_id))]
    for g, n in shuffled:
        if n > 1:
            fits = np.flatnonzero(left >= n)
            if not len(fits):
                raise ValueError("a group fits no fold any more")
            at = int(rng.choice(fits, p=left[fits] / left[fits].sum()))
            left[at] -= n
            out[g] = at + 1
    single = [g for g, n in shuffled if n == 1]
    single = [single[i] for i in rng.permutation(len(single))]
    places = np.repeat(np.arange(1, len(left) + 1), left)
    return out | dict(zip(single, places[rng.permutation(len(places))].tolist()))


def contract_roles(assigned: DataFrame, baskets: DataFrame) -> DataFrame:
    """(outer_fold, inner_basket, record, role) from records with their own fold (``fold``) and baskets per outer fold.

    ``baskets``: outer_fold, fold, inner_basket. In the contract of a basket its records
    validate, those of other baskets fit, those of the outer fold test. A record becomes
    a row of every contract, so records are spread over the tasks before that.
    """
    assigned = assigned.repartition(int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record")
    b = baskets.select("outer_fold", "fold", "inner_basket")
    per = b.select("outer_fold", "inner_basket").distinct().withColumnRenamed("inner_basket", "contract_basket")
    train = assigned.join(b, "fold").join(per, "outer_fold").select("outer_fold", F.col("contract_basket").alias("inner_basket"), "record", F.when(F.col("inner_basket") == F.col("contract_basket"), "validation").otherwise("fit").alias("role"))
    test = assigned.select("record", F.col("fold").alias("outer_fold")).join(per, "outer_fold").select("outer_fold", F.col("contract_basket").alias("inner_basket"), "record", F.lit("test").alias("role"))
    return train.unionByName(test)


def contract_manifest(roles: DataFrame) -> DataFrame:
    """Counts and id-set hashes of every role in each (outer_fold, inner_basket)."""
    at = ["outer_fold", "inner_basket"]
    per = id_set_hashes(roles, [*at, "role"], "record")
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    nothing = F.sha2(F.lit(""), 256)
    out = []
    for role in ("fit", "validation", "test"):
        out += [F.coalesce(of(role, "n"), F.lit(0)).alias(f"n_{role}"), F.coalesce(of(role, "h"), nothing).alias(f"{role}_sha256")]
    return per.groupBy(*at).agg(*out)


def overlap_counts(records: DataFrame, fold: str, groups: Sequence[str]) -> DataFrame:
    """(group_kind, n_groups, n_in_several): how many values of each grouping lie in more than one fold."""
    flat = F.array(*[F.struct(F.lit(g).alias("group_kind"), F.col(g).cast("string").alias("v")) for g in groups])
    per = records.filter(F.col(fold).isNotNull()).select(F.explode(flat).alias("x"), fold).select("x.*", fold).filter("v IS NOT NULL").groupBy("group_kind", "v").agg(F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    return per.groupBy("group_kind").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_in_several"))


def gate_counts(records: DataFrame, partition: str, minimum_components: int) -> DataFrame:
    """Rows, molecules, components and sources per partition, and whether it has enough components."""
    return records.filter(F.col(partition).isNotNull()).groupBy(partition).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("molecule_id").alias("n_molecules"), F.count_distinct("analogue_component_id").alias("n_components"), F.count_distinct("source").alias("n_sources"),
    ).withColumn("has_enough", F.col("n_components") >= minimum_components)


#: The partitions in order and the least numbers that a release needs, by their names in the gate. Fixed names; numbers are the caller's.
PARTITIONS = ("train", "validation", "calibration", "final_test")


def gate_summary(records: DataFrame, minima: Mapping[str, int], partition: str = "partition") -> DataFrame:
    """(rule, n, passed) for one release of partitions: components per partition against their minima, sources outside
    train and in the final test against theirs, values in several partitions (none allowed) and, last, ``admissible``.

    ``minima``: train, validation, calibration, final_test, sources_outside_train, final_test_sources. Rows without a partition don't count.
    """
    r = records.filter(F.col(partition).isNotNull())
    part = F.col(partition)
    counts = [F.count_distinct(F.when(part == p, F.col("analogue_component_id"))).alias(f"{p}_analogue_components") for p in PARTITIONS]
    counts += [F.count_distinct(F.when(part != "train", F.col("source"))).alias("sources_outside_train"), F.count_distinct(F.when(part == "final_test", F.col("source"))).alias("final_test_sources")]
    one = r.agg(*counts)
    need = [minima[p] for p in PARTITIONS] + [minima["sources_outside_train"], minima["final_test_sources"]]
    found = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n"), (F.col(c) >= n).alias("passed")) for c, n in zip(one.columns, need)])
    names = {"source": "sources", "analogue_component_id": "components", "sealed_block_id": "blocks"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    several = overlap_counts(r, partition, list(names)).select(F.concat(kind[F.col("group_kind")], F.lit("_in_multiple_partitions")).alias("rule"), F.col("n_in_several").alias("n"), (F.col("n_in_several") == 0).alias("passed"))
    every = one.select(F.explode(found).alias("x")).select("x.*").unionByName(several)
    whole = every.agg(F.count_if(~F.col("passed")).alias("n"), F.min("passed").alias("passed"))
    return every.unionByName(whole.select(F.lit("admissible").alias("rule"), "n", "passed"))


def fold_targets(assigned: DataFrame, labels: DataFrame, fold: str, record: str, value: str) -> DataFrame:
    """(outer_fold, record, value): the training targets of each fold; held-out targets never appear. Meant for a sink partitioned by fold."""
    folds = assigned.select(F.col(fold).alias("outer_fold")).distinct()
    own = assigned.select(record, F.col(fold).alias("_f"))
    every = own.withColumn("outer_fold", F.explode(folds.agg(F.array_sort(F.collect_list("outer_fold"))).scalar())).filter("outer_fold <> _f")
    return every.join(labels.select(record, value), record).select("outer_fold", record, value)


def authoritative_records(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Labelled training records and test records whose label is null, in one table."""
    return train.unionByName(test.withColumn(target, F.lit(None).cast(train.schema[target].dataType)).select(*train.columns))


def scaffold_or_singleton(scaffold: str, record: str) -> Column:
    """A scaffold key, or one of the record's own where it is empty."""
    return F.when(F.trim(F.coalesce(F.col(scaffold), F.lit(""))) == "", F.concat(F.lit("NO_SCAFFOLD:"), record)).otherwise(F.col(scaffold))


def role_batch(roles: DataFrame, rows: DataFrame, fold: int, basket: int, role: str, record: str = "record") -> DataFrame:
    """The rows of one role of one contract, in the order of their ids; raises if an id is missing from ``rows`` or there twice."""
    ids = roles.filter((F.col("outer_fold") == fold) & (F.col("inner_basket") == basket) & (F.col("role") == role)).select(record)
    batch = rows.join(ids, record, "left_semi")
    require_unique(batch, [record])
    require_empty(ids.join(rows, record, "left_anti"), f"ids of {role} without rows")
    return batch.orderBy(record)


def weight_sidecar(weights: DataFrame, record: str, weight: str) -> DataFrame:
    """(n_rows, weights_sha256) of usable training weights: finite, none negative, one positive at least. The hash is that of the content in any order."""
    require_finite(weights, [weight])
    low, high = weights.agg(F.min(weight), F.max(weight)).first()
    if low is None or low < 0 or high <= 0:
        raise Violation("weights must not be negative and some must be positive")
    return frame_hash(weights.select(record, weight)).withColumnRenamed("content_hash", "weights_sha256")


def contract_problems(roles: DataFrame, manifest: DataFrame) -> DataFrame:
    """(outer_fold, inner_basket, role, problem): where a manifest's numbers or id-set hashes don't follow from the roles.

    Counts and hashes are derived anew per role, not through ``contract_manifest``; a
    contract that only one side has is a problem of every role.
    """
    again = id_set_hashes(roles, ["outer_fold", "inner_basket", "role"], "record")
    stated = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"n_{r}").alias("_n"), F.col(f"{r}_sha256").alias("_h")) for r in ("fit", "validation", "test")])
    said = manifest.select("outer_fold", "inner_basket", F.explode(stated).alias("x")).select("outer_fold", "inner_basket", "x.*").filter("_n > 0")
    both = again.join(said, ["outer_fold", "inner_basket", "role"], "full")
    problem = F.when(F.col("_n").isNull(), "not_in_manifest").when(F.col("n").isNull(), "not_in_roles").when(F.col("n") != F.col("_n"), "count").when(F.col("h") != F.col("_h"), "hash")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("outer_fold", "inner_basket", "role", "problem")


def residual_gaps(residuals: DataFrame, assigned: DataFrame, record: str = "record") -> DataFrame:
    """(outer_fold, n_residuals, n_repeated, n_missing): whether each fold has one residual for every record outside it."""
    n = assigned.select(record).distinct().count()
    own = assigned.groupBy(F.col("fold").alias("outer_fold")).agg(F.count_distinct(record).alias("_own"))
    per = residuals.groupBy("outer_fold", record).agg(F.count(F.lit(1)).alias("_c")).groupBy("outer_fold").agg(F.sum("_c").alias("n_residuals"), F.count_if(F.col("_c") > 1).alias("n_repeated"), F.count(F.lit(1)).alias("_d"))
    return per.join(own, "outer_fold").select("outer_fold", "n_residuals", "n_repeated", (F.lit(n) - F.col("_own") - F.col("_d")).alias("n_missing"))
