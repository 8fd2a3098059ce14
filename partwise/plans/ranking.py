"""Positions and running totals over ordered groups of any size.

A window over a group puts the whole group into one task. Here the rows are
written once, range-partitioned by (group, order) into as many parts as their
size asks for and sorted there, so a large group spreads over many parts. Each
part numbers its rows and adds up its values as it is written; what lies before
a group's piece in other parts is one row per (group, part), which is joined.
No second exchange of the rows is needed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from partwise.plans.lineage import Scratch

#: Bytes of written (compressed) rows in one part at most, and at least while there are idle cores.
PART_BYTES, LEAST_BYTES = 16 << 20, 1 << 19
_INDEX_BITS = 33  # of monotonically_increasing_id, below the part's number


def _parts(size: int, cores: int) -> int:
    return max(1, -(-size // PART_BYTES), min(cores, -(-size // LEAST_BYTES)))


def _sums(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """``df`` with ``_r{i}``: the running sum of each value over the rows of a partition, in their order."""
    whole = {v: isinstance(df.schema[v].dataType, T.IntegralType) for v in values}
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"_r{i}", T.LongType() if whole[v] else T.DoubleType()) for i, v in enumerate(values)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [0] * len(values)
        for b in batches:
            columns = list(b.columns)
            for i, v in enumerate(values):
                kind = pa.int64() if whole[v] else pa.float64()
                sums = np.cumsum(pc.fill_null(b.column(b.schema.get_field_index(v)).cast(kind), 0).to_numpy(zero_copy_only=False)) + before[i]
                before[i] = sums[-1] if len(sums) else before[i]
                columns.append(pa.array(sums, kind))
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *[f"_r{i}" for i in range(len(values))]])

    return df.mapInArrow(run, schema)


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], values: Sequence[str] = (), position: str = "position", scratch: Scratch | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with its 1-based ``position`` in each group and, for each number v, ``v_running`` and ``v_total``.

    ``order`` must be unique within a group, else equal rows take positions in
    no fixed order. Null group keys form groups of their own; a null value adds
    nothing. Sums are longs for whole numbers, else doubles. An empty input gives
    an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession, "rank")
    rows = scratch.write(df)
    n = partitions or _parts(scratch.last_bytes(), df.sparkSession.sparkContext.defaultParallelism)
    key = [*[F.col(c) for c in group], *order]
    sorted_ = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    summed = _sums(sorted_, values) if values else sorted_
    mark = F.monotonically_increasing_id()
    placed = scratch.write(summed.withColumn("_at", mark))
    scratch.drop(rows)
    placed = placed.withColumn("_part", F.shiftright("_at", _INDEX_BITS))
    start = [F.min_by(F.col(f"_r{i}") - F.coalesce(F.col(v), F.lit(0)), "_at").alias(f"_c{i}") for i, v in enumerate(values)]
    pieces = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), *start, *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = pieces.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), (zero(F.sum("_n").over(before)) - F.col("_first") + 1).alias("_n0"),
        *[x for i in range(len(values)) for x in ((zero(F.sum(f"_s{i}").over(before)) - F.col(f"_c{i}")).alias(f"_b{i}"), zero(F.sum(f"_s{i}").over(whole)).alias(f"_t{i}"))],
    )
    same = placed["_part"] == offsets["_p"]
    for i, c in enumerate(group):
        same &= placed[c].eqNullSafe(offsets[f"_g{i}"])
    return placed.join(offsets, same).select(
        *[placed[c] for c in df.columns], (F.col("_at") + F.col("_n0")).alias(position),
        *[x for i, v in enumerate(values) for x in ((F.col(f"_r{i}") + F.col(f"_b{i}")).alias(f"{v}_running"), F.col(f"_t{i}").alias(f"{v}_total"))],
    )
