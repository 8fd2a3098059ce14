"""Exact 64-bit numbers for text keys, so that graphs and joins move longs instead of text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.plans.lineage import Scratch

#: Ids of sixteen lower-case hex digits behind a prefix are 64-bit numbers already.
HEX_FORM = r"^[A-Z]+-[0-9a-f]{16}$"


def hex_number(c: str) -> Column:
    """The long behind ``PREFIX-`` and sixteen hex digits, in the order of the digits; null for any other form."""
    digits = F.substring_index(F.col(c), "-", -1)
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("long")
    return F.when(F.col(c).rlike(HEX_FORM), F.shiftleft(half(1) - F.lit(1 << 31), 32) + half(9))


def hex_text(c: str, prefix: str) -> Column:
    """The inverse of ``hex_number``."""
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.concat(F.lit(prefix), half(F.shiftright(F.col(c), 32) + F.lit(1 << 31)), half(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))))


def hashed(seed: int, *cols: str | Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


class Numbers:
    """Different longs for different rows of key columns: their hash, and for the few rows whose hash another row has, a number from a list.

    Among very many rows some hashes coincide under any seed. Of the rows with one
    hash the least keeps it; the others try further seeds until they have a number
    that no row has. The list is empty unless hashes coincide; its size is known
    from what is written, so Spark chooses how to join it.
    """

    def __init__(self, different: DataFrame, cols: Sequence[str], scratch: Scratch, hash_of: Callable[..., Column] = hashed):
        """``different`` has each row of ``cols`` (no nulls) once and may be scanned several times."""
        self.cols, self.hash_of, self.moved = list(cols), hash_of, None
        key = F.struct(*self.cols)
        rows = different.select(*self.cols, hash_of(0, *self.cols).alias("_h"))
        shared = scratch.write(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_k")).filter("_n > 1"))
        seed, waiting = 0, None
        if not shared.isEmpty():
            waiting = scratch.write(rows.join(shared, "_h").filter(key != F.col("_k")).select(*self.cols))
        while waiting is not None and not waiting.isEmpty():
            seed += 1
            tried = waiting.select(*self.cols, hash_of(seed, *self.cols).alias("_id"))
            taken = rows.select(F.col("_h").alias("_id"))
            taken = taken if self.moved is None else taken.unionAll(self.moved.select("_id"))
            once = tried.groupBy("_id").agg(F.min(key).alias("_k")).join(taken, "_id", "left_anti")
            won = scratch.write(once.select("_k.*", "_id"))
            self.moved = won if self.moved is None else scratch.write(self.moved.unionByName(won))
            waiting = scratch.write(waiting.join(won, self.cols, "left_anti"))

    def add(self, df: DataFrame, name: str, cols: Sequence[Column] | None = None) -> DataFrame:
        """``df`` with the number of the given columns (default: the key columns) as ``name``; null where one of them is null."""
        cols = list(cols or [F.col(c) for c in self.cols])
        some = cols[0].isNotNull()
        for c in cols[1:]:
            some &= c.isNotNull()
        plain = self.hash_of(0, *cols)
        if self.moved is None:
            return df.withColumn(name, F.when(some, plain))
        keyed = df.withColumns({f"_m{i}": c for i, c in enumerate(cols)})
        moved = self.moved.toDF(*[f"_m{i}" for i in range(len(cols))], "_moved")
        return keyed.join(moved, [f"_m{i}" for i in range(len(cols))], "left").withColumn(name, F.when(some, F.coalesce("_moved", plain))).select(*df.columns, name)
