"""Problem 6: filling containers of fixed capacity by exact-complement hashing.

Sizes are integers up to the capacity, so a histogram of at most `capacity` rows
describes any number of items. The plan is made on that histogram: for each size,
largest first, combinations of one, two or three further sizes that fill its gap
exactly are looked up in indexes of single, pair and triple sums and consumed as
often as the counts allow; what is left goes best-fit into the smallest gap that
holds it. Each step serves all items of a size at once and uses up a size or a
gap, so the plan's length depends on the capacity alone. Items then find their
container by their rank among the items of their size.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.plans.lineage import Scratch
from partwise.plans.ranking import running_totals

#: After so many used-up sizes the index of pair sums is made anew; until then it may name sums that no longer exist, which the count check refuses.
STALE = 256


class Plan:
    """Slots (size, first rank, items, first container): the i-th of these items goes to the i-th container from there on."""

    def __init__(self, counts: Mapping[int, int], capacity: int):
        if capacity < 1:
            raise ValueError("a capacity must be positive")
        self.capacity, self.bins, self.slots = capacity, 0, []
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            if not 1 <= size <= capacity:
                raise ValueError(f"size {size} doesn't fit {capacity}")
            self.left[size] = n
        self.used = [0] * (capacity + 1)
        self.gone = STALE
        self._exact()
        self._best_fit()

    def _slot(self, size: int, n: int, first: int) -> None:
        self.slots.append((size, self.used[size], n, first))
        self.used[size] += n
        self.left[size] -= n

    def _times(self, sizes: list[int]) -> int:
        """How often the counts allow this combination."""
        return min(int(self.left[s]) // k for s, k in Counter(sizes).items())

    def _pair(self, total: int, with_: list[int], most: int) -> list[int] | None:
        """Two sizes of the given sum, the larger at most `most`, larger ones first."""
        lo, hi = (total + 1) // 2, min(total - 1, most)
        if hi < lo:
            return None
        there = self.left > 0
        for a in (np.flatnonzero(there[lo : hi + 1] & there[total - hi : total - lo + 1][::-1]) + lo)[::-1]:
            if self._times([*with_, int(a), total - int(a)]) > 0:
                return [int(a), total - int(a)]
        return None

    def _fill(self, size: int) -> list[int] | None:
        """Up to three further sizes that fill what `size` leaves open."""
        gap = self.capacity - size
        if gap == 0:
            return []
        if self._times([size, gap]) > 0:
            return [gap]
        if two := self._pair(gap, [size], gap):
            return two
        if self.gone >= STALE:
            spectrum = np.fft.rfft((self.left > 0).astype(float), 2 * self.capacity + 2)
            self.pairs, self.gone = np.fft.irfft(spectrum * spectrum, 2 * self.capacity + 2) > 0.5, 0  # numbers of pairs, exact to far below a half
        low = -(-gap // 3)  # the largest of three is a third of the gap at least
        if gap - 1 > low:
            for c in (np.flatnonzero((self.left[low : gap - 1] > 0) & self.pairs[2 : gap - low + 1][::-1]) + low)[::-1]:
                c = int(c)
                if two := self._pair(gap - c, [size, c], c):
                    return [c, *two]
        return None

    def _exact(self) -> None:
        for size in range(self.capacity, 0, -1):
            while self.left[size] > 0 and (more := self._fill(size)) is not None:
                n, first = self._times([size, *more]), self.bins
                for s in [size, *more]:
                    self._slot(s, n, first)
                self.bins += n
                self.gone += sum(self.left[s] == 0 for s in {size, *more})

    def _best_fit(self) -> None:
        gaps: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges of containers
        have = 0

        def add(gap: int, first: int, n: int) -> None:
            nonlocal have
            if gap > 0 and n > 0:
                gaps[gap].append((first, n))
                have |= 1 << gap

        for size in np.flatnonzero(self.left > 0)[::-1]:
            size = int(size)
            while (n := int(self.left[size])) > 0:
                if open_ := have >> size:
                    gap = size + (open_ & -open_).bit_length() - 1
                    first, there = gaps[gap].pop()
                    if not gaps[gap]:
                        have &= ~(1 << gap)
                    n = min(n, there)
                    self._slot(size, n, first)
                    add(gap, first + n, there - n)
                    add(gap - size, first, n)
                else:
                    each = self.capacity // size
                    full, rest = divmod(n, each)
                    for k, new in ((each, full), (rest, 1 if rest else 0)):
                        if new and k:
                            for _ in range(k):
                                self._slot(size, new, self.bins)
                            add(self.capacity - k * size, self.bins, new)
                            self.bins += new

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items of smaller sizes by size, the place of each slot's first item among all items by size and rank, and the container less the first rank of each slot."""
        base = np.concatenate([[0], np.cumsum(np.array(self.used, np.int64))])
        s = np.array(sorted(self.slots), np.int64).reshape(-1, 4)
        return base, base[s[:, 0]] + s[:, 1], s[:, 3] - s[:, 1]


def pack(items: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """(limit_name, id, part_no, n_tokens, container_id) for every item and limit.

    ``items`` has id and n_tokens (null counts as 0); further columns are ignored.
    An item that fits is never split. A larger one fills containers of its own to
    capacity and its remainder is packed like an item; a multiple of the capacity
    leaves none. An item without tokens has one part, given to some container of
    the limit. Items with equal sizes take their places in the order of id. Only
    histograms (at most the sum of the capacities) reach the driver. No items give
    no rows.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "pack")
    base = scratch.write(items.select("id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")))
    caps = F.array(*[F.struct(F.lit(name).alias("limit_name"), F.lit(int(c)).alias("cap")) for name, c in limits.items()])
    each = base.select("id", "n", F.explode(caps).alias("l")).select("l.*", "id", "n")
    each = each.select("limit_name", "cap", "id", "n", F.when(F.col("n") > F.col("cap"), F.expr("n div cap")).otherwise(F.lit(0)).alias("whole"))
    each = each.withColumn("rest", F.col("n") - F.col("whole") * F.col("cap"))
    sizes: dict[str, dict[int, int]] = {name: {} for name in limits}
    for name, rest, n in each.filter("rest > 0").groupBy("limit_name", "rest").agg(F.count(F.lit(1)).alias("c")).collect():
        sizes[name][rest] = n
    plans = {name: Plan(sizes[name], int(c)) for name, c in limits.items()}
    tables = spark.sparkContext.broadcast({name: (*p.lookup(), p.bins) for name, p in plans.items()})

    @F.pandas_udf("long")
    def container(name: pd.Series, rest: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(name), np.int64)
        names, r, k = name.to_numpy(), rest.to_numpy(np.int64), rank.to_numpy(np.int64) - 1
        for one in set(names):
            base, keys, shift, bins = tables.value[one]
            here = names == one
            if len(keys):
                at = np.searchsorted(keys, base[r[here]] + k[here], "right") - 1
                out[here] = np.where(r[here] > 0, k[here] + shift[at], k[here] % max(1, bins))
        return pd.Series(out)

    ranked = running_totals(each.filter("rest > 0 OR n = 0"), ["limit_name", "rest"], [F.asc("id")], position="rank", scratch=scratch)
    parts = ranked.select("limit_name", "id", F.col("whole").cast("int").alias("part_no"), F.col("rest").alias("n_tokens"), F.concat_ws("-", "limit_name", container("limit_name", "rest", "rank").cast("string")).alias("container_id"))
    own = each.filter("whole > 0").select("limit_name", "id", "cap", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))).alias("part_no"))
    own = own.select("limit_name", "id", "part_no", F.col("cap").cast("long").alias("n_tokens"), F.concat_ws("-", "limit_name", F.lit("own"), F.col("id").cast("string"), F.col("part_no").cast("string")).alias("container_id"))
    return parts.unionByName(own)
