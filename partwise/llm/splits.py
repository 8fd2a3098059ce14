"""Problem 4: splits that keep related records together.

Components come from parallel hooking and shortcutting: every root hooks to its
smallest neighbour, pointers are jumped, and edges are lifted to the new parents
until none is left. Component sizes are then chosen for the splits by subset
sums over the size multiplicities.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.ids import Numbers
from partwise.plans.lineage import Scratch
from partwise.plans.ranking import running_totals

#: Sums are marked in pieces of so many, which bounds what a step holds besides the marks.
PIECE = 1 << 22


def hook_and_shortcut(edges: DataFrame, scratch: Scratch, jumps: int = 2, max_rounds: int = 200) -> DataFrame:
    """(vertex, root) for every end of ``edges`` (long columns a and b, no nulls); root is the smallest vertex of the component.

    Loops and repeated edges do no harm; an end that has only loops is its own root.
    Where few vertices are parents, their list is small as written and Spark broadcasts it.
    """
    ends = edges.select("a", "b")
    e = scratch.write(ends.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    lone = e.filter("x = y").select("x", F.col("x").alias("p"))
    parents: list[DataFrame] = []
    live = scratch.write_some(e.filter("x <> y"))
    while live is not None:
        if len(parents) == max_rounds:
            raise RuntimeError("hooking did not end")
        both = live.select("x", "y").unionAll(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        p = scratch.write(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p")))
        for _ in range(jumps):  # every parent is itself a vertex with a parent
            hubs = scratch.write(p.select("p").distinct())
            up = scratch.write_some(p.select(F.col("x").alias("p"), F.col("p").alias("_p")).join(hubs, "p").filter("p <> _p"))
            if up is None:
                break
            p = scratch.write(p.join(up, "p", "left").select("x", F.coalesce("_p", "p").alias("p")))
        parents.append(p)
        lifted = live.join(p.withColumnRenamed("p", "px"), "x").select("px", F.col("y").alias("x")).join(p, "x").filter("px <> p")
        live = scratch.write_some(lifted.select(F.least("px", "p").alias("x"), F.greatest("px", "p").alias("y")).distinct())
    if not parents:
        return lone.toDF("vertex", "root").distinct()
    down = parents[-1]
    for p in reversed(parents[:-1]):
        up = down.select(F.col("x").alias("p"), F.col("p").alias("_r"))
        down = scratch.write(p.join(up, "p", "left").select("x", F.coalesce("_r", "p").alias("p")))
    alone = lone.join(down.select("x"), "x", "left_anti")
    return down.unionByName(alone).toDF("vertex", "root")


def _number(seed: int, kind: str | Column, value: str | Column) -> Column:
    """A hash behind the number of the kind, so that values of earlier kinds come first."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.shiftleft(kind.cast("long"), 59) + F.shiftrightunsigned(F.xxhash64(F.lit(seed), kind, value), 5)


class Related:
    """Rows related by key values and by records, and the components that they form.

    ``keys`` go from coarse to fine (15 at most): vertices are the values of the keys, numbered so
    that coarse ones come first and become parents at once. A row links its values;
    rows of one record link theirs. A row without values stands for its record.

    ``vertices``: (kind, value, lo, hi, vertex), with the least and largest ``mark`` of the rows that have the value.
    ``rows``: (record, mark, hub), hub being the vertex of the first value. ``parents``: (vertex, root).
    """

    def __init__(self, df: DataFrame, record: str, keys: Sequence[str], mark: Column, scratch: Scratch):
        none = F.lit(None).cast("string")
        flat = scratch.write(df.select(F.col(record).cast("string").alias("record"), mark.cast("string").alias("mark"), *[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))
        names = [f"k{i}" for i in range(len(keys))]
        bare = F.coalesce(*[F.col(n) for n in names], none).isNull()
        flat = flat.withColumn(f"k{len(keys)}", F.when(bare, F.col("record")))
        names.append(f"k{len(keys)}")
        each = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(n).alias("value")) for i, n in enumerate(names)])
        nodes = flat.select(F.explode(each).alias("x"), "mark").select("x.*", "mark").filter("value IS NOT NULL")
        nodes = scratch.write(nodes.groupBy("kind", "value").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")))
        numbers = Numbers(nodes, ["kind", "value"], scratch, _number)
        self.vertices = numbers.add(nodes, "vertex")
        for i, n in enumerate(names):
            flat = numbers.add(flat, f"n{i}", [F.lit(i), F.col(n)])
        hub = F.coalesce(*[F.col(f"n{i}") for i in range(len(names))])
        self.rows = flat.select("record", "mark", hub.alias("hub"), F.array_compact(F.array(*[F.col(f"n{i}") for i in range(len(names))])).alias("ns")).filter("hub IS NOT NULL")
        several = self.rows.dropna(subset=["record"]).groupBy("record").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi")).filter("lo <> hi").select("record", "lo")
        ties = self.rows.join(scratch.write(several), "record").select(F.col("lo").alias("a"), F.col("hub").alias("b"))
        edges = self.rows.select(F.col("hub").alias("a"), F.explode("ns").alias("b")).unionAll(ties)
        self.parents = scratch.write(hook_and_shortcut(edges.distinct(), scratch))


def _closest(left: Mapping[int, int], goal: float) -> dict[int, int]:
    """Copies of each size whose sum is closest to ``goal`` (ties: the smaller sum), exactly.

    Taking the largest sizes first gives a sum at some distance below the goal, so
    only sums up to that distance above it matter. It is taken where no whole number
    is closer; else every sum in that range is marked with the item that first reached it.
    """
    aim = math.ceil(goal - 0.5)  # the closest whole number, the smaller one of two
    took, rest = {}, aim
    for s in sorted(left, reverse=True):
        k = min(left[s], rest // s)
        if k:
            took[s] = k
            rest -= s * k
    if rest == 0:
        return took
    cap = aim + rest
    items: list[tuple[int, int, int]] = []  # weight, size, copies
    for s in sorted(left, reverse=True):
        c, k = min(left[s], cap // s), 1
        while c > 0:  # 1, 2, 4, ... copies make every multiplicity
            k = min(k, c)
            items.append((s * k, s, k))
            c -= k
            k *= 2
    first = np.full(cap + 1, -1, np.int16 if len(items) < 32_000 else np.int32)  # the item that first reached a sum
    first[0] = 0
    for i, (w, _, _) in enumerate(items):
        for hi in range(cap + 1, w, -PIECE):  # from above, so that an item is used once
            lo = max(w, hi - PIECE)
            to = first[lo:hi]
            to[(first[lo - w : hi - w] >= 0) & (to < 0)] = i
        if first[aim] >= 0:
            break
    below = aim - int((first[aim::-1] >= 0).argmax())
    above = first[aim:] >= 0
    at = aim + int(above.argmax()) if above.any() else below
    at = min(below, at, key=lambda x: (abs(x - goal), x))
    took = {}
    while at > 0:
        w, s, k = items[first[at]]
        took[s] = took.get(s, 0) + k
        at -= w
    return took


def choose_sizes(sizes: Mapping[int, int], targets: Mapping[str, float]) -> dict[str, dict[int, int]]:
    """How many components of each size go to each split, so that split totals come near their target shares.

    ``sizes`` maps a component size to its number of components. Splits choose in
    ascending order of share; each takes the subset sum closest to its target from
    what is left (ties: the smaller sum), and the split of largest share takes the
    rest. Sums are exact at every size. Targets are scaled to sum to one. No sizes
    give empty choices.
    """
    order = sorted(targets, key=lambda n: (targets[n], n))
    if not order:
        return {}
    total, share = sum(s * c for s, c in sizes.items()), sum(targets.values()) or 1
    left = {s: c for s, c in sizes.items() if s > 0 and c > 0}
    chosen: dict[str, dict[int, int]] = {n: {} for n in order}
    for name in order[:-1]:
        chosen[name] = _closest(left, total * targets[name] / share)
        for s, c in chosen[name].items():
            left[s] -= c
        left = {s: c for s, c in left.items() if c > 0}
    chosen[order[-1]] = left
    return chosen


def group_splits(records: DataFrame, record: str, keys: Sequence[str], targets: Mapping[str, float]) -> DataFrame:
    """(record, component, partition) for every different non-null record; all records of a component share one partition.

    ``component`` is the root's number as text. Rows may repeat; a record whose
    rows carry different key values links them. Null keys link nothing. Records are
    counted and placed by their first value, so that only one join has a row for
    each record, and where few values come first, their list is small as written
    and Spark broadcasts it. Only the table of component sizes is gathered: at most
    sqrt(2 n) different sizes for n records. An empty input gives an empty result.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "splits")
    rel = Related(records, record, keys, F.lit(None), scratch)
    placed = scratch.write(rel.rows.dropna(subset=["record"]).groupBy("record").agg(F.min("hub").alias("vertex")))
    hubs = scratch.write(placed.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).join(rel.parents, "vertex"))
    sized = scratch.write(hubs.groupBy("root").agg(F.sum("n").alias("size")))
    sizes = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = choose_sizes(sizes, targets)
    ranked = running_totals(sized, ["size"], [F.asc("root")], position="rank", scratch=scratch)
    ranges, upto = [], {}
    for name, took in sorted(plan.items()):
        for s, c in sorted(took.items()):
            ranges.append((int(s), upto.get(s, 0), upto.get(s, 0) + c, name))
            upto[s] = upto.get(s, 0) + c
    table = spark.createDataFrame(ranges, "size long, after long, upto long, partition string")
    # At most (splits x different sizes) rows, sqrt-bounded as above.
    given = ranked.join(F.broadcast(table), "size").filter("rank > after AND rank <= upto").select("root", "partition")
    where = scratch.write(hubs.join(given, "root").select("vertex", "root", "partition"))
    return placed.join(where, "vertex").select(F.col("record").alias(record), F.col("root").cast("string").alias("component"), "partition")


def straddling_keys(records: DataFrame, record: str, keys: Sequence[str], partition: str) -> DataFrame:
    """(key_kind, key_value, component): values of ``keys`` whose records lie in more than one partition, each once.

    Rows with a null partition don't count, but they link. The rows come from the
    table of parents, joined with what partitions each vertex has; ``component`` is
    the least `kind=value` of all that is related to the value, directly or over others.
    """
    scratch = Scratch(records.sparkSession, "straddle")
    rel = Related(records, record, keys, F.col(partition), scratch)
    kinds = F.array(*map(F.lit, [*keys, record]))
    named = F.element_at(kinds, F.col("kind") + 1)
    known = scratch.write(rel.parents.join(rel.vertices, "vertex").select("root", named.alias("key_kind"), F.col("value").alias("key_value"), (F.col("lo") != F.col("hi")).alias("_open"), F.when(F.col("kind") < len(keys), F.concat_ws("=", named, "value")).alias("_name")))
    labels = known.groupBy("root").agg(F.min("_name").alias("component"), F.max("_open").alias("_any")).filter("_any")
    return known.filter("_open").join(labels, "root").select("key_kind", "key_value", "component")
