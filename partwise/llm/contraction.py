"""Problem 3: groups of linked records by randomised contraction.

In every round each vertex hooks to the vertex of its closed neighbourhood that
comes first in a fresh hash order; edges are relabelled, loops dropped and
repeats removed, until no edge is left. The hash of a long under a fixed seed is
a bijection of the 64-bit numbers, so the hash itself serves as the label of the
next round and nothing can collide. The per-round mappings are then expanded
backwards. The expected number of edges falls by a constant factor a round,
whatever the shape of the graph (long chains and hubs included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from partwise.llm.ids import hex_number, hex_text
from partwise.plans.lineage import Scratch
from partwise.plans.ranking import running_totals


def contract(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 200, scratch: Scratch | None = None) -> DataFrame:
    """(vertex, group) for every vertex: ``group`` is the smallest vertex of its connected group.

    ``edges`` has long columns a and b in any direction, with repeats and loops;
    ``vertices`` has a long column vertex and adds lone vertices. Rows with a null
    end link nothing, but their other end counts as a vertex. Further columns are
    ignored. Empty inputs give an empty result. Each vertex comes out once.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "contract")
    ends = edges.select("a", "b")
    linked = ends.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = scratch.write_some(linked.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct())
    maps: list[DataFrame] = []
    while e is not None:
        if len(maps) == max_rounds:
            raise RuntimeError("contraction did not end")  # needs a broken source of hashes
        i = len(maps)
        h = lambda c: F.xxhash64(F.lit(i), F.col(c))  # noqa: E731, B023
        both = e.select("x", h("y").alias("hy")).unionAll(e.select(F.col("y").alias("x"), h("x").alias("hy")))
        m = scratch.write(both.groupBy("x").agg(F.min("hy").alias("hy")).select("x", F.least(h("x"), "hy").alias("r")))
        maps.append(m)
        nxt = e.join(m.withColumnRenamed("r", "rx"), "x").select("rx", F.col("y").alias("x")).join(m, "x").filter("rx <> r")
        nxt = scratch.write_some(nxt.select(F.least("rx", "r").alias("x"), F.greatest("rx", "r").alias("y")).distinct())
        scratch.drop(e)
        e = nxt
    all_vertices = ends.select(F.col("a").alias("vertex")).unionAll(ends.select(F.col("b").alias("vertex")))
    if vertices is not None:
        all_vertices = all_vertices.unionAll(vertices.select("vertex"))
    all_vertices = all_vertices.dropna().distinct()
    if not maps:
        return all_vertices.select("vertex", F.col("vertex").alias("group"))
    # Labels of different rounds are different name spaces, so the round goes with the label.
    down = maps[-1].select("x", F.col("r").alias("label"), F.lit(len(maps)).alias("level"))
    for i in range(len(maps) - 2, -1, -1):
        up = down.select(F.col("x").alias("r"), "label", "level")
        down = maps[i].join(up, "r", "left").select("x", F.coalesce("label", "r").alias("label"), F.coalesce("level", F.lit(i + 1)).alias("level"))
        if (len(maps) - i) % 6 == 0:
            down = scratch.write(down)
    down = scratch.write(down)
    least = down.groupBy("level", "label").agg(F.min("x").alias("group"))
    grouped = down.join(least, ["level", "label"]).select(F.col("x").alias("vertex"), "group")
    return all_vertices.join(grouped, "vertex", "left").select("vertex", F.coalesce("group", "vertex").alias("group"))


def contract_ids(edges: DataFrame, vertices: DataFrame, prefix: str) -> DataFrame:
    """The same for text ids: ``edges`` (a, b), ``vertices`` (vertex), result (vertex, group), all strings.

    Ids in plain form become the 64-bit numbers that they spell. If any id has
    another form, all ids get their position in string order instead; either way
    the smallest number is the smallest string.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "contract")
    odd = lambda c, n: F.count_if(F.col(c).isNotNull() & (F.col(n).isNull() | ~F.col(c).startswith(prefix))).alias(n)
    seen = Observation(), Observation()  # other forms are counted as the numbers are written
    numbers = edges.select("a", "b", hex_number("a").alias("na"), hex_number("b").alias("nb")).observe(seen[0], odd("a", "na"), odd("b", "nb"))
    lone = vertices.select("vertex", hex_number("vertex").alias("n")).observe(seen[1], odd("vertex", "n"))
    plain_edges, plain_vertices = scratch.write(numbers.select(F.col("na").alias("a"), F.col("nb").alias("b"))), scratch.write(lone.select(F.col("n").alias("vertex")))
    if not any(n for s in seen for n in s.get.values()):
        found = contract(plain_edges, plain_vertices, scratch=scratch)
        return found.select(hex_text("vertex", prefix).alias("vertex"), hex_text("group", prefix).alias("group"))
    ends = scratch.write(edges.select("a", "b"))
    ids = ends.select(F.col("a").alias("vertex")).unionAll(ends.select(F.col("b").alias("vertex"))).unionAll(vertices.select("vertex")).dropna()
    names = scratch.write(running_totals(ids.distinct(), [], [F.asc("vertex")], position="n", scratch=scratch))
    na, nb = names.toDF("a", "na"), names.toDF("b", "nb")
    numbered = ends.join(na, "a", "left").join(nb, "b", "left").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    found = contract(numbered, names.select(F.col("n").alias("vertex")), scratch=scratch)
    return found.join(names.toDF("_v", "vertex"), "vertex").join(names.toDF("_g", "group"), "group").select(F.col("_v").alias("vertex"), F.col("_g").alias("group"))
