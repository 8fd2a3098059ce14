"""Analogue graphs: similarity edges, one-token-edit edges, connected components and joint blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.hashing import stable_id
from partwise.functions.sequences import mask_buckets, one_token_edit
from partwise.plans.lineage import Scratch
from partwise.plans.ranking import running_totals


#: Sets of one block at most, held out and for training, and codes of one block at most: a block lies in one task's memory.
HELD_BLOCK, TRAIN_BLOCK, BLOCK_CODES = 4096, 16384, 1 << 22
#: Counts of shared codes that are held at once, and columns of the bit matrices they are multiplied from.
_COUNTS, _COLUMNS = 1 << 22, 2048


def _coded(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, codes) for every item with bits: its bits as numbers in the order of frequency, ascending. Comparing and intersecting them is cheap, and a set's first ones are its rarest."""
    bits = items.select("id", F.explode(F.array_distinct("bits")).alias("bit")).filter("bit IS NOT NULL")
    codes = running_totals(bits.groupBy("bit").agg(F.count(F.lit(1)).alias("f")), [], [F.asc("f"), F.asc("bit")], position="code", scratch=scratch).select("bit", F.col("code").cast("int").alias("code"))
    return bits.join(codes, "bit").groupBy("id").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def similar_sets(items: DataFrame, threshold: float, low: float = 0.0, high: float = float("inf"), short: bool = False) -> DataFrame:
    """(a, b, similarity) with a < b for sets of Tanimoto similarity at least ``threshold`` and weight ratio w(a) / w(b) within [low, high].

    ``items``: id (string, unique), bits (array), weight. Prefix filtering: bits are ordered
    from rare to frequent, and two sets that are similar enough share one of their
    first n - ceil(threshold n) + 1 bits, so only those are joined, and only between
    sets whose sizes allow the threshold. Sets without bits are similar to none.
    ``short`` says that sets have few bits: pairs are then found by equal parts of their
    sets (see ``_part_pairs``), of which far fewer meet in vain when the threshold is high
    and no bit is rare. The result is the same.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    scratch = Scratch(items.sparkSession, "similar")
    sets = scratch.write(_coded(items, scratch).join(items.select("id", F.col("weight").cast("double").alias("weight")), "id").withColumn("n", F.size("codes")))
    first = sets.select("id", "n", F.explode(F.slice("codes", 1, F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)).alias("code"))
    a, b = first.toDF("a", "na", "code"), first.toDF("b", "nb", "code")
    sizes = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    pairs = _part_pairs(sets, threshold) if short else a.join(b, "code").filter(sizes).select("a", "b").distinct()
    full = pairs.join(sets.toDF("a", "ca", "wa", "na"), "a").join(sets.toDF("b", "cb", "wb", "nb"), "b").withColumn("_i", F.size(F.array_intersect("ca", "cb")))
    full = full.withColumn("similarity", F.col("_i") / (F.col("na") + F.col("nb") - F.col("_i")))
    ratio = F.col("wa") / F.nullif("wb", F.lit(0.0))
    inside = (ratio >= low) & (ratio <= high) if (low, high) != (0.0, float("inf")) else F.lit(True)
    return full.filter((F.col("similarity") >= threshold) & inside).select("a", "b", "similarity")


def _part_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a < b, once each, among which are all pairs that reach the threshold; ``sets``: id, codes, weight, n.

    Sets of given sizes that are similar enough differ in e codes at most. Of e // 2 + 1
    parts, by the codes' remainders, one at least then differs in one code at most: it is
    the same in both, or that of one without one code is that of the other. So each part
    meets equal ones, and ones that lack one code of it. A word with a bit for each code
    shows nearly all other meetings to be vain before sets are joined.
    """
    least = lambda p, q: math.ceil(threshold / (1 + threshold) * (p + q) - 1e-9)
    ns = sorted(r.n for r in sets.select("n").distinct().collect())  # different sizes, not sets
    near = {q: [p for p in ns if p <= q and least(p, q) <= p] for q in ns}
    parts = {q: max(p + q - 2 * least(p, q) for p in near[q]) // 2 + 1 for q in ns}
    if not ns:
        return sets.select(F.col("id").alias("a"), F.col("id").alias("b"))
    of = F.create_map(*[x for n in ns for x in (F.lit(n), F.array(*[F.lit(k) for k in sorted({parts[q] for q in ns if n in near[q]})]))])
    parts_of = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    word = F.expr("aggregate(codes, 0L, (s, c) -> s | shiftleft(1L, c % 64))")
    each = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda k: F.filter("codes", lambda c: c % F.col("many") == k))
    rows = sets.select("id", "n", "codes", word.alias("word"), F.explode(F.element_at(of, F.col("n"))).alias("many")).select("id", "n", "word", "many", F.posexplode(each).alias("k", "part"))
    whole = rows.select("id", "n", "word", "many", F.xxhash64("many", "k", "part").alias("key"))
    fewer = F.transform("part", lambda x: F.xxhash64("many", "k", F.array_remove("part", x)))
    lacking = rows.select("id", "n", "word", F.explode(fewer).alias("key"))
    other = whole.select("id", "n", "word", "key", F.lit(False).alias("lacks")).unionByName(lacking.withColumn("lacks", F.lit(True)))
    met = whole.toDF("a", "na", "wa", "many", "key").join(other.toDF("b", "nb", "wb", "key", "lacks"), "key")
    differ = F.col("na") + F.col("nb") - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    fit = (F.col("many") == F.element_at(parts_of, F.greatest("na", "nb"))) & (F.bit_count(F.col("wa").bitwiseXOR(F.col("wb"))) <= differ)
    return met.filter((F.col("a") < F.col("b")) | (F.col("lacks") & (F.col("a") != F.col("b")))).filter(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_edit_pairs(items: DataFrame) -> DataFrame:
    """(a, b) with a < b that differ in exactly one token; ``items``: id, tokens, topology.

    Equal sequences are one class, by their least id; classes meet in the buckets of
    their masks (all tokens but one), per topology and length, as ids alone,
    and every meeting is verified. Members of a class are then paired with those of
    the other, and equal sequences with each other where a rotation is one edit away.
    """
    scratch = Scratch(items.sparkSession, "edits")
    given = scratch.write(items.select("id", "tokens", "topology").dropna())
    classes = scratch.write(given.groupBy("tokens", "topology").agg(F.min("id").alias("c")))
    cyc = F.col("topology").startswith("circle_head_to_tail")
    m = scratch.write(classes.select("c", F.explode(mask_buckets("tokens", "topology", cyc)).alias("bucket")))
    meet = m.toDF("a", "bucket").join(m.toDF("b", "bucket"), "bucket").filter("a <= b").select("a", "b").distinct()
    full = meet.join(classes.toDF("ta", "pa", "a"), "a").join(classes.toDF("tb", "pb", "b"), "b")
    near = scratch.write(full.filter(one_token_edit("ta", "tb", "pa", "pb")).select("a", "b"))
    of = given.join(classes, ["tokens", "topology"]).select("id", "c")
    pairs = near.join(of.toDF("x", "a"), "a").join(of.toDF("y", "b"), "b").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def typed_edges(similar: DataFrame, edits: DataFrame, similar_type: str = "ecfp4", edit_type: str = "exact_one_token_edit") -> DataFrame:
    """(a, b, edge_types, similarity): both kinds of edges as one, types sorted and joined by bars; null similarity for pure edit edges."""
    both = similar.select("a", "b", F.lit(similar_type).alias("t"), "similarity").unionByName(edits.select("a", "b", F.lit(edit_type).alias("t"), F.lit(None).cast("double").alias("similarity")))
    return both.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("t")), "|").alias("edge_types"), F.max("similarity").alias("similarity"))


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every vertex: the smallest id that it is connected to; lone vertices are their own root.

    Alternating large-star and small-star rounds: each round links the neighbours of
    a vertex to the least of them, so no vertex's neighbourhood is held in memory
    beyond a minimum. Rounds are written to the shared folder.
    """
    scratch = Scratch(vertices.sparkSession, "components")
    e = edges.select("a", "b").dropna().filter("a <> b")
    e = scratch.write(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = scratch.write(small)
        seen = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = nxt
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not converge")
    ids = vertices.select("id").distinct()
    return ids.join(e.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def component_ids(components: DataFrame, prefix: str) -> DataFrame:
    """(id, component_id, component_size): ids hashed from the sorted members, so they don't depend on the root chosen.

    The hash is defined over the members' text in order, so a component's ids (not its
    rows) meet in one task here; use the root as the label where components are huge.
    """
    named = components.groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("m")).select("root", stable_id(prefix, F.array_join("m", "\x1f")).alias("component_id"), F.size("m").alias("component_size"))
    return components.join(named, "root").select("id", "component_id", "component_size")


def joint_blocks(records: DataFrame, source: str, component: str) -> DataFrame:
    """(source, component, block_id): sources and components closed over each other, ids hashed from their sorted members. Rows with a null in either are ignored."""
    links = records.select(F.col(source).alias("s"), F.col(component).alias("c")).dropna().distinct()
    edges = links.select(F.concat(F.lit("SOURCE::"), "s").alias("a"), F.concat(F.lit("COMPONENT::"), "c").alias("b"))
    vertices = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    roots = connected_components(vertices, edges)
    of = lambda p: F.array_sort(F.collect_set(F.when(F.col("id").startswith(p), F.substr("id", F.lit(len(p) + 1)))))
    blocks = roots.groupBy("root").agg(of("SOURCE::").alias("ss"), of("COMPONENT::").alias("cs")).select("root", stable_id("BLOCK", F.array_join(F.concat("ss", "cs"), "\x1f")).alias("block_id"))
    by_source = roots.filter(F.col("id").startswith("SOURCE::")).join(blocks, "root").select(F.substr("id", F.lit(9)).alias("s"), "block_id")
    return links.join(by_source, "s").select(F.col("s").alias(source), F.col("c").alias(component), "block_id")


def threshold_sweep(edges: DataFrame, vertices: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, n_edges, n_components) when edges with a similarity below the threshold are left out; edges without one always count.

    Thresholds go from high to low: a lower one only adds edges, so its components are
    formed between those of the one before, over the added edges alone.
    """
    spark, scratch = vertices.sparkSession, Scratch(vertices.sparkSession, "sweep")
    e = scratch.write(edges.select("a", "b", "similarity"))
    of, above, out = None, None, []
    for t in sorted(thresholds, reverse=True):
        kept = F.col("similarity").isNull() | (F.col("similarity") >= t)
        added = e.filter(kept if above is None else kept & ~above)
        if of is None:
            of = scratch.write(connected_components(vertices, added))
        else:
            new = added.join(of.toDF("a", "_a"), "a").join(of.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            up = connected_components(of.select(F.col("root").alias("id")), new).toDF("root", "_up")
            of = scratch.write(of.join(up, "root").select("id", F.col("_up").alias("root")))
        above = F.col("similarity").isNull() | (F.col("similarity") >= t)
        out.append((float(t), e.filter(kept).count(), of.select("root").distinct().count()))
    return spark.createDataFrame(out, "threshold double, n_edges long, n_components long")


def sweep_reproduces(sweep: DataFrame, edges: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """(threshold, n_edges, n_components, reproduces): whether a sweep gives at one threshold what forming the components from nothing gives there."""
    kept = edges.filter(F.col("similarity").isNull() | (F.col("similarity") >= threshold))
    own = connected_components(vertices, kept).agg(F.count_distinct("root").alias("_c"))
    n = kept.agg(F.count(F.lit(1)).alias("_e"))
    at = sweep.filter(F.abs(F.col("threshold") - threshold) < 1e-9).join(own).join(n)  # one row each
    return at.select("threshold", "n_edges", "n_components", ((F.col("n_edges") == F.col("_e")) & (F.col("n_components") == F.col("_c"))).alias("reproduces"))


def nearest_training(items: DataFrame, split: str, threshold: float) -> DataFrame:
    """(id, nearest, similarity) for every held-out item: its most similar training item (ties: the smaller id), null where none reaches the threshold.

    ``items``: id, bits, weight and a split column that is ``train`` for training items.
    """
    pairs = similar_sets(items, threshold)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    train = items.filter(F.col(split) == "train").select(F.col("id").alias("other"))
    best = both.join(train, "other", "left_semi").groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("m"))
    held = items.filter(F.col(split) != "train").select("id")
    return held.join(best, "id", "left").select("id", F.col("m.other").alias("nearest"), (-F.col("m.s")).alias("similarity"))


def _shared(h: Sequence[np.ndarray], t: Sequence[np.ndarray], n_held: int, n_train: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first column, counts): how many codes each held-out and each training set share, for some training sets at a time.

    ``h``, ``t``: row and code of every code of the sets. Frequent codes are multiplied
    as matrices, pairs that rare ones make are counted, whichever is less work.
    """
    common, at = np.unique(h[1]), np.unique(t[1])
    common = np.intersect1d(common, at, assume_unique=True)
    (hr, hc), (tr, tc) = ((r[k], np.searchsorted(common, c[k])) for r, c, k in ((*x, np.isin(x[1], common)) for x in (h, t)))
    fh, ft = (np.bincount(c, minlength=len(common)).astype(float) for c in (hc, tc))
    dense = 30 * (fh * ft) > n_held * n_train  # a multiplication takes a fraction of the time of a scattered addition
    step = max(1, _COUNTS // n_held)
    kind = np.float32 if len(common) < 1 << 24 else np.float64  # exact for whole numbers up to there
    number = np.cumsum(dense) - 1
    hd, td = dense[hc], dense[tc]
    rows = hr[np.argsort(hc, kind="stable")]  # held-out sets by code
    start, many = np.cumsum(fh).astype(int) - fh.astype(int), fh.astype(int)
    for first in range(0, n_train, step):
        width = min(step, n_train - first)
        out = np.zeros((n_held, width), kind)
        here = td & (tr >= first) & (tr < first + width)
        for c in range(0, int(dense.sum()), _COLUMNS):
            wide = min(_COLUMNS, int(dense.sum()) - c)
            x, y = np.zeros((n_held, wide), kind), np.zeros((width, wide), kind)
            k, j = number[hc] - c, number[tc] - c
            k, j = hd & (k >= 0) & (k < wide), here & (j >= 0) & (j < wide)
            x[hr[k], number[hc[k]] - c] = 1
            y[tr[j] - first, number[tc[j]] - c] = 1
            out += x @ y.T
        col, code = tr[rare := ~td & (tr >= first) & (tr < first + width)] - first, tc[rare]
        upto = np.cumsum(many[code])
        for c in range(0, int(upto[-1]) if len(upto) else 0, _COUNTS):  # pairs of a held-out and a training set with a rare code, in lots of that many
            pair = np.arange(c, min(c + _COUNTS, int(upto[-1])))
            entry = np.searchsorted(upto, pair, side="right")
            row = rows[start[code[entry]] + pair - (upto[entry] - many[code[entry]])]
            out += np.bincount(row * width + col[entry], minlength=out.size).reshape(out.shape).astype(kind)
        yield first, out


def _block_nearest(held: pa.Table, train: pa.Table) -> pa.Table:
    """(id, other, similarity): the most similar training set of each held-out set of two blocks, the smaller id of equals, if they share a code."""
    train = train.sort_by("other")
    h, t = (x.column("codes").combine_chunks() for x in (held, train))
    (n, m), pairs = (np.asarray(x.value_lengths()) for x in (h, t)), [(np.repeat(np.arange(len(x)), np.asarray(x.value_lengths())), np.asarray(x.flatten())) for x in (h, t)]
    best, at = np.zeros(len(n)), np.zeros(len(n), int)
    for first, k in _shared(*pairs, len(n), len(m)) if len(n) and len(m) else ():
        k = k.astype(float)
        k /= (n[:, None] + m[None, first : first + k.shape[1]]) - k
        top = k.argmax(1)
        value = k[np.arange(len(n)), top]
        better = value > best
        best[better], at[better] = value[better], top[better] + first
    found = best > 0
    return pa.table({"id": held.column("id").filter(pa.array(found)), "other": train.column("other").take(pa.array(at[found])), "similarity": pa.array(best[found])})


def _nearest_of(held: DataFrame, train: DataFrame, sizes: dict, near: bool) -> DataFrame:
    """Best pairs of blocks whose bands of sizes lie within one of each other (``near``) or farther apart; every such pair of blocks is compared once.

    ``sizes``: for held (False) and training sets (True) the number of blocks of each band.
    """
    blocks = lambda x: F.create_map(*[F.lit(v).cast("int") for kv in sizes[x].items() for v in kv])
    own = lambda df, x: df.withColumn("b", F.pmod(F.xxhash64("id"), F.element_at(blocks(x), F.col("band"))).cast("int"))

    def meet(df: DataFrame, x: bool) -> DataFrame:
        apart = F.abs(F.col("_band") - F.col("band"))
        out = own(df, x).withColumn("_band", F.explode(F.array(*[F.lit(k).cast("int") for k in sizes[not x]]))).filter(apart <= 1 if near else apart > 1)
        return out.withColumn("_b", F.explode(F.sequence(F.lit(0), F.element_at(blocks(not x), F.col("_band")) - 1)))

    h = meet(held, False).select("id", "codes", F.col("band").alias("hx"), F.col("b").alias("hb"), F.col("_band").alias("tx"), F.col("_b").alias("tb"))
    t = meet(train, True).select(F.col("id").alias("other"), "codes", F.col("_band").alias("hx"), F.col("_b").alias("hb"), F.col("band").alias("tx"), F.col("b").alias("tb"))
    keys = ["hx", "hb", "tx", "tb"]
    kind = held.schema["id"].dataType.simpleString()
    each = h.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(_block_nearest, f"id {kind}, other {kind}, similarity double")
    return each.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "other")).alias("m"))


def nearest_training_exact(items: DataFrame, split: str, threshold: float) -> DataFrame:
    """The same without a least similarity; ``threshold`` only says what the fast pass covers. Null only for items that share no bit with any training item.

    Only held-out sets meet training sets, equal sets as one, block by block; each pair
    of blocks is a task of its own. Sets whose sizes rule the threshold out meet in a
    second pass, for the items that the first leaves below it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    scratch = Scratch(items.sparkSession, "nearest")
    given = scratch.write(items.select("id", (F.col(split) == "train").alias("train"), "bits").filter("train IS NOT NULL"))
    sets = scratch.write(_coded(given, scratch).join(given.select("id", "train"), "id"))
    wide = max(0.1, -math.log(threshold) * (1 + 1e-9))  # sizes within the threshold lie in one band or in neighbouring ones
    classes = scratch.write(sets.groupBy("train", "codes").agg(F.min("id").alias("id")).withColumn("band", F.floor(F.log(F.size("codes")) / wide).cast("int")))
    sizes = {False: {}, True: {}}
    for r in classes.groupBy("train", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("codes")).alias("codes")).orderBy("train", "band").collect():  # a row per band
        sizes[r.train][r.band] = max(-(-r.n // (TRAIN_BLOCK if r.train else HELD_BLOCK)), -(-r.codes // BLOCK_CODES))
    ids = given.filter("NOT train").select("id")
    if not sizes[False] or not sizes[True]:
        return ids.select("id", F.lit(None).cast(ids.schema["id"].dataType).alias("nearest"), F.lit(None).cast("double").alias("similarity"))
    held, train = (classes.filter(x).select("id", "codes", "band") for x in ("NOT train", "train"))
    best = scratch.write(held.join(_nearest_of(held, train, sizes, True), "id", "left").select("id", "m"))
    if any(abs(a - b) > 1 for a in sizes[False] for b in sizes[True]):
        low = best.filter(F.col("m").isNull() | (-F.col("m.s") < threshold))
        more = scratch.write(_nearest_of(scratch.write(held.join(low, "id", "left_semi")), train, sizes, False)).withColumnRenamed("m", "_m")
        best = best.join(more, "id", "left").select("id", F.least("m", "_m").alias("m"))
    of = sets.filter("NOT train").select(F.col("id").alias("item"), "codes").join(held.drop("band"), "codes").select("item", "id")
    found = of.join(best, "id").select(F.col("item").alias("id"), "m")
    return ids.join(found, "id", "left").select("id", F.col("m.other").alias("nearest"), (-F.col("m.s")).alias("similarity"))
