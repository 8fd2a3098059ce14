"""Sizes of very unequal groups against plain Python."""

import random

from pyspark.sql import functions as F

from partwise.operators.concentration import ranked_sizes, size_conflicts
from partwise.plans.ranking import running_totals
from partwise.plans.skew import distinct_counts, heavy_keys

SCHEMA = "run string, pct int, key string, item string, other string, _slot int"


def rows(seed=1, n=4000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if r.random() < 0.6 else f"k{r.randrange(60)}"
        out.append((f"run{r.randrange(2)}", 80, key, f"i{r.randrange(n)}", None if r.random() < 0.2 else f"o{r.randrange(5)}", 1))
    out += out[:500]
    out += [(None, 80, "x", "i", None, None), ("run0", 80, None, "i", None, None), ("run0", 80, "x", None, None, None)]
    return out


def expected(data):
    sets = {}
    for run, pct, key, item, *_ in data:
        if None not in (run, pct, key, item):
            sets.setdefault((run, pct), {}).setdefault(key, set()).add(item)
    out = {}
    for scope, by in sets.items():
        total, seen = sum(map(len, by.values())), 0
        for rank, (key, items) in enumerate(sorted(by.items(), key=lambda x: (-len(x[1]), x[0])), 1):
            seen += len(items)
            out[(*scope, key)] = (len(items), rank, round(seen / total, 9))
    return out


def test_ranked_sizes_equal_plain_python(spark):
    data = rows()
    got = ranked_sizes(spark.createDataFrame(data, SCHEMA), ["run", "pct"], "key", "item", {"n_other": "other"}).collect()
    assert {(r.run, r.pct, r.key): (r.n_records, r.block_rank, round(r.cumulative_record_share, 9)) for r in got} == expected(data)


def test_heavy_and_light_ways_agree(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert {r.key for r in heavy_keys(df, ["key"], share=0.2, fraction=1.0).collect()} == {"hot"}
    a = distinct_counts(df, ["run", "key"], {"n": "item"}, "rows", share=0.001, fraction=1.0).collect()  # every key is heavy
    b = distinct_counts(df, ["run", "key"], {"n": "item"}, "rows", share=2.0).collect()  # none is
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == len({(r.run, r.key) for r in a})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ranked_sizes(df, ["run", "pct"], "key", "item").count() == 0


def test_running_totals_with_null_group_and_value(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), (None, 1, 2), (None, 4, 3)], "g string, k int, v int")
    got = {(r.g, r.k): (r.position, r.v_running, r.v_total) for r in running_totals(df, ["g"], [F.asc("k")], ["v"], partitions=3).collect()}
    assert got == {("a", 1): (1, 5, 12), ("a", 2): (2, 5, 12), ("a", 3): (3, 12, 12), (None, 1): (1, 2, 5), (None, 4): (2, 5, 5)}


def test_size_conflicts(spark):
    e = spark.createDataFrame([("a", 3, 0.6), ("b", 2, 1.0), ("c", 1, 0.5)], "key string, n_records long, cumulative_record_share double")
    s = spark.createDataFrame(
        [("a", 3, 0.6), ("a", 3, 0.6), ("b", 2, 0.99), ("d", 1, 0.1), (None, 1, 0.1), ("c", 1, None)], "key string, n_records long, cumulative_record_share double"
    )
    assert {r.key for r in size_conflicts(e, s, ["key"]).collect()} == {"b", "c", "d"}
