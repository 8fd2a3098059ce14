"""Problems 2 to 5 against brute force on small inputs."""

import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from partwise.llm.contraction import contract, contract_ids
from partwise.llm.editjoin import cross_split_pairs, edit_join, segment_windows, substring_windows
from partwise.llm.fusion import LEAD, N_CHANNELS, copy_probability, fuse, pair_counts, parse, posterior, prepare
from partwise.llm.ids import Numbers, hex_number, hex_text
from partwise.plans.lineage import Scratch
from partwise.llm.splits import choose_sizes, group_splits, straddling_keys


def components(edges, vertices=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for v in vertices:
        find(v)
    for a, b in edges:
        if a is None or b is None:
            for x in (a, b):
                if x is not None:
                    find(x)
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def graphs():
    r = random.Random(5)
    yield "chain", [(i, i + 1) for i in range(300)], [900]
    yield "star", [(0, i) for i in range(1, 300)] + [(5, 5)], []
    yield "random", [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(350)] * 2 + [(None, 7), (8, None), (None, None), (-(2**63), 2**63 - 1)], [None, 1000, 1000]
    yield "empty", [], []
    yield "loops", [(3, 3), (4, 4)], [5]


@pytest.mark.parametrize("name,edges,extra", list(graphs()), ids=lambda x: x if isinstance(x, str) else "")
def test_contract(spark, name, edges, extra):
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in edges], "a long, b long, x int, r int")
    vs = spark.createDataFrame([(v,) for v in extra], "vertex long")
    got = contract(df, vs).collect()
    assert {r.vertex: r.group for r in got} == components(edges, [v for v in extra if v is not None])
    assert len(got) == len({r.vertex for r in got})


@pytest.mark.parametrize("odd", [False, True])
def test_contract_ids_plain_and_odd_forms(spark, odd):
    r = random.Random(2)
    ids = [f"MOL-{r.getrandbits(64):016x}" for _ in range(80)] + ["MOL-ffffffffffffffff", "MOL-0000000000000000"] + (["MOL-x", "other", ""] if odd else [])
    edges = [(r.choice(ids), r.choice(ids)) for _ in range(60)] + [(None, ids[0])]
    got = contract_ids(spark.createDataFrame(edges, "a string, b string"), spark.createDataFrame([(i,) for i in ids], "vertex string"), "MOL-").collect()
    assert {r.vertex: r.group for r in got} == components(edges, ids)


def test_hex_numbers_round_trip_in_order(spark):
    ids = ["MOL-0000000000000000", "MOL-00000000ffffffff", "MOL-7fffffffffffffff", "MOL-8000000000000000", "MOL-ffffffffffffffff"]
    rows = spark.createDataFrame([(i,) for i in ids], "v string").select("v", hex_number("v").alias("n")).select("v", "n", hex_text("n", "MOL-").alias("t")).orderBy("n").collect()
    assert [r.v for r in rows] == [r.t for r in rows] == ids


def test_numbers_differ_though_hashes_coincide(spark):
    few = lambda seed, *cols: F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 9))
    rows = spark.createDataFrame([(i % 3, f"v{i}") for i in range(200)], "kind int, value string")
    numbers = Numbers(rows, ["kind", "value"], Scratch(spark, "test"), few)
    assert numbers.moved.count() > 10
    twice = rows.unionAll(rows).unionAll(spark.createDataFrame([(1, None)], "kind int, value string"))
    got = numbers.add(twice, "n").collect()
    assert len(got) == 401 and len({(r.kind, r.value) for r in got if r.n is not None}) == len({r.n for r in got} - {None}) == 200
    plain = Numbers(rows, ["value"], Scratch(spark, "test"))
    assert plain.moved is None and plain.add(rows, "n").select("n").distinct().count() == 200


KEYS = ["source", "comp", "block"]
RECORDS = "rec string, source string, comp string, block string, part string, root string, vertex int"


def split_rows(seed=3, n=300):
    r = random.Random(seed)
    pick = lambda p, m: None if r.random() < 0.2 else f"{p}{r.randrange(m)}"
    rows = [(f"r{i}", pick("s", 120), pick("c", 150), pick("b", 150), r.choice(["train", "test", None]), "z", 0) for i in range(n)]
    return rows + rows[:40] + [("r1", "s1", None, None, "train", None, None), (None, "s2", "c3", None, "test", None, None), ("lone", None, None, None, None, None, None)]


def record_components(rows):
    edges, names = [], set()
    for rec, *keys in [row[:4] for row in rows]:
        nodes = ([("rec", rec)] if rec else []) + [(k, v) for k, v in zip(KEYS, keys) if v]
        edges += [(nodes[0], x) for x in nodes]
        names |= {rec} - {None}
    c = components(edges)
    return {n: c[("rec", n)] for n in names}


def test_group_splits_keep_components_and_meet_targets(spark):
    rows = split_rows()
    targets = {"train": 0.6, "validation": 0.2, "test": 0.2}
    got = group_splits(spark.createDataFrame(rows, RECORDS), "rec", KEYS, targets).collect()
    expected = record_components(rows)
    assert len(got) == len(expected) and {r.rec for r in got} == set(expected)
    pairs = {(expected[r.rec], r.component) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert len({(r.component, r.partition) for r in got}) == len({r.component for r in got})


def test_straddling_keys(spark):
    rows = split_rows(9)
    parts = {}
    for _, *keys, part, _, _ in rows:
        for k, v in zip(KEYS, keys):
            if v and part:
                parts.setdefault((k, v), set()).add(part)
    got = straddling_keys(spark.createDataFrame(rows, RECORDS), "rec", KEYS, "part").collect()
    assert sorted((r.key_kind, r.key_value) for r in got) == sorted(k for k, p in parts.items() if len(p) > 1)
    edges = [(("r", rec or f"row{i}"), (k, v)) for i, (rec, *keys, _, _, _) in enumerate(rows) for k, v in zip(KEYS, keys) if v]
    of, least = components(edges), {}
    for (k, v), root in of.items():
        if k != "r":
            least[root] = min(least.get(root, "z"), f"{k}={v}")
    assert all(r.component == least[of[r.key_kind, r.key_value]] for r in got)


def test_splits_of_empty_table(spark):
    df = spark.createDataFrame([], RECORDS)
    assert group_splits(df, "rec", KEYS, {"train": 0.5, "test": 0.5}).count() == 0
    assert straddling_keys(df, "rec", KEYS, "part").count() == 0


def test_choose_sizes_is_closest_subset_sum():
    r = random.Random(1)
    for _ in range(40):
        sizes = {r.randrange(1, 12): r.randrange(1, 4) for _ in range(4)}
        total = sum(s * c for s, c in sizes.items())
        got = choose_sizes(sizes, {"a": 0.3, "b": 0.7})
        items = [s for s, c in sizes.items() for _ in range(c)]
        best = min(abs(sum(x) - 0.3 * total) for n in range(len(items) + 1) for x in set(itertools.combinations(sorted(items), n)))
        assert abs(sum(s * c for s, c in got["a"].items()) - 0.3 * total) == pytest.approx(best)
        assert all(got["a"].get(s, 0) + got["b"].get(s, 0) == c for s, c in sizes.items())


def test_choose_sizes_odd_cases():
    assert choose_sizes({}, {"a": 0.5, "b": 0.5}) == {"a": {}, "b": {}}
    assert choose_sizes({100: 1}, {"a": 0.2, "b": 0.8}) == {"a": {}, "b": {100: 1}}
    big = choose_sizes({9_000_000: 1, 1_000_000: 3, 1: 500_001}, {"a": 0.1, "b": 0.9})
    assert abs(sum(s * c for s, c in big["a"].items()) - 0.1 * 12_500_001) <= 2


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice("CNO="))
        elif s and at < len(s):
            s[at : at + 1] = [] if kind == 1 else [r.choice("CNO=")]
    return "".join(s)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_edit_join_finds_every_pair(spark, k):
    r = random.Random(k)
    base = ["".join(r.choice("CNO=") for _ in range(r.randrange(0, 40))) for _ in range(40)] + ["", "C", "CN", "é" * 30]
    other = sorted({edited(r, b, r.randrange(0, k + 3)) for b in base for _ in range(3)} | {""})
    base = sorted(set(base))
    a = spark.createDataFrame(list(enumerate(base)) + [(None, "x"), (99, None)], "id long, s string")
    b = spark.createDataFrame(list(enumerate(other)), "id long, s string")
    got = {(x.cut_id, x.other_id): x.distance for x in edit_join(a, b, k).collect()}
    want = {(i, j): d for i, x in enumerate(base) for j, y in enumerate(other) if (d := levenshtein(x, y)) <= k}
    assert got == want
    assert {(x.cut_id, x.other_id): x.distance for x in edit_join(a, b, k, most_bits=0).collect()} == want  # without the filter


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_a_segment_is_met_within_k_edits(k):
    r = random.Random(k)
    for _ in range(4000):
        x = "".join(r.choice("CN") for _ in range(r.randrange(0, 8 * k)))
        y = edited(r, x, k)
        cut = {(q, s, x[p : p + w]) for q, s, p, w in segment_windows(len(x), k)}
        assert cut & {(q, s, y[p : p + w]) for q, s, p, w in substring_windows(len(y), k)}, (x, y)


def test_cross_split_pairs(spark):
    schema = "record string, molecule string, structure string, split string, id long"
    rows = [
        ("a", "m1", "C" * 30, "train", 1), ("a", "m1", "C" * 30, "train", 2), ("b", "m2", "C" * 29 + "N", "validation", 1), ("c", "m1", None, "final_test", 1),
        ("d", None, "N" * 40, "train", 1), ("e", None, "N" * 33, "calibration", 1), ("f", "m2", "O" * 50, None, 1), (None, "m2", "C" * 30, "train", 1), ("g", None, None, "train", 1),
    ]
    got = sorted(map(tuple, cross_split_pairs(spark.createDataFrame(rows, schema)).collect()))
    assert got == [("a", "b"), ("a", "c")]
    assert cross_split_pairs(spark.createDataFrame([], schema)).count() == 0


MANIFEST = "raw_group_id string, raw_id string, year string, version string, recorded_at timestamp, curation_status string, is_censored boolean, curated_id string, used int, k int"
CURATED = "curated_id string, raw_ids_used string"


def manifest(spark, rows):
    return spark.createDataFrame(rows, MANIFEST), spark.createDataFrame([("SSCP-1", "P:3 | P:4||"), ("SSCP-1", "p:9"), (None, "P:1"), ("SSCP-2", None)], CURATED)


def test_best_rows_decide_under_the_prior(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        ("g", "P:10", "2001", "n/a", t(9), "excluded", None, None, 1, 1),
        ("g", "P:3", " ", "1.0", t(1), "Included ", False, "sscp-1", 1, 1),
        ("g", "P:4", "2002", "-", None, "INCLUDED", None, " SSCP-1", 1, 1),
        ("g", "P:9", "2003", None, t(3), "included", True, "SSCP-1", 1, 1),
        ("g", "P:9", "2003", None, t(3), "included", True, "SSCP-1", 1, 1),
        ("tie", "P:11", "2001", "1", t(2), None, None, None, 1, 1),
        ("tie", "P:9", "2004", "1", t(2), None, None, None, 1, 1),
        ("one", "P:1", "2001", "1", t(2), None, None, None, 1, 1),
        (None, "P:1", "2001", "1", t(2), None, None, None, 1, 1),
        ("g", None, "2009", "1", t(20), None, None, None, 1, 1),
        ("none", "P:1", "NA", "unknown", None, None, None, None, 1, 1),
        ("none", "P:2", "None", "", None, None, None, None, 1, 1),
        *[("big", f"P:{i}" + "0" * 40, f"{i}", "1", t(2), "included", None, None, 1, 1) for i in range(1, 200)],  # many values, numbers of any length
        ("big", "P:7" + "0" * 39, "x", "1", t(2), "included", None, None, 1, 1),
    ]
    m, c = manifest(spark, rows)
    got = sorted((r.group, r.field_name, r.raw_id, r.value) for r in fuse(m, c, ["year", "version"], prior=LEAD).filter("several").collect())
    far = "P:7" + "0" * 39
    assert got == [("big", "version", far, "1"), ("big", "year", far, "x"), ("g", "version", "P:3", "1.0"), ("g", "year", "P:4", "2002"), ("tie", "version", "P:9", "1"), ("tie", "year", "P:9", "2004")]
    e, c = manifest(spark, [])
    assert fuse(e, c, ["year"], prior=LEAD).count() == 0


def test_p2_found_forms_no_estimates(spark, monkeypatch):
    from partwise.llm import table_queries

    r = random.Random(5)
    texts = ["2001", "2002", None, "na"]
    rows = [(r.choice(["g1", "g2", "g3", f"h{i}"]), r.choice([f"P:{i}", f"Q{i}x", "none"]), r.choice(texts), r.choice(texts), r.choice([None, datetime(2024, 1, r.randrange(1, 9))]), r.choice(["included", "x"]), r.choice([None, True]), None, 0, 0) for i in range(200)]
    m, c = manifest(spark, rows)
    m = m.withColumns({"topology_signature": F.lit(None).cast("string"), "canonical_sequence": F.col("year")})
    want = {(x.group, x.field_name, x.raw_id) for x in fuse(m, c, table_queries.FIELDS, prior=LEAD).filter("several").collect()}
    monkeypatch.setattr(table_queries, "_table", lambda spark, sf, name: m if name == "curation_manifest" else c)
    monkeypatch.setattr(table_queries, "fuse", lambda *_: (_ for _ in ()).throw(AssertionError("a fusion without effect")))
    got = [tuple(x) for x in table_queries.p2_found(spark, "").collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_heavy_groups_come_out_as_light_ones(spark, monkeypatch):
    from partwise.llm import fusion

    r = random.Random(4)
    rows = [(r.choice(["g1", "g2", "g3"]), f"P:{i}", r.choice(["2001", "2002", None]), r.choice(["1", "2", "na"]), datetime(2024, 1, r.randrange(1, 20)), r.choice(["included", "x"]), None, None, 0, 0) for i in range(300)]
    m, c = manifest(spark, rows)
    light = sorted(map(tuple, fuse(m, c, ["year", "version"]).collect()))
    monkeypatch.setattr(fusion, "heavy_keys", lambda df, keys: spark.createDataFrame([("g1",), ("g3",)], "group string"))
    heavy = sorted(map(tuple, fuse(m, c, ["year", "version"]).collect()))
    assert [x[:3] + x[4:] for x in light] == [x[:3] + x[4:] for x in heavy] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(light, heavy))


def test_fusion_prefers_accurate_channels_over_copies(spark):
    t = datetime(2024, 1, 1)
    rows = []
    for i in range(60):  # included rows agree with each other; excluded ones often err in the same way
        truth, wrong = "A", "B"
        rows += [(f"g{i}", f"P:{i}0", truth, None, t, "included", False, None, 0, 0), (f"g{i}", f"P:{i}1", truth, None, None, "included", None, None, 0, 0)]
        rows += [(f"g{i}", f"P:{i}2", wrong if i % 3 else truth, None, t, "excluded", True, None, 0, 0)]
    rows += [("q", "P:1", None, None, None, None, None, None, 0, 0), ("w", "P:2", "Z", None, t, None, None, None, 0, 0)]
    m, c = manifest(spark, rows)
    got = {r.group: r for r in fuse(m, c, ["year", "version"]).collect()}
    assert len(got) == 61 and "q" not in got and got["w"].value == "Z"
    assert all(got[f"g{i}"].value == "A" for i in range(60)) and got["g1"].raw_id == "P:10" and got["g1"].n_values == 2
    e, c = manifest(spark, [])
    assert fuse(e, c, ["year"]).count() == 0


def test_posterior_and_copying():
    a, none = np.full(N_CHANNELS, 0.8), np.zeros((N_CHANNELS, N_CHANNELS))
    pattern = [(1, [(0, 1.0), (1, 1.0)]), (1, [(2, 1.0)])]
    assert parse("1*0:3,1:2;1*2:1") == (None, pattern) and parse("1|2*7:1;1*7:2") == (1, [(2, [(7, 0.25)]), (1, [(7, 0.5)])])
    alone = posterior(pattern, a, none)
    assert posterior(pattern, a, none, 1, LEAD)[-1] == 1 and posterior(pattern, a, none, 1, 0.0).tolist() == alone.tolist()
    channels, true, false = pair_counts([(1, [(0, 0.5), (1, 1.0)]), (2, [(0, 0.25)])], 0)
    assert channels == [0, 1] and true[0, 1] == 0.5 and false[0, 1] == 0 and false[0, 0] == 0.125
    copied = none.copy()
    copied[0, 1] = copied[1, 0] = 1
    assert alone[0] > 0.9 and posterior(pattern, a, copied)[0] < alone[0]
    counts = np.zeros((3, 3, 3))
    counts[1, 0, 1] = counts[1, 1, 0] = 8  # shared false values
    counts[0, 0, 2] = counts[0, 2, 0] = 2
    counts[2, 0, 2] = counts[2, 2, 0] = 6  # mostly different
    d = copy_probability(*counts, np.full(3, 0.8))
    assert d[0, 1] > 0.99 and d[0, 2] < 0.1 and d[1, 2] == 0


def test_fusion_equals_a_plain_loop(spark):
    """The same estimates object by object, without patterns or Spark."""
    from partwise.llm import fusion

    r = random.Random(6)
    rows = []
    for g in range(120):
        truth = r.choice("ABC")
        for k in range(r.randrange(1, 7)):
            good = r.random() < 0.7
            value = truth if r.random() < (0.9 if good else 0.4) else r.choice(["B", "D", "E", "na", None])
            at = None if r.random() < 0.1 else datetime(2024, r.randrange(1, 13), 1)
            rows.append((f"g{g}", f"P:{g}{k}", value, r.choice(["1", "2", "-"]), at, "included" if good else "excluded", r.choice([True, False, None]), "SSCP-1" if good else None, 0, 0))
    m, c = manifest(spark, rows)
    fields = ["year", "version"]
    got = {(x.group, x.field_name): (x.value, round(x.posterior, 6)) for x in fuse(m, c, fields).collect()}

    counts = {}
    for x in prepare(m, c, fields).withColumn("channel", fusion.channel(fields, fusion.age_cuts(m))).collect():
        for f in fields:
            v = x[f]
            if v is not None and v.strip().lower() not in ("", "na", "-"):
                by = counts.setdefault((x.group, f), {}).setdefault(x.channel, {})
                by[v.strip()] = by.get(v.strip(), 0) + 1
    shares = {o: {(ch, v): n / sum(by.values()) for ch, by in chs.items() for v, n in by.items()} for o, chs in counts.items()}
    accuracy, dep = np.full(N_CHANNELS, 0.8), np.zeros((N_CHANNELS, N_CHANNELS))

    def judge(o):
        values = sorted({v for _, v in shares[o]})
        score = []
        for v in values:
            total, before = 0.0, []
            for ch in sorted((ch for ch, w in shares[o] if w == v), key=lambda ch: (-accuracy[ch], ch)):
                free = np.prod([1 - fusion.COPY_RATE * dep[ch, b] for b in before])
                total += shares[o][ch, v] * free * np.log(fusion.N_FALSE * accuracy[ch] / (1 - accuracy[ch]))
                before.append(ch)
            score.append(total)
        e = np.exp(score)
        return values, e / (e.sum() + fusion.N_FALSE + 1 - len(values))

    for _ in range(200):
        n, mass, pairs = np.zeros(N_CHANNELS), np.zeros(N_CHANNELS), np.zeros((3, N_CHANNELS, N_CHANNELS))
        for o in shares:
            values, post = judge(o)
            win = values[int(post.argmax())]
            for (a, v), x in shares[o].items():
                n[a] += x
                mass[a] += x * post[values.index(v)]
                for (b, w), y in shares[o].items():
                    if a != b:
                        pairs[2 if v != w else 0 if v == win else 1, a, b] += x * y
        last, accuracy = accuracy, np.where(n > 0, np.clip((mass + 0.8) / (n + 1), 0.01, 0.99), 0.8)
        dep = copy_probability(*pairs, accuracy)
        if np.abs(accuracy - last).max() <= 1e-3:
            break
    want = {}
    for o in shares:
        values, post = judge(o)
        want[o] = (values[int(post.argmax())], round(float(post.max()), 6))
    assert got == want


def test_what_copy_detection_changes(spark, monkeypatch):
    """A channel and its copy outvote one better channel unless the copied votes are discounted."""
    from partwise.llm import fusion

    t, r, rows = datetime(2024, 1, 1), random.Random(8), []
    for i in range(300):
        truth, wrong = str(r.randrange(5)), str(r.randrange(5, 9))
        first = truth if r.random() < 0.6 else wrong
        other = lambda p, bad: truth if r.random() < p else f"{bad}{r.randrange(9)}"
        claims = [("included", False, first), ("included", True, first), ("excluded", False, other(0.9, "a")), ("excluded", True, other(0.6, "b")), ("excluded", None, other(0.6, "c"))]
        rows += [(f"g{i:03}", f"P:{i}{k}", v, truth, t, status, censored, None, 0, 0) for k, (status, censored, v) in enumerate(claims)]
    m, c = manifest(spark, rows)
    truths = m.groupBy(F.col("raw_group_id").alias("group")).agg(F.min("version").alias("truth"))
    right = lambda: fuse(m, c, ["year"]).join(truths, "group").filter("value = truth").count()
    with_it = right()
    monkeypatch.setattr(fusion, "COPY_RATE", 1e-9)
    without = right()
    print(with_it, without)
    assert with_it > without + 10
