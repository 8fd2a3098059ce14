"""Queries over whole inputs, on small tables with what cuts would lose."""

import itertools
import hashlib
import json
import random

from partwise.operators import graph
from partwise.queries import curation, evaluation, structure


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_record_edges_use_whole_sequences(spark, tmp_path):
    ring, chain = "circle_head_to_tail|total=7|main=7|tokens=7", "lariat|total=7|main=6|tokens=7"
    base = list("ABCDEFG")
    late, two = base[:6] + ["X"], base[:5] + ["X", "Y"]  # these differ after the fifth token alone
    turned = base[3:] + base[:3]
    seqs = [(t, s) for t in (ring, chain) for s in (base, late, two, turned, ["Q"] + base[1:])]
    rows = [(f"R{i}", t, json.dumps(s)) for i, (t, s) in enumerate(seqs)] + [("R0", ring, json.dumps(base)), ("bad", ring, "none"), ("null", None, json.dumps(base))]
    put(spark, tmp_path, "curated_records_public", rows, "curated_id string, topology_signature string, canonical_sequence string")
    members = {}
    for r in structure.graph_sequence_members(spark, str(tmp_path)).collect():
        members.setdefault(r.sequence_id, set()).add(r.curated_id)
    assert {frozenset(m) for m in members.values()} == {frozenset(m) for m in ({"R0", "R3"}, *({f"R{i}"} for i in (1, 2, 4, 5, 6, 7, 8, 9)))}
    spins = lambda t, s: [s[i:] + s[:i] for i in range(len(s))] if t == ring else [s]
    edit = lambda i, j: seqs[i][0] == seqs[j][0] and any(sum(x != y for x, y in zip(seqs[i][1], s)) == 1 for s in spins(*seqs[j]))
    near = lambda i, j: len({*seqs[i][1]} & {*seqs[j][1]}) / len({*seqs[i][1]} | {*seqs[j][1]}) >= 0.8
    of = {int(c[1:]): k for k, m in members.items() for c in m}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(seqs)), 2) if of[i] != of[j]]
    want = {tuple(sorted((of[i], of[j]))) for i, j in pairs if edit(i, j)}
    own = set(of.values())  # the queries add a variant of each sequence
    assert want and {(r.a, r.b) for r in structure.graph_one_edit(spark, str(tmp_path)).collect() if {r.a, r.b} <= own} == want
    kinds = {}
    for i, j in pairs:
        for name, holds in (("ecfp4", near(i, j)), ("exact_one_token_edit", edit(i, j))):
            if holds:
                kinds.setdefault(tuple(sorted((of[i], of[j]))), set()).add(name)
    assert {(r.a, r.b): set(r.edge_types.split("|")) for r in structure.graph_typed_edges(spark, str(tmp_path)).collect() if {r.a, r.b} <= own} == kinds


def test_short_sets_give_the_same_pairs(spark):
    r = random.Random(4)
    rows = [(f"s{i:03}", r.sample("ABCDEFGHIJKL", r.randrange(0, 9)), float(r.randrange(1, 9))) for i in range(150)]
    items = spark.createDataFrame(rows, "id string, bits array<string>, weight double")
    for t in (0.4, 0.8):
        got = [sorted(map(tuple, graph.similar_sets(items, t, 0.5, 2.0, short=x).collect())) for x in (False, True)]
        assert got[0] and got[0] == got[1]


def test_short_sets_meet_by_their_parts(spark, monkeypatch):
    r = random.Random(6)
    base = [r.sample(range(120), r.randrange(1, 30)) for _ in range(60)]
    near = [[x for x in b if r.random() > 0.1] + r.sample(range(120), r.randrange(3)) for b in base for _ in range(2)]
    items = spark.createDataFrame([(f"s{i:03}", b, 1.0) for i, b in enumerate(base + near)], "id string, bits array<int>, weight double")
    met = []
    found = graph._part_pairs
    monkeypatch.setattr(graph, "_part_pairs", lambda *a: met.append(found(*a)) or met[-1])
    for t in (0.6, 0.8, 1.0):
        got = {(x.a, x.b): x.similarity for x in graph.similar_sets(items, t, short=True).collect()}
        sets = {f"s{i:03}": {*b} for i, b in enumerate(base + near) if b}
        want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in itertools.combinations(sets.items(), 2) if len(x & y) / len(x | y) >= t}
        assert want and got == want
    assert met[1].count() < 400  # at 0.8; a bit for each of few rare ones makes thousands meet


def test_edits_meet_under_any_rotation(spark, monkeypatch):
    monkeypatch.setattr(graph, "masks", None, raising=False)  # the least rotation of every mask isn't formed
    r = random.Random(7)
    seqs = [(f"q{i:03}", [r.choice("AB*") for _ in range(r.randrange(0, 6))], r.choice(["circle_head_to_tail", "lariat"])) for i in range(120)]
    spins = lambda t, k: [t[i:] + t[:i] for i in range(len(t))] if k.startswith("circle") else [t]
    want = {(i, j) for (i, t, k), (j, u, m) in itertools.combinations(seqs, 2) if k == m and len(t) == len(u) and any(sum(x != y for x, y in zip(t, s)) == 1 for s in spins(u, k))}
    got = graph.one_edit_pairs(spark.createDataFrame(seqs, "id string, tokens array<string>, topology string")).collect()
    assert want and {(x.a, x.b) for x in got} == want and len(got) == len(want)


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_joint_blocks_close_over_every_row(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"S{r.randrange(60)}", f"AC-{r.randrange(80)}") for _ in range(90)]
    dirty = [(f" {s.lower()} ", f"ac-{c[3:]} ") for s, c in rows[:20]] + [(None, "AC-1"), ("S1", None)]
    put(spark, tmp_path, "split_manifest_public", rows + dirty, "source string, analogue_component_id string")
    root = union_find([(("s", s.lower()), ("c", c)) for s, c in rows])
    got = structure.graph_joint_blocks(spark, str(tmp_path)).collect()
    assert {(x.source, x.component) for x in got} == {(s.lower(), c) for s, c in rows} and len(got) == len(set(rows))
    pairs = {(x.block_id, root["s", x.source]) for x in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


def test_components_link_over_unlisted_molecules(spark, tmp_path):
    edges = [("MOL-A", "MOL-X", 0.9), ("MOL-x ", "MOL-B", None), ("MOL-B", "MOL-C", 0.75), ("MOL-Y", "MOL-Z", 0.85), ("MOL-D", "MOL-D", 0.9), ("MOL-W", None, 0.9)]
    put(spark, tmp_path, "analogue_edges", edges, "molecule_id_a string, molecule_id_b string, ecfp4_tanimoto double")
    put(spark, tmp_path, "analogue_components", [(f"MOL-{x}",) for x in "ABCDE"] + [(None,)], "molecule_id string")
    groups = {}
    for r in structure.graph_components(spark, str(tmp_path)).collect():
        groups.setdefault((r.component_id, r.component_size), set()).add(r.id[-1])
    assert sorted((n, "".join(sorted(m))) for (_, n), m in groups.items()) == [(1, "d"), (1, "e"), (1, "w"), (2, "yz"), (4, "abcx")]
    sweep = sorted(map(tuple, structure.graph_threshold_sweep(spark, str(tmp_path)).collect()))
    assert sweep == [(0.7, 5, 5), (0.8, 4, 6), (0.9, 3, 7)]


def test_nearest_training_below_the_threshold(spark):
    r = random.Random(8)
    rows = [(f"i{i:02}", r.sample(range(40), r.randrange(1, 12)), 1.0, "test" if i % 4 == 0 else "train") for i in range(60)] + [("alone", [99], 1.0, "test")]
    got = {x.id: (x.nearest, x.similarity) for x in graph.nearest_training_exact(spark.createDataFrame(rows, "id string, bits array<int>, weight double, split string"), "split", 0.4).collect()}
    want = {}
    for i, b, _, s in rows:
        if s == "test":
            best = min((-len({*b} & {*o}) / len({*b} | {*o}), j) for j, o, _, k in rows if k == "train")
            want[i] = (best[1], -best[0]) if best[0] else (None, None)
    assert got == want and any(s and s < 0.4 for _, s in want.values())


def test_nearest_training_meets_training_items_alone(spark, monkeypatch):
    monkeypatch.setattr(graph, "similar_sets", lambda *_, **__: (_ for _ in ()).throw(AssertionError("all pairs of items")))
    for name, n in (("HELD_BLOCK", 9), ("TRAIN_BLOCK", 13), ("BLOCK_CODES", 200)):
        monkeypatch.setattr(graph, name, n)
    r = random.Random(3)
    bits = [r.sample(range(30), r.randrange(15, 25)) for _ in range(30)] + [r.sample(range(60), r.randrange(1, 5)) for _ in range(30)] + [[70], [71, 72], []]
    rows = [(f"i{i:02}", b + b[:1], 1.0, "test" if i % 3 == 0 else None if i % 20 == 1 else "train") for i, b in enumerate(bits + bits[::2])]  # a bit twice, sets twice
    items = spark.createDataFrame(rows, "id string, bits array<int>, weight double, split string")
    want = {}
    for i, b, _, s in rows:
        if s == "test":
            best = min((-len({*b} & {*o}) / max(1, len({*b} | {*o})), j) for j, o, _, k in rows if k == "train")
            want[i] = (best[1], -best[0]) if best[0] else (None, None)
    for t in (0.3, 0.9, 1.0):
        assert {x.id: (x.nearest, x.similarity) for x in graph.nearest_training_exact(items, "split", t).collect()} == want
    alone = graph.nearest_training_exact(items.filter("split = 'test'"), "split", 0.4).collect()
    assert {x.id for x in alone} == set(want) and not any(x.nearest for x in alone)


def test_inventory_names_every_file(spark, tmp_path):
    folder = tmp_path / "tables"
    (folder / "parts.parquet").mkdir(parents=True)
    for name in ("region.parquet", "lineitem.parquet", "notes.csv", "parts.parquet/part-0.parquet"):
        (folder / name).write_text(name)
    got = {r.name: r.sha256 for r in structure.files_inventory(spark, str(folder)).collect()}
    assert got == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("region.parquet", "lineitem.parquet", "notes.csv", "parts.parquet/part-0.parquet")}


def test_every_used_id_is_reconciled(spark, monkeypatch, tmp_path):
    raw = spark.createDataFrame([("P:1", "s", "CC"), ("P:2", "s", "NN")], "raw_id string, source string, structure string")
    monkeypatch.setattr(curation, "raw_rows", lambda *_: raw)
    rows = [("s", "CC", "P:1| P:2 ||P:9")]
    put(spark, tmp_path, "curated_records_public", rows, "source string, canonical_smiles string, raw_ids_used string")
    got = {r.id: r.reason for r in curation.curate_reconcile_all(spark, str(tmp_path)).collect()}
    assert got == {"P:1": "direct_single_record_match", "P:2": "id_maps_to_another_structure", "P:9": "id_absent_from_raw_namespace"}


def test_bootstrap_draws_ten_thousand(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluation, "predictions", lambda *_: None)
    monkeypatch.setattr(evaluation.m, "source_cube", lambda _: None)
    monkeypatch.setattr(evaluation.inf, "bootstrap", lambda cube, arms, n: seen.append(n) or spark.range(1))
    evaluation.inference_bootstrap_full(spark, "")
    assert seen == [10_000]
