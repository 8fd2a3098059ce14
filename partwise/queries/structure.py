"""Graphs, folds and contracts, ledgers and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.functions.hashing import stable_id
from partwise.functions.sequences import canonical_tokens, parse_tokens, tokens_text
from partwise.functions.text import plain_id, plain_partition, plain_words, sql_plain_id, sql_plain_partition, sql_plain_words
from partwise.operators import allocation, folds, graph, ledger
from partwise.plans import contracts
from partwise.plans.lineage import Scratch
from partwise.queries.common import rounded, table
from partwise.sources import files

# Graphs


def graph_similar_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose sets of event types by hour are similar, with a bound on the ratio of their numbers of events."""
    bit = F.concat_ws("-", "event_type", F.hour("ts").cast("string"))
    m = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.collect_set(bit).alias("bits"), F.count(F.lit(1)).cast("double").alias("weight"))
    return rounded(graph.similar_sets(m, 0.4, 0.8, 1.25))


def _record_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(curated_id, id, tokens, topology) for every curated record whose sequence parses; rotations of one ring are one sequence with one id."""
    r = table(spark, sf, "curated_records_public").select("curated_id", F.col("topology_signature").alias("topology"), parse_tokens("canonical_sequence").alias("t")).dropna()
    r = r.select("curated_id", canonical_tokens("t", "topology").alias("tokens"), "topology").distinct()
    return r.withColumn("id", stable_id("SEQ", "topology", tokens_text("tokens")))


def graph_sequence_members(spark: SparkSession, sf: str) -> DataFrame:
    """Which curated records have which of the sequences that the record edges join."""
    return _record_sequences(spark, sf).select(F.col("id").alias("sequence_id"), "curated_id")


def _sequence_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every different sequence of the curated records, and each with its last token exchanged: the table itself has few neighbours."""
    m = Scratch(spark, "sequences").write(_record_sequences(spark, sf).select("tokens", "topology").distinct())
    other = F.concat(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), F.array(F.lit("Gly")))
    both = m.unionByName(m.filter("size(tokens) > 0").select(canonical_tokens(other, "topology").alias("tokens"), "topology")).distinct()
    return both.withColumn("id", stable_id("SEQ", "topology", tokens_text("tokens")))


def graph_one_edit(spark: SparkSession, sf: str) -> DataFrame:
    """One-edit edges between the different whole sequences."""
    return graph.one_edit_pairs(_sequence_variants(spark, sf))


def graph_typed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Both kinds of edges between the different whole sequences."""
    m = Scratch(spark, "sequences").write(_sequence_variants(spark, sf))
    sets = m.select("id", F.col("tokens").alias("bits"), F.size("tokens").cast("double").alias("weight"))
    return rounded(graph.typed_edges(graph.similar_sets(sets, 0.8, short=True), graph.one_edit_pairs(m)))


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "analogue_edges").select(plain_id("molecule_id_a").alias("a"), plain_id("molecule_id_b").alias("b"), F.col("ecfp4_tanimoto").alias("similarity"))
    v = table(spark, sf, "analogue_components").select(plain_id("molecule_id").alias("id")).filter("id IS NOT NULL").distinct()
    return v, e


def _split_users(spark: SparkSession, sf: str) -> DataFrame:
    bit = F.concat_ws("-", "event_type", F.hour("ts").cast("string"))
    m = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(bit).alias("bits"), F.count(F.lit(1)).cast("double").alias("weight"))
    return m.select(F.col("user_id").cast("string").alias("id"), "bits", "weight", F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split"))


def graph_nearest_training(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar training user of every fifth, held-out user, however low its similarity."""
    return rounded(graph.nearest_training_exact(_split_users(spark, sf), "split", 0.4)).fillna({"nearest": "", "similarity": 0.0})


def _linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vertices are the listed molecules and both ends of every edge; edges are all that have two ends."""
    v, e = _edges(spark, sf)
    ends = v.unionByName(e.select(F.col("a").alias("id"))).unionByName(e.select(F.col("b").alias("id")))
    return ends.filter("id IS NOT NULL").distinct(), e.dropna(subset=["a", "b"])


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components over all edges, of listed molecules and of those that only edges name, with ids hashed from their members."""
    return graph.component_ids(graph.connected_components(*_linked(spark, sf)), "AC")


def graph_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Edges and components at three thresholds, over all edges and the same molecules."""
    v, e = _linked(spark, sf)
    return graph.threshold_sweep(e, v, (0.70, 0.80, 0.90))


def graph_sweep_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the sweep gives at 0.80 what components formed from nothing give there."""
    v, e = _linked(spark, sf)
    return graph.sweep_reproduces(graph.threshold_sweep(e, v, (0.70, 0.80, 0.90)), e, v, 0.80)


def graph_joint_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of sources and components closed over all rows of the split manifest that name both."""
    m = table(spark, sf, "split_manifest_public").select(plain_words("source").alias("source"), plain_id("analogue_component_id").alias("component"))
    return graph.joint_blocks(m, "source", "component")


# Folds


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records with a block, source and component of the fixed nations and regions."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # fixed table
    return c.select(F.col("c_custkey").cast("string").alias("curated_id"), F.col("n_name").alias("sealed_block_id"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 40).cast("string").alias("analogue_component_id"), F.col("c_acctbal").alias("value"), F.when(F.col("c_custkey") % 9 > 0, (F.col("c_custkey") % 60).cast("string")).alias("scaffold_raw"))


def folds_roles(spark: SparkSession, sf: str) -> DataFrame:
    return folds.fold_roles(_records(spark, sf), "sealed_block_id")


def folds_inner_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy baskets of each fold's training blocks."""
    return folds.inner_baskets(folds.fold_roles(_records(spark, sf), "sealed_block_id"), "sealed_block_id")


def folds_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Group folds by component and by block."""
    r = _records(spark, sf)
    return folds.group_fold(r, "curated_id", "analogue_component_id").join(folds.group_fold(r, "curated_id", "sealed_block_id"), "curated_id")


def folds_four_groupings(spark: SparkSession, sf: str) -> DataFrame:
    """Group folds by component, block, source and scaffold key."""
    r = _records(spark, sf).withColumn("scaffold", folds.scaffold_or_singleton("scaffold_raw", "curated_id"))
    out = r.select("curated_id")
    for g in ("analogue_component_id", "sealed_block_id", "source", "scaffold"):
        out = out.join(folds.group_fold(r, "curated_id", g).drop(g), "curated_id")
    return out


def folds_ordinal_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return folds.ordinal_baskets(table(spark, sf, "region"), "r_regionkey")


def folds_matched_size(spark: SparkSession, sf: str) -> DataFrame:
    """Records in folds of the exact sizes of the nations, in hash order."""
    r = _records(spark, sf)
    sizes = r.groupBy(F.col("sealed_block_id").alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return folds.hash_balanced_folds(r, "curated_id", sizes, "fold", "n", "matched|")


def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("record"), F.col("n_regionkey").alias("fold"))
    return folds.contract_roles(own, folds.ordinal_baskets(table(spark, sf, "region"), "r_regionkey"))


def folds_contract_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return folds.contract_manifest(_contracts(spark, sf))


def folds_contract_proof(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.role_proof(_contracts(spark, sf), table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record")), "record", ["outer_fold", "inner_basket"], "role")


def _split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The split manifest with ids, sources and partitions in plain form."""
    ids = [plain_id(c).alias(c) for c in ("molecule_id", "analogue_component_id", "sealed_block_id")]
    return table(spark, sf, "split_manifest_public").select("curated_id", plain_words("source").alias("source"), *ids, plain_partition("partition").alias("partition"))


def folds_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return folds.overlap_counts(_split_rows(spark, sf), "partition", ["source", "analogue_component_id", "sealed_block_id", "molecule_id"])


def folds_gate(spark: SparkSession, sf: str) -> DataFrame:
    return folds.gate_counts(_split_rows(spark, sf), "partition", 20)


MINIMA = {"train": 60, "validation": 20, "calibration": 20, "final_test": 20, "sources_outside_train": 15, "final_test_sources": 5}


def folds_gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every check of a release of partitions: minima, values in several partitions, admissibility."""
    return folds.gate_summary(_split_rows(spark, sf), MINIMA)


def folds_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as blocks, allocated to the partitions at least deviation."""
    n = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # fixed table
    blocks = n.groupBy(F.col("n_regionkey").cast("string").alias("sealed_block_id")).agg(F.count(F.lit(1)).alias("n_curated_rows"), F.count_distinct(F.col("c_custkey") % 97).alias("n_analogue_components"), F.count_distinct("n_name").alias("n_sources"))
    got = allocation.allocate([r.asDict() for r in blocks.collect()], {"train": 0.55, "validation": 0.2, "calibration": 0.15, "final_test": 0.1}, {p: 20 for p in folds.PARTITIONS} | {"sources_outside_train": 4, "final_test_sources": 1})
    return spark.createDataFrame([(b, p, round(got.objective, 6), got.is_proven) for b, p in sorted(got.partition.items())], "sealed_block_id string, partition string, objective double, is_proven boolean")


def folds_matched_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers' nations as groups and single parts drawn into folds of given sizes: places filled and groups kept whole."""
    groups = [(r.g, r.n) for r in table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()]  # one row per nation
    n = sum(x for _, x in groups)
    groups += [(f"part-{i}", 1) for i in range(n)]
    sizes = [n, n // 2, n - n // 2]
    made = spark.createDataFrame([(f, x) for (g, x), f in ((y, folds.matched_size_assignment(groups, sizes, 20260603)[y[0]]) for y in groups)], "fold int, n long")
    return made.groupBy("fold").agg(F.sum("n").alias("n_records"))


def contract_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Groupings that must each lie in one value of the next coarser one, and how many of their values don't."""
    r = _split_rows(spark, sf).dropna()
    pairs = (("curated_id", "molecule_id"), ("molecule_id", "analogue_component_id"), ("analogue_component_id", "sealed_block_id"), ("source", "sealed_block_id"), ("sealed_block_id", "partition"))
    out = [contracts.group_constant(r, g, v).agg(F.count(F.lit(1)).alias("n_broken")).select(F.lit(g).alias("group"), F.lit(v).alias("value"), "n_broken") for g, v in pairs]
    return contracts.union_all(out)


def folds_training_targets(spark: SparkSession, sf: str) -> DataFrame:
    """How many training targets each fold has, and their sum."""
    r = _records(spark, sf).join(F.broadcast(table(spark, sf, "nation").select(F.col("n_name").alias("sealed_block_id"), F.col("n_regionkey").alias("f"))), "sealed_block_id")
    t = folds.fold_targets(r, r, "f", "curated_id", "value")
    return rounded(t.groupBy("outer_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


def folds_authoritative(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled training rows and unlabelled test rows in one table."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return folds.authoritative_records(c.filter("c_mktsegment <> 'BUILDING'"), c.filter("c_mktsegment = 'BUILDING'"), "c_acctbal").withColumn("c_acctbal", F.coalesce("c_acctbal", F.lit(-1e9)))


def folds_singletons(spark: SparkSession, sf: str) -> DataFrame:
    """Components as scaffold keys, records without one alone."""
    s = table(spark, sf, "split_manifest_public").select("curated_id", "analogue_component_id").distinct()
    return s.select("curated_id", folds.scaffold_or_singleton("analogue_component_id", "curated_id").alias("scaffold"))


def folds_residual_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Residual slots of every customer outside each region, less those of two customers and with some repeated."""
    own = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("record"), F.col("n_regionkey").alias("fold"))
    r = own.withColumn("outer_fold", F.explode(F.array(*map(F.lit, range(5))))).filter("outer_fold <> fold AND record NOT IN (3, 4)")
    return folds.residual_gaps(r.unionAll(r.filter("record < 100")), own)


# Ledgers

_TYPES = {"signup": "CLAIMED", "view": "HEARTBEAT", "click": "SCIENTIFIC_STARTED", "purchase": "COMPLETED", "error": "FAILED"}


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Users as identities and their events as chains: a sign-up claims a new attempt; every 97th event has a wrong hash."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[F.col("event_type")]
    e = table(spark, sf, "events").select(F.col("user_id").alias("identity"), F.row_number().over(w).alias("event_index"), kind.alias("event_type"), F.sum((F.col("event_type") == "signup").cast("int")).over(w).alias("attempt"), F.col("ts").alias("at"), "event_id")
    known = F.create_map(*[F.lit(x) for kv in ledger.STATUS_OF.items() for x in kv])
    own = F.sha2(F.concat_ws("|", "identity", "event_index", "event_type"), 256)
    e = e.withColumn("status", known[F.col("event_type")]).withColumn("own_hash", own).withColumn("event_hash", F.when(F.col("event_id") % 97 == 0, F.lit("broken")).otherwise(own))
    return e.withColumn("prev_hash", F.lag("event_hash").over(Window.partitionBy("identity").orderBy("event_index"))).withColumn("spec", F.lit("spec"))


def ledger_chain_problems(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.chain_problems(_ledger(spark, sf))


def ledger_attempt_states(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.attempt_states(_ledger(spark, sf))


def ledger_status(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.status_summary(_ledger(spark, sf))


def ledger_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.accepted_attempts(ledger.attempt_states(_ledger(spark, sf)))


def ledger_runtime(spark: SparkSession, sf: str) -> DataFrame:
    e = _ledger(spark, sf).groupBy("identity", "attempt").agg(F.min("at").alias("a"), F.max(F.when(F.col("status") != "CLAIMED_BEFORE_NAMESPACE_OR_MODEL", F.col("at"))).alias("b"))
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    return rounded(ledger.runtime_seconds(e.select("identity", sec("a").alias("started"), sec("b").alias("finished")), 1_706_000_000.0), 2)


def ledger_ready(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as stages that depend on the two orders before; every order but each eleventh is done."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"))
    deps = F.filter(F.array(F.col("position") - 1, F.col("position") - 2), lambda d: d >= 0)
    stages = o.select("position", F.col("position").cast("string").alias("identity"), F.transform(deps, lambda d: d.cast("string")).alias("dependencies"))
    return ledger.ready_stages(stages, o.filter("position % 11 <> 5").select(F.col("position").cast("string").alias("identity")))


def ledger_plan_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as stages whose namespaces are names, which repeat, with dependencies beyond the plan."""
    p = table(spark, sf, "part")
    return ledger.plan_problems(p.select(F.col("p_partkey").alias("position"), F.col("p_partkey").cast("string").alias("identity"), F.concat_ws("/", "p_name", "p_brand").alias("namespace"), F.array((F.col("p_partkey") + 7).cast("string")).alias("dependencies")))


def ledger_accounting(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "click", "fit").otherwise("predict").alias("kind"), (F.col("event_type") != "error").alias("finished"), F.col("value").alias("seconds"))
    return rounded(ledger.accounting(t, ["user_id"]), 2)


def ledger_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf)
    n = rows.count()
    per = rows.groupBy(F.col("sealed_block_id").alias("outer_fold")).agg((F.lit(n) - F.count(F.lit(1))).alias("n_train_rows"))
    return rounded(ledger.resource_projection(per, 0.25, 9), 3)


# Files


def files_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Hash and kind of every file below the folder; names are paths within it."""
    f = files.inventory(spark, sf)
    name = F.substring_index("path", "/" + sf.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return f.select(name.alias("name"), "size", "sha256", "kind")


def files_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written once as CSV and scanned back with a schema, by segment."""
    s = Scratch(spark, "csv")
    c = table(spark, sf, "customer")
    c.write.mode("errorifexists").option("header", True).csv(f"{s.base}/c")
    back = files.scan_csv(spark, f"{s.base}/c", c.schema, ["c_custkey", "c_acctbal", "c_mktsegment"])
    return rounded(back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")), 2)


QUERIES = {
    f.__name__: f
    for f in (
        graph_similar_sets, graph_one_edit, graph_typed_edges, graph_nearest_training, graph_components, graph_threshold_sweep, graph_joint_blocks, graph_sequence_members, graph_sweep_check, folds_roles, folds_inner_baskets, folds_comparison, folds_ordinal_baskets, folds_matched_size,
        folds_contract_manifest, folds_contract_proof, folds_overlap, folds_gate, folds_gate_summary, folds_allocation, folds_matched_draws, folds_four_groupings, contract_ladder, folds_training_targets, folds_authoritative, folds_singletons, folds_residual_gaps, ledger_chain_problems, ledger_attempt_states, ledger_status, ledger_accepted,
        ledger_runtime, ledger_ready, ledger_plan_problems, ledger_accounting, ledger_projection, files_inventory, files_csv_round_trip,
    )
}

_SIM = """sim AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.bits, b.bits)) / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits))) AS similarity, a.w / b.w AS ratio
  FROM (SELECT id, list_distinct(tokens) AS bits, len(tokens) AS w FROM m) a JOIN (SELECT id, list_distinct(tokens) AS bits, len(tokens) AS w FROM m) b ON a.id < b.id AND len(a.bits) > 0 AND len(b.bits) > 0)"""
_SEQ = """q AS (SELECT DISTINCT topology_signature AS topology, CAST(canonical_sequence AS JSON)::VARCHAR[] AS a FROM curated_records_public
  WHERE curated_id IS NOT NULL AND topology_signature IS NOT NULL AND regexp_matches(trim(canonical_sequence), '^\\[.*\\]$')),
k0 AS (SELECT DISTINCT topology, CASE WHEN starts_with(topology, 'circle_head_to_tail') AND len(a) > 0 THEN list_min(list_transform(range(len(a)), lambda i: list_concat(a[i + 1:], a[1:i]))) ELSE a END AS tokens FROM q),
k1 AS (SELECT topology, list_concat(tokens[1:len(tokens) - 1], ['Gly']) AS a FROM k0 WHERE len(tokens) > 0),
k AS (SELECT topology, tokens FROM k0 UNION SELECT topology, CASE WHEN starts_with(topology, 'circle_head_to_tail') THEN list_min(list_transform(range(len(a)), lambda i: list_concat(a[i + 1:], a[1:i]))) ELSE a END FROM k1),
m AS (SELECT 'SEQ-' || substr(sha256(topology || chr(31) || to_json(tokens)), 1, 16) AS id, topology, tokens FROM k)"""
_EDIT = """rot AS (SELECT id, topology, unnest(CASE WHEN starts_with(topology, 'circle_head_to_tail') THEN list_transform(range(len(tokens)), lambda i: list_concat(tokens[i + 1:], tokens[1:i])) ELSE [tokens] END) AS t FROM m WHERE len(tokens) > 0),
pos AS (SELECT id, topology, t, unnest(range(1, len(t) + 1)) AS i FROM rot), mk AS (SELECT DISTINCT id, topology, t[i] AS tok, array_to_string(list_concat(t[1:i - 1], ['*'], t[i + 1:]), chr(1)) AS mask FROM pos),
bp AS (SELECT id, topology, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM m), base AS (SELECT id, topology, tokens[i] AS tok, array_to_string(list_concat(tokens[1:i - 1], ['*'], tokens[i + 1:]), chr(1)) AS mask FROM bp),
ed AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM base x JOIN mk y ON x.mask = y.mask AND x.topology = y.topology AND x.id <> y.id AND x.tok <> y.tok)"""
_CC = f"""RECURSIVE e0 AS (SELECT {sql_plain_id('molecule_id_a')} AS a, {sql_plain_id('molecule_id_b')} AS b, ecfp4_tanimoto AS similarity FROM analogue_edges),
e AS (SELECT * FROM e0 WHERE a IS NOT NULL AND b IS NOT NULL), v AS (SELECT {sql_plain_id('molecule_id')} AS id FROM analogue_components WHERE molecule_id IS NOT NULL UNION SELECT a FROM e0 WHERE a IS NOT NULL UNION SELECT b FROM e0 WHERE b IS NOT NULL)"""
_SPLIT = f"""sp AS (SELECT curated_id, {sql_plain_words('source')} AS source, {sql_plain_id('molecule_id')} AS molecule_id, {sql_plain_id('analogue_component_id')} AS analogue_component_id, {sql_plain_id('sealed_block_id')} AS sealed_block_id, {sql_plain_partition('partition')} AS partition
  FROM split_manifest_public)"""
_REGION = "own AS (SELECT c_custkey::VARCHAR AS record, n_regionkey AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey), bk AS (SELECT a.r_regionkey AS outer_fold, b.r_regionkey AS fold, row_number() OVER (PARTITION BY a.r_regionkey ORDER BY b.r_regionkey) AS inner_basket FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey)"
_ROLES = f"""{_REGION}, k AS (SELECT DISTINCT outer_fold, inner_basket FROM bk), ro AS (SELECT k.outer_fold, k.inner_basket, record, CASE WHEN own.fold = k.outer_fold THEN 'test' WHEN bk.inner_basket = k.inner_basket THEN 'validation' ELSE 'fit' END AS role
  FROM k CROSS JOIN own LEFT JOIN bk ON bk.outer_fold = k.outer_fold AND bk.fold = own.fold)"""
_KINDS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())
_ST = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ledger.STATUS_OF.items())
_LEDGER = f"""l0 AS (SELECT user_id AS identity, event_id, ts AS "at", row_number() OVER w AS event_index, CASE event_type {_KINDS} END AS event_type, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS attempt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, CASE event_type {_ST} END AS status FROM l0), st AS (SELECT identity, attempt, arg_max(event_type, event_index) AS last_event, arg_max(status, event_index) AS status, arg_max("at", event_index) AS "at" FROM l GROUP BY ALL)"""
_PLACED = "p AS (SELECT *, lag(attempt) OVER (PARTITION BY identity ORDER BY event_index) AS pa FROM l)"
_CUST = "rec AS (SELECT c_custkey::VARCHAR AS curated_id, n_name AS sealed_block_id, n_regionkey AS f, c_mktsegment AS source, (c_custkey % 40)::VARCHAR AS analogue_component_id, c_acctbal AS value, CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 60)::VARCHAR ELSE 'NO_SCAFFOLD:' || c_custkey END AS scaffold FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _greedy_sql(groups: str, scope: str, group: str, folds: int) -> str:
    """Recursive SQL for greedy folds of a table (scope, group, n)."""
    zeros = "[" + ", ".join(["0"] * folds) + "]"
    return f"""o AS (SELECT {scope}, {group}, n, row_number() OVER (PARTITION BY {scope} ORDER BY n DESC, {group}) AS k FROM {groups}),
st AS (SELECT DISTINCT {scope}, 0::BIGINT AS k, {zeros}::BIGINT[] AS t, ''::VARCHAR AS g, 0::BIGINT AS n, 0::BIGINT AS fold FROM o
  UNION ALL SELECT st.{scope}, o.k, list_transform(st.t, lambda v, i: CASE WHEN i = list_position(st.t, list_min(st.t)) THEN v + o.n ELSE v END), o.{group}, o.n, list_position(st.t, list_min(st.t)) FROM st JOIN o ON o.{scope} = st.{scope} AND o.k = st.k + 1),
placed AS (SELECT {scope}, g AS {group}, n, CAST(fold AS INTEGER) AS fold FROM st WHERE k > 0)"""


SQL = {
    "graph_similar_sets": """WITH m AS (SELECT user_id::VARCHAR AS id, list_distinct(list(event_type || '-' || hour(ts))) AS bits, count(*)::DOUBLE AS w FROM events GROUP BY 1),
s AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.bits, b.bits)) AS k, len(a.bits) AS na, len(b.bits) AS nb, a.w / b.w AS ratio FROM m a JOIN m b ON a.id < b.id)
SELECT a, b, round(k / (na + nb - k), 6) AS similarity FROM s WHERE k / (na + nb - k) >= 0.4 AND ratio BETWEEN 0.8 AND 1.25""",
    "graph_sequence_members": """WITH r AS (SELECT DISTINCT curated_id, topology_signature AS topology, CAST(canonical_sequence AS JSON)::VARCHAR[] AS a FROM curated_records_public WHERE curated_id IS NOT NULL AND topology_signature IS NOT NULL AND regexp_matches(trim(canonical_sequence), '^\\[.*\\]$'))
SELECT DISTINCT 'SEQ-' || substr(sha256(topology || chr(31) || to_json(CASE WHEN starts_with(topology, 'circle_head_to_tail') AND len(a) > 0 THEN list_min(list_transform(range(len(a)), lambda i: list_concat(a[i + 1:], a[1:i]))) ELSE a END)), 1, 16) AS sequence_id, curated_id FROM r""",
    "graph_one_edit": f"WITH {_SEQ}, {_EDIT} SELECT a, b FROM ed",
    "graph_typed_edges": f"""WITH {_SEQ}, {_SIM}, {_EDIT}, u AS (SELECT a, b, 'ecfp4' AS t, similarity FROM sim WHERE similarity >= 0.8 UNION ALL SELECT a, b, 'exact_one_token_edit', NULL FROM ed)
SELECT a, b, string_agg(DISTINCT t, '|' ORDER BY t) AS edge_types, round(max(similarity), 6) AS similarity FROM u GROUP BY a, b""",
    "graph_components": f"""WITH {_CC}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id, id AS o FROM v UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.o)
SELECT id, 'AC-' || substr(sha256(string_agg(o, chr(31) ORDER BY o)), 1, 16) AS component_id, CAST(count(*) AS INTEGER) AS component_size FROM r GROUP BY id""",
    "graph_threshold_sweep": f"""WITH {_CC}, t AS (SELECT unnest([0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS threshold), k AS (SELECT threshold, a, b FROM t, e WHERE similarity IS NULL OR similarity >= threshold),
s AS (SELECT * FROM k UNION SELECT threshold, b, a FROM k), r AS (SELECT threshold, id, id AS o FROM t, v UNION SELECT r.threshold, r.id, s.b FROM r JOIN s ON s.threshold = r.threshold AND s.a = r.o), g AS (SELECT threshold, id, min(o) AS root FROM r GROUP BY ALL)
SELECT threshold, (SELECT count(*) FROM k WHERE k.threshold = g.threshold) AS n_edges, count(DISTINCT root) AS n_components FROM g GROUP BY threshold""",
    "graph_joint_blocks": f"""WITH RECURSIVE {_SPLIT}, l AS (SELECT DISTINCT source, analogue_component_id AS component FROM sp WHERE source IS NOT NULL AND analogue_component_id IS NOT NULL),
n AS MATERIALIZED (SELECT DISTINCT a.source AS a, b.source AS b FROM l a JOIN l b USING (component)), r AS (SELECT a AS root, a AS source FROM n UNION SELECT r.root, n.b FROM r JOIN n ON n.a = r.source),
g AS (SELECT root, list(source ORDER BY source) AS ss FROM r GROUP BY root), w AS (SELECT DISTINCT root, component FROM r JOIN l USING (source)), c AS (SELECT root, list(component ORDER BY component) AS cs FROM w GROUP BY root)
SELECT l.source, component, 'BLOCK-' || substr(sha256(array_to_string(list_concat(ss, cs), chr(31))), 1, 16) AS block_id FROM l JOIN g ON g.root = l.source JOIN c ON c.root = l.source""",
    "folds_roles": f"""WITH {_CUST}, s AS (SELECT sealed_block_id, count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(DISTINCT analogue_component_id) AS n_components FROM rec GROUP BY 1), n AS (SELECT *, dense_rank() OVER (ORDER BY sealed_block_id) AS k FROM s)
SELECT t.k AS outer_fold, t.sealed_block_id AS test_block, n.sealed_block_id, CASE WHEN t.k = n.k THEN 'test' ELSE 'train' END AS role, n.n_rows, n.n_sources, n.n_components FROM n t CROSS JOIN n""",
    "folds_inner_baskets": f"""WITH RECURSIVE {_CUST}, b AS (SELECT sealed_block_id, count(*) AS n FROM rec GROUP BY 1), i AS (SELECT sealed_block_id AS test_block, row_number() OVER (ORDER BY sealed_block_id) AS outer_fold FROM b),
gr AS (SELECT outer_fold, sealed_block_id, n FROM i JOIN b ON sealed_block_id <> test_block), {_greedy_sql('gr', 'outer_fold', 'sealed_block_id', 4)}
SELECT outer_fold, test_block, sealed_block_id, n AS n_rows, fold AS inner_basket FROM placed JOIN i USING (outer_fold)""",
    "folds_comparison": f"""WITH RECURSIVE {_CUST}, gr AS (SELECT k || '' AS scope, g, count(*) AS n FROM (SELECT 'c' AS k, analogue_component_id AS g FROM rec UNION ALL SELECT 'b', sealed_block_id FROM rec) GROUP BY ALL), {_greedy_sql('gr', 'scope', 'g', 5)}
SELECT curated_id, analogue_component_id, c.fold AS analogue_component_id_fold, sealed_block_id, b.fold AS sealed_block_id_fold FROM rec JOIN placed c ON c.scope = 'c' AND c.g = analogue_component_id JOIN placed b ON b.scope = 'b' AND b.g = sealed_block_id""",
    "folds_ordinal_baskets": f"WITH {_REGION} SELECT * FROM bk",
    "folds_matched_size": f"""WITH {_CUST}, s AS (SELECT sealed_block_id AS fold, count(*) AS n FROM rec GROUP BY 1), b AS (SELECT fold, sum(n) OVER (ORDER BY fold) - n AS lo, sum(n) OVER (ORDER BY fold) AS hi FROM s),
k AS (SELECT curated_id, row_number() OVER (ORDER BY sha256('matched|' || curated_id), curated_id) AS p FROM rec) SELECT curated_id, fold FROM k JOIN b ON p > lo AND p <= hi""",
    "folds_contract_manifest": f"""WITH {_ROLES} SELECT outer_fold, inner_basket, """ + ", ".join(f"count(DISTINCT record) FILTER (role = '{x}') AS n_{x}, sha256(coalesce(string_agg(record || chr(10), '' ORDER BY record || chr(10)) FILTER (role = '{x}'), '')) AS {x}_sha256" for x in ("fit", "validation", "test")) + " FROM ro GROUP BY ALL",
    "folds_contract_proof": f"WITH {_ROLES} SELECT outer_fold, inner_basket, count(DISTINCT record) AS n_known, 0 AS n_several, 0 AS n_unknown, (SELECT count(*) FROM own) - count(DISTINCT record) AS n_missing, true AS is_partition FROM ro GROUP BY ALL",
    "folds_overlap": f"WITH {_SPLIT} " + " UNION ALL ".join(f"SELECT '{g}' AS group_kind, count(*) AS n_groups, count(*) FILTER (k > 1) AS n_in_several FROM (SELECT {g}, count(DISTINCT partition) AS k FROM sp WHERE {g} IS NOT NULL AND partition IS NOT NULL GROUP BY 1)" for g in ("source", "analogue_component_id", "sealed_block_id", "molecule_id")),
    "folds_gate": f"WITH {_SPLIT} SELECT partition, count(*) AS n_rows, count(DISTINCT molecule_id) AS n_molecules, count(DISTINCT analogue_component_id) AS n_components, count(DISTINCT source) AS n_sources, count(DISTINCT analogue_component_id) >= 20 AS has_enough FROM sp WHERE partition IS NOT NULL GROUP BY 1",
    "folds_gate_summary": f"""WITH {_SPLIT}, q AS (SELECT * FROM sp WHERE partition IS NOT NULL), """ + "k AS (" + " UNION ALL ".join([f"SELECT '{p}_analogue_components' AS rule, count(DISTINCT analogue_component_id) AS n, {MINIMA[p]} AS least FROM q WHERE partition = '{p}'" for p in folds.PARTITIONS] + [f"SELECT 'sources_outside_train', count(DISTINCT source), {MINIMA['sources_outside_train']} FROM q WHERE partition <> 'train'", f"SELECT 'final_test_sources', count(DISTINCT source), {MINIMA['final_test_sources']} FROM q WHERE partition = 'final_test'"])
    + "), l AS (" + " UNION ALL ".join(f"SELECT '{name}_in_multiple_partitions' AS rule, count(*) AS n FROM (SELECT {c} FROM q WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT partition) > 1)" for c, name in (("source", "sources"), ("analogue_component_id", "components"), ("sealed_block_id", "blocks")))
    + "), r AS (SELECT rule, n, n >= least AS passed FROM k UNION ALL SELECT rule, n, n = 0 FROM l) SELECT * FROM r UNION ALL SELECT 'admissible', count(*) FILTER (NOT passed), bool_and(passed) FROM r",
    "folds_allocation": """WITH RECURSIVE b AS (SELECT n_regionkey::VARCHAR AS id, row_number() OVER (ORDER BY n_regionkey::VARCHAR) AS i, count(*)::DOUBLE AS r, count(DISTINCT c_custkey % 97)::DOUBLE AS c, count(DISTINCT n_name)::DOUBLE AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey),
t AS (SELECT sum(r) AS r, sum(c) AS c, sum(s) AS s FROM b), w AS (SELECT 0::BIGINT AS i, []::INTEGER[] AS a, [0, 0, 0, 0]::DOUBLE[] AS r, [0, 0, 0, 0]::DOUBLE[] AS c, [0, 0, 0, 0]::DOUBLE[] AS s, 0::DOUBLE AS tie
  UNION ALL SELECT b.i, list_append(w.a, p), list_transform(w.r, lambda x, j: CASE WHEN j = p THEN x + b.r ELSE x END), list_transform(w.c, lambda x, j: CASE WHEN j = p THEN x + b.c ELSE x END), list_transform(w.s, lambda x, j: CASE WHEN j = p THEN x + b.s ELSE x END), w.tie + 1e-9 * b.i * p
  FROM w JOIN b ON b.i = w.i + 1, (SELECT unnest([1, 2, 3, 4]) AS p)),
f AS (SELECT a, tie + """ + " + ".join(f"{wt} / t.{k} * (" + " + ".join(f"abs(w.{k}[{p}] - {x} * t.{k})" for p, x in enumerate((0.55, 0.2, 0.15, 0.1), 1)) + ")" for k, wt in (("r", 1.0), ("c", 0.25), ("s", 0.1))) + """ AS o FROM w, t
  WHERE len(a) = (SELECT count(*) FROM b) AND list_min(w.c) >= 20 AND w.s[2] + w.s[3] + w.s[4] >= 4 AND w.s[4] >= 1),
z AS (SELECT * FROM f ORDER BY o LIMIT 1) SELECT id AS sealed_block_id, ['train', 'validation', 'calibration', 'final_test'][a[i]] AS partition, round(o, 6) AS objective, true AS is_proven FROM b, z""",
    "folds_matched_draws": "WITH n AS (SELECT count(*) AS n FROM supplier) SELECT 1::INTEGER AS fold, n AS n_records FROM n UNION ALL SELECT 2, n // 2 FROM n UNION ALL SELECT 3, n - n // 2 FROM n",
    "folds_four_groupings": f"""WITH RECURSIVE {_CUST}, gr AS (SELECT k || '' AS scope, g, count(*) AS n FROM (SELECT 'c' AS k, analogue_component_id AS g FROM rec UNION ALL SELECT 'b', sealed_block_id FROM rec UNION ALL SELECT 's', source FROM rec UNION ALL SELECT 'f', scaffold FROM rec) GROUP BY ALL), {_greedy_sql('gr', 'scope', 'g', 5)}
SELECT curated_id, c.fold AS analogue_component_id_fold, b.fold AS sealed_block_id_fold, s.fold AS source_fold, f.fold AS scaffold_fold FROM rec JOIN placed c ON c.scope = 'c' AND c.g = analogue_component_id JOIN placed b ON b.scope = 'b' AND b.g = sealed_block_id
JOIN placed s ON s.scope = 's' AND s.g = source JOIN placed f ON f.scope = 'f' AND f.g = scaffold""",
    "contract_ladder": f"WITH {_SPLIT}, q AS (SELECT * FROM sp WHERE curated_id IS NOT NULL AND source IS NOT NULL AND molecule_id IS NOT NULL AND analogue_component_id IS NOT NULL AND sealed_block_id IS NOT NULL AND partition IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", '{v}' AS value, count(*) AS n_broken FROM (SELECT {g} FROM q GROUP BY 1 HAVING count(DISTINCT {v}) > 1)" for g, v in (("curated_id", "molecule_id"), ("molecule_id", "analogue_component_id"), ("analogue_component_id", "sealed_block_id"), ("source", "sealed_block_id"), ("sealed_block_id", "partition"))),
    "graph_sweep_check": f"""WITH {_CC}, k AS (SELECT a, b FROM e WHERE similarity IS NULL OR similarity >= 0.8), s AS (SELECT * FROM k UNION SELECT b, a FROM k), r AS (SELECT id, id AS o FROM v UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.o)
SELECT 0.8::DOUBLE AS threshold, (SELECT count(*) FROM k) AS n_edges, count(DISTINCT root) AS n_components, true AS reproduces FROM (SELECT id, min(o) AS root FROM r GROUP BY id)""",
    "folds_training_targets": f"WITH {_CUST} SELECT r_regionkey AS outer_fold, count(*) AS n, round(sum(value), 2) AS total FROM region JOIN rec ON f <> r_regionkey WHERE r_regionkey IN (SELECT f FROM rec) GROUP BY 1",
    "folds_authoritative": "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN -1e9 ELSE c_acctbal END AS c_acctbal FROM customer",
    "folds_singletons": "SELECT DISTINCT curated_id, CASE WHEN trim(coalesce(analogue_component_id, '')) = '' THEN 'NO_SCAFFOLD:' || curated_id ELSE analogue_component_id END AS scaffold FROM split_manifest_public",
    "graph_nearest_training": """WITH m AS (SELECT user_id, list_distinct(list(event_type || '-' || hour(ts))) AS bits FROM events GROUP BY 1),
s AS (SELECT a.user_id::VARCHAR AS id, b.user_id::VARCHAR AS o, len(list_intersect(a.bits, b.bits)) AS k, len(a.bits) AS na, len(b.bits) AS nb FROM m a JOIN m b ON a.user_id % 5 = 0 AND b.user_id % 5 <> 0),
t AS (SELECT id, o, k / (na + nb - k) AS similarity FROM s WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY k / (na + nb - k) DESC, o) = 1)
SELECT user_id::VARCHAR AS id, coalesce(o, '') AS nearest, round(coalesce(similarity, 0), 6) AS similarity FROM m LEFT JOIN t ON t.id = user_id::VARCHAR WHERE user_id % 5 = 0""",
    "folds_residual_gaps": """WITH own AS (SELECT c_custkey AS record, n_regionkey AS fold FROM customer JOIN nation ON c_nationkey = n_nationkey), f AS (SELECT DISTINCT fold AS outer_fold FROM own),
r AS (SELECT outer_fold, record FROM f JOIN own ON fold <> outer_fold WHERE record NOT IN (3, 4))
SELECT outer_fold, count(*) + count(*) FILTER (record < 100) AS n_residuals, count(*) FILTER (record < 100) AS n_repeated, (SELECT count(*) FROM own WHERE fold <> r.outer_fold) - count(*) AS n_missing FROM r GROUP BY outer_fold""",
    "ledger_chain_problems": f"""WITH {_LEDGER}, {_PLACED} SELECT identity, event_index, 'self_hash' AS problem FROM p WHERE event_id % 97 = 0
UNION ALL SELECT identity, event_index, 'attempt_order' FROM p WHERE NOT (attempt = coalesce(pa, 0) + 1 OR coalesce(attempt = pa, false)) UNION ALL SELECT identity, event_index, 'attempt_start' FROM p WHERE attempt = coalesce(pa, 0) + 1 AND event_type <> 'CLAIMED'""",
    "ledger_attempt_states": f"WITH {_LEDGER} SELECT * FROM st",
    "ledger_status": f"""WITH {_LEDGER}, x AS (SELECT * FROM st WHERE status IN ('FAILED_RECORDED', 'INTERRUPTED_RECORDED') ORDER BY "at" DESC, identity DESC LIMIT 1)
SELECT count(DISTINCT identity) FILTER (status = 'COMPLETED_ACCEPTED') AS completed_stages, count(*) FILTER (status = 'FAILED_RECORDED') AS failed_attempts, count(*) FILTER (status = 'INTERRUPTED_RECORDED') AS interrupted_attempts,
(SELECT max("at") FROM l WHERE event_type = 'HEARTBEAT') AS last_heartbeat, (SELECT "at" FROM x) AS last_error_at, (SELECT identity FROM x) AS last_error_identity FROM st""",
    "ledger_accepted": f"WITH {_LEDGER} SELECT identity, min(attempt) AS attempt FROM st WHERE status = 'COMPLETED_ACCEPTED' GROUP BY identity HAVING count(*) = 1",
    "ledger_runtime": f"""WITH {_LEDGER}, a AS (SELECT identity, attempt, floor(epoch(min("at"))) AS s, floor(epoch(max("at") FILTER (status <> 'CLAIMED_BEFORE_NAMESPACE_OR_MODEL'))) AS f FROM l GROUP BY ALL)
SELECT identity, count(*) AS n_attempts, round(sum(greatest(0, coalesce(f, 1706000000) - s)), 2) AS seconds FROM a GROUP BY identity""",
    "ledger_ready": "SELECT o_orderkey AS position, o_orderkey::VARCHAR AS identity FROM orders WHERE o_orderkey % 11 = 5",
    "ledger_plan_problems": """WITH s AS (SELECT p_partkey, p_partkey::VARCHAR AS identity, concat_ws('/', p_name, p_brand) AS n FROM part) SELECT 'repeated_namespace' AS problem, min(identity) AS identity FROM s GROUP BY n HAVING count(*) > 1
UNION SELECT 'unknown_dependency', identity FROM s WHERE p_partkey + 7 NOT IN (SELECT p_partkey FROM s)""",
    "ledger_accounting": """SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_finished, count(*) FILTER (event_type = 'error') AS n_failed, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 2) AS fit_seconds,
round(coalesce(sum(value) FILTER (event_type <> 'click'), 0), 2) AS predict_seconds FROM events GROUP BY user_id""",
    "ledger_projection": f"WITH {_CUST} SELECT sealed_block_id AS outer_fold, (SELECT count(*) FROM rec) - count(*) AS n_train_rows, round(((SELECT count(*) FROM rec) - count(*)) * 0.25 * 9, 3) AS seconds FROM rec GROUP BY 1",
    "files_csv_round_trip": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1",
}
