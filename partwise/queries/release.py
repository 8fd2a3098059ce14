"""Guards, hashes, sinks, manifests, stage identities and release gates, each with planted faults and counted violations."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.cleaning import normalized_source
from partwise.functions.hashing import array_hash, canonical_json_hash, frame_hash, ordered_ids_hash, rng_seed
from partwise.operators import folds, ledger
from partwise.plans import contracts
from partwise.plans.lineage import Scratch
from partwise.queries.common import table
from partwise.queries.structure import _ROLES, _contracts
from partwise.sources import files


def _refused(f: Callable[[], object], kinds: tuple = (contracts.Violation, FileExistsError, RuntimeError)) -> bool:
    try:
        f()
    except kinds:
        return True
    return False


# Files


def _local(s: Scratch) -> str:
    """The scratch folder as a path of the driver, for bundles of driver size that are renamed."""
    path = s.base.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def _bundle(spark: SparkSession, sf: str) -> dict[str, bytes]:
    """A text file for each nation: its name and key."""
    return {f"{r.n_name}.{'json' if r.n_nationkey % 3 else 'csv'}": f"{r.n_name},{r.n_nationkey}\n".encode() for r in table(spark, sf, "nation").collect()}  # 25 rows


def _published(spark: SparkSession, sf: str) -> DataFrame:
    """An inventory of published files with known content, by name."""
    target = f"{_local(Scratch(spark, 'bundle'))}/out"
    files.publish(_bundle(spark, sf), target)
    found = files.inventory(spark, target).withColumn("path", F.substring_index("path", "/", -1))
    return Scratch(spark, "inventory").write(found)


def files_known_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Size, hash and kind of files with known content."""
    return _published(spark, sf).select("path", "size", "sha256", "kind")


def files_totals(spark: SparkSession, sf: str) -> DataFrame:
    return files.inventory_totals(_published(spark, sf))


def _manifest(inventory: DataFrame) -> DataFrame:
    """A manifest with planted faults by the last digit of the name: 1 left out, 2 another size, 3 another hash, and one file that isn't there."""
    digit = F.regexp_extract("path", r"([0-9])\.", 1)
    m = inventory.filter(digit != "1").select("path", F.when(digit == "2", F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(digit == "3", F.lit("0")).otherwise(F.col("sha256")).alias("sha256"))
    return m.unionByName(inventory.sparkSession.createDataFrame([("GONE.csv", 1, "0")], "path string, size long, sha256 string"))


def files_manifest_problems(spark: SparkSession, sf: str) -> DataFrame:
    found = _published(spark, sf)
    return files.manifest_problems(found, _manifest(found))


def files_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Added, removed and changed files between a faulty manifest and what is there."""
    found = _published(spark, sf)
    return files.changed_files(_manifest(found), found)


def files_checksum_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = _published(spark, sf).withColumn("path", F.concat(F.lit("/base/"), "path"))
    return files.checksum_lines(found, "/base", r"^NATION_[56]\.").select("line")


def files_release_problems(spark: SparkSession, sf: str) -> DataFrame:
    """An audit of a release: one required file absent, forbidden names, files too large, lines that leak, risky headers."""
    n = table(spark, sf, "nation")
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 3 > 0, ".json").otherwise(".csv"))
    texts = n.select(name.alias("path"), F.lit(1).alias("line_no"), F.concat_ws(",", "n_name", F.col("n_nationkey").cast("string")).alias("line"))
    return files.release_problems(_published(spark, sf), texts, ["NATION_4.json", "README.md"], r"^NATION_2[0-9]", 12, r"_1[02],", ["nation_3"])


def files_glob_match(spark: SparkSession, sf: str) -> DataFrame:
    """The only file of a pattern by name, and whether a pattern with several is refused."""
    name = files.one_match(spark, f"{sf}/regio*.parquet").rsplit("/", 1)[-1]
    return spark.createDataFrame([(name, _refused(lambda: files.one_match(spark, f"{sf}/*o*.parquet")))], "name string, refuses_several boolean")


def files_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nations written as JSON and scanned with a schema, for the regions of a small configuration."""
    s = Scratch(spark, "json")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.json(f"{s.base}/n")
    path = f"{_local(s)}/config.json"
    with open(path, "x", encoding="utf-8") as f:
        json.dump({"regions": [0, 2]}, f)
    back = spark.read.schema(n.schema).json(f"{s.base}/n")
    return back.filter(F.col("n_regionkey").isin(files.read_config(path)["regions"])).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.max("n_name").alias("last"))


def files_fixed_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of customers written as one CSV file in a fixed order and format, and whether a second write is refused."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    path = f"{Scratch(spark, 'fixed').base}/customers.csv"
    digest = files.write_csv(c, path, ["c_custkey"], 2)
    return spark.createDataFrame([(digest, _refused(lambda: files.write_csv(c, path, ["c_custkey"], 2)))], "sha256 string, refuses_second boolean")


def files_write_once(spark: SparkSession, sf: str) -> DataFrame:
    """Nations written once by region; a second write is refused."""
    s = Scratch(spark, "once")
    n = table(spark, sf, "nation")
    files.write_once(n, f"{s.base}/n", partition_by=["n_regionkey"])
    refused = _refused(lambda: files.write_once(n, f"{s.base}/n"), (Exception,))
    return spark.read.parquet(f"{s.base}/n").groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("refuses_second", F.lit(refused))


def files_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations published; readers get the second, whole."""
    root = f"{_local(Scratch(spark, 'generations'))}/root"
    bundle = _bundle(spark, sf)
    files.publish_generation({n: b for n, b in bundle.items() if n.endswith(".csv")}, root)
    files.publish_generation({n: b + b for n, b in bundle.items() if n.endswith(".json")}, root)
    number, got = files.read_generation(root)
    return spark.createDataFrame([(number, n, b.decode()) for n, b in sorted(got.items())], "generation int, name string, content string")


# Guards

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "curation_manifest", "curated_records_public", "analogue_edges", "analogue_components", "split_manifest_public", "block_assignments")
FAMILIES = {"identity": r"(_id|key)$", "time": r"(_at|date|^ts)$", "structure": "smiles|sequence|topology", "size": r"^n_|size|count", "outcome": "permeab|label|target"}


def contract_column_families(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns of the tables belong to which family of names."""
    names = spark.createDataFrame([(t, c) for t in TABLES for c in table(spark, sf, t).columns], "table string, column string")
    return contracts.column_families(names, FAMILIES)


def contract_guards(spark: SparkSession, sf: str) -> DataFrame:
    """What the schema and key guards refuse and what they let pass."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    nested = c.select("c_custkey", F.struct(F.lit(1.0).alias("Replicate_Min")).alias("more"))
    cases = {
        "columns_there": lambda: contracts.require_columns(c, ["c_custkey", "c_name"]),
        "columns_missing": lambda: contracts.require_columns(c, ["c_custkey", "absent"]),
        "outcome_blind": lambda: contracts.require_outcome_blind(c),
        "outcome_nested": lambda: contracts.require_outcome_blind(nested),
        "outcome_exact": lambda: contracts.require_outcome_blind(c.withColumnRenamed("c_name", "Y")),
        "predictors": lambda: contracts.require_predictors(c, ["c_acctbal", "c_nationkey"], "c_name"),
        "predictors_repeated": lambda: contracts.require_predictors(c, ["c_acctbal", "c_acctbal"], "c_name"),
        "predictors_collide": lambda: contracts.require_predictors(c.withColumn("C-AcctBal", F.lit(1)), ["c_acctbal", "C-AcctBal"], "c_name"),
        "predictors_reserved": lambda: contracts.require_predictors(c.withColumn("Sealed Block Id", F.lit(1)), ["Sealed Block Id"], "c_name"),
        "predictors_target": lambda: contracts.require_predictors(c, ["c_name"], "c_name"),
        "keys_unique": lambda: contracts.require_unique(c, ["c_custkey"]),
        "keys_repeated": lambda: contracts.require_unique(c, ["c_nationkey"]),
        "values_finite": lambda: contracts.require_finite(n.withColumn("x", F.lit(1.0)), ["x"]),
        "values_infinite": lambda: contracts.require_finite(n.withColumn("x", F.lit(float("inf"))), ["x"]),
    }
    return spark.createDataFrame([(k, _refused(f)) for k, f in cases.items()], "guard string, is_refused boolean")


def contract_joins(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of validated joins, and joins that are refused."""
    c, n = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    some = n.filter("n_regionkey <> 1")
    rows = [
        ("one_to_one", contracts.join_one_to_one(n, some.select("k"), ["k"]).count()), ("many_to_one", contracts.join_many_to_one(c, n, ["k"]).count()),
        ("many_to_one_open", contracts.join_many_to_one(c, some, ["k"], complete=False).filter("n_name IS NULL").count()),
        ("incomplete_refused", int(_refused(lambda: contracts.join_many_to_one(c, some, ["k"])))), ("repeated_refused", int(_refused(lambda: contracts.join_one_to_one(c, n, ["k"])))),
    ]
    return spark.createDataFrame(rows, "case string, n long")


# Hashes


def hash_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of the names of each segment in their order."""
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(ordered_ids_hash(F.array_sort(F.collect_list("c_name"))).alias("ordered_sha256"))


def hash_frame_text(spark: SparkSession, sf: str) -> DataFrame:
    """Content hash of molecules with their numbers of sources, the same for any order of the rows."""
    return frame_hash(table(spark, sf, "analogue_components").select("molecule_id", "n_sources"))


def hash_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of the balances of each nation in the order of customers, to 17 digits."""
    a = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.col("c_acctbal").cast("double").alias("x")))), lambda v: v["x"])
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(a.alias("a")).select("c_nationkey", array_hash("a").alias("array_sha256"))


def hash_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of canonical JSON and the seeds derived from it."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    return spark.createDataFrame([(r.n_nationkey, canonical_json_hash({"name": r.n_name, "key": r.n_nationkey}), str(rng_seed({"key": r.n_nationkey}))) for r in rows], "n_nationkey long, json_sha256 string, seed string")


def scalar_normalized_source(spark: SparkSession, sf: str) -> DataFrame:
    """Digits masked before hashing, and how many runs there were."""
    text, n = normalized_source("s_name", "[0-9]+", "<N>")
    return table(spark, sf, "supplier").select("s_suppkey", text.alias("text"), n.alias("n_masked"))


# Contracts, stages and gates


def folds_role_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The validation rows of one contract, and that an absent id is refused."""
    roles = Scratch(spark, "roles").write(_contracts(spark, sf))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record"), "c_name")
    refused = _refused(lambda: folds.role_batch(roles, rows.filter("record % 10 <> 0"), 1, 2, "validation"))
    return folds.role_batch(roles, rows, 1, 2, "validation").withColumn("refuses_absent", F.lit(refused))


def folds_weight_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    """Number and hash of usable weights, and which weights are refused."""
    w = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record"), (F.col("c_custkey") % 3).cast("double").alias("weight"))
    bad = [_refused(lambda x=x: folds.weight_sidecar(w.withColumn("weight", x), "record", "weight")) for x in (F.lit(0.0), -F.col("weight"), F.lit(float("nan")))]
    return folds.weight_sidecar(w, "record", "weight").withColumn("refuses_bad", F.lit(all(bad)))


def folds_contract_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts derived anew against a manifest with planted faults: a count of fold 0, a hash of fold 1, a contract of fold 2 left out."""
    roles = Scratch(spark, "roles").write(_contracts(spark, sf))
    at = lambda f, b: (F.col("outer_fold") == f) & (F.col("inner_basket") == b)
    m = folds.contract_manifest(roles).withColumn("n_fit", F.when(at(0, 1), F.col("n_fit") + 1).otherwise(F.col("n_fit"))).withColumn("test_sha256", F.when(at(1, 2), F.lit("0")).otherwise(F.col("test_sha256")))
    return folds.contract_problems(roles, m.filter(~at(2, 3)))


def _stages(spark: SparkSession, sf: str) -> list[dict]:
    return [{"kind": "fit", "key": r.n_name, "dependencies": [f"d{r.n_regionkey}"], "protocol_lock_sha256": "lock", "execution": {"seed": r.n_nationkey}, "expected_outputs": ["model"], "note": "free"} for r in table(spark, sf, "nation").collect()]  # 25 rows


def ledger_stage_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Identity of what a stage computes and hash of its whole specification."""
    return spark.createDataFrame([(s["key"], *ledger.stage_identity(s)) for s in _stages(spark, sf)], "key string, identity string, spec_sha256 string")


def ledger_locked_problems(spark: SparkSession, sf: str) -> DataFrame:
    """A plan with a wrong hash of itself, one locked file absent and some changed."""
    found = _published(spark, sf)
    return ledger.locked_problems({"stages": 3, "plan_sha256": "0"}, _manifest(found), found)


def ledger_release_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether labels open when all, and when all but one, of the required stages are accepted."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("identity"))
    least = o.agg(F.min("identity")).first()[0]
    opens = [not _refused(lambda a=a: ledger.release_gate(o, a)) for a in (o, o.filter(F.col("identity") != least))]
    return spark.createDataFrame([tuple(opens)], "opens_complete boolean, opens_incomplete boolean")


QUERIES = {
    f.__name__: f
    for f in (
        files_known_inventory, files_totals, files_manifest_problems, files_changes, files_checksum_lines, files_release_problems, files_glob_match, files_json_round_trip, files_fixed_csv, files_write_once, files_generations, contract_column_families,
        contract_guards, contract_joins, hash_ordered, hash_frame_text, hash_arrays, hash_canonical_json, scalar_normalized_source, folds_role_batch, folds_weight_sidecar, folds_contract_problems, ledger_stage_identities, ledger_locked_problems, ledger_release_gate,
    )
}

_FILES = """n AS (SELECT n_name || CASE WHEN n_nationkey % 3 > 0 THEN '.json' ELSE '.csv' END AS path, n_name || ',' || n_nationkey || chr(10) AS content, n_name, n_nationkey FROM nation),
i AS (SELECT path, length(content) AS size, sha256(content) AS sha256, CASE WHEN ends_with(path, '.csv') THEN 'table' ELSE 'provenance' END AS kind, n_name, n_nationkey FROM n)"""
_FAULTS = f"{_FILES}, m AS (SELECT path, CASE WHEN n_name[-1] = '2' THEN size + 1 ELSE size END AS size, CASE WHEN n_name[-1] = '3' THEN '0' ELSE sha256 END AS sha256 FROM i WHERE n_name[-1] <> '1' UNION ALL SELECT 'GONE.csv', 1, '0')"


def _frame_sql(row: str, columns: list[str], source: str, name: str) -> str:
    """SQL of ``frame_hash`` for rows whose JSON is given as an expression."""
    parts = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR) AS p{i}" for i in range(8))
    joined = ", ".join(f"p{i}" for i in range(8))
    return f"h AS (SELECT sha256({row}) AS h FROM {source}), p AS (SELECT count(*) AS n_rows, {parts} FROM h), fh AS (SELECT n_rows, sha256(concat_ws(chr(31), '{json.dumps(columns)}', n_rows, {joined})) AS {name} FROM p)"


_MOLECULE = """concat('{"molecule_id":', CASE WHEN molecule_id IS NULL THEN 'null' ELSE '"' || replace(replace(molecule_id, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't') || '"' END, ',"n_sources":', coalesce(n_sources::VARCHAR, 'null'), '}')"""
_WEIGHT = """concat('{"record":"', c_custkey, '","weight":', c_custkey % 3, '.0}')"""
_GUARDS = {"columns_there": False, "columns_missing": True, "outcome_blind": False, "outcome_nested": True, "outcome_exact": True, "predictors": False, "predictors_repeated": True, "predictors_collide": True, "predictors_reserved": True, "predictors_target": True, "keys_unique": False, "keys_repeated": True, "values_finite": False, "values_infinite": True}
_CORE = """'{"dependencies":["d' || n_regionkey || '"],"execution":{"seed":' || n_nationkey || '},"expected_outputs":["model"],"key":"' || n_name || '","kind":"fit",'"""
SQL = {
    "files_known_inventory": f"WITH {_FILES} SELECT path, size, sha256, kind FROM i",
    "files_totals": f"WITH {_FILES} SELECT kind, count(*) AS n_files, sum(size)::BIGINT AS n_bytes FROM i GROUP BY 1",
    "files_manifest_problems": f"WITH {_FAULTS} SELECT path, CASE WHEN i.path IS NULL THEN 'absent' WHEN m.path IS NULL THEN 'unlisted' WHEN i.size <> m.size THEN 'size' ELSE 'hash' END AS problem FROM i FULL JOIN m USING (path) WHERE i.path IS NULL OR m.path IS NULL OR i.size <> m.size OR i.sha256 <> m.sha256",
    "files_changes": f"WITH {_FAULTS} SELECT path, CASE WHEN i.path IS NULL THEN 'removed' WHEN m.path IS NULL THEN 'added' ELSE 'changed' END AS change FROM i FULL JOIN m USING (path) WHERE i.path IS NULL OR m.path IS NULL OR i.sha256 <> m.sha256",
    "files_checksum_lines": f"WITH {_FILES} SELECT sha256 || '  ' || path AS line FROM i WHERE n_name NOT IN ('NATION_5', 'NATION_6')",
    "files_release_problems": f"""WITH {_FILES} SELECT x AS path, 'required_absent' AS problem FROM (SELECT unnest(['NATION_4.json', 'README.md']) AS x) WHERE x NOT IN (SELECT path FROM i) UNION ALL SELECT path, 'forbidden_name' FROM i WHERE regexp_matches(path, '^NATION_2[0-9]')
UNION ALL SELECT path, 'too_large' FROM i WHERE size > 12 UNION ALL SELECT path, 'leak' FROM i WHERE n_name IN ('NATION_10', 'NATION_12') UNION ALL SELECT path, 'risky_column' FROM i WHERE n_name = 'NATION_3' AND ends_with(path, '.csv')""",
    "files_glob_match": "SELECT 'region.parquet' AS name, true AS refuses_several",
    "files_json_round_trip": "SELECT n_regionkey, count(*) AS n, max(n_name) AS last FROM nation WHERE n_regionkey IN (0, 2) GROUP BY 1",
    "files_fixed_csv": "SELECT sha256('c_custkey,c_name,c_acctbal' || chr(10) || string_agg(c_custkey || ',' || c_name || ',' || printf('%.2f', c_acctbal::DOUBLE) || chr(10), '' ORDER BY c_custkey)) AS sha256, true AS refuses_second FROM customer",
    "files_write_once": "SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n, true AS refuses_second FROM nation GROUP BY 1",
    "files_generations": f"WITH {_FILES} SELECT 2 AS generation, path AS name, content || content AS content FROM n WHERE ends_with(path, '.json')",
    "contract_column_families": f"""WITH c AS (SELECT DISTINCT table_name AS t, lower(column_name) AS c FROM duckdb_columns() WHERE table_name IN {TABLES}), f AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in FAMILIES.items())}) x(family, p))
SELECT family, count(c) AS n_columns, count(DISTINCT t) AS n_tables, coalesce(string_agg(DISTINCT c, '|' ORDER BY c), '') AS columns FROM f LEFT JOIN c ON regexp_matches(c, p) GROUP BY family""",
    "contract_guards": " UNION ALL ".join(f"SELECT '{k}' AS guard, {str(v).lower()} AS is_refused" for k, v in _GUARDS.items()),
    "contract_joins": """SELECT 'one_to_one' AS "case", (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS n UNION ALL SELECT 'many_to_one', (SELECT count(*) FROM customer) UNION ALL SELECT 'many_to_one_open', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)
UNION ALL SELECT 'incomplete_refused', 1 UNION ALL SELECT 'repeated_refused', 1""",
    "hash_ordered": "SELECT c_mktsegment, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS ordered_sha256 FROM customer GROUP BY 1",
    "hash_frame_text": f"WITH {_frame_sql(_MOLECULE, ['molecule_id', 'n_sources'], 'analogue_components', 'content_hash')} SELECT * FROM fh",
    "hash_arrays": "SELECT c_nationkey, sha256(string_agg(format('{:.17g}', c_acctbal::DOUBLE), ',' ORDER BY c_custkey)) AS array_sha256 FROM customer GROUP BY 1",
    "hash_canonical_json": """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS json_sha256, CAST(CAST('0x' || substr(sha256('{"key":' || n_nationkey || '}'), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM nation""",
    "scalar_normalized_source": "SELECT s_suppkey, regexp_replace(s_name, '[0-9]+', '<N>', 'g') AS text, len(regexp_extract_all(s_name, '[0-9]+'))::INTEGER AS n_masked FROM supplier",
    "folds_role_batch": f"WITH {_ROLES} SELECT record, c_name, true AS refuses_absent FROM ro JOIN customer ON c_custkey::VARCHAR = record WHERE outer_fold = 1 AND inner_basket = 2 AND role = 'validation'",
    "folds_weight_sidecar": f"WITH {_frame_sql(_WEIGHT, ['record', 'weight'], 'customer', 'weights_sha256')} SELECT *, true AS refuses_bad FROM fh",
    "folds_contract_problems": "SELECT 0 AS outer_fold, 1 AS inner_basket, 'fit' AS role, 'count' AS problem UNION ALL SELECT 1, 2, 'test', 'hash' UNION ALL SELECT 2, 3, unnest(['fit', 'validation', 'test']), 'not_in_manifest'",
    "ledger_stage_identities": f"""WITH s AS (SELECT n_name AS key, n_nationkey, n_regionkey, n_name, sha256({_CORE} || '"protocol_lock_sha256":"lock"}}') AS identity FROM nation)
SELECT key, identity, sha256({_CORE} || '"note":"free","protocol_lock_sha256":"lock","scientific_identity_sha256":"' || identity || '"}}') AS spec_sha256 FROM s""",
    "ledger_locked_problems": f"WITH {_FAULTS} SELECT 'plan_hash' AS problem, '' AS path UNION ALL SELECT CASE WHEN i.path IS NULL THEN 'locked_absent' ELSE 'locked_changed' END, m.path FROM m LEFT JOIN i USING (path) WHERE i.path IS NULL OR i.size <> m.size OR i.sha256 <> m.sha256",
    "ledger_release_gate": "SELECT true AS opens_complete, false AS opens_incomplete",
}
