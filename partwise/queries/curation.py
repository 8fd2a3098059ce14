"""Curation, its audits, hashing and scalar rules over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions import cleaning as c
from partwise.functions import sequences as seq
from partwise.functions.hashing import frame_hash, id_set_hash, ordered_ids_hash, seed_of_index, stable_id
from partwise.functions.text import plain_id, plain_words, sql_plain_id, sql_plain_words
from partwise.operators import curate
from partwise.plans import contracts
from partwise.queries.common import rounded, table

NOTES = ("", "", "", "", "solubility limit", "Not tested", "n/a", "%T>100", "below LOD", "< -7.5", "value set to -10", "see footnote")
_N = "CAST(regexp_extract(raw_id, '([0-9]+)$', 1) AS BIGINT)"


def raw_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Raw measurement rows: each raw id once, with an endpoint derived from its number (missing for every 29th)."""
    m = table(spark, sf, "curation_manifest").select("raw_id", plain_words("source").alias("source"), "canonical_smiles", "year", "version", "topology_signature", "canonical_sequence", "is_censored").filter("raw_id IS NOT NULL")
    one = m.groupBy("raw_id").agg(F.min(F.struct(*m.columns[1:])).alias("x")).select("raw_id", "x.*")
    n = F.regexp_extract("raw_id", "([0-9]+)$", 1).cast("long")
    return one.select(
        "raw_id", n.alias("sort_id"), "source", F.col("canonical_smiles").alias("structure"), "year", "version", F.col("topology_signature").alias("topology"), F.col("canonical_sequence").alias("sequence"),
        F.coalesce("is_censored", F.lit(False)).alias("censored"), F.when(n % 29 != 0, (n % 997) / 100.0).alias("endpoint"),
    )


def curate_records(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(curate.curated_records(raw_rows(spark, sf)))


def curate_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return curate.curation_manifest(raw_rows(spark, sf))


def curate_flow(spark: SparkSession, sf: str) -> DataFrame:
    r = raw_rows(spark, sf)
    return curate.curation_flow(curate.curation_manifest(r), curate.curated_records(r))


def curate_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    r = raw_rows(spark, sf)
    return rounded(curate.source_audit(r, curate.curated_records(r)))


def curate_endpoint_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric values of censored rows, missing ones as a group of their own."""
    return rounded(curate.class_shares(raw_rows(spark, sf).filter("censored"), "endpoint", "source"))


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.regexp_extract("raw_id", "([0-9]+)$", 1).cast("long")
    pick = lambda k: F.element_at(F.array(*map(F.lit, NOTES)), (n % k % len(NOTES) + 1).cast("int"))
    return raw_rows(spark, sf).select("raw_id", "source", F.nullif(pick(12), F.lit("")).alias("note_1"), F.when(n % 5 == 0, F.lit("  ")).otherwise(F.nullif(pick(7), F.lit(""))).alias("note_2"))


def curate_note_classes(spark: SparkSession, sf: str) -> DataFrame:
    n = _notes(spark, sf).withColumn("note_class", c.note_class("note_1", "note_2")).withColumn("by_text", c.censored_by_text("note_1", "note_2")).withColumn("by_presence", c.censored_by_presence("note_1", "note_2"))
    return n.groupBy("note_class").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_sources"), F.count_if("by_text").alias("n_by_text"), F.count_if("by_presence").alias("n_by_presence"))


def curate_rollup(spark: SparkSession, sf: str) -> DataFrame:
    ids = [plain_id(c).alias(c) for c in ("sealed_block_id", "molecule_id", "analogue_component_id")]
    s = table(spark, sf, "split_manifest_public").select("curated_id", *ids, plain_words("source").alias("source"), "ring_size").distinct()
    return curate.rollup(s.filter("sealed_block_id IS NOT NULL"), "sealed_block_id")


def curate_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Curated records' first used raw ids and structures against the raw table."""
    r = raw_rows(spark, sf).select("raw_id", "source", F.coalesce("structure", F.lit("")).alias("structure"))
    listed = table(spark, sf, "curated_records_public").select(F.coalesce("source", F.lit("")).alias("split"), F.trim(F.substring_index("raw_ids_used", "|", 1)).alias("id"), F.coalesce("canonical_smiles", F.lit("")).alias("structure")).distinct()
    return curate.reconcile(listed, r)


def curate_reconcile_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same for every used raw id of a curated record."""
    r = raw_rows(spark, sf).select("raw_id", "source", F.coalesce("structure", F.lit("")).alias("structure"))
    ids = F.explode(F.split("raw_ids_used", r"\|"))
    listed = table(spark, sf, "curated_records_public").select(F.coalesce("source", F.lit("")).alias("split"), F.coalesce("canonical_smiles", F.lit("")).alias("structure"), ids.alias("id"))
    listed = listed.withColumn("id", F.trim("id")).filter("id <> ''").select("split", "id", "structure").distinct()
    return curate.reconcile(listed, r)


def scalar_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaning, coercion, prefixes, indicators, affine maps and token counts per raw row."""
    t = seq.parse_tokens("sequence")
    return raw_rows(spark, sf).select(
        "raw_id", c.clean("year").alias("year"), c.number("version").alias("version"), c.prefix("topology").alias("topology"), *c.one_hot(c.prefix("topology"), ("lariat", "circle_other")),
        F.round(c.normalized("endpoint"), 6).alias("normalized"), F.round(c.denormalized(c.normalized("endpoint")), 6).alias("back"), c.is_finite("endpoint").alias("is_finite"),
        *[F.coalesce(x, F.lit(-1)).alias(n) for n, x in (("n_tokens", F.size(t)), ("n_methylated", c.count_methylated(t)), ("n_noncanonical", c.count_noncanonical(t)))],
    )


def scalar_topology(spark: SparkSession, sf: str) -> DataFrame:
    """Topology signatures rebuilt from shapes, lengths and closure notes."""
    r = table(spark, sf, "curated_records_public").select("curated_id", "topology_signature", "ring_size", "main_chain_length", "canonical_sequence").distinct()
    kind = F.substring_index("topology_signature", "|", 1)
    shape = F.when(kind.startswith("circle"), "Circle").when(kind == "lariat", "Lariat").otherwise("")
    helm = F.when(kind == "circle_head_to_tail", F.concat(F.lit("PEPTIDE1,PEPTIDE1,1:R1-"), F.col("main_chain_length").cast("string"), F.lit(":R2")))
    built = c.topology_signature(shape, F.col("ring_size"), F.col("main_chain_length"), helm, F.size(seq.parse_tokens("canonical_sequence")))
    return r.select("curated_id", built.alias("signature"))


def scalar_canonical_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical rotation of every sequence of a head-to-tail ring; other sequences as they are."""
    r = table(spark, sf, "curated_records_public").select("canonical_sequence", "topology_signature").dropna().distinct()
    t = r.withColumn("t", seq.parse_tokens("canonical_sequence")).filter("t IS NOT NULL")
    return t.select("canonical_sequence", "topology_signature", F.array_join(seq.canonical_tokens("t", "topology_signature"), ",").alias("canonical"))


def hash_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Content ids of curated records and molecules, nulls as empty fields."""
    return table(spark, sf, "curated_records_public").select("curated_id", stable_id("REC", "source", "year", "version").alias("record_hash"), stable_id("MOL", "canonical_smiles").alias("molecule_hash")).distinct()


def hash_id_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of the id set of each source, and of its ordered ids."""
    s = table(spark, sf, "split_manifest_public").select(plain_words("source").alias("source"), "curated_id", plain_id("molecule_id").alias("molecule_id")).filter("source IS NOT NULL").groupBy("source")
    return s.agg(id_set_hash("curated_id").alias("set_sha256"), ordered_ids_hash(F.array_sort(F.collect_list("molecule_id"))).alias("ordered_sha256"))


def hash_frame(spark: SparkSession, sf: str) -> DataFrame:
    return frame_hash(table(spark, sf, "analogue_components").select("molecule_id", "molecular_weight", "n_sources"))


def hash_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", seed_of_index("n_nationkey").alias("seed"))


def contract_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Where components of the split manifest and of the component table differ per molecule."""
    of = lambda name: table(spark, sf, name).select(plain_id("molecule_id").alias("molecule_id"), plain_id("analogue_component_id").alias("c")).filter("molecule_id IS NOT NULL").groupBy("molecule_id").agg(F.min("c").alias("c"))
    return contracts.compare_mappings(of("split_manifest_public"), of("analogue_components"), ["molecule_id"], "c")


def contract_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Curated ids that the split manifest lacks or has beyond the curated records, when some are taken from it and some renamed."""
    observed = table(spark, sf, "split_manifest_public").dropna(subset=["curated_id"]).withColumn("curated_id", F.when(F.col("curated_id").endswith("7"), F.concat("curated_id", F.lit("-x"))).otherwise(F.col("curated_id"))).filter(~F.col("curated_id").endswith("3"))
    return contracts.coverage_gaps(table(spark, sf, "curated_records_public").dropna(subset=["curated_id"]), observed, ["curated_id"])


def contract_group_constant(spark: SparkSession, sf: str) -> DataFrame:
    """Components whose records come from several sources."""
    s = table(spark, sf, "split_manifest_public").select(plain_id("analogue_component_id").alias("analogue_component_id"), plain_words("source").alias("source"))
    return contracts.group_constant(s.filter("analogue_component_id IS NOT NULL"), "analogue_component_id", "source")


QUERIES = {
    f.__name__: f
    for f in (
        curate_records, curate_manifest, curate_flow, curate_source_audit, curate_endpoint_histogram, curate_note_classes, curate_rollup, curate_reconcile, curate_reconcile_all, scalar_rules, scalar_topology, scalar_canonical_cycles,
        hash_ids, hash_id_sets, hash_frame, hash_seeds, contract_mapping, contract_coverage, contract_group_constant,
    )
}

_RAW = f"""m AS (SELECT DISTINCT ON (raw_id) raw_id, source, canonical_smiles, year, version, topology_signature, canonical_sequence, is_censored FROM (SELECT * REPLACE ({sql_plain_words('source')} AS source) FROM curation_manifest) WHERE raw_id IS NOT NULL
  ORDER BY raw_id, source NULLS FIRST, canonical_smiles NULLS FIRST, year NULLS FIRST, version NULLS FIRST, topology_signature NULLS FIRST, canonical_sequence NULLS FIRST, is_censored NULLS FIRST),
raw AS (SELECT raw_id, {_N} AS sort_id, source, canonical_smiles AS structure, year, version, topology_signature AS topology, canonical_sequence AS sequence, coalesce(is_censored, false) AS censored,
  CASE WHEN {_N} % 29 <> 0 THEN ({_N} % 997) / 100.0 END AS endpoint FROM m)"""
_AGREE = ("year", "version", "topology", "sequence")
_ID = lambda prefix, *cols: f"'{prefix}-' || substr(sha256(" + " || chr(31) || ".join(f"coalesce({x}, '')" for x in cols) + "), 1, 16)"
_JUDGED = f"""{_RAW}, j AS (SELECT * REPLACE (coalesce(structure, '') AS structure, coalesce(sequence, '') AS sequence), coalesce(structure, '') <> '' AND coalesce(sequence, '') <> '' AS parsed,
  coalesce(structure, '') <> '' AND coalesce(sequence, '') <> '' AND NOT censored AND endpoint IS NOT NULL AS usable FROM raw),
g AS (SELECT source, structure, count(*) AS n_raw_rows, count(*) FILTER (usable) AS n_uncensored_used, {', '.join(f"count(DISTINCT trim(coalesce({c}, ''))) FILTER (usable) AS n_{c}, arg_min(trim(coalesce({c}, '')), row(sort_id, raw_id)) FILTER (usable) AS f_{c}" for c in _AGREE)},
  string_agg(raw_id, '|' ORDER BY raw_id) AS raw_ids_all, string_agg(raw_id, '|' ORDER BY raw_id) FILTER (usable) AS raw_ids_used, min(endpoint) FILTER (usable) AS lo, max(endpoint) FILTER (usable) AS hi, median(endpoint) FILTER (usable) AS md
  FROM j WHERE parsed GROUP BY source, structure),
v AS (SELECT *, CASE WHEN n_uncensored_used = 0 THEN 'irrecoverably_censored_or_missing_label' WHEN n_year <> 1 OR n_version <> 1 OR n_topology <> 1 OR n_sequence <> 1 THEN 'incompatible_same_source_group:' ||
  concat_ws('|', {', '.join(f"CASE WHEN n_{c} <> 1 THEN '{c}' END" for c in _AGREE)}) END AS verdict FROM g),
rec AS (SELECT {_ID('SSCP', 'source', 'structure')} AS curated_id, {_ID('MOL', 'structure')} AS molecule_id, structure, trim(coalesce(source, '')) AS source, {', '.join(f'f_{c} AS {c}' for c in _AGREE)},
  raw_ids_all, raw_ids_used, n_raw_rows, n_uncensored_used, lo AS replicate_min, hi AS replicate_max, hi - lo AS replicate_spread, md AS endpoint FROM v WHERE verdict IS NULL),
man AS (SELECT raw_id, CASE WHEN j.structure <> '' THEN {_ID('GRP', 'j.source', 'j.structure')} ELSE {_ID('RAW', 'raw_id')} END AS raw_group_id, trim(coalesce(j.source, '')) AS source, censored,
  CASE WHEN NOT parsed OR verdict IS NOT NULL THEN 'excluded' WHEN censored THEN 'excluded_linked_to_curated_group' ELSE 'included' END AS curation_status,
  CASE WHEN j.structure = '' THEN 'invalid_structure' WHEN j.sequence = '' THEN 'invalid_sequence' WHEN verdict IS NOT NULL THEN verdict WHEN censored THEN 'irrecoverably_censored_row' ELSE 'compatible_uncensored_replicate' END AS reason,
  CASE WHEN parsed AND verdict IS NULL THEN {_ID('SSCP', 'j.source', 'j.structure')} ELSE '' END AS curated_id
  FROM j LEFT JOIN v ON j.source IS NOT DISTINCT FROM v.source AND j.structure = v.structure AND j.parsed)"""
_NOTE = "[" + ", ".join(repr(x) for x in NOTES) + "]"
_TOKENS = "from_json(sequence, '[\"VARCHAR\"]')"
SQL = {
    "curate_records": f"WITH {_JUDGED} SELECT * REPLACE (round(replicate_spread, 6) AS replicate_spread, round(endpoint, 6) AS endpoint) FROM rec",
    "curate_manifest": f"WITH {_JUDGED} SELECT * FROM man",
    "curate_flow": f"""WITH {_JUDGED} SELECT 'raw_rows' AS counter, count(*) AS n FROM man UNION ALL SELECT 'invalid_rows', count(*) FROM man WHERE reason LIKE 'invalid%' UNION ALL SELECT 'censored_rows', count(*) FROM man WHERE censored
UNION ALL SELECT 'excluded_raw_rows', count(*) FROM man WHERE curation_status LIKE 'excluded%' UNION ALL SELECT 'incompatible_groups', count(DISTINCT raw_group_id) FROM man WHERE reason LIKE 'incompatible%'
UNION ALL SELECT 'curated_records', count(*) FROM rec UNION ALL SELECT 'curated_molecules', count(DISTINCT molecule_id) FROM rec UNION ALL SELECT 'curated_sources', count(DISTINCT source) FROM rec UNION ALL SELECT 'collapsed_groups', count(*) FROM rec WHERE n_uncensored_used > 1""",
    "curate_source_audit": f"""WITH {_JUDGED}, a AS (SELECT source, count(*) AS raw_rows, count(*) FILTER (censored) AS censored_rows, count(endpoint) AS numeric_rows FROM raw GROUP BY source),
b AS (SELECT source, count(*) AS curated_records, median(endpoint) AS endpoint_median, quantile_cont(endpoint, 0.25) AS endpoint_q1, quantile_cont(endpoint, 0.75) AS endpoint_q3, min(endpoint) AS endpoint_min, max(endpoint) AS endpoint_max FROM rec GROUP BY source)
SELECT a.source, raw_rows, censored_rows, numeric_rows, raw_rows - censored_rows AS uncensored_rows, round(censored_rows / raw_rows, 6) AS censored_fraction, coalesce(curated_records, 0) AS curated_records, round(endpoint_median, 6) AS endpoint_median, round(endpoint_q1, 6) AS endpoint_q1,
round(endpoint_q3, 6) AS endpoint_q3, round(endpoint_min, 6) AS endpoint_min, round(endpoint_max, 6) AS endpoint_max FROM a LEFT JOIN b ON a.source = b.source""",
    "curate_endpoint_histogram": f"WITH {_RAW} SELECT round(endpoint, 6) AS endpoint, count(*) AS n_rows, count(DISTINCT source) AS n_sources, round(count(*) / (SELECT count(*) FROM raw WHERE censored), 6) AS share FROM raw WHERE censored GROUP BY 1",
    "curate_note_classes": f"""WITH {_RAW}, n AS (SELECT source, nullif({_NOTE}[sort_id % 12 % 12 + 1], '') AS a, CASE WHEN sort_id % 5 = 0 THEN '  ' ELSE nullif({_NOTE}[sort_id % 7 % 12 + 1], '') END AS b FROM raw),
t AS (SELECT *, lower(concat_ws(' ', CASE WHEN trim(coalesce(a, '')) <> '' THEN a END, CASE WHEN trim(coalesce(b, '')) <> '' THEN b END)) AS x FROM n),
k AS (SELECT *, CASE WHEN x = '' THEN 'not_censored' WHEN contains(x, 'solubility') OR contains(x, 'not tested') THEN 'solubility_or_not_tested' WHEN contains(x, 'no value') OR contains(x, 'n/a') OR contains(x, '%t>100') THEN 'no_reportable_value'
  WHEN contains(x, 'not detected') OR contains(x, 'undetected') OR contains(x, 'below lod') OR contains(x, 'blod') THEN 'not_detected_or_below_lod' WHEN regexp_matches(x, '(^|\\s)<\\s*[-+]?\\d') THEN 'explicit_upper_limit'
  WHEN contains(x, 'set to') OR contains(x, 'value described') THEN 'database_assigned_or_reported_floor' ELSE 'other_detection_limit_note' END AS note_class FROM t)
SELECT note_class, count(*) AS n_rows, count(DISTINCT source) AS n_sources, count(*) FILTER (trim(coalesce(a, '')) <> '' OR trim(coalesce(b, '')) <> '') AS n_by_text, count(*) FILTER (a IS NOT NULL OR b IS NOT NULL) AS n_by_presence FROM k GROUP BY 1""",
    "curate_rollup": f"""WITH s AS (SELECT DISTINCT curated_id, {sql_plain_id('sealed_block_id')} AS sealed_block_id, {sql_plain_id('molecule_id')} AS molecule_id, {sql_plain_id('analogue_component_id')} AS analogue_component_id, {sql_plain_words('source')} AS source, ring_size FROM split_manifest_public WHERE sealed_block_id IS NOT NULL)
SELECT sealed_block_id, count(*) AS n_rows, count(DISTINCT molecule_id) AS n_molecules, count(DISTINCT analogue_component_id) AS n_components, count(DISTINCT source) AS n_sources, coalesce(string_agg(DISTINCT source, '|' ORDER BY source), '') AS sources,
array_to_string(list_transform(list_sort(list_distinct(list(ring_size) FILTER (ring_size IS NOT NULL))), lambda x: x::VARCHAR), '|') AS ring_sizes FROM s GROUP BY 1""",
    "curate_reconcile": f"""WITH {_RAW}, r AS (SELECT raw_id, source, coalesce(structure, '') AS structure FROM raw), l AS (SELECT DISTINCT coalesce(source, '') AS split, trim(string_split(raw_ids_used, '|')[1]) AS id, coalesce(canonical_smiles, '') AS structure FROM curated_records_public),
x AS (SELECT structure, count(*) AS n, string_agg(DISTINCT raw_id, '|' ORDER BY raw_id) AS raw_ids, string_agg(DISTINCT source, '|' ORDER BY source) AS raw_sources FROM r WHERE structure <> '' GROUP BY 1)
SELECT split, id, l.structure, coalesce(r.structure = l.structure AND l.structure <> '', false) AS direct_match, coalesce(raw_ids, '') AS raw_ids, coalesce(raw_sources, '') AS raw_sources,
CASE WHEN r.raw_id IS NULL THEN 'id_absent_from_raw_namespace' WHEN NOT coalesce(r.structure = l.structure AND l.structure <> '', false) THEN 'id_maps_to_another_structure' WHEN n > 1 THEN 'row_stands_for_several_raw_records' ELSE 'direct_single_record_match' END AS reason
FROM l LEFT JOIN r ON r.raw_id = l.id LEFT JOIN x ON x.structure = l.structure""",
    "hash_ids": f"SELECT DISTINCT curated_id, {_ID('REC', 'source', 'year', 'version')} AS record_hash, {_ID('MOL', 'canonical_smiles')} AS molecule_hash FROM curated_records_public",
    "hash_id_sets": f"""WITH s AS (SELECT {sql_plain_words('source')} AS source, curated_id, {sql_plain_id('molecule_id')} AS molecule_id FROM split_manifest_public)
SELECT source, sha256(coalesce(string_agg(DISTINCT curated_id || chr(10), '' ORDER BY curated_id || chr(10)), '')) AS set_sha256, sha256(coalesce(string_agg(molecule_id, chr(10) ORDER BY molecule_id), '')) AS ordered_sha256
FROM s WHERE source IS NOT NULL GROUP BY source""",
    "hash_seeds": "SELECT n_nationkey, CAST(123 * n_nationkey * n_nationkey AS BIGINT) AS seed FROM nation",
    "scalar_rules": f"""WITH {_RAW}, t AS (SELECT *, CASE WHEN regexp_matches(trim(sequence), '^\\[.*\\]$') THEN CAST(sequence AS JSON)::VARCHAR[] END AS tk FROM raw)
SELECT raw_id, trim(coalesce(year, '')) AS year, try_cast(version AS DOUBLE) AS version, string_split(topology, '|')[1] AS topology, coalesce(CAST(string_split(topology, '|')[1] = 'lariat' AS INTEGER), 0) AS is_lariat,
coalesce(CAST(string_split(topology, '|')[1] = 'circle_other' AS INTEGER), 0) AS is_circle_other, round((endpoint + 6) / 2, 6) AS normalized, round(endpoint, 6) AS back, endpoint IS NOT NULL AS is_finite,
CAST(coalesce(len(tk), -1) AS INTEGER) AS n_tokens, CAST(coalesce(len(list_filter(tk, lambda x: starts_with(x, 'Me_'))), -1) AS INTEGER) AS n_methylated, CAST(coalesce(len(list_filter(tk, lambda x: NOT list_contains({list(c.CANONICAL)}, x))), -1) AS INTEGER) AS n_noncanonical FROM t""",
    "scalar_topology": """WITH r AS (SELECT DISTINCT curated_id, topology_signature, ring_size, main_chain_length, canonical_sequence FROM curated_records_public)
SELECT curated_id, CASE WHEN string_split(topology_signature, '|')[1] = 'circle_head_to_tail' AND ring_size = main_chain_length AND main_chain_length > 0 THEN 'circle_head_to_tail' WHEN starts_with(topology_signature, 'circle') THEN 'circle_other'
WHEN starts_with(topology_signature, 'lariat|') THEN 'lariat' ELSE 'unknown' END || '|total=' || coalesce(ring_size, -1) || '|main=' || coalesce(main_chain_length, -1) || '|tokens=' ||
coalesce(CASE WHEN regexp_matches(trim(canonical_sequence), '^\\[.*\\]$') THEN len(CAST(canonical_sequence AS JSON)::VARCHAR[]) END, -1) AS signature FROM r""",
    "scalar_canonical_cycles": """WITH r AS (SELECT DISTINCT canonical_sequence, topology_signature FROM curated_records_public WHERE canonical_sequence IS NOT NULL AND topology_signature IS NOT NULL AND regexp_matches(trim(canonical_sequence), '^\\[.*\\]$')),
t AS (SELECT *, CAST(canonical_sequence AS JSON)::VARCHAR[] AS a FROM r)
SELECT canonical_sequence, topology_signature, array_to_string(CASE WHEN starts_with(topology_signature, 'circle_head_to_tail') AND len(a) > 0 THEN list_min(list_transform(range(len(a)), lambda i: list_concat(a[i + 1:], a[1:i]))) ELSE a END, ',') AS canonical FROM t""",
    "contract_mapping": f"""WITH a AS (SELECT {sql_plain_id('molecule_id')} AS molecule_id, min({sql_plain_id('analogue_component_id')}) AS c FROM split_manifest_public WHERE molecule_id IS NOT NULL GROUP BY 1),
b AS (SELECT {sql_plain_id('molecule_id')} AS molecule_id, min({sql_plain_id('analogue_component_id')}) AS c FROM analogue_components WHERE molecule_id IS NOT NULL GROUP BY 1)
SELECT molecule_id, CASE WHEN b.molecule_id IS NULL THEN 'left_only' WHEN a.molecule_id IS NULL THEN 'right_only' ELSE 'value' END AS provenance FROM a FULL JOIN b USING (molecule_id)
WHERE a.molecule_id IS NULL OR b.molecule_id IS NULL OR a.c IS DISTINCT FROM b.c""",
    "contract_coverage": """WITH e AS (SELECT DISTINCT curated_id FROM curated_records_public WHERE curated_id IS NOT NULL), o AS (SELECT DISTINCT CASE WHEN ends_with(curated_id, '7') THEN curated_id || '-x' ELSE curated_id END AS curated_id FROM split_manifest_public WHERE curated_id IS NOT NULL AND NOT ends_with(curated_id, '3'))
SELECT curated_id, 'missing' AS gap FROM e ANTI JOIN o USING (curated_id) UNION ALL SELECT curated_id, 'extra' FROM o ANTI JOIN e USING (curated_id)""",
    "contract_group_constant": f"SELECT {sql_plain_id('analogue_component_id')} AS analogue_component_id, count(DISTINCT {sql_plain_words('source')}) AS n_values FROM split_manifest_public WHERE analogue_component_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {sql_plain_words('source')}) > 1",
    "curate_reconcile_all": f"""WITH {_RAW}, r AS (SELECT raw_id, source, coalesce(structure, '') AS structure FROM raw), l AS (SELECT DISTINCT * FROM (SELECT coalesce(source, '') AS split, trim(unnest(string_split(raw_ids_used, '|'))) AS id, coalesce(canonical_smiles, '') AS structure FROM curated_records_public) WHERE id <> ''),
x AS (SELECT structure, count(*) AS n, string_agg(DISTINCT raw_id, '|' ORDER BY raw_id) AS raw_ids, string_agg(DISTINCT source, '|' ORDER BY source) AS raw_sources FROM r WHERE structure <> '' GROUP BY 1)
SELECT split, id, l.structure, coalesce(r.structure = l.structure AND l.structure <> '', false) AS direct_match, coalesce(raw_ids, '') AS raw_ids, coalesce(raw_sources, '') AS raw_sources,
CASE WHEN r.raw_id IS NULL THEN 'id_absent_from_raw_namespace' WHEN NOT coalesce(r.structure = l.structure AND l.structure <> '', false) THEN 'id_maps_to_another_structure' WHEN n > 1 THEN 'row_stands_for_several_raw_records' ELSE 'direct_single_record_match' END AS reason
FROM l LEFT JOIN r ON r.raw_id = l.id LEFT JOIN x ON x.structure = l.structure""",
}
