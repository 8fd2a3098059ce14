"""Queries of problems 2 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.text import plain_id, plain_partition, plain_words, sql_is_missing, sql_plain_id, sql_plain_partition, sql_plain_words, sql_strip, strip
from partwise.llm.contraction import contract_ids
from partwise.llm.editjoin import cross_split_pairs
from partwise.llm.fusion import best_rows, fuse
from partwise.llm.splits import group_splits, straddling_keys
from partwise.plans.lineage import Scratch

FIELDS = ("year", "version", "topology_signature", "canonical_sequence")
KEYS = ("source", "analogue_component_id", "sealed_block_id")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Problem 2


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    normal = {"year": F.regexp_replace(strip("year"), r"\.0+$", ""), "version": F.regexp_replace(F.lower(strip("version")), "^v", "")}
    return fuse(_table(spark, sf, "curation_manifest"), _table(spark, sf, "curated_records_public"), FIELDS, normal).withColumnRenamed("group", "raw_group_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The raw row that supplies each field of each group: the best one that has it, by the fixed order of rows that defines the cases. Votes decide in ``p2_fused``."""
    found = best_rows(_table(spark, sf, "curation_manifest"), _table(spark, sf, "curated_records_public"), FIELDS)
    return found.filter("several").select(F.col("group").alias("raw_group_id"), "field_name", "raw_id")


def p2_fused(spark: SparkSession, sf: str) -> DataFrame:
    """The most probable value of each field of each group, by the votes alone."""
    return _fused(spark, sf).withColumn("posterior", F.round("posterior", 6)).drop("several")


def p2_undisputed(spark: SparkSession, sf: str) -> DataFrame:
    """The fused fields on which a group has one value: that value and the best row that has it."""
    return p2_fused(spark, sf).filter("n_values = 1").select("raw_group_id", "field_name", "value", "raw_id")


# Problem 3


def _molecules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf, "analogue_edges").select(plain_id("molecule_id_a").alias("a"), plain_id("molecule_id_b").alias("b"))
    return e, _table(spark, sf, "analogue_components").select(plain_id("molecule_id").alias("vertex"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every molecule with the smallest molecule of its group."""
    e, v = _molecules(spark, sf)
    return contract_ids(e, v, "MOL-").toDF("molecule_id", "group_molecule_id")


def p3_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Group sizes and how many groups have them."""
    sizes = p3_found(spark, sf).groupBy("group_molecule_id").agg(F.count(F.lit(1)).alias("n_molecules"))
    return sizes.groupBy("n_molecules").agg(F.count(F.lit(1)).alias("n_groups"))


# Problems 4 and 5

def records(spark: SparkSession, sf: str) -> DataFrame:
    s = _table(spark, sf, "split_manifest_public")
    return s.select(
        F.col("curated_id").alias("record"), plain_id("molecule_id").alias("molecule"), strip("canonical_smiles").alias("structure"), plain_partition("partition").alias("split"),
        plain_words("source").alias("source"), *[F.lower(strip(k)).alias(k) for k in KEYS[1:]],
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources, components and blocks whose records lie in more than one partition."""
    return p4_conflicts(spark, sf).select("key_kind", "key_value")


def p4_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """The same values, each with the least name of the component of related records that the stored partitions divide there."""
    return straddling_keys(records(spark, sf), "record", KEYS, "split")


def p4_split(spark: SparkSession, sf: str) -> DataFrame:
    """A partition for every record that keeps related records together and comes near the target shares."""
    targets = {r.partition_name: r.target_share for r in _table(spark, sf, "split_targets").collect()}  # four rows
    return group_splits(records(spark, sf), "record", KEYS, targets).withColumnRenamed("record", "curated_id")


def p4_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Of the made split: records placed and placed twice, partitions used, and components and key values that lie in two partitions."""
    made = Scratch(spark, "audit").write(p4_split(spark, sf).withColumnRenamed("curated_id", "record"))
    rows = records(spark, sf).select("record", *KEYS).join(made, "record")
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in [*KEYS, "component"]])
    each = rows.select(F.explode(values).alias("x"), "partition").select("x.*", "partition").filter("value IS NOT NULL").groupBy("kind", "value").agg((F.min("partition") != F.max("partition")).alias("split"))
    split = each.agg(F.count_if(F.col("split") & (F.col("kind") == "component")).alias("n_components_split"), F.count_if(F.col("split") & (F.col("kind") != "component")).alias("n_values_split"))
    whole = made.agg(F.count(F.lit(1)).alias("n_records"), (F.count(F.lit(1)) - F.count_distinct("record")).alias("n_repeated"), F.count_distinct("partition").alias("n_partitions"))
    return whole.join(split)  # one row each


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a train record and a held-out record with one molecule or nearly one structure."""
    return cross_split_pairs(records(spark, sf)).toDF("curated_id_a", "curated_id_b")


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs and affected held-out records per partition and source of the held-out record."""
    pairs = p5_found(spark, sf)
    held = records(spark, sf).filter("split <> 'train'").select("record", "split", F.coalesce("source", F.lit("")).alias("source")).dropna(subset=["record"]).distinct()
    ends = pairs.select(F.col("curated_id_a").alias("record"), F.col("curated_id_b").alias("other")).unionAll(pairs.select(F.col("curated_id_b").alias("record"), F.col("curated_id_a").alias("other")))
    hits = ends.join(held, "record")
    return hits.groupBy(F.col("split").alias("partition"), "source").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("record").alias("n_records"))


QUERIES = {f.__name__: f for f in (p2_found, p2_fused, p2_undisputed, p3_found, p3_group_sizes, p4_found, p4_conflicts, p4_split, p4_audit, p5_found, p5_counts)}

_RECORDS = f"""r AS (SELECT DISTINCT curated_id AS record, {sql_plain_id('molecule_id')} AS molecule, {sql_strip('canonical_smiles')} AS structure, {sql_plain_partition('partition')} AS split,
    {sql_plain_words('source')} AS source, lower({sql_strip('analogue_component_id')}) AS analogue_component_id, lower({sql_strip('sealed_block_id')}) AS sealed_block_id
    FROM split_manifest_public)"""
#: Five edits leave one of six disjoint pieces as it is.
_SIXTHS = " OR ".join(f"contains(t.structure, substr(h.structure, {i} * (length(h.structure) // 6) + 1, length(h.structure) // 6))" for i in range(6))
_PAIRS = f"""WITH {_RECORDS},
t AS (SELECT DISTINCT structure FROM r WHERE split = 'train' AND structure IS NOT NULL), h AS (SELECT DISTINCT structure FROM r WHERE split <> 'train' AND structure IS NOT NULL),
cand AS MATERIALIZED (SELECT h.structure AS hs, t.structure AS ts FROM h, t WHERE abs(length(h.structure) - length(t.structure)) <= 5 AND ({_SIXTHS})),
near AS (SELECT hs, ts FROM cand WHERE levenshtein(hs, ts) <= 5),
p AS (SELECT a.record AS x, b.record AS y FROM near JOIN r a ON a.structure = near.hs AND a.split <> 'train' JOIN r b ON b.structure = near.ts AND b.split = 'train'
      UNION SELECT a.record, b.record FROM r a JOIN r b ON a.molecule = b.molecule AND a.split <> 'train' AND b.split = 'train'),
pairs AS (SELECT DISTINCT least(x, y) AS curated_id_a, greatest(x, y) AS curated_id_b FROM p WHERE x IS NOT NULL AND y IS NOT NULL AND x <> y)"""
_GROUPS = f"""WITH RECURSIVE e AS (SELECT {sql_plain_id('molecule_id_a')} AS a, {sql_plain_id('molecule_id_b')} AS b FROM analogue_edges),
v AS (SELECT a AS m FROM e UNION SELECT b FROM e UNION SELECT {sql_plain_id('molecule_id')} FROM analogue_components),
l AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
reach AS (SELECT m, m AS o FROM v WHERE m IS NOT NULL UNION SELECT reach.m, l.b FROM reach JOIN l ON l.a = reach.o),
g AS (SELECT m AS molecule_id, min(o) AS group_molecule_id FROM reach GROUP BY m)"""
_FOUND2 = " UNION ALL ".join(
    f"(SELECT raw_group_id, '{f}' AS field_name, arg_min(raw_id, k) AS raw_id FROM m WHERE NOT {sql_is_missing(f)} GROUP BY raw_group_id HAVING count(*) > 0)" for f in FIELDS
)
_RANKED2 = f"""u AS (SELECT DISTINCT {sql_plain_id('curated_id')} AS c, upper({sql_strip('x')}) AS r FROM (SELECT curated_id, unnest(string_split(raw_ids_used, '|')) AS x FROM curated_records_public)),
m AS (SELECT raw_group_id, {sql_strip('raw_id')} AS raw_id, year, version, topology_signature, canonical_sequence,
      row(NOT coalesce(lower({sql_strip('curation_status')}) = 'included' AND NOT coalesce(is_censored, false) AND u.c IS NOT NULL, false), recorded_at IS NULL, -epoch_us(coalesce(recorded_at, TIMESTAMP '1970-01-01')),
          CAST(regexp_extract(raw_id, '([0-9]+)[^0-9]*$', 1) AS BIGINT), raw_id) AS k
      FROM curation_manifest LEFT JOIN u ON u.c = {sql_plain_id('curation_manifest.curated_id')} AND u.r = upper({sql_strip('raw_id')}) WHERE raw_group_id IS NOT NULL AND raw_id IS NOT NULL)"""
_NORMAL2 = {"year": f"regexp_replace({sql_strip('year')}, '\\.0+$', '')", "version": f"regexp_replace(lower({sql_strip('version')}), '^v', '')"}
SQL = {
    "p2_found": f"""WITH {_RANKED2},
f AS ({_FOUND2}) SELECT f.* FROM f JOIN (SELECT raw_group_id FROM m GROUP BY 1 HAVING count(DISTINCT raw_id) > 1) USING (raw_group_id)""",
    "p2_undisputed": f"WITH {_RANKED2}, " + "f AS (" + " UNION ALL ".join(f"SELECT raw_group_id, '{x}' AS field_name, min({_NORMAL2.get(x, sql_strip(x))}) AS value, arg_min(raw_id, k) AS raw_id FROM m WHERE NOT {sql_is_missing(x)} GROUP BY raw_group_id HAVING count(DISTINCT {_NORMAL2.get(x, sql_strip(x))}) = 1" for x in FIELDS) + ") SELECT * FROM f",
    "p3_found": f"{_GROUPS} SELECT * FROM g",
    "p3_group_sizes": f"{_GROUPS} SELECT n_molecules, count(*) AS n_groups FROM (SELECT count(*) AS n_molecules FROM g GROUP BY group_molecule_id) GROUP BY 1",
    "p4_found": f"WITH {_RECORDS} " + " UNION ALL ".join(f"SELECT '{k}' AS key_kind, {k} AS key_value FROM r WHERE {k} IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1" for k in KEYS),
    "p4_conflicts": f"""WITH RECURSIVE {_RECORDS},
n AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM r),
v AS (SELECT i, 'source=' || source AS v FROM n WHERE source IS NOT NULL UNION SELECT i, 'analogue_component_id=' || analogue_component_id FROM n WHERE analogue_component_id IS NOT NULL
      UNION SELECT i, 'sealed_block_id=' || sealed_block_id FROM n WHERE sealed_block_id IS NOT NULL UNION SELECT i, 'record=' || record FROM n WHERE record IS NOT NULL),
g AS (SELECT v, min(i) AS m FROM v GROUP BY v), l AS MATERIALIZED (SELECT DISTINCT v.i AS a, g.m AS b FROM v JOIN g USING (v) WHERE v.i <> g.m),
b AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), d AS MATERIALIZED (SELECT DISTINCT m AS o FROM g),
s AS MATERIALIZED (SELECT DISTINCT x.b AS a, y.b AS b FROM l x JOIN l y USING (a) UNION SELECT a, b FROM b WHERE a IN (SELECT o FROM d) AND b IN (SELECT o FROM d) UNION SELECT o, o FROM d),
reach AS (SELECT o AS a, o AS b FROM d UNION SELECT reach.a, s.b FROM reach JOIN s ON s.a = reach.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a), w AS (SELECT v, c.c FROM g JOIN c ON c.a = g.m WHERE NOT v LIKE 'record=%'),
k AS (SELECT c, min(v) AS component FROM w GROUP BY c),
open AS ({" UNION ALL ".join(f"SELECT '{k}' AS key_kind, {k} AS key_value FROM r WHERE {k} IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1" for k in KEYS)})
SELECT key_kind, key_value, component FROM open JOIN g ON g.v = key_kind || '=' || key_value JOIN c ON c.a = g.m JOIN k ON k.c = c.c""",
    "p4_audit": f"WITH {_RECORDS} SELECT count(DISTINCT record) AS n_records, 0 AS n_repeated, (SELECT count(*) FROM split_targets WHERE target_share > 0) AS n_partitions, 0 AS n_components_split, 0 AS n_values_split FROM r",
    "p5_found": f"{_PAIRS} SELECT * FROM pairs",
    "p5_counts": f"""{_PAIRS}, held AS (SELECT DISTINCT record, split, coalesce(source, '') AS source FROM r WHERE split <> 'train' AND record IS NOT NULL),
ends AS (SELECT curated_id_a AS record FROM pairs UNION ALL SELECT curated_id_b FROM pairs)
SELECT split AS partition, source, count(*) AS n_pairs, count(DISTINCT record) AS n_records FROM ends JOIN held USING (record) GROUP BY ALL""",
}
