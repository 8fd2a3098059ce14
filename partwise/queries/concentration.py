"""Problem 1: blocks of very unequal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwise.functions.text import plain_id, plain_words, sql_plain_id, sql_plain_words
from partwise.operators.concentration import ranked_sizes, size_conflicts

SCOPE = ["assignment_run_id", "threshold_pct"]


def _pct():
    return F.round(F.col("tanimoto_threshold") * 100).cast("int").alias("threshold_pct")


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    a = spark.read.parquet(f"{sf}/block_assignments.parquet")
    return a.select("assignment_run_id", _pct(), plain_id("sealed_block_id").alias("sealed_block_id"), "curated_id", "molecule_id", "analogue_component_id", plain_words("source").alias("source"))


def p1_ranked_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every block of every run and threshold with counts, rank, share and cumulative share."""
    extra = {"n_unique_molecules": "molecule_id", "n_analogue_components": "analogue_component_id", "n_sources": "source"}
    out = ranked_sizes(assignments(spark, sf), SCOPE, "sealed_block_id", "curated_id", extra)
    return out.withColumns({c: F.round(c, 9) for c in ("record_share", "cumulative_record_share")})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks whose stored size or cumulative share doesn't follow from the assignments."""
    expected = ranked_sizes(assignments(spark, sf), SCOPE, "sealed_block_id", "curated_id")
    s = spark.read.parquet(f"{sf}/block_definition_ranked_sizes.parquet")
    stored = s.select("assignment_run_id", _pct(), plain_id("sealed_block_id").alias("sealed_block_id"), "n_records", "cumulative_record_share")
    return size_conflicts(expected, stored, [*SCOPE, "sealed_block_id"])


_EXPECTED = f"""
a AS (SELECT assignment_run_id, CAST(round(tanimoto_threshold * 100) AS INTEGER) AS threshold_pct, {sql_plain_id('sealed_block_id')} AS sealed_block_id,
             curated_id, molecule_id, analogue_component_id, {sql_plain_words('source')} AS source FROM block_assignments),
n AS (SELECT assignment_run_id, threshold_pct, sealed_block_id, count(DISTINCT curated_id) AS n_records, count(DISTINCT molecule_id) AS n_unique_molecules,
             count(DISTINCT analogue_component_id) AS n_analogue_components, count(DISTINCT source) AS n_sources
      FROM a WHERE curated_id IS NOT NULL AND sealed_block_id IS NOT NULL AND assignment_run_id IS NOT NULL AND threshold_pct IS NOT NULL GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY assignment_run_id, threshold_pct ORDER BY n_records DESC, sealed_block_id) AS block_rank,
             n_records / sum(n_records) OVER (PARTITION BY assignment_run_id, threshold_pct) AS record_share,
             sum(n_records) OVER (PARTITION BY assignment_run_id, threshold_pct ORDER BY n_records DESC, sealed_block_id ROWS UNBOUNDED PRECEDING)
             / sum(n_records) OVER (PARTITION BY assignment_run_id, threshold_pct) AS cumulative_record_share FROM n)"""

QUERIES = {"p1_found": p1_found, "p1_ranked_sizes": p1_ranked_sizes}
SQL = {
    "p1_found": f"""WITH {_EXPECTED},
s AS (SELECT assignment_run_id, CAST(round(tanimoto_threshold * 100) AS INTEGER) AS threshold_pct, {sql_plain_id('sealed_block_id')} AS sealed_block_id, n_records, cumulative_record_share
      FROM block_definition_ranked_sizes WHERE assignment_run_id IS NOT NULL AND tanimoto_threshold IS NOT NULL AND sealed_block_id IS NOT NULL)
SELECT DISTINCT assignment_run_id, threshold_pct, sealed_block_id FROM e FULL JOIN s USING (assignment_run_id, threshold_pct, sealed_block_id)
WHERE e.n_records IS NULL OR s.n_records IS NULL OR s.cumulative_record_share IS NULL OR s.n_records <> e.n_records
   OR abs(s.cumulative_record_share - e.cumulative_record_share) > 0.000001""",
    "p1_ranked_sizes": f"WITH {_EXPECTED} SELECT * REPLACE (round(record_share, 9) AS record_share, round(cumulative_record_share, 9) AS cumulative_record_share) FROM e",
}
