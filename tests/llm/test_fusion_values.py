"""Fusion keeps every different value of a channel."""

from datetime import datetime

from partwise.llm.table_queries import p2_fused

FIELDS = "raw_group_id string, raw_id string, year string, version string, topology_signature string, canonical_sequence string, recorded_at timestamp, curation_status string, is_censored boolean, curated_id string"


def test_values_of_one_channel_stay_claims(spark, tmp_path):
    t = datetime(2024, 1, 1)
    row = lambda g, i, v: (g, f"P:{g}{i}", None, v, None, None, t, "included", False, "SSCP-1")
    rows = [row("split", i, v) for i, v in enumerate(["1.2", "1.2", "1.2", "1.1", "1.1"])] + [row("even", i, v) for i, v in enumerate(["2", "1"])] + [row("one", i, "3") for i in range(5)]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/curation_manifest.parquet")
    spark.createDataFrame([("SSCP-1", "")], "curated_id string, raw_ids_used string").write.parquet(f"{tmp_path}/curated_records_public.parquet")
    got = {r.raw_group_id: r for r in p2_fused(spark, str(tmp_path)).filter("field_name = 'version'").collect()}
    assert {g: (r.value, r.n_values) for g, r in got.items()} == {"split": ("1.2", 2), "even": ("1", 2), "one": ("3", 1)}
    assert got["even"].posterior < got["split"].posterior < got["one"].posterior and got["even"].posterior < 0.5 + 1e-6
