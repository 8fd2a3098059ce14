"""From raw measurement rows to one record per source and structure, and audits of that step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.cleaning import clean
from partwise.functions.hashing import stable_id
from partwise.plans.quantiles import exact_quantiles

#: Fields in which the usable rows of a group must agree.
AGREE = ("year", "version", "topology", "sequence")


def _judged(raw: DataFrame) -> DataFrame:
    """Raw rows joined with their group's verdict. ``raw``: raw_id, sort_id, source, structure, year, version, topology, sequence, censored, endpoint."""
    r = raw.select("raw_id", "sort_id", "source", *[F.coalesce(c, F.lit("")).alias(c) for c in ("structure", "sequence")], "year", "version", "topology", F.coalesce("censored", F.lit(False)).alias("censored"), F.col("endpoint").cast("double").alias("endpoint"))
    r = r.withColumn("parsed", (F.col("structure") != "") & (F.col("sequence") != "")).withColumn("usable", F.col("parsed") & ~F.col("censored") & F.col("endpoint").isNotNull())
    use = lambda c: F.when(F.col("usable"), c)
    first = F.min(use(F.struct("sort_id", "raw_id", *[clean(c).alias(c) for c in AGREE])))
    groups = r.filter("parsed").groupBy("source", "structure").agg(
        F.count(F.lit(1)).alias("n_raw_rows"), F.count_if("usable").alias("n_uncensored_used"), first.alias("first"),
        *[F.count_distinct(use(clean(c))).alias(f"_n_{c}") for c in AGREE],
        F.array_join(F.array_sort(F.collect_list("raw_id")), "|").alias("raw_ids_all"), F.array_join(F.array_sort(F.collect_list(use(F.col("raw_id")))), "|").alias("raw_ids_used"),
        F.min(use(F.col("endpoint"))).alias("replicate_min"), F.max(use(F.col("endpoint"))).alias("replicate_max"), F.median(use(F.col("endpoint"))).alias("endpoint_median"),
    )
    conflicts = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") != 1, F.lit(c)) for c in AGREE])), "|")
    verdict = F.when(F.col("n_uncensored_used") == 0, "irrecoverably_censored_or_missing_label").when(conflicts != "", F.concat(F.lit("incompatible_same_source_group:"), conflicts))
    groups = groups.withColumn("verdict", verdict).withColumn("curated_id", F.when(F.col("verdict").isNull(), stable_id("SSCP", "source", "structure")))
    g = groups.withColumnsRenamed({"source": "_gs", "structure": "_gx", "replicate_min": "_lo", "replicate_max": "_hi"})
    return r.join(g, r["source"].eqNullSafe(g["_gs"]) & (r["structure"] == g["_gx"]) & r["parsed"], "left")


def curated_records(raw: DataFrame) -> DataFrame:
    """One record per source and structure with usable, agreeing rows: its first row's fields, id lists, and the median, spread and range of the endpoint.

    A null source is a source of its own. The median is exact.
    """
    j = _judged(raw).filter("curated_id IS NOT NULL AND parsed")
    return j.groupBy("curated_id").agg(
        stable_id("MOL", F.first("structure")).alias("molecule_id"), F.first("structure").alias("structure"), clean(F.first("source")).alias("source"), *[F.first(f"first.{c}").alias(c) for c in AGREE],
        F.first("raw_ids_all").alias("raw_ids_all"), F.first("raw_ids_used").alias("raw_ids_used"), F.first("n_raw_rows").alias("n_raw_rows"), F.first("n_uncensored_used").alias("n_uncensored_used"),
        F.first("_lo").alias("replicate_min"), F.first("_hi").alias("replicate_max"), (F.first("_hi") - F.first("_lo")).alias("replicate_spread"), F.first("endpoint_median").alias("endpoint"),
    )


def curation_manifest(raw: DataFrame) -> DataFrame:
    """Every raw row with its status, the reason, and the record that it went into."""
    j = _judged(raw)
    reason = (
        F.when(F.col("structure") == "", "invalid_structure").when(F.col("sequence") == "", "invalid_sequence").when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(F.col("censored"), "irrecoverably_censored_row").otherwise("compatible_uncensored_replicate")
    )
    status = F.when(~F.col("parsed") | F.col("verdict").isNotNull(), "excluded").when(F.col("censored"), "excluded_linked_to_curated_group").otherwise("included")
    group = F.when(F.col("structure") != "", stable_id("GRP", "source", "structure")).otherwise(stable_id("RAW", "raw_id"))
    return j.select("raw_id", group.alias("raw_group_id"), clean("source").alias("source"), "censored", status.alias("curation_status"), reason.alias("reason"), F.coalesce("curated_id", F.lit("")).alias("curated_id"))


def curation_flow(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Counters of the whole step, as (counter, n)."""
    m = manifest.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("reason").isin("invalid_structure", "invalid_sequence")).alias("invalid_rows"), F.count_if("censored").alias("censored_rows"),
        F.count_if(F.col("curation_status").startswith("excluded")).alias("excluded_raw_rows"), F.count_distinct(F.when(F.col("reason").startswith("incompatible"), F.col("raw_group_id"))).alias("incompatible_groups"),
    )
    r = records.agg(F.count(F.lit(1)).alias("curated_records"), F.count_distinct("molecule_id").alias("curated_molecules"), F.count_distinct("source").alias("curated_sources"), F.count_if(F.col("n_uncensored_used") > 1).alias("collapsed_groups"))
    return m.unpivot([], list(m.columns), "counter", "n").unionByName(r.unpivot([], list(r.columns), "counter", "n"))


def source_audit(raw: DataFrame, records: DataFrame) -> DataFrame:
    """Per raw source its rows, censored rows and numeric endpoints, with quartiles and range of its curated endpoints where it has any."""
    a = raw.groupBy("source").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if("censored").alias("censored_rows"), F.count("endpoint").alias("numeric_rows"))
    a = a.withColumn("uncensored_rows", F.col("raw_rows") - F.col("censored_rows")).withColumn("censored_fraction", F.col("censored_rows") / F.col("raw_rows"))
    c = records.groupBy("source").agg(F.count(F.lit(1)).alias("curated_records"), F.min("endpoint").alias("endpoint_min"), F.max("endpoint").alias("endpoint_max"))
    q = exact_quantiles(records, ["source"], "endpoint", (0.25, 0.5, 0.75)).select("source", *[F.col("q")[i].alias(f"endpoint_{n}") for i, n in enumerate(("q1", "median", "q3"))])
    c = c.join(q, "source", "left")
    return a.join(c, "source", "left").withColumn("curated_records", F.coalesce("curated_records", F.lit(0)))


def class_shares(df: DataFrame, kind: str, source: str) -> DataFrame:
    """Rows, different sources and share of all rows per class; null is a class."""
    per = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(source).alias("n_sources"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return per.select(kind, "n_rows", "n_sources", (F.col("n_rows") / total).alias("share"))


def rollup(records: DataFrame, group: str) -> DataFrame:
    """Per group the rows, different molecules, components and sources, and the sorted sources as text."""
    return records.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("molecule_id").alias("n_molecules"), F.count_distinct("analogue_component_id").alias("n_components"), F.count_distinct("source").alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_set("ring_size")), lambda x: x.cast("string")), "|").alias("ring_sizes"),
    )


def reconcile(listed: DataFrame, raw: DataFrame) -> DataFrame:
    """Foreign (split, id, structure) rows against raw (raw_id, source, structure): whether the id means the same structure, and the raw ids and sources of that structure."""
    by_id = raw.groupBy("raw_id").agg(F.collect_set("structure").alias("_structures"))
    by_x = raw.filter("structure <> ''").groupBy("structure").agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_set("raw_id")), "|").alias("raw_ids"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("raw_sources"))
    j = listed.join(by_id.withColumnRenamed("raw_id", "id"), "id", "left").join(by_x, "structure", "left")
    direct = F.coalesce(F.array_contains("_structures", F.col("structure")) & (F.col("structure") != ""), F.lit(False))
    reason = (
        F.when(F.col("_structures").isNull(), "id_absent_from_raw_namespace").when(~direct, "id_maps_to_another_structure")
        .when(F.col("_n") > 1, "row_stands_for_several_raw_records").otherwise("direct_single_record_match")
    )
    empty = F.lit("")
    return j.select("split", "id", "structure", direct.alias("direct_match"), F.coalesce("raw_ids", empty).alias("raw_ids"), F.coalesce("raw_sources", empty).alias("raw_sources"), reason.alias("reason"))
