"""Queries of problems 6 to 8. SQL can't express them, only what an audit of their results must give; the tests hold them against brute force and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partwise.llm.chunking import cut_texts
from partwise.llm.packing import pack
from partwise.llm.tokens import token_count
from partwise.llm.winnow import leaks
from partwise.plans.lineage import Scratch


def _limits(spark: SparkSession, sf: str, purpose: str) -> dict[str, tuple[int, int]]:
    """The few rows of a purpose by name."""
    rows = spark.read.parquet(f"{sf}/length_limits.parquet").filter(F.col("purpose") == purpose).orderBy("limit_name").collect()
    return {r.limit_name: (r.max_tokens, r.overlap_tokens) for r in rows}


def p6_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document for every `pack` limit."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sized = d.select(F.col("doc_id").alias("id"), token_count("text").alias("n_tokens"))
    return pack(sized, {k: v[0] for k, v in _limits(spark, sf, "pack").items()}).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of the room used, per limit."""
    limits = spark.createDataFrame([(k, v[0]) for k, v in _limits(spark, sf, "pack").items()], "limit_name string, max_tokens long")
    each = p6_pack(spark, sf).groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("n"))
    per = each.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return per.join(F.broadcast(limits), "limit_name").withColumn("fill_share", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("max_tokens")), 6))


def p6_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per limit: documents with a place, parts placed twice, documents divided though they fit, containers above the capacity, and whether there are at most a hundredth and one more containers than the tokens need."""
    limits = spark.createDataFrame([(k, v[0]) for k, v in _limits(spark, sf, "pack").items()], "limit_name string, max_tokens long")
    made = Scratch(spark, "audit").write(p6_pack(spark, sf)).join(F.broadcast(limits), "limit_name")
    docs = made.groupBy("limit_name", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part_no").alias("parts"), F.sum("n_tokens").alias("t"), F.first("max_tokens").alias("max_tokens"))
    docs = docs.groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("n") != F.col("parts")).alias("n_twice"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("max_tokens"))).alias("n_divided"))
    bins = made.groupBy("limit_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.first("max_tokens").alias("max_tokens"))
    bins = bins.groupBy("limit_name").agg(F.count_if(F.col("t") > F.col("max_tokens")).alias("n_overfilled"), (F.count_if(F.col("t") > 0) <= F.ceil(F.sum("t") / F.first("max_tokens")) * 1.01 + 1).alias("is_tight"))
    return docs.join(bins, "limit_name")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the held-out items that leaked into them."""
    return leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet"))


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every document for every `cut` limit."""
    return cut_texts(spark.read.parquet(f"{sf}/documents.parquet"), _limits(spark, sf, "cut"))


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per limit: texts with pieces, texts whose pieces begin at the start, touch or overlap in order and end at the end, pieces that aren't the text at their place, and pieces above the limit."""
    made = Scratch(spark, "audit").write(p8_pieces(spark, sf))
    limits = spark.createDataFrame([(k, v[0]) for k, v in _limits(spark, sf, "cut").items()], "limit_name string, max_tokens long")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("text <> ''")
    at = Window.partitionBy("limit_name", "doc_id").orderBy("piece_no")  # the pieces of one text
    chain = made.select("limit_name", "doc_id", "piece_no", "start_char", "end_char").withColumns({"prior": F.lag("end_char").over(at), "before": F.lag("start_char").over(at)})
    joined = F.when(F.col("piece_no") == 0, F.col("start_char") == 0).otherwise((F.col("start_char") <= F.col("prior")) & (F.col("start_char") > F.col("before")) & (F.col("end_char") > F.col("prior")))
    whole = chain.groupBy("limit_name", "doc_id").agg(F.min(F.coalesce(joined, F.lit(False))).alias("joined"), F.max("end_char").alias("end"))
    ends = whole.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").groupBy("limit_name").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("joined") & (F.col("end") == F.col("n"))).alias("n_rejoined"))
    same = made.join(docs, "doc_id").join(F.broadcast(limits), "limit_name").groupBy("limit_name").agg(
        F.count_if(F.expr("substring(text, cast(start_char + 1 as int), cast(end_char - start_char as int)) <> piece")).alias("n_other_text"), F.count_if(F.col("n_tokens") > F.col("max_tokens")).alias("n_over_limit")
    )
    return ends.join(same, "limit_name")


QUERIES = {f.__name__: f for f in (p6_pack, p6_fill, p6_audit, p7_found, p8_pieces, p8_audit)}
SQL: dict[str, str] = {
    "p6_audit": "SELECT limit_name, (SELECT count(*) FROM documents) AS n_documents, 0 AS n_twice, 0 AS n_divided, 0 AS n_overfilled, true AS is_tight FROM length_limits WHERE purpose = 'pack'",
    "p8_audit": """SELECT limit_name, n AS n_texts, n AS n_rejoined, 0 AS n_other_text, 0 AS n_over_limit
FROM length_limits, (SELECT count(*) AS n FROM documents WHERE text <> '') WHERE purpose = 'cut'""",
}
