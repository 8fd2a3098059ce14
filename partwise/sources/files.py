"""Typed scans, write-once sinks, and file manifests over any storage that Spark reads."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partwise.plans.contracts import Violation, require_columns
from partwise.plans.lineage import Scratch

# Scans


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV file with a header; with a schema nothing is inferred, with columns only those are parsed."""
    r = spark.read.option("header", True).option("mode", "FAILFAST")
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    return require_columns(df, columns) if columns else df


def scan_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_config(path: str) -> dict:
    """A small JSON or YAML configuration, read by the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def one_match(spark: SparkSession, pattern: str) -> str:
    """The only file that a glob matches."""
    found = [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").limit(2).collect()]
    if len(found) != 1:
        raise Violation(f"{pattern} must match exactly one file")
    return found[0]


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file from its first line."""
    return spark.read.option("header", True).csv(path).limit(0).columns


# Sinks


def write_once(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Fails if the target exists."""
    w = df.write.mode("errorifexists").format(kind)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str], decimals: int | None = 12) -> str:
    """One CSV file in a fixed order and number format with bare line ends, written once; returns the SHA-256 of its bytes.

    Tasks write the sorted lines as text parts to the shared folder; the driver then
    joins the bytes of the parts in order, a buffer at a time, and hashes them as they
    pass. Nulls are empty; fields with a comma, quote or line end are quoted.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    shown = [F.format_string(f"%.{decimals}f", c) if decimals is not None and isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c).cast("string") for c in df.columns]
    quoted = [F.when(F.col(c).isNull(), "").when(x.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x) for c, x in zip(df.columns, shown)]
    scratch = Scratch(spark, "csv")
    df.orderBy(*order).select(F.concat_ws(",", *quoted).alias("line")).write.text(f"{scratch.base}/lines")
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in df.columns) + "\n"
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    out = jvm.java.security.DigestOutputStream(fs.create(target, False), digest)
    try:
        out.write(bytearray(head.encode()))
        folder = jvm.org.apache.hadoop.fs.Path(f"{scratch.base}/lines")
        source = folder.getFileSystem(conf)
        for name in sorted(f.getPath().toString() for f in source.listStatus(folder) if f.getPath().getName().startswith("part-")):
            part = source.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
    finally:
        out.close()
        scratch.drop_all()
    return bytes(digest.digest()).hex()


def publish(files: Mapping[str, bytes], target: str) -> dict[str, str]:
    """Write a bundle beside its target, check names and hashes, sync and rename; readers see all of it or nothing."""
    if os.path.exists(target):
        raise FileExistsError(target)
    stage = f"{target}.{uuid.uuid4().hex}"
    os.makedirs(stage)
    try:
        for name, body in files.items():
            with open(os.path.join(stage, name), "xb") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
        found = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(stage).iterdir()}
        if found != {n: hashlib.sha256(b).hexdigest() for n, b in files.items()}:
            raise Violation("what was written differs from the bundle")
        os.rename(stage, target)
        return found
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def publish_generation(files: Mapping[str, bytes], root: str) -> int:
    """Publish a bundle as the next generation below ``root`` and point readers to it; returns its number.

    A pointer file is replaced in one step once the bundle is complete, so a reader sees
    all files of one generation, never a mix. Older generations stay.
    """
    os.makedirs(root, exist_ok=True)
    number = 1 + max((int(n[4:]) for n in os.listdir(root) if re.fullmatch(r"gen-\d+", n)), default=0)
    found = publish(files, os.path.join(root, f"gen-{number}"))
    stage = os.path.join(root, f"pointer.{uuid.uuid4().hex}")
    with open(stage, "x", encoding="utf-8") as f:
        json.dump({"generation": number, "files": found}, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(stage, os.path.join(root, "CURRENT"))
    return number


def read_generation(root: str) -> tuple[int, dict[str, bytes]]:
    """Number and files of the current generation; an error if a file isn't what the pointer says."""
    told = json.loads(Path(root, "CURRENT").read_text(encoding="utf-8"))
    files = {n: Path(root, f"gen-{told['generation']}", n).read_bytes() for n in told["files"]}
    if {n: hashlib.sha256(b).hexdigest() for n, b in files.items()} != told["files"]:
        raise Violation("the current generation differs from its pointer")
    return told["generation"], files


# Manifests

#: Kinds of files by their name, the first that fits. Fixed values.
KINDS = (("checkpoint", r"\.pt$"), ("metadata", r"(tasks|metadata)\.json$"), ("provenance", r"\.json$"), ("table", r"\.(csv|parquet)$"), ("cache", r"\.(npy|gzip)$"))


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified, sha256, kind) of every file below a folder. Hashing runs where the files are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    kind = F.lit("other")
    for name, rule in reversed(KINDS):
        kind = F.when(F.col("path").rlike(rule), name).otherwise(kind)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two inventories."""
    j = before.select("path", F.col("sha256").alias("_a")).join(after.select("path", F.col("sha256").alias("_b")), "path", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return j.withColumn("change", change).filter("change IS NOT NULL").select("path", "change")


def manifest_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): files that a manifest (path, size, sha256) names but that are absent or differ, and files that it doesn't name."""
    j = manifest.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"), F.lit(True).alias("_m")).join(files.select("path", "size", "sha256", F.lit(True).alias("_f")), "path", "full")
    problem = F.when(F.col("_f").isNull(), "absent").when(F.col("_m").isNull(), "unlisted").when(F.col("_s") != F.col("size"), "size").when(F.col("_h") != F.col("sha256"), "hash")
    return j.withColumn("problem", problem).filter("problem IS NOT NULL").select("path", "problem")


def checksum_lines(files: DataFrame, root: str, excluded: str = r"(^|/)(SHA256SUMS|\.git/|__pycache__/)") -> DataFrame:
    """(line) in the usual ``hash  relative path`` form, for sinks sorted by path; excluded files are left out."""
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    rel = F.substr("path", at + F.lit(len(root.rstrip("/")) + 1))
    return files.withColumn("rel", rel).filter(~F.col("rel").rlike(excluded)).select("rel", F.concat_ws("  ", "sha256", "rel").alias("line"))


def release_problems(files: DataFrame, texts: DataFrame, required: Sequence[str], forbidden: str, most_bytes: int, leak: str, risky_columns: Sequence[str] = ()) -> DataFrame:
    """(path, problem) of a release: required files absent, forbidden names, files too large, lines that leak, and CSV headers with risky columns.

    ``files`` is an inventory, ``texts`` has (path, line_no from 1, line).
    """
    spark = files.sparkSession
    need = spark.createDataFrame([(r,) for r in required], "suffix string")
    hit = files.select("path").withColumn("suffix", F.explode(F.array(*[F.when(F.col("path").endswith(r), F.lit(r)) for r in required]))).dropna() if required else files.select("path", F.lit("").alias("suffix")).limit(0)
    out = need.join(hit, "suffix", "left_anti").select(F.col("suffix").alias("path"), F.lit("required_absent").alias("problem"))
    out = out.unionByName(files.filter(F.col("path").rlike(forbidden)).select("path", F.lit("forbidden_name").alias("problem")))
    out = out.unionByName(files.filter(F.col("size") > most_bytes).select("path", F.lit("too_large").alias("problem")))
    out = out.unionByName(texts.filter(F.col("line").rlike(leak)).select("path", F.lit("leak").alias("problem")))
    if risky_columns:
        head = texts.filter((F.col("line_no") == 1) & F.col("path").rlike(r"\.csv$"))
        risky = F.arrays_overlap(F.split(F.lower("line"), ","), F.array(*[F.lit(c.lower()) for c in risky_columns]))
        out = out.unionByName(head.filter(risky).select("path", F.lit("risky_column").alias("problem")))
    return out.distinct()
