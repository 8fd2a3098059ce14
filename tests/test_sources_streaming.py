"""Files, sinks, streams and the registry."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from partwise.plans.contracts import Violation
from partwise.plans.lineage import Scratch, shared_dir
from partwise.sources import files
from partwise.streaming import status


def test_files(spark, tmp_path):
    d = tmp_path / "r"
    d.mkdir()
    (d / "a.csv").write_text("id,label\n1,2\n")
    (d / "b.json").write_text('{"k": 1}')
    found = files.inventory(spark, str(d))
    by = {os.path.basename(r.path): r for r in found.collect()}
    assert by["a.csv"].kind == "table" and by["b.json"].sha256 == hashlib.sha256(b'{"k": 1}').hexdigest()
    manifest = found.select("path", "size", "sha256")
    assert files.manifest_problems(found, manifest).count() == 0
    assert [r.problem for r in files.manifest_problems(found, manifest.withColumn("sha256", F.lit("x"))).collect()] == ["hash", "hash"]
    assert {r.problem for r in files.manifest_problems(found.filter("kind = 'table'"), manifest).collect()} == {"absent"}
    assert files.header(spark, str(d / "a.csv")) == ["id", "label"] and files.one_match(spark, str(d / "*.csv")).endswith("a.csv")
    with pytest.raises(Violation):
        files.one_match(spark, str(d / "*"))
    assert files.scan_csv(spark, str(d / "a.csv"), "id int, label int", ["id"]).first().id == 1 and files.scan_json(spark, str(d / "b.json")).first().k == 1
    texts = spark.createDataFrame([(str(d / "a.csv"), 1, "id,label"), (str(d / "b.json"), 1, "C:\\Users\\x")], "path string, line_no int, line string")
    got = {(os.path.basename(r.path), r.problem) for r in files.release_problems(found, texts, ["README.md", "a.csv"], r"\.json$", 10, r"C:\\Users", ["label"]).collect()}
    assert got == {("README.md", "required_absent"), ("b.json", "forbidden_name"), ("a.csv", "too_large"), ("b.json", "leak"), ("a.csv", "risky_column")}
    assert {r.rel for r in files.checksum_lines(found, str(d)).collect()} == {"a.csv", "b.json"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.5, 'a"b'), (1, None, None)], "k int, v double, t string")
    p = str(tmp_path / "t.csv")
    digest = files.write_csv(df, p, ["k"], 3)
    body = open(p, "rb").read()
    assert body == b'k,v,t\n1,,\n2,0.500,"a""b"\n' and digest == hashlib.sha256(body).hexdigest()
    with pytest.raises(FileExistsError):
        files.write_csv(df, p, ["k"])
    assert files.publish({"x": b"1"}, str(tmp_path / "bundle")) == {"x": hashlib.sha256(b"1").hexdigest()}
    with pytest.raises(FileExistsError):
        files.publish({"x": b"1"}, str(tmp_path / "bundle"))
    files.write_once(df, str(tmp_path / "o"), partition_by=["k"])
    with pytest.raises(Exception, match="EXISTS"):
        files.write_once(df, str(tmp_path / "o"))


def test_scratch(spark):
    s = Scratch(spark, "test")
    assert s.base.startswith(shared_dir(spark))
    a = s.write(spark.range(5))
    b = s.write(spark.range(3))
    s.drop(a)
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(a.inputFiles()[0]).count()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("i", n, "HEARTBEAT", f"2024-01-0{n % 3 + 1} 00:00:00", 1.0) for n in (1, 2, 4, 5)] + [("j", 1, "CLAIMED", "2024-01-01 05:00:00", 2.0)]
    df = spark.createDataFrame(rows, "identity string, event_index long, event_type string, t string, value double").withColumn("at", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(src)

    def run(make, mode):
        name = f"q{abs(hash(make.__name__)) % 10**8}"
        q = make(spark.readStream.schema(df.schema).parquet(src)).writeStream.outputMode(mode).format("memory").queryName(name).start()
        try:
            q.processAllAvailable()
            return spark.table(name).collect()
        finally:
            q.stop()

    assert {(r.identity, r.event_index, r.n_events) for r in run(status.latest_states, "complete")} == {("i", 5, 4), ("j", 1, 1)}
    assert [(r.identity, r.event_index, r.expected) for r in run(status.chain_gaps, "append")] == [("i", 4, 3)]
    assert sum(r.n_events for r in run(status.windowed_counts, "complete")) == 5
    assert {(r.identity, r.event_index) for r in status.latest_states(df).collect()} == {("i", 5), ("j", 1)}


def test_registry():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "metrics_estimand_ladder" in q and all(map(str.strip, s.values()))
