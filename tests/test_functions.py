"""Scalar rules, hashes and sequence expressions against hand-computed values."""

import hashlib
import math

from pyspark.sql import functions as F

from partwise.functions import cleaning as c
from partwise.functions import hashing as h
from partwise.functions import sequences as s
from partwise.functions.text import is_missing, plain_id, plain_words


def one(spark, expr, schema="a string, b string", row=("x", "y")):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_plain_forms(spark):
    rows = spark.createDataFrame([("  mol-AB12\t",), ("block-\u00a0",), (None,), ("Word",)], "a string").select(plain_id("a").alias("v")).collect()
    assert [r.v for r in rows] == ["MOL-ab12", "BLOCK-", None, "word"]
    assert one(spark, plain_words("a"), row=("  2004-Gertamdra 1 ", "")) == "2004_gertamdra_1"
    assert [one(spark, is_missing("a"), row=(v, "")) for v in (None, " ", "N/A", "-", "unknown", "None", "0", "nano")] == [True] * 6 + [False] * 2


def test_cleaning(spark):
    assert one(spark, c.clean("a"), row=(None, "")) == "" and one(spark, c.clean("a"), row=(" x ", "")) == "x"
    assert one(spark, c.number("a"), row=("1.5x", "")) is None and one(spark, c.number("a"), row=("-7.5", "")) == -7.5
    assert one(spark, c.censored_by_text("a", "b"), row=(" ", None)) is False and one(spark, c.censored_by_presence("a", "b"), row=(" ", None)) is True
    for note, kind in (
        (None, "not_censored"), (" ", "not_censored"), ("Not tested; below LOD", "solubility_or_not_tested"), ("%T>100", "no_reportable_value"), ("BLOD", "not_detected_or_below_lod"),
        ("log < -8", "explicit_upper_limit"), ("a<-8", "other_detection_limit_note"), ("set to -10", "database_assigned_or_reported_floor"),
    ):
        assert one(spark, c.note_class("a", "b"), row=(note, None)) == kind
    sig = lambda *x: one(spark, c.topology_signature("a", "b", "c", "d", "e"), "a string, b string, c string, d string, e int", x)
    assert sig("Circle", "6", "6.0", "X,1:R1-6:R2", 6) == "circle_head_to_tail|total=6|main=6|tokens=6"
    assert sig("circle", "6", "5", "X,1:R1-5:R2", 6) == "circle_other|total=6|main=5|tokens=6"
    assert sig(None, None, "x", None, None) == "unknown|total=-1|main=-1|tokens=-1"
    assert one(spark, c.normalized(F.lit(-5.0))) == 0.5 and one(spark, c.denormalized(F.lit(0.5))) == -5.0
    assert [one(spark, c.is_finite(F.lit(x).cast("double"))) for x in (1.0, float("inf"), float("nan"), None)] == [True, False, False, False]


def test_hashes(spark):
    ids = spark.createDataFrame([("b",), ("a",), ("a",)], "i string")
    assert ids.agg(h.id_set_hash("i")).first()[0] == "911169ddaaf146aff539f58c26c489af3b892dff0fe283c1c264c65ae5aa59a2"
    assert ids.filter("false").agg(h.id_set_hash("i")).first()[0] == hashlib.sha256(b"").hexdigest()
    assert one(spark, h.ordered_ids_hash(F.array(F.lit("b"), F.lit("a"), F.lit("a")))) == hashlib.sha256(b"b\na\na").hexdigest()
    assert one(spark, h.stable_id("GRP", "a", "b"), row=(None, "x")) == "GRP-" + hashlib.sha256(b"\x1fx").hexdigest()[:16]
    assert [r.s for r in spark.range(5).select(h.seed_of_index("id").alias("s")).collect()] == [0, 123, 492, 1107, 1968]
    a = spark.createDataFrame([(1, "x"), (2, None), (1, "x")], "n int, t string")
    b = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "n int, t string").repartition(3)
    assert h.frame_hash(a).first() == h.frame_hash(b).first() != h.frame_hash(a.limit(2)).first()
    assert h.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode() and h.canonical_json({"a": "é"}, True) == b'{"a":"\\u00e9"}'
    v = spark.createDataFrame([(1.5,), (-0.0,), (math.pi,), (None,)], "x double").withColumn("h", h.double_hex("x")).withColumn("y", h.hex_double("h")).collect()
    assert v[0].h == "3ff8000000000000" and [r.x for r in v] == [r.y for r in v]


def test_sequences(spark):
    df = spark.createDataFrame([(["A", "B", "C", "D"], ["C", "D", "A", "X"]), (["A", "B", "C", "D"], ["A", "X", "C", "Y"]), ([], [])], "a array<string>, b array<string>")
    ring, chain = F.lit("circle_head_to_tail|x"), F.lit("lariat|x")
    assert [r.v for r in df.select(s.one_token_edit("a", "b", ring, ring).alias("v")).collect()] == [True, False, False]
    assert [r.v for r in df.select(s.one_token_edit("a", "b", chain, chain).alias("v")).collect()] == [False, False, False]
    assert not any(r.v for r in df.select(s.one_token_edit("a", "b", ring, chain).alias("v")).collect())
    cyc = [r.v for r in df.select(s.canonical_cycle("b").alias("v")).collect()]
    assert cyc == [["A", "X", "C", "D"], ["A", "X", "C", "Y"], []]
    assert one(spark, s.parse_tokens("a"), row=("""['A', "B c",  'D']""", "")) == ["A", "B c", "D"] and one(spark, s.parse_tokens("a"), row=("A", "")) is None
    assert df.select(s.tanimoto("a", "b").alias("v")).collect()[0].v == 3 / 5 and df.select(s.tanimoto("a", "b").alias("v")).collect()[2].v is None
    assert one(spark, s.bit_tanimoto(F.array(F.lit(7), F.lit(1)), F.array(F.lit(3), F.lit(8)))) == 2 / 5
    assert len(df.select(s.masks("a", F.lit(False)).alias("v")).first().v) == 4
