"""Content ids and hashes. Null fields count as empty text, so a null never shortens what is hashed."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separator of the fields of a content id. Fixed value.
FIELD = "\x1f"


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def stable_id(prefix: str, *cols: Column | str, length: int = 16) -> Column:
    """``PREFIX-`` and the first hex digits of the SHA-256 of the joined fields."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws(FIELD, *map(_text, cols)), 256), 1, length))


def id_set_hash(c: Column | str) -> Column:
    """Aggregate: SHA-256 of the different ids in order, each followed by a line end; the hash of nothing for no ids."""
    ids = F.array_sort(F.collect_set(c))
    return F.sha2(F.when(F.size(ids) > 0, F.concat(F.array_join(ids, "\n"), F.lit("\n"))).otherwise(F.lit("")), 256)


def _changes(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """For each row but the first whether it differs from the row before in any of the columns; nulls are equal."""
    out = np.zeros(max(0, b.num_rows - 1), bool)
    for name in names:
        c = b.column(name)
        x, y = c.slice(1), c.slice(0, len(out))
        same = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False) | (x.is_null().to_numpy(zero_copy_only=False) & y.is_null().to_numpy(zero_copy_only=False))
        out |= ~same
    return out


def _pieces(b: pa.RecordBatch, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The stretches of a sorted batch that have equal keys."""
    at = [0, *(np.flatnonzero(_changes(b, keys)) + 1).tolist(), b.num_rows]
    for i, j in zip(at, at[1:]):
        if j > i:
            yield b.slice(i, j - i)


def id_set_hashes(df: DataFrame, keys: Sequence[str], ids: str, n: str = "n", h: str = "h") -> DataFrame:
    """(keys, n, h): for each group the number of different non-null ids and their ``id_set_hash``. The ids must be text.

    A group's set is never held in one place: rows are range-partitioned by keys and id
    and sorted there, equal ones lie side by side, and each batch leaves its ids as a
    piece of the text that is hashed. One task per group then reads the pieces in order.
    """
    ks, fields = [f"_k{i}" for i in range(len(keys))], [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    rows = df.select(*[F.col(k).alias(x) for k, x in zip(keys, ks)], F.col(ids).alias("_id"))
    rows = rows.repartitionByRange(*ks, "_id").sortWithinPartitions(*ks, "_id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for p in _pieces(b, ks):
                c = p.column("_id").drop_null()
                key = [p.column(k)[0].as_py() for k in ks]
                if len(c):
                    new = np.append(last != (key, c[0].as_py()), pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False))
                    last = (key, c[-1].as_py())
                    c = c.filter(pa.array(new.astype(bool)))
                text = ("\n".join(c.to_pylist()) + "\n").encode() if len(c) else b""
                yield pa.RecordBatch.from_arrays([*[p.column(k).slice(0, 1) for k in ks], pa.array([len(c)], pa.int64()), pa.array([text], pa.binary())], [*ks, "_n", "_text"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = key = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key, pa.array([count], pa.int64()), pa.array([whole.hexdigest()])], [*ks, n, h])

        for b in batches:
            for p in _pieces(b, ks):
                now = [p.column(k)[0].as_py() for k in ks]
                if now != last:
                    if key:
                        yield done()
                    last, key, count, whole = now, [p.column(k).slice(0, 1) for k in ks], 0, hashlib.sha256()
                count += pc.sum(p.column("_n")).as_py()
                for t in p.column("_text"):
                    whole.update(t.as_buffer())
        if key:
            yield done()

    kept = T.StructType([*fields, T.StructField("_n", T.LongType()), T.StructField("_text", T.BinaryType())])
    pieces = rows.mapInArrow(texts, kept).withColumn("_at", F.monotonically_increasing_id())  # range partitions are in order
    whole = pieces.repartition(*ks).sortWithinPartitions(*ks, "_at").select(*ks, "_n", "_text")
    out = whole.mapInArrow(hashes, T.StructType([*fields, T.StructField(n, T.LongType()), T.StructField(h, T.StringType())]))
    return out.select(*[F.col(x).alias(k) for k, x in zip(keys, ks)], n, h)


def ordered_ids_hash(ids: Column | str) -> Column:
    """SHA-256 of an array of ids in its own order, joined by line ends, repeats kept."""
    return F.sha2(F.array_join(ids, "\n"), 256)


def canonical_json(value: object, ascii_only: bool = False) -> bytes:
    """Compact JSON with sorted keys, of a driver-side value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False).encode()


def canonical_json_hash(value: object, ascii_only: bool = False) -> str:
    return hashlib.sha256(canonical_json(value, ascii_only)).hexdigest()


def rng_seed(material: object) -> int:
    """The first 64 bits of the hash of a description, as the seed of a generator."""
    return int(canonical_json_hash(material, ascii_only=True)[:16], 16)


def row_hash(cols: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def frame_hash(df: DataFrame) -> DataFrame:
    """One row (n_rows, content_hash), the same for the same rows in any order: hashes of rows are folded by parts of the hash, then joined.

    Each row hash is split in 8 numbers of 32 bits; their sums (exact in decimal) and
    the row count are hashed. No row is collected.
    """
    h = df.select(row_hash(df.columns).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(8)]
    sums = h.agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    return sums.select("n_rows", F.sha2(F.concat_ws(FIELD, F.lit(json.dumps(df.columns)), "n_rows", *[_text(f"p{i}") for i in range(8)]), 256).alias("content_hash"))


@F.pandas_udf(T.StringType())
def double_hex(v: pd.Series) -> pd.Series:
    """The 16 hex digits of a double's big-endian bytes; null for null."""
    return v.map(lambda x: None if pd.isna(x) else struct.pack(">d", x).hex())


@F.pandas_udf(T.DoubleType())
def hex_double(v: pd.Series) -> pd.Series:
    """The inverse of ``double_hex``."""
    return v.map(lambda x: None if x is None else struct.unpack(">d", bytes.fromhex(x))[0])


@F.pandas_udf(T.StringType())
def array_hash(v: pd.Series) -> pd.Series:
    """SHA-256 of an array of doubles in 17 significant digits, joined by commas."""
    return v.map(lambda a: None if a is None else hashlib.sha256(",".join("%.17g" % x for x in a).encode()).hexdigest())


def seed_of_index(i: Column | str) -> Column:
    """The seed schedule 123 i squared."""
    i = F.col(i) if isinstance(i, str) else i
    return (F.lit(123) * i * i).cast("long")
