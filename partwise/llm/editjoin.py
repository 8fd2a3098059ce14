"""Problem 5: equal or nearly equal strings between two sides, by an edit-distance segment join.

Each string of one side is cut into k + 1 segments of one width, the first half
of them counted from its start, the others from its end. At most k edits leave
one segment untouched that has at most i edits before it, if it is the i-th from
the start (from 0), or at most i behind it, if it is the i-th from the end: else
the first h segments would take h edits or more, the last k + 1 - h as many
again. So a partner contains it at a position shifted by at most i from its own
start or end. The width is the length divided by k + 1, which neighbouring lengths
share, so a string of the other side has few substrings to offer.

These are matched with the segments by hash. While the segments are few enough, a
bit filter of bounded size goes to the tasks first, and only the substrings that
pass it are shuffled; beyond that all are. Candidates whose characters differ too much
drop out, the others are verified by Spark's banded Levenshtein. Only hashes, ids and
counts of characters are shuffled for the match, never the texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwise.llm.ids import Numbers
from partwise.plans.lineage import Scratch

_BASE, _SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bits of the filter for each segment, and at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28


def segment_windows(length: int, k: int) -> list[tuple[int, int, int, int]]:
    """(width, segment, start, width) of the segments of a string; one of at most k characters has a single entry for its length instead."""
    if length <= k:
        return [(length, -1, 0, 0)]
    q, h = length // (k + 1), (k + 2) // 2
    return [(q, i, i * q, q) for i in range(h)] + [(q, h + j, length - (j + 1) * q, q) for j in range(k + 1 - h)]


def substring_windows(length: int, k: int) -> list[tuple[int, int, int, int]]:
    """(width, segment, start, width) of all substrings that may be a segment of a string within k edits; (length, -1, 0, 0) for each short one."""
    low, high, h = max(0, length - k), length + k, (k + 2) // 2
    out = [(n, -1, 0, 0) for n in range(low, min(high, k) + 1)]
    for q in range(max(low, k + 1) // (k + 1), high // (k + 1) + 1):
        partners = range(max(low, q * (k + 1)), min(high, q * (k + 1) + k) + 1)
        for seg in range(k + 1):
            most, at = (seg, seg * q) if seg < h else (seg - h, length - (seg - h + 1) * q)
            for shift in range(-most, most + 1):
                moved = shift if seg < h else -shift  # insertions less deletions on the segment's own side
                if 0 <= at + shift <= length - q and any(abs(moved) + abs(length - n - moved) <= k for n in partners):
                    out.append((q, seg, at + shift, q))
    return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), len(texts[0])).astype(np.uint64)


def _bags(codes: np.ndarray) -> np.ndarray:
    """How often each of eight classes of characters occurs (255 at most), a byte each. An edit moves one count, or two by one."""
    of, out = (codes ^ (codes >> np.uint64(3))) & np.uint64(7), np.zeros(len(codes), np.uint64)
    for c in range(8):
        out |= np.minimum((of == c).sum(1), 255).astype(np.uint64) << np.uint64(8 * c)
    return out.view(np.int64)


def _bags_apart(a: str, b: str) -> Column:
    """The sum of differences of two bags: at most twice the edits between the strings."""
    count = lambda x, c: F.shiftrightunsigned(x, 8 * c).bitwiseAND(F.lit(255))
    return sum((F.abs(count(a, c) - count(b, c)) for c in range(1, 8)), F.abs(count(a, 0) - count(b, 0)))


def _window_keys(codes: np.ndarray, windows: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Keys of the windows (columns) of strings of one length (rows), by prefix hashes: each costs the same, whatever its width."""
    m = codes.shape[1]
    prefix = np.zeros((m + 1, len(codes)), np.uint64)
    for j in range(m):
        prefix[j + 1] = prefix[j] * np.uint64(_BASE) + codes[:, j] + np.uint64(1)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, _BASE, np.uint64)]))
    at = np.array(windows, np.int64)
    start, width = at[:, 2], at[:, 3]
    h = prefix[start + width] - prefix[start] * power[width][:, None]
    h ^= ((at[:, 0] << 8) + at[:, 1] + 1).astype(np.uint64)[:, None] * np.uint64(_SALT)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_BASE)
    return (h ^ (h >> np.uint64(32))).view(np.int64).T


def _passed(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys have both their bits in the filter."""
    last, k = np.uint64(64 * len(bits) - 1), keys.view(np.uint64)
    low, high = k & last, (k >> np.uint64(32)) & last
    return ((bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & (bits[high >> np.uint64(6)] >> (high & np.uint64(63))) & np.uint64(1)).astype(bool)


def _keyed(df: DataFrame, name: str, k: int, windows: Callable[[int, int], list[tuple[int, int, int, int]]], bits: Broadcast | None = None) -> DataFrame:
    """(name_id, key, name_bag) for every window of every (id, s) that passes the filter."""

    def run(batches):
        for batch in batches:
            by_length: dict[int, tuple[list[int], list[str]]] = {}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, texts = by_length.setdefault(len(text), ([], []))
                ids.append(i)
                texts.append(text)
            for length, (ids, texts) in by_length.items():
                at = windows(length, k)
                for lo in range(0, len(ids), 1024):
                    codes = _codes(texts[lo : lo + 1024])
                    keys = np.ascontiguousarray(_window_keys(codes, at)).ravel()
                    owner, bag = np.repeat(np.array(ids[lo : lo + 1024], np.int64), len(at)), np.repeat(_bags(codes), len(at))
                    if bits is not None:
                        there = _passed(keys, bits.value)
                        keys, owner, bag = keys[there], owner[there], bag[there]
                    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(keys), pa.array(bag)], [f"{name}_id", "key", f"{name}_bag"])

    return df.select("id", "s").mapInArrow(run, f"{name}_id bigint, key bigint, {name}_bag bigint")


def _filter(keys: DataFrame, n: int) -> Broadcast:
    """The bits of the keys as 64-bit words; what is gathered and sent is at most MOST_BITS."""
    size = max(1 << 12, 1 << (BITS_EACH * n - 1).bit_length())
    at = F.explode(F.array(F.col("key").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1)))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63L as int))")).alias("bits")).toPandas()
    bits = np.zeros(size >> 6, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def edit_join(cut: DataFrame, other: DataFrame, k: int = 5, scratch: Scratch | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """(cut_id, other_id, distance) for all pairs of strings within k edits of one character.

    Both sides have a unique long ``id`` and a string ``s``; rows with a null in
    either are ignored, and so are further columns. Give each different string once:
    copies are the caller's to expand. The empty string is a string like any other.
    """
    scratch = scratch or Scratch(cut.sparkSession, "edit")
    a, b = cut.select("id", "s").dropna(), other.select("id", "s").dropna()
    keys = scratch.write(_keyed(a, "cut", k, segment_windows))
    n = keys.count()
    bits = _filter(keys, n) if n * BITS_EACH <= most_bits else None
    # The segments are a small part of what they meet, so each partition's are hashed instead of sorting both sides.
    candidates = keys.hint("shuffle_hash").join(_keyed(b, "other", k, substring_windows, bits), "key").filter(_bags_apart("cut_bag", "other_bag") <= 2 * k).select("cut_id", "other_id").distinct()
    near = candidates.join(a.toDF("cut_id", "_a"), "cut_id").join(b.toDF("other_id", "_b"), "other_id")
    return near.select("cut_id", "other_id", F.levenshtein("_a", "_b", k).alias("distance")).filter("distance >= 0")


def cross_split_pairs(records: DataFrame, k: int = 5, train: str = "train", most_bits: int = MOST_BITS) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: one record in ``train``, the other in another split, with the same molecule or structures within k edits.

    ``records`` has strings record, molecule, structure and split. Rows without a
    record or a split are ignored; null molecules and structures match nothing.
    Repeated rows count once. A record never pairs with itself. Joins run over
    different structures; copies of one are expanded only where a pair was found.
    """
    scratch = Scratch(records.sparkSession, "overlap")
    r = records.select("record", "molecule", "structure", (F.col("split") == train).alias("t")).dropna(subset=["record", "t"])
    texts = scratch.write(r.filter("structure IS NOT NULL").groupBy("structure").agg(F.bool_or("t").alias("t"), F.bool_or(~F.col("t")).alias("h")))
    numbers = Numbers(texts, ["structure"], scratch)
    numbered = scratch.write(numbers.add(texts, "id").select("id", F.col("structure").alias("s"), "t", "h"))
    near = scratch.write(edit_join(numbered.filter("h"), numbered.filter("t"), k, scratch, most_bits).select("cut_id", "other_id"))
    own = numbers.add(r.filter("structure IS NOT NULL"), "id")
    held = own.filter("NOT t").select(F.col("id").alias("cut_id"), F.col("record").alias("x")).distinct()
    trained = own.filter("t").select(F.col("id").alias("other_id"), F.col("record").alias("y")).distinct()
    by_text = near.join(held, "cut_id").join(trained, "other_id").select("x", "y")
    mol = r.filter("molecule IS NOT NULL").select("record", "molecule", "t").distinct()
    by_molecule = mol.filter("NOT t").select("molecule", F.col("record").alias("x")).join(mol.filter("t").select("molecule", F.col("record").alias("y")), "molecule").select("x", "y")
    return by_text.unionByName(by_molecule).filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
