"""Token sequences: parsing, rotations of cycles, masks, one-token edits and set similarity, all as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_tokens(text: Column | str) -> Column:
    """Tokens of a JSON or Python list literal of strings; null where the text is no list."""
    t = F.trim(_c(text))
    listed = t.rlike(r"^\[.*\]$") | t.rlike(r"^\(.*\)$")
    found = F.transform(F.regexp_extract_all(t, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0)), lambda x: F.trim(F.substr(x, F.lit(2), F.length(x) - 2)))
    return F.when(listed, found)


def tokens_text(tokens: Column | str) -> Column:
    """Compact JSON of the tokens; empty for null."""
    return F.coalesce(F.to_json(_c(tokens)), F.lit(""))


def rotations(a: Column | str) -> Column:
    """All rotations of an array; the empty array has itself."""
    a = _c(a)
    n = F.size(a)
    turned = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.slice(a, i + 1, n - i), F.slice(a, F.lit(1), i)))
    return F.when(n > 0, turned).otherwise(F.array(a))


def canonical_cycle(a: Column | str) -> Column:
    """The rotation that comes first in order."""
    return F.array_min(rotations(a))


def canonical_tokens(tokens: Column | str, topology: Column | str) -> Column:
    """Head-to-tail circles as their canonical rotation, everything else as it is."""
    return F.when(_c(topology).startswith("circle_head_to_tail"), canonical_cycle(tokens)).otherwise(_c(tokens))


def masks(a: Column | str, cyclic: Column) -> Column:
    """The sequence with each position in turn replaced by ``*``; as canonical cycles where ``cyclic``."""
    a = _c(a)
    one = lambda i: F.transform(a, lambda x, j: F.when(j == i, F.lit("*")).otherwise(x))
    each = F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.when(cyclic, canonical_cycle(one(i))).otherwise(one(i)))
    return F.when(F.size(a) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<array<string>>"))


def mask_buckets(a: Column | str, topology: Column | str, cyclic: Column) -> Column:
    """For each position a hash of the topology and all other tokens in their order: from the one after it onwards where ``cyclic``, else with its place.

    Sequences whose masks are equal share a hash, for a circle has only one rotation that begins at its mask.
    """
    a, topology = _c(a), _c(topology)
    n = F.size(a)
    before, after = lambda i: F.slice(a, F.lit(1), i), lambda i: F.slice(a, i + 2, n)
    key = lambda i: F.when(cyclic, F.xxhash64(topology, F.lit(-1), F.concat(after(i), before(i)))).otherwise(F.xxhash64(topology, i, F.concat(before(i), after(i))))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), key))).otherwise(F.array().cast("array<long>"))


def one_token_edit(a: Column | str, b: Column | str, topology_a: Column | str, topology_b: Column | str) -> Column:
    """Same topology and length and exactly one differing token, under any rotation of b for head-to-tail circles."""
    a, b, ta, tb = map(_c, (a, b, topology_a, topology_b))
    one = lambda r: F.size(F.filter(F.zip_with(a, r, lambda x, y: x != y), lambda d: d)) == 1
    turned = F.when(ta.startswith("circle_head_to_tail"), rotations(b)).otherwise(F.array(b))
    return F.coalesce((ta == tb) & (F.size(a) == F.size(b)) & F.exists(turned, one), F.lit(False))


def tanimoto(a: Column | str, b: Column | str) -> Column:
    """Shared over all different members of two sets; null when both are empty."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def bit_tanimoto(a: Column | str, b: Column | str) -> Column:
    """The same for bit sets held as arrays of 64-bit words."""
    a, b = _c(a), _c(b)
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda s, w: s + F.bit_count(w))
    either = total(lambda x, y: x.bitwiseOR(y))
    return F.when(either > 0, total(lambda x, y: x.bitwiseAND(y)) / either)
