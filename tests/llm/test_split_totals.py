"""Split totals on more records than fit small tables."""

import itertools
import random

import pytest

from partwise.llm.splits import choose_sizes


def total(d):
    return sum(s * c for s, c in d.items())


def test_equal_sizes_above_four_million_records():
    got = choose_sizes({3: 2_000_000}, {"a": 0.1, "b": 0.9})
    assert got == {"a": {3: 200_000}, "b": {3: 1_800_000}}


def test_mixed_sizes_above_four_million_records():
    sizes = {7_001: 300, 5_003: 400, 3_001: 500, 1_999: 700}
    got = choose_sizes(sizes, {"a": 0.1, "b": 0.2, "c": 0.7})
    n = total(sizes)
    assert abs(total(got["a"]) - 0.1 * n) <= 1 and abs(total(got["b"]) - 0.2 * n) <= 1
    assert all(sum(got[x].get(s, 0) for x in "abc") == c for s, c in sizes.items())


def test_few_large_sizes_against_every_subset():
    r = random.Random(3)
    for _ in range(3):
        items = [r.randrange(100_000, 900_000) for _ in range(12)]
        sizes = {}
        for s in items:
            sizes[s] = sizes.get(s, 0) + 1
        goal = 0.3 * sum(items)
        best = min(abs(sum(x) - goal) for n in range(13) for x in itertools.combinations(items, n))
        assert abs(total(choose_sizes(sizes, {"a": 0.3, "b": 0.7})["a"]) - goal) == pytest.approx(best)
