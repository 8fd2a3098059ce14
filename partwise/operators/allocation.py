"""Capacity-balanced allocation of indivisible blocks to partitions, with minima, solved exactly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

from partwise.operators.folds import PARTITIONS

#: The measures of a block, and the weight of each measure's deviation relative to its total. Fixed values.
WEIGHTS = {"n_curated_rows": 1.0, "n_analogue_components": 0.25, "n_sources": 0.10}
#: What a block's partition adds by its place, so that ties have one solution. Fixed value.
TIE = 1e-9


@dataclass(frozen=True)
class Allocation:
    """Partition of each block, the objective, and whether no better allocation exists."""

    partition: dict[str, str]
    objective: float
    is_proven: bool


def allocate(blocks: Sequence[Mapping[str, object]], shares: Mapping[str, float], minima: Mapping[str, int] | None = None, most_nodes: int = 5_000_000) -> Allocation | None:
    """The allocation of least weighted deviation from the shares that meets the minima; None if there is none.

    ``blocks`` have ``sealed_block_id`` and the measures of ``WEIGHTS``; there are few of
    them, so this is a search on the driver. The objective adds, for each measure, the
    absolute deviations of the partitions' sums from their shares, times the weight
    over the total, and ``TIE`` times the places of block and partition (from 1, blocks
    by id). Blocks are placed from large to small. What a partition has above its
    share can't be taken back and is missed elsewhere, so twice the excess bounds
    every completion from below; a branch ends where that bound, or what is left for
    the minima, doesn't suffice. After ``most_nodes`` branches the best allocation
    found is returned as not proven.
    """
    if abs(sum(shares[p] for p in PARTITIONS) - 1) > 1e-9:
        raise ValueError("shares must sum to one")
    rows = sorted(blocks, key=lambda b: str(b["sealed_block_id"]))
    k, m = len(PARTITIONS), len(WEIGHTS)
    size = np.array([[float(b[c]) for c in WEIGHTS] for b in rows]).reshape(len(rows), m)
    total = size.sum(0)
    weight = np.array(list(WEIGHTS.values())) / np.maximum(total, 1.0)
    goal = np.array([[shares[p] for p in PARTITIONS]]).T * total
    order = sorted(range(len(rows)), key=lambda i: (-float((size[i] * weight).sum()), i))
    rest = np.zeros((len(order) + 1, m))
    for d in range(len(order) - 1, -1, -1):
        rest[d] = rest[d + 1] + size[order[d]]
    ties = [sum(TIE * (i + 1) for i in order[d:]) for d in range(len(order) + 1)]
    least = np.array([minima[p] for p in PARTITIONS], float) if minima else np.zeros(k)
    outside, final = (minima["sources_outside_train"], minima["final_test_sources"]) if minima else (0, 0)
    components, sources = list(WEIGHTS).index("n_analogue_components"), list(WEIGHTS).index("n_sources")
    best: list = [np.inf, None]
    nodes = 0
    at = [0] * len(order)

    def search(d: int, filled: np.ndarray, tie: float) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > most_nodes:
            return
        lacking = np.maximum(least - filled[:, components], 0).sum()
        if lacking > rest[d][components] or filled[1:, sources].sum() + rest[d][sources] < outside or filled[3, sources] + rest[d][sources] < final:
            return
        if d == len(order):
            value = float((np.abs(filled - goal) * weight).sum()) + tie
            if value < best[0]:
                best[:] = [value, at.copy()]
            return
        over = np.maximum(filled - goal, 0)
        if 2 * float((over * weight).sum()) + tie + ties[d] >= best[0]:
            return
        i = order[d]
        after = 2 * (np.maximum(filled + size[i] - goal, 0) - over) @ weight
        for p in np.lexsort((np.arange(k), after)):
            at[i] = int(p)
            filled[p] += size[i]
            search(d + 1, filled, tie + TIE * (i + 1) * (int(p) + 1))
            filled[p] -= size[i]

    search(0, np.zeros((k, m)), 0.0)
    if best[1] is None:
        return None
    return Allocation({str(b["sealed_block_id"]): PARTITIONS[p] for b, p in zip(rows, best[1])}, best[0], nodes <= most_nodes)
