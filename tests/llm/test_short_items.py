"""Every pattern of substitutions that the rule allows has a seed."""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pytest

from draftlake.llm import decontaminate


def has_seed(equal: list[bool], masks: tuple[str, ...]) -> bool:
    line = "".join("1" if e else "0" for e in equal)
    fits = lambda mask, at: all(line[at + k] == "1" for k, bit in enumerate(mask) if bit == "1")
    return any(fits(m, at) for m in masks for at in range(len(line) - len(m) + 1))


@pytest.mark.parametrize("n", range(1, 20))
def test_short_items(n):
    for many in range(4):
        for places in itertools.combinations(range(n), many):
            equal = [k not in places for k in range(n)]
            if decontaminate.best_stretch(np.array(equal))[2] >= decontaminate.least_equal(n):
                assert has_seed(equal, decontaminate.masks_of(n)), (n, places)


def without_seed(n: int, many: int, masks: tuple[str, ...]) -> int:
    """Stretches of ``n`` words with ``many`` substitutions and no seed, counted by their last words."""
    keep = max(map(len, masks)) - 1
    wanted = [(int(m, 2), len(m)) for m in masks]
    state = Counter({(0, 0): 1})
    for read in range(1, n + 1):
        after: Counter = Counter()
        for (last, used), ways in state.items():
            after[last << 1 & ((1 << keep) - 1), used + 1] += ways
            now = last << 1 | 1
            if not any(read >= size and now & bits == bits for bits, size in wanted):
                after[now & ((1 << keep) - 1), used] += ways
        state = Counter({k: v for k, v in after.items() if k[1] <= many})
    return sum(state.values())


@pytest.mark.parametrize("n", [10, 11, 12, 13, 14, 15, 16, 18, 20, 23, 25, 30, 35, 40, 50, 60])
def test_stretches_of_long_items(n):
    # All stretches with at most so many substitutions, those at the ends included.
    many = min(n // 5, n - decontaminate.MIN_MATCH)
    assert without_seed(n, many, decontaminate.MASKS) == 0
    assert without_seed(12, 2, ("1111111", "11101001011")) > 0  # the count does find gaps
