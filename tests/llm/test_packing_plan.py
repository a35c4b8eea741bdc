from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm.packing import places, plan


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 100), st.lists(st.integers(1, 100), max_size=300))
def test_plan_places_all(capacity, lengths):
    h = Counter(min(n, capacity) for n in lengths)
    made, got = plan(dict(h), capacity), Counter()
    for pattern, count in made:
        assert count > 0 and sum(pattern) <= capacity
        assert sum(3 * n > capacity for n in pattern) <= 2
        for n in pattern:
            got[n] += count
    assert got == h
    where, taken = places(made), set()
    for n, c in h.items():
        begin, seq, each, off = where[n]
        for k in range(c):
            i = int(np.searchsorted(begin, k, "right")) - 1
            r = k - int(begin[i])
            taken.add((int(seq[i]) + r // int(each[i]), int(off[i]) + r % int(each[i]) * n))
    assert len(taken) == sum(h.values())


def best_pairs(items, capacity):
    """The most pairs that fit, by trying all."""
    if len(items) < 2:
        return 0
    out = 0
    for i, j in combinations(range(len(items)), 2):
        if items[i] + items[j] <= capacity:
            out = max(out, 1 + best_pairs([x for k, x in enumerate(items) if k not in (i, j)], capacity))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(11, 30), max_size=6))
def test_large_items_pair_as_often_as_can_be(items):
    made = plan(dict(Counter(items)), 30)
    assert sum(count for pattern, count in made if len(pattern) == 2) == best_pairs(items, 30)


def test_few_sequences():
    r = np.random.default_rng(3)
    h = Counter(np.minimum(2048, r.lognormal(6, 1.2, 100_000).astype(int) + 1).tolist())
    assert sum(c for _, c in plan(dict(h), 2048)) <= 1.001 * sum(k * v for k, v in h.items()) / 2048 + 1
