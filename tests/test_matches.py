"""Longest earlier matches by sorted suffixes, against the search by distances back."""

import time

import numpy as np

from tessera.operators.entropy import match_lengths, match_lengths_expanding


def test_longest_earlier_matches():
    rnd = np.random.default_rng(4)
    shapes = [rnd.integers(0, k, n) for k in (1, 2, 3, 9) for n in (1, 2, 3, 7, 64, 257)]
    shapes += [np.tile(rnd.integers(0, 2, 23), 9), np.r_[np.zeros(40, int), 1, np.zeros(40, int)]]
    for code in shapes:
        for points in (np.arange(1, len(code) // 2 + 1), np.arange(1, len(code))):
            assert match_lengths_expanding(code, points).tolist() == match_lengths(code, points, points).tolist()


def test_a_long_message():
    """200,000 codes, also one block repeated: a pass for each distance back would take minutes."""
    rnd = np.random.default_rng(5)
    for code in (rnd.integers(0, 2, 200_000), np.tile(rnd.integers(0, 2, 4000), 50)):
        began = time.time()
        found = match_lengths_expanding(code, np.arange(1, 100_001))
        assert time.time() - began < 20 and found.min() >= 1
    assert found[4000:].min() > 4000
