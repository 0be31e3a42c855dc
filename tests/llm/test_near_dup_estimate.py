"""The estimate filter of near duplicates: what it may lose."""

from math import ceil, comb

import numpy as np

from routeloom.llm import near_dup


def test_estimate_keeps_pairs_of_the_least_similarity():
    n, j = near_dup.REGISTERS, 0.85
    fewest = ceil(near_dup.LEAST_ESTIMATE * n)
    assert sum(comb(n, k) * j**k * (1 - j) ** (n - k) for k in range(fewest)) < 1e-7
    a = np.full(n, 1000, np.uint16)
    b = a.copy()
    b[80:100] += 500
    b[100:] -= 500
    # 80 of 120 registers equal: one pair in some 400,000 at 0.85 has as few
    assert near_dup.may_link(a[None], b[None], np.array([500]), np.array([500])).all()
