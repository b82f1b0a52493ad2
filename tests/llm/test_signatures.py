"""Weighted arrivals: agreement of registers follows the weighted similarity, and equal weights are no weights."""

import numpy as np

from chatloom.llm.signatures import probminhash, shingles


def test_weights_of_one_change_nothing():
    owner, element, count = shingles(["abcdefghij", "abcdefgxyz"], 5)
    assert (probminhash(owner, element, None, 2, 64) == probminhash(owner, element, np.ones(len(owner)), 2, 64)).all()


def test_agreement_follows_the_weights():
    owner, element = np.array([0, 0, 1, 1]), np.array([11, 22, 11, 33], np.uint64)
    agree = lambda w: (lambda s: (s[0] == s[1]).mean())(probminhash(owner, element, w, 2, 4096))
    assert abs(agree(None) - 1 / 3) < 0.05
    assert abs(agree(np.array([8.0, 1.0, 8.0, 1.0])) - 0.8) < 0.05
