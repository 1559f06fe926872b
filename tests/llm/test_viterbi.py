"""The shortcut against the whole recursion, with paths that never use the top language."""

import numpy as np

from parchment.llm import langid


def test_two_runs_pay_one_change():
    rng = np.random.default_rng(6)
    cases = [np.array([[-8, 0, -20], [-8, -20, 0]], np.float32)]
    cases += [np.minimum(rng.choice([0.0, -3, -6, -9, -20], (n, 4)), 0).astype(np.float32) for n in (2, 3, 5, 8) for _ in range(500)]
    for s in cases:
        start = np.zeros(s.shape[1])
        total = start + s[0]
        for row in s[1:]:
            total = np.maximum(total, total.max() - 9.0) + row
        path = langid.viterbi(s, start, 9.0)
        mine = s[range(len(s)), path].sum() - 9.0 * (np.diff(path) != 0).sum()
        assert abs(total.max() - mine) < 1e-3
