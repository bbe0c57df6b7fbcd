"""The shortcut for texts of one language."""

import numpy as np

from partloom.llm import langid
from test_texts import plain_viterbi


def test_two_languages_that_share_one_change_are_not_constant():
    s = np.repeat([[0.0, -10.0, -2.5], [-10.0, 0.0, -2.5]], 4, axis=0) * (langid.SWITCH / 12)
    assert plain_viterbi(s, langid.SWITCH) == [0] * 4 + [1] * 4
    assert langid._constant(s) is None


def test_shortcut_takes_only_best_paths():
    rng = np.random.default_rng(5)
    taken = 0
    for _ in range(3000):
        s = rng.normal(0, langid.SWITCH / 6, (rng.integers(1, 12), 3)) - [0, 0, langid.SWITCH / 20]
        one = langid._constant(s)
        if one is not None:
            taken += 1
            assert plain_viterbi(s, langid.SWITCH) == [one] * len(s)
    assert taken > 100
