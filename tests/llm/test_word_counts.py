"""Words are told apart by hash."""

import numpy as np

from phishscreen.llm import lm


def test_distinct_words_as_unique_gives_them():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5000):
        hashes = rng.choice(rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2), n) if n else np.zeros(0, np.uint64)
        words, back = lm.distinct(hashes)
        known, inverse = np.unique(hashes, return_inverse=True)
        assert words.dtype == known.dtype and (words == known).all() and (back == inverse).all()
