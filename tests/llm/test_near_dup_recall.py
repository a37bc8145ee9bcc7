"""Short sets exactly at the threshold must be nominated, too."""

import numpy as np
import pytest

from snapweave.llm import near_dup


@pytest.mark.parametrize("percent,both,union", [(85, 6, 7), (85, 17, 20), (85, 34, 40), (80, 8, 10), (80, 16, 20)])
def test_short_pairs_at_the_threshold(percent, both, union):
    rnd = np.random.default_rng(7)
    signer, limit, lost, n = near_dup.Signer(percent), near_dup.max_sketch_distance(percent), 0, 2000
    for _ in range(n):
        s = rnd.integers(0, 1 << 64, union, dtype=np.uint64)
        cut = both + int(rnd.integers(0, union - both + 1))
        x, y = signer.samples(np.sort(s[:cut])), signer.samples(np.sort(np.append(s[:both], s[cut:])))
        apart = np.bitwise_count(signer.sketch(x) ^ signer.sketch(y)).sum()
        lost += not (apart <= limit and (signer.bands(x)[0] == signer.bands(y)[0]).any())
    assert lost <= 1
