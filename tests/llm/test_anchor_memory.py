"""Anchors are sought in sections: the same ones, in less memory."""

import tracemalloc

import numpy as np
import pytest

from logweir.llm.suffix_dedup import sliding_argmin


@pytest.mark.parametrize("section", [1, 3, 50, 1 << 17])
def test_sections_find_the_leftmost_least(section):
    x = np.random.default_rng(4).integers(0, 9, 400).astype(np.uint64)
    assert sliding_argmin(x, 7, section).tolist() == [k + int(np.argmin(x[k : k + 7])) for k in range(394)]


def test_memory_does_not_follow_the_text():
    x = np.random.default_rng(5).integers(0, 1 << 62, 2_000_000).astype(np.uint64)
    tracemalloc.start()
    sliding_argmin(x, 177)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * x.nbytes
