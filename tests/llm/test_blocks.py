"""Blocks of arrays: small headers, the same arrays again."""

import numpy as np

from logweir.llm.hash_arrays import pack_arrays, unpack_arrays


def test_arrays_come_back():
    sent = [np.arange(5), np.zeros(0, np.uint64), np.array([[1, 2, 3], [4, 5, 1 << 63]], np.uint64), np.array([-0.5, 2.0]), np.array([True, False])]
    found = unpack_arrays(pack_arrays(*sent))
    assert [x.tolist() for x in found] == [x.tolist() for x in sent]
    assert found[2].shape == (2, 3)


def test_a_small_array_has_a_small_header():
    assert len(pack_arrays(np.arange(7))) <= 64
