"""Packed columns come back as they were."""

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from opsledger.llm.blocks import packed, unpacked
from opsledger.llm.kneser_ney import _packed_positions, _unpacked_positions


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**32 - 1), st.integers(0, 255), st.integers(-(2**63), 2**63 - 1)), max_size=60))
def test_round_trip(rows):
    columns = [np.array([r[i] for r in rows], dtype=t) for i, t in enumerate(("u8", "u4", "u1", "i8"))]
    columns[0].sort()
    for want, got in zip(columns, unpacked(packed(*columns), "u8", "u4", "u1", "i8"), strict=True):
        assert np.array_equal(want, got) and want.dtype == got.dtype


@given(st.lists(st.tuples(st.integers(0, 2**63 - 1), st.integers(0, 2**32 - 1)), max_size=60))
def test_positions(rows):
    keys, docs = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.uint32)
    docs.sort()
    a, b = _unpacked_positions(_packed_positions(keys, docs))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(keys.tolist(), docs.tolist()))


def test_blocks_are_spread_and_grow_with_the_root():
    from opsledger.llm.blocks import BLOCK_BYTES, block_bytes, spread

    numbers = [task << 24 | i for task in range(400) for i in range(2)]
    for parts in (64, 200):
        counts = np.bincount([spread(x) % parts for x in numbers], minlength=parts)
        assert counts.max() < 30 and (counts > 0).mean() > 0.9
    assert block_bytes(0) == block_bytes(16 << 30) == BLOCK_BYTES and block_bytes(1 << 46) == 1 << 29
