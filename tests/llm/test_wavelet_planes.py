"""Planes of a wavelet shard are parted by places, not by a choice bit by bit."""

from __future__ import annotations

import inspect

import numpy as np
import pytest

from tidemark.llm import wavelet as wv


@pytest.mark.parametrize("n, most", [(1, 1), (5, 2), (3000, 50_000), (wv.BLOCK + 7, 70_000)])
def test_shards_give_their_ids_back(n, most):
    ids = np.random.default_rng(n).integers(0, most, n).astype(np.uint32)
    shard = wv.Shard(wv.write_shard(ids, [3, None], np.array([0, n // 2, n])))
    assert (shard.ids() == ids).all() and shard.doc_ids == [3, None]
    for i in {0, n // 2, n - 1}:
        assert shard.access(i) == ids[i]


def test_no_plane_is_parted_by_a_mask():
    for source in (inspect.getsource(wv.write_shard), inspect.getsource(wv.Shard.ids)):
        assert "[bit]" not in source and "[~bit]" not in source
