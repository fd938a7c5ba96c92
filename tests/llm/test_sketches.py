"""What op6 stores and shuffles of a record: sketches of four bits a range, entries of a bucket by record."""

import random

import numpy as np
import pytest
from florilege.llm import jaccard


def universe(draw, n):
    return np.array(sorted({draw.getrandbits(64) for _ in range(n)}), np.uint64)


@pytest.mark.parametrize("n", [1, 7, 40, 700])
def test_sketches_differ_in_no_more_ranges_than_sets_in_shingles(n):
    draw = random.Random(n)
    for _ in range(40):
        base = universe(draw, n)
        a, b = (np.union1d(base[[draw.random() < 0.9 for _ in base]], universe(draw, draw.randint(0, 5))) for _ in range(2))
        if not len(a) or not len(b):
            continue
        x, y = (np.frombuffer(jaccard.sketch(s, len(s)), np.uint8)[None] for s in (a, b))
        width = 2 * min(x.shape[1], y.shape[1])
        differ = int((jaccard._ranges(x, width) != jaccard._ranges(y, width)).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert x.shape[1] <= max(4, len(a) / 2)
    one, other = (np.frombuffer(jaccard.sketch(s, len(s)), np.uint8)[None] for s in (universe(draw, n + 60), universe(draw, n + 60)))
    width = 2 * min(one.shape[1], other.shape[1])
    assert (jaccard._ranges(one, width) != jaccard._ranges(other, width)).mean() > 0.5


@pytest.mark.parametrize(("most_size", "times"), [(500, 3), (70_000, 3), (500, 400)])
def test_entries_of_a_bucket_come_back(most_size, times):
    draw = np.random.default_rng(3)
    sids = draw.integers(0, 1 << 63, 50).astype(np.uint64)
    sizes = draw.integers(1, most_size, 50)
    sizes[0] = most_size
    row = draw.permutation(np.repeat(np.arange(0, 50, 2), times))
    sig = draw.integers(0, 1 << 32, len(row)).astype(np.uint64)
    data = jaccard._blob(sids, sizes, sig, row)
    got = sorted(zip(*(x.tolist() for x in jaccard._unblob(data)), strict=True))
    assert got == sorted(zip(sig.tolist(), sids[row].tolist(), sizes[row].tolist(), strict=True))
    assert len(data) <= 16 + 4 * len(row) + 25 * (8 + (2 if most_size < 1 << 16 else 4) + (1 if times < 256 else 4))
