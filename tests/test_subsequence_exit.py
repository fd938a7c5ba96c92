"""The common subsequence is given up once no alignment of the length asked for is left, wherever matches stand."""

import random

import pytest
from florilege.functions import similarity


class Read(dict):
    """Places that count how many characters are looked up."""

    n = 0

    def get(self, *args):
        self.n += 1
        return super().get(*args)


def test_matches_too_far_away_dont_count():
    a, b = "a" * 100 + "b" * 100, "b" * 100 + "a" * 100
    places = Read(similarity.places_of(a))
    assert similarity.common_subsequence(places, 200, b, 170) == -1
    assert places.n <= 64


@pytest.mark.parametrize("seed", range(5))
def test_no_reachable_length_is_given_up(seed):
    draw = random.Random(seed)
    for _ in range(300):
        a = "".join(draw.choices("abcde ", k=draw.randrange(1, 150)))
        b = "".join(c for c in a if draw.random() < 0.9) + "".join(draw.choices("abc", k=draw.randrange(0, 40)))
        b = b[k:] + b[:k] if (k := draw.randrange(0, 20)) else b
        places = similarity.places_of(a)
        most = similarity.common_subsequence(places, len(a), b)
        for least in {0, most // 2, most - 1, most}:
            assert similarity.common_subsequence(places, len(a), b, least) == most
        assert similarity.common_subsequence(places, len(a), b, most + 1) in (-1, most)
