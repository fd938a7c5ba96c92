"""F2 verify_exact_then_fuzzy: pairs that can't reach the ratio are told apart for all queries at once, and none that reaches it is lost."""

import random
from difflib import SequenceMatcher

import pytest
from florilege.functions import similarity
from florilege.operators import verify


def _text(draw, n):
    return "".join(draw.choice(("ab", "cd", "e ", "fo", " g", "hin", "q", "é", "ﷺ ", "𐍈")) for _ in range(n))


@pytest.mark.parametrize("threshold", [0.85, 0.6])
def test_no_near_pair_is_lost(threshold):
    draw = random.Random(3)
    texts = [_text(draw, n) for n in (1, 2, 20, 34, 40, 70, 95, 105, 110, 130, 250, 400, 700)] + ["x" * 199, "x" * 200, "abcdefghijkl" * 25]
    queries = [""]
    for t in texts * 6:
        rows = list(t)
        for _ in range(draw.randrange(0, max(2, int(len(t) * draw.choice((0.02, 0.1, 0.2)))))):
            at = draw.randrange(len(rows))
            rows[at] = draw.choice(("", "z", "ab", rows[at] + " "))
        queries.append("".join(rows)[draw.randrange(0, 9) :])
    got = {(i, k): r for i, k, r in similarity.Near(texts, threshold, 0).of(queries)}
    want = {(i, k): SequenceMatcher(None, q, t).ratio() for i, q in enumerate(queries) for k, t in enumerate(texts) if q and q not in t}
    assert got == {k: r for k, r in want.items() if r >= threshold} and len(got) > 30


def test_pairs_far_apart_need_no_alignment_of_their_own(monkeypatch):
    asked = []
    monkeypatch.setattr(similarity, "common_subsequence", lambda *a: asked.append(a) or 0)
    draw = random.Random(4)
    words = ["".join(draw.choices("etaoinshr", k=draw.randrange(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    near = similarity.Near([say(n) for n in (20, 25, 30, 40, 45, 50)], 0.85, 0)
    assert near.of([say(draw.randrange(20, 50)) for _ in range(400)]) == [] and not asked


def test_spans_inside_passages_and_near_them(spark):
    passage = "in the beginning of the long passage there stood a lamp beside the river and nobody knew who lit it"
    rows = [(1, passage), (2, passage[4:60]), (3, passage[:-9] + "made"), (4, "the river"), (5, passage[4:20] + " went elsewhere altogether"), (6, None), (7, "12"), (8, "x" * 5000)]
    spans = spark.createDataFrame(rows, "i long, s string")
    corpus = spark.createDataFrame([(9, passage), (10, None)], "p long, t string")
    got = {r.i: (r.is_match, r.p, r.match_type) for r in verify.verify_verses(spans, "i", "s", corpus, "p", "t").collect()}
    none = (False, None, None)
    assert got == {1: (True, 9, "exact"), 2: (True, 9, "substring"), 3: (True, 9, "fuzzy"), 4: (True, 9, "fuzzy"), 5: none, 6: none, 7: none, 8: none}
    empty = verify.verify_verses(spans, "i", "s", corpus.limit(0), "p", "t")
    assert empty.count() == 8 and empty.filter("is_match").count() == 0
