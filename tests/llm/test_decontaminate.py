"""Decontamination against brute force, over segments and parts of several sizes."""

import random
import re

import pytest

from florilege.llm import decontaminate

SCHEMA = "doc_id long, text string, lang string, segment string, place string"
PIECES = ["the", "of", "a", "b", "cat", "sat", "on", "mat", "é", "x1"]


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window, slop):
    out = []
    for i, t in docs:
        w, hit, found, near = split(t), set(), set(), set()
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for name, text in items:
            q = split(text)
            n = min(window, len(q))
            for k in range(len(q) - n + 1) if q else ():
                win = q[k : k + n]
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == win:
                        hit |= set(range(s, s + n))
                        found.add("" if name is None else str(name))
                for s in range(-slop, len(w) + slop):
                    if all(any(abs(p - s - j) <= slop for p in at.get(x, ())) for j, x in enumerate(win)):
                        near.add("" if name is None else str(name))
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((i, len(w), len(hit), [tuple(s) for s in spans], sorted(found, key=str.encode), sorted(near, key=str.encode) if slop else []))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, [(s.start, s.stop) for s in r.spans], r["items"], r.near) for r in df.collect()), key=repr)


@pytest.mark.parametrize("window,slop,segment,part", [(3, 0, 1 << 20, 1 << 20), (3, 1, 60, 1 << 20), (4, 2, 200, 12), (10, 1, 1 << 20, 40)])
def test_equals_brute_force(spark, window, slop, segment, part):
    rng = random.Random(window * 7 + slop)
    say = lambda n: "".join(rng.choice(PIECES) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, say(rng.randrange(1, 16))) for k in range(12)] + [(3, say(5)), (None, say(4)), (40, None), (41, " ,, "), (42, "cat"), (42, "cat")]
    docs = [(k, say(rng.randrange(0, 40))) for k in range(60)]
    docs += [(100 + k, say(5) + (items[k][1] or "").upper() + " " + say(5)) for k in range(12)] + [(None, say(9)), (None, None), (7, ""), (5, say(3)), (5, say(3)), (9, (items[1][1] + " ") * 3)]
    d = spark.createDataFrame([(i, t, "x", "s", "p") for i, t in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id int, n_words int")
    out = decontaminate.decontaminate(d, q, window=window, slop=slop, segment_bytes=segment, part_words=part)
    assert got(out) == brute(docs, items, window, slop)
    assert all(r.contaminated == (r.n_hit > 0) for r in out.collect())


def test_a_long_item_is_cut_into_overlapping_chunks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_WORDS", 8)
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(100))
    words = text.split()
    docs = [(k, "z " + " ".join(words[k : k + 5]) + " z") for k in range(96)]
    out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", text)], "item_id string, text string"), window=5)
    assert got(out) == brute(docs, [("i", text)], 5, 0)
    assert all(r.n_hit >= 5 for r in out.collect())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert decontaminate.decontaminate(docs, some.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert got(decontaminate.decontaminate(some, items)) == [(1, 3, 0, [], [], [])]


def test_a_very_long_text_and_a_frequent_word(spark):
    text = "the " * 200_000 + "one two three four five " + "the " * 50_000
    items = [(1, "the one two three four five the"), (2, "the the the the the the the the the the the")]
    (r,) = decontaminate.decontaminate(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), slop=1).collect()
    assert (r.n_words, r.n_hit, r["items"]) == (250_005, 250_000 + 5, ["1", "2"])
