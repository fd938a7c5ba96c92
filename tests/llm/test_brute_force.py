"""Whole results of the operators without SQL against plain recomputation: shards, WARC records, importance scores, packing."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from florilege.llm import importance, packing, queries, warc


def test_every_shard_is_counted_and_named_by_its_least_document(spark):
    rows = queries.op2_sharding(spark, DATA).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.doc_id)
    assert all(min(m) == s for s, m in held.items())
    assert all(r.shard_rows == len(held[r.shard]) for r in rows)
    # Four arrivals are four versions at least, and nobody sees two of them.
    assert len({r.version for r in rows}) == 1 and rows[0].version >= 4


def records(data):
    """(headers, block) of WARC records, by the lengths that they state."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        assert lines[0] == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        yield headers, rest[:n]
        data = rest[n + 4 :]


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_every_record_states_its_own_lengths_digests_and_source(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    of = {}
    for r in queries.op5_warc(spark, DATA).collect():
        ((headers, block),) = records(bytes(r.record))
        assert headers["WARC-Type"] == r.warc_type and headers["WARC-Block-Digest"] == r.block_digest == sha1(block)
        assert headers.get("WARC-Refers-To") == r.refers_to
        of.setdefault(r.page_id, {})[r.warc_type] = (r, headers, block)
    assert set(of) == set(pages)
    for i, made in of.items():
        assert set(made) == {"response", "metadata", "conversion"}
        source, headers, block = made["response"]
        http, _, payload = block.partition(b"\r\n\r\n")
        assert payload == (pages[i].html or "").encode() and headers["WARC-Payload-Digest"] == sha1(payload)
        for kind in ("metadata", "conversion"):
            r, h, b = made[kind]
            assert r.refers_to == source.record_id and h["WARC-Target-URI"] == headers["WARC-Target-URI"]
            assert h["X-Source-Headers"] == http.decode().replace("\r\n", " | ")
            assert (h["X-Source-Payload-Digest"], h["X-Source-Block-Digest"]) == (sha1(payload), sha1(block))
        assert made["conversion"][2].decode() == warc.plain_text(pages[i].html or "")
    assert len({r.record_id for m in of.values() for r, _, _ in m.values()}) == 3 * len(of)


def bucket(gram, buckets):
    """The bucket of a word, or of a pair of words: what the pair has more than its words."""
    raw = np.frombuffer(gram.encode(), np.uint8)
    got = Counter(importance.ngram_buckets(raw, np.array([0, len(raw)]), buckets)[0].tolist())
    for w in gram.split() if " " in gram else ():
        got -= Counter([bucket(w, buckets)])
    ((only, n),) = got.items()
    assert n == 1
    return only


def test_scores_are_the_log_likelihood_ratio_and_the_noise_of_the_id(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["ab", "cd", "é", "x", "the", "of"]) for _ in range(rng.randrange(0, 30))) for i in range(60)}
    good = {i for i in texts if i % 4 == 0}
    model = importance.Model(buckets=1 << 12, temperature=0.5)
    labels = spark.createDataFrame([(i, int(i in good)) for i in texts if i % 2 == 0], "doc_id long, quality int")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    grams = {i: [*t.split(), *(f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False))] for i, t in texts.items()}
    at = {g: bucket(g, model.buckets) for g in {g for gs in grams.values() for g in gs}}
    raw, target = Counter(at[g] for gs in grams.values() for g in gs), Counter(at[g] for i in good for g in grams[i])
    smooth = lambda c, b: math.log(c[b] + model.smoothing) - math.log(sum(c.values()) + model.smoothing * model.buckets)
    uniform = {r.id: r.u for r in spark.createDataFrame([(i,) for i in texts], "id long").select("id", ((F.shiftrightunsigned(F.xxhash64(F.lit(model.seed), "id"), 12).cast("double") + 0.5) / float(1 << 52)).alias("u")).collect()}
    rows = importance.resample(docs, labels, model=model).collect()
    score = {}
    for r in rows:
        ratio = sum(smooth(target, at[g]) - smooth(raw, at[g]) for g in grams[r.doc_id])
        score[r.doc_id] = r.score
        assert r.n_grams == len(grams[r.doc_id]) and r.log_ratio == pytest.approx(ratio, abs=1e-4)
        assert r.score == pytest.approx(ratio - model.temperature * math.log(-math.log(uniform[r.doc_id])), abs=1e-4)
    k = math.ceil(len(texts) * len(good) / (len(texts) / 2))
    assert {r.doc_id for r in rows if r.kept} == set(sorted(score, key=score.get, reverse=True)[:k])


@pytest.mark.parametrize("seed,capacities", [(1, (8, 16, 32)), (2, (5, 12, 40, 100)), (3, (64,))])
def test_packing_is_best_fit_over_all_open_bins(spark, seed, capacities):
    rng = random.Random(seed)
    lengths = [(i, rng.choice([0, 1, 2, 3, 5, 8, 13, 21, 34, 90, 250])) for i in range(300)]
    top = max(capacities)
    pieces = [(i, p, min(top, n - p * top)) for i, n in sorted(lengths, key=lambda x: (-x[1], x[0])) for p in range(max(1, -(-n // top)))]
    order = sorted(range(len(pieces)), key=lambda k: -pieces[k][2])
    size = packing.plan_sizes(np.array([n for *_, n in pieces]), capacities, 16.0)
    bins, want = [], {}
    for k in order:
        i, p, n = pieces[k]
        fits = [(room - used, b) for b, (room, used) in enumerate(bins) if room - used >= n and room > used]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([capacities[size[next(c for c, x in enumerate(capacities) if x >= n)]], 0])
        want[i, p] = (b, bins[b][1], n)
        bins[b][1] += n
    got = {(r.doc_id, r.piece): r for r in packing.best_fit(spark.createDataFrame(lengths, "doc_id long, n int"), F.col("n"), capacities=capacities).collect()}
    assert set(got) == set(want)
    name = {}
    for key, (b, offset, n) in want.items():
        r = got[key]
        assert (name.setdefault(b, r.bin_id), offset, n) == (r.bin_id, r.bin_offset, r.n_tokens)
        assert r.capacity == min(c for c in capacities if c >= bins[b][1])
    assert len(set(name.values())) == len(bins)


@pytest.mark.parametrize("seed,capacities,fixed", [(1, (8, 16, 32), 16.0), (2, (5, 12, 40, 100), 3.0), (3, (64,), 0.0), (4, (16, 24, 64, 100, 256), 1.0), (5, (10, 15, 21), 0.0)])
def test_sizes_are_the_cheapest_of_all_plans(seed, capacities, fixed):
    """Each plan is packed piece by piece; the planned one costs least."""
    rng = random.Random(seed)
    lengths = np.array([min(max(capacities), rng.choice([0, 1, 2, 3, 5, 8, 11, 13, 14, 21, 34, 90, 250])) for _ in range(120)])
    kinds = [next(k for k, c in enumerate(capacities) if c >= n) for n in lengths]
    cost = {}
    for plan in itertools.product(*(range(k, len(capacities)) for k in range(len(capacities)))):
        bins = []
        for n, k in sorted(zip(lengths.tolist(), kinds, strict=True), reverse=True):
            fits = [(room - used, b) for b, (room, used) in enumerate(bins) if room - used >= n and room > used]
            if fits:
                bins[min(fits)[1]][1] += n
            else:
                bins.append([capacities[plan[k]], n])
        cost[plan] = sum(min(c for c in capacities if c >= used) + fixed for _, used in bins)
    assert cost[tuple(packing.plan_sizes(lengths, capacities, fixed).tolist())] == min(cost.values())
    alone = cost[tuple(packing.plan_sizes(lengths, capacities, fixed, most=0).tolist())]
    assert min(cost.values()) <= alone <= cost[tuple(range(len(capacities)))]
    held = packing.pack(lengths, capacities, fixed)
    assert sum({b: c + fixed for b, c in zip(held[0].tolist(), held[2].tolist(), strict=True)}.values()) == min(cost.values())


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_of_one_id_are_dealt_over_groups(spark, hot):
    rows = [(hot, 1 + i % 40) for i in range(2_000)] + [(i, 5) for i in range(100, 300)]
    out = packing.best_fit(spark.createDataFrame(rows, "doc_id long, n int"), F.col("n"), group_rows=100).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter(rows)
    groups = Counter(r.group_id for r in out)
    assert len(groups) == 22 and max(groups.values()) < 200
    used = Counter()
    for r in out:
        used[r.bin_id] += r.n_tokens
    assert all(r.capacity == min(c for c in packing.CAPACITIES if c >= used[r.bin_id]) for r in out)


def stored(headers, block, end=b"\r\n"):
    return end.join([b"WARC/1.0", *headers, b"Content-Length: %d" % len(block)]) + end * 2 + block + end * 2


def test_legal_headers_and_codings_of_archives(spark):
    page = "<html><title>Caf\u00e9</title><p>d\u00e9j\u00e0 vu</p></html>"
    raw = page.encode("latin-1")
    squeezed = gzip.compress(raw)
    chunks = b"".join(b"%x;x=y\r\n%b\r\n" % (len(squeezed[i : i + 7]), squeezed[i : i + 7]) for i in range(0, len(squeezed), 7)) + b"0\r\n\r\n"
    kinds = {
        "plain": (b"Content-Type: text/html; charset=ISO-8859-1", raw),
        "gzip": (b"content-encoding:gzip\r\nContent-Type: text/html;charset=\"latin-1\"", squeezed),
        "two members": (b"Content-Encoding: x-gzip\r\nContent-Type: text/html; charset=latin-1", gzip.compress(raw[:20]) + gzip.compress(raw[20:])),
        "chunked": (b"TRANSFER-ENCODING: gzip, chunked\r\nContent-Encoding: gzip\r\nContent-Type: x; charset=latin-1", chunks),
        "joined before": (b"Transfer-Encoding: chunked", page.encode()),
        "deflate": (b"Content-Encoding: deflate", zlib.compress(page.encode())),
        "raw deflate": (b"Content-Encoding: deflate", zlib.compress(page.encode())[2:-4]),
        "both": (b"Content-Encoding: deflate, gzip", gzip.compress(zlib.compress(page.encode()))),
        "no such set": (b"Content-Type: text/html; charset=klingon", page.encode()),
        "no set for text": (b"Content-Type: text/html; charset=hex", page.encode()),
        "other coding": (b"Content-Encoding: own", squeezed),
    }
    data = b""
    for i, (name, (http, body)) in enumerate(kinds.items()):
        block = b"HTTP/1.1 200 OK\r\n" + http + b"\r\n\r\n" + body
        headers = [b"warc-type:Response", b"WARC-RECORD-ID:<urn:%d>" % i, b"Warc-Target-Uri:  http://a/", b"\tand on", b"X-Note", b"warc-date: 2024"] if i else [b"WARC-Type:response"]
        data += stored([b"WARC-Type: warcinfo"], b"about") + stored(headers, block, b"\n" if name == "deflate" else b"\r\n")
    cut = data[: data.rindex(b"HTTP/1.1") + 9]
    files = {"a": data, "b": gzip.compress(data), "cut": cut, "cut b": gzip.compress(data)[:-200], "none": b"\r\n\r\n", "other": b"<html>", "no length": b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"}
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    of = {}
    for r in warc.archive_derivatives(frame).collect():
        of.setdefault(r.path, []).append(r)
    assert set(of) == set(files) - {"none"}
    for path in ("a", "b"):
        texts = [bytes(r.record).split(b"\r\n\r\n", 1)[1][:-4].decode() for r in of[path] if r.warc_type == "conversion"]
        # Without its head, the page has its title in the metadata and its text in the conversion.
        assert texts == [warc.plain_text(page)] * 10 + [""]
        metas = [bytes(r.record).decode() for r in of[path] if r.warc_type == "metadata"]
        assert all("title: Caf\u00e9\r\n" in m for m in metas[:10]) and "title: " not in metas[10]
        assert [r.refers_to for r in of[path][2:]] == [f"<urn:{i}>" for i in range(1, 11) for _ in range(2)]
        assert all("WARC-Target-URI: http://a/ and on\r\n" in m for m in metas[1:]) and "WARC-Target-URI: urn:unknown\r\n" in metas[0]
    assert len(of["cut"]) == 21 and of["cut"][-1].warc_type == "damaged" and b"too early" in bytes(of["cut"][-1].record)
    assert [r.record for r in of["cut"][:-1]] == [r.record for r in of["a"][:20]]
    assert of["cut b"][-1].warc_type == of["other"][0].warc_type == of["no length"][0].warc_type == "damaged"
    with pytest.raises(Exception, match="too early"):
        warc.archive_derivatives(frame.filter("path = 'cut'"), damaged="raise").collect()
