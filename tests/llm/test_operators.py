"""The other operators: results against brute force, round trips, and the edge cases that their docstrings define."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from florilege.llm import bpe, exact_dedup, importance, packing, quality_rules, sharding, url_filter, warc

sha = lambda b: hashlib.sha256(b).hexdigest()
TEXTS = [None, "", "a", "a", "A", "x" * 5000, "x" * 5000, "x" * 4999 + "y", "ab", "ba", "a b\n", "é"]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _len string, count long")


@pytest.mark.parametrize("bits", [1 << 15, exact_dedup.MOST_BITS])
def test_exact_dedup(spark, bits):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, TEXTS), prefix_chars=3, most_bits=bits).collect()}
    of = {}
    for i, t in enumerate(TEXTS):
        of.setdefault(t or "", []).append(i)
    assert got == {i: (max(m), len(m), i == max(m)) for m in of.values() for i in m}


def test_exact_dedup_of_nothing_null_ids_and_repeated_rows(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "t"), (None, "t"), (3, "u"), (3, "u")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()) == [(0, None, 2, True)] * 2 + [(3, 3, 2, True)] * 2


def test_shards_merge_by_tier_and_keep_every_row(spark, tmp_path):
    docs = frame(spark, [str(random.Random(i).random()) * 40 for i in range(400)]).repartition(16)
    tiers = sharding.Tiers(target_bytes=40_000, fanout=4)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", tiers)
    store.append(docs)
    before = len(store.manifest()["shards"])
    store.append(docs.limit(5))
    done = store.compact()
    assert before == 16 and len(done["shards"]) < 16 and not store.plan(done["shards"])
    key = lambda df: Counter(r.doc_id for r in df.collect())
    assert key(store.read()) == key(docs) + key(docs.limit(5))
    assert store.read().select("_shard").distinct().count() == len(done["shards"])
    live = {str(p.relative_to(tmp_path / "s")) for p in (tmp_path / "s/data").rglob("*.parquet")}
    assert {s["path"] for s in done["shards"]} <= live


def test_a_version_is_committed_once(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    base = store.manifest()
    store.append(frame(spark, ["a"]))
    with pytest.raises(sharding.Conflict):
        store.commit(base, [], frame(spark, []).schema.json())
    assert store.version() == 1 and store.read().count() == 1


def test_an_empty_table_is_a_version(spark, tmp_path):
    assert sharding.shard(frame(spark, []), f"file://{tmp_path}/s").read().count() == 0


ODD = [None, "", "  a", "x" * 300, "é\x00ÿ \x1c\x85 　日本語🙂", "<|endoftext|>", "a\n\n  b\t\tc", "#" * 5000, "aaaaaaab" * 50, "I'll we've 12345 ½ don't", "word " * 2000, "\r\n\r\n"]


def test_bpe_is_the_librarys_and_decodes(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x4E00, 0x4F00), 10, 32])) for _ in range(200)) for _ in range(60)]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    tokens = bpe.bpe_encode(frame(spark, texts), path, P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in tokens.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(tokens, path).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.bpe_encode(frame(spark, []), path, P.PATTERN).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.bpe_decode(lists, path).collect()] == [b"", b""]


def test_a_small_cache_changes_nothing():
    import public_tokenizers as P

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    text = " ".join(f"w{i}xyz{i % 7}" for i in range(300))
    small, large = bpe.Codec(ranks, P.PATTERN, cache=10), bpe.Codec(ranks, P.PATTERN)
    for _ in range(3):
        assert small.encode([text])[0].tolist() == large.encode([text])[0].tolist()


def test_both_engines_split_alike_and_words_of_any_length_are_the_librarys():
    import public_tokenizers as P
    import regex
    import tiktoken

    ranks, rng = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), random.Random(8)
    signs = [chr(i) for i in range(256)] + list(" \n's ab") * 12
    texts = ["".join(rng.choices(signs, k=60)) for _ in range(2000)] + ["ab" * 700, "x" * 1731, "xy" * 1500, "日本" * 300, " " * 4000 + "x"]
    split = bpe.splitter(P.PATTERN)
    assert [split(t) for t in texts] == [regex.findall(P.PATTERN, t) for t in texts]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [x.tolist() for x in bpe.Codec(ranks, P.PATTERN).encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    assert bpe.splitter(r"(?i)\p{L}+|.")("aB\xe9.") == ["aBé", "."]


def test_a_text_of_millions_of_tokens_is_decoded_and_unknown_ids_are_errors():
    codec = bpe.Codec({bytes([b]): b for b in range(256)} | {b"ab": 300}, r"\S+|\s+")
    ids = np.tile(np.array([300, 99, 200], np.int32), 1_000_000)
    assert codec.decode([ids, ids[:1]]) == [b"abc\xc8" * 1_000_000, b"ab"]
    for bad in (256, 299, 301, -1):
        with pytest.raises(KeyError):
            codec.decode([np.array([1, bad], np.int32)])


def test_long_words_in_many_runs_of_the_recursion(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    ranks, rng = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), random.Random(3)
    text = " ".join("".join(rng.choices("abcdeABé", k=rng.choice([1, 7, 40, 59, 70]))) for _ in range(400)) + " " + "a" * 63 + " " + "ab" * 31
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for rows in (1, 5000, bpe._ROWS):
        monkeypatch.setattr(bpe, "_ROWS", rows)
        assert bpe.Codec(ranks, P.PATTERN).encode([text])[0].tolist() == enc.encode_ordinary(text)


def test_the_bpe_query_gives_the_librarys_digests(spark, tmp_path):
    import public_tokenizers as P
    import tiktoken

    from florilege.llm.queries import op3_byte_bpe

    frame(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    ids = [enc.encode_ordinary(t or "") for t in ODD]
    want = [(i, len(x), sha(" ".join(map(str, x)).encode()), sha((ODD[i] or "").encode())) for i, x in enumerate(ids)]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_byte_bpe(spark, str(tmp_path)).collect()) == want


def test_warc_records(spark):
    page = '<html lang="fr"><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><script>var t="</p>";</script><p>One&nbsp;&lt;1&gt;<br>two</p><a href="/x?a=1&amp;b=2">go</a> 3 < 4</body></html>'
    rows = [(1, "http://a/b", page, 1), (2, None, None, 1), (None, "http://c\r\nX: y", "", 1), (1, "http://a/b", page, 1)]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string, record int")).collect()
    assert len(got) == 12
    data = b"".join(bytes(r.record) for r in got)
    records = list(warc.parse(data))
    assert len(records) == 12
    for r, (h, block) in zip(got, records):
        assert h["WARC-Record-ID"] == r.record_id and h["WARC-Block-Digest"] == r.block_digest == warc.digest(block) and int(h["Content-Length"]) == r.n_bytes == len(block)
    by = {(r.page_id, r.warc_type): (r, block) for r, (_, block) in zip(got, records)}
    assert by[1, "conversion"][1].decode() == "One\u00a0<1>\ntwo\ngo 3 < 4"
    assert by[1, "conversion"][0].refers_to == by[1, "metadata"][0].refers_to == by[1, "response"][0].record_id
    meta = by[1, "metadata"][1].decode()
    assert "outlink: /x?a=1&b=2\r\n" in meta and "language: fr\r\n" in meta and f"source-payload-digest: {warc.digest(page.encode())}" in meta
    assert by[2, "response"][0].target_uri == "urn:unknown" and by[2, "conversion"][1] == b""
    assert warc.derivatives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_importance_keeps_what_looks_like_the_target(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slow", "green"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["$$$", "buy", "win", "###", "now"]) for _ in range(80))
    texts = [good() if i % 4 else bad() for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in importance.resample(frame(spark, texts), labels).collect()}
    assert sum(got.values()) == 150 and sum(got[i] for i in range(100, 200) if i % 4) >= 74
    odd = frame(spark, [None, "", "the", "the"])
    rows = importance.resample(odd, labels, model=importance.Model(share=0.5)).collect()
    assert sum(r.kept for r in rows) == 2 and [r.log_ratio for r in rows if not r.n_grams] == [0, 0]
    assert importance.resample(frame(spark, []), labels).count() == 0
    assert importance.resample(odd, labels.limit(0)).filter("kept").count() == 4


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate((rng.normal(size=500), np.full(300, 0.25), rng.normal(size=200) * 1e-6))
    df = spark.createDataFrame([(float(v),) for v in values], "score double").cache()
    for k in (1, 2, 400, 700, 1000):
        bound = sorted(values, reverse=True)[k - 1]
        assert importance.kth_largest(df, k, 8) == (bound, k - int((values > bound).sum()))


def url_brute(url, rules, default="allow"):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_hosts_of_many_labels(spark):
    urls = ["http://" + "a." * 50_000 + "example.org/es/x", "http://" + "." * 50_000, "http://a..example.org/es/", "http://org./x", "http://example.org" + ".b" * 20_000]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rules_frame(spark)).collect()}
    assert got == {i: url_brute(u, url_filter.RULES)[2:] for i, u in enumerate(urls)}



@pytest.mark.parametrize("limit", [0, 1000])
def test_url_filter(spark, limit):
    hosts = ["example.org", "a.example.org", "notexample.org", "ORG", "x.com", "com", "", "a..org", "b.de"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x", "/fr/a#b", "/de/", "//"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://u@", "x:", "://") for h in hosts for p in paths] + [None, "", "http://a.org/\nx", "a://b://c.org/"]
    rules = [*url_filter.RULES, ("a.example.org", "/", "block"), ("example.org", "/es/", "allow"), ("de", "", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, url_filter.rules_frame(spark, rules), broadcast_rules=limit).collect()}
    assert got == {i: url_brute(u, [r for r in rules if r[0] is not None]) for i, u in enumerate(urls)}
    assert url_filter.url_filter(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def test_packing(spark):
    rng = random.Random(4)
    lengths = [rng.choice([1, 5, 100, 511, 512, 513, 2000, 9000, 20000]) for _ in range(500)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)] + [(None, 7, "x"), (3, None, "x"), (4, -5, "x")], "doc_id long, n long, bin_id string")
    rows = packing.best_fit(df, F.col("n"), group_rows=100).collect()
    total = Counter()
    bins = {}
    for r in rows:
        total[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert total == Counter({i: n for i, n in enumerate(lengths)}) + Counter({None: 7})
    for members in bins.values():
        members.sort(key=lambda r: (r.bin_offset, r.n_tokens))
        assert all(a.bin_offset + a.n_tokens <= b.bin_offset for a, b in zip(members, members[1:]))
        used = sum(r.n_tokens for r in members)
        assert {r.capacity for r in members} == {min(c for c in packing.CAPACITIES if c >= used)}
    padding = sum(m[0].capacity for m in bins.values()) / sum(total.values())
    assert padding < 1.1
    assert packing.best_fit(df.limit(0), F.col("n")).count() == 0


def quality_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_signals(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "a b c", "a b c a b c", "a a a a a", "x y z\nx y z\n\n x y z", "é # $ <b> | a\x0bb\rc"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3) for _ in range(40)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.signals(frame(spark, texts)).collect()}
    assert got == {i: quality_brute(t) for i, t in enumerate(texts)}


def test_certified_cutoffs_are_the_exact_bounds(spark):
    from math import comb

    rng = random.Random(1)
    rows = [(s, 100, 100, int(100 * min(1, max(0, rng.gauss(0.05, 0.06)))), 10, 0, rng.randrange(8)) for s, n in (("a", 900), ("b", 500), ("c", 30)) for _ in range(n)]
    good = spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    risk = quality_rules.Risk()
    got = {r.stratum: (r.cut_symbols, r.cut_dup_lines, r.cut_repeats) for r in quality_rules.certify(good, "lang", risk).collect()}
    p, tests = risk.alpha / 3, 9

    def cut(values):
        best, n = None, len(values)
        for c in quality_rules.CUTOFFS:
            k = sum(v > c for v in values)
            if sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > risk.delta / tests:
                break
            best = c
        return best

    of = lambda s, f: [f(r) for r in rows if r[0] == s]
    assert got == {s: (cut(of(s, lambda r: r[3] / r[2])), cut(of(s, lambda r: r[5] / r[4])), cut(of(s, lambda r: r[6] / r[1]))) for s in "abc"}
    assert got["a"][0] is not None and got["c"] == (None, None, None)


def test_quality_rules_edges(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (99, None)], "doc_id long, quality int")
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(0, long, None, 1), (0, long, None, 1), (None, None, "en", 2), (2, "short", "en", 3)], "doc_id long, text string, lang string, n_words int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.kept) for r in quality_rules.quality_rules(df, labels).collect())
    assert got == [(-1, 0, False), (0, 60, True), (0, 60, True), (2, 1, False)]
    assert quality_rules.quality_rules(df.limit(0), labels).count() == 0 and quality_rules.quality_rules(df, labels.limit(0)).count() == 4


@pytest.mark.parametrize("bad", ["<!--", "<script>", "<script", "<a <a", "<title>", "<html lang lang", "</script ", "<a href='", "&#9"])
def test_pages_are_read_in_linear_time(bad):
    import time

    times = []
    for n in (20_000, 320_000):
        page = bad * (n // len(bad))
        began = time.process_time()
        warc.derive(*warc.response("1", "http://a/", page, "2024"))
        times.append(time.process_time() - began)
    assert times[1] < 60 * times[0] + 2


def test_hidden_parts_go_and_what_is_not_closed_stays():
    page = "<HEAD><title>t</title></HEAD>a<!-- x --><script>1</script >b<style>c<style>d</style>e<script>f<!--g"
    assert warc.without_hidden(page) == " a  b e<script>f<!--g"
    assert warc.plain_text("x &#" + "9" * 6000 + "; &#65;") == "x \ufffd A"


def test_archives_give_the_records_of_their_pages(spark):
    import gzip

    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derivatives(pages).collect()
    data = b"".join(bytes(r.record) for r in rows if r.warc_type == "response")
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(gzip.compress(data))), ("c", None)], "path string, content binary")
    got = warc.archive_derivatives(files).collect()
    want = {(r.record_id, r.refers_to, bytes(r.record)) for r in rows if r.warc_type != "response"}
    assert len(got) == 8 and {(r.record_id, r.refers_to, bytes(r.record)) for r in got} == want
    assert all(b"X-Source-Headers: HTTP/1.1 200 OK" in x and b"X-Source-Payload-Digest: sha1:" in x for *_, x in want)


@pytest.mark.parametrize("ids,k", [([1] * 10, 3), ([None] * 6 + [5], 3), ([1, 1, None, None], 2)])
def test_importance_keeps_just_k_of_tied_rows(spark, ids, k):
    docs = spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(99, 1)], "doc_id long, quality int")
    assert importance.resample(docs, labels, model=importance.Model(share=k / len(ids))).filter("kept").count() == k


def test_columns_named_like_the_shards_stay_and_readers_of_the_last_version_too(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "doc_id long, _shard string").repartition(4)
    store = sharding.shard(docs, f"file://{tmp_path}/s", sharding.Tiers(target_bytes=1 << 20), arrivals=3)
    assert store.shard_col() == "__shard" and store.version() > 3
    got = store.read().collect()
    assert sorted((r.doc_id, r._shard) for r in got) == sorted((i, f"v{i}") for i in range(40)) and len({r["__shard"] for r in got}) < 12
    assert store.read(store.version() - 1).count() == 40
    lost = tmp_path / "s/data/lost"
    lost.mkdir()
    store.vacuum(grace=-5)
    assert not lost.exists() and store.read().count() == 40
    with pytest.raises(sharding.Conflict):
        store._change({"data/none"}, [], docs.schema.json())
