import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import docs, hard_rows, words
from pyspark.sql import functions as F

from trackloom.llm import mixing, quality, queries, token_records, topk, url_filter
from trackloom.llm.graph import components


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Deal by weight, cut at the limit, deal the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
            rest -= target[s]
        open_ -= over or open_
    return target


def mixed_rows(n=600):
    rnd = random.Random(4)
    return [(k, words(k, rnd.randrange(1, 80)), rnd.choice(["a"] * 8 + ["b", "c", "d", "B", None, "é"])) for k in range(n)]


def test_mixing_meets_targets(spark):
    rows = mixed_rows() + [(1000, None, "a"), (1001, "", "zz"), (None, "x y z", "b")]
    table = docs(spark, rows).repartition(3)
    got = mixing.mix(table).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    want = brute_targets(size)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= 25
    again = mixing.mix(docs(spark, rows[::-1]))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))
    assert "Python" not in again._jdf.queryExecution().toString()


def test_mixing_of_odd_tables(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert [(r.size, r.taken) for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()] == [(0, 0), (0, 0)]
    table = docs(spark, mixed_rows(80))
    taken = mixing.take(table)
    assert taken.columns == table.columns
    want = {r.doc_id: r.copies for r in mixing.mix(table).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()} == want


def test_mixing_follows_document_weights(spark):
    rows = [(k, words(k, 20), "a" if k % 2 else "b") for k in range(4000)]
    table = docs(spark, rows).withColumn("importance", F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0))
    got = mixing.mix(table, weights=(1.0, 1.0), share=0.5, weight="importance").withColumn("heavy", F.col("doc_id") % 4 < 2)
    share = {r.heavy: r.m for r in got.groupBy("heavy").agg(F.avg("copies").alias("m")).collect()}
    assert share[True] > 1.8 * share[False]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b", "/x", "block"), (None, "/", "block")]
URLS = [None, "", "no scheme", "http://Example.NET/en/a?b#c", "http://www.example.net/de/", "http://net", "http://net/", "ftp://x.example.com/de/y", "https://x.org/fr", "https://x.org/fr/", "http://a.b/xyz", "http://c.a.b/x?", "http://ca.b/x", "x://y.net/p://q", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://é.net/", "http://net:80/", "\nhttp://u.net/\n"]


def brute_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
    fits = [(len(h + p), h.lower() + p, v) for h, p, v in RULES if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_url_filter_equals_brute_force(spark, broadcast):
    rows = [(k, u, "x") for k, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, URLS[4], "x"), (None, None, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, digest string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, broadcast_bytes=broadcast)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr((k, *brute_verdict(u))) for k, u, _ in rows)
    assert url_filter.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def brute_top(rows, k=10):
    ints = [(i, np.floor(np.array(v, float) * 1024).astype(object).astype(int)) for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v)]
    out = []
    for q, v in ints:
        if q % 100 == 0:
            scores = sorted((-int((v * w).sum()), i) for i, w in ints if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 3)
    rnd = np.random.RandomState(1)
    rows = [(k, [float(x) for x in rnd.randn(6).astype(np.float32)]) for k in range(900)]
    rows += [(1000 + k, rows[5][1]) for k in range(60)]  # ties
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2100, []), (2200, [1.0, 2.0]), (2201, [3.0, -1.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(table.repartition(3), F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    huge = spark.createDataFrame([(0, [3e8, 1.0]), (1, [3e8, 5.0]), (2, [-3e8, 7.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_token_records_round_trip(spark):
    from tokenizers import Tokenizer

    rows = hard_rows() + [(40, "<|endoftext|> don't\r\n\n x"), (41, "tail space "), (42, " \n lead")]
    path = token_records.new_folder(spark)
    token_records.write(docs(spark, rows).repartition(3), path, queries.tokenizer_path())
    got = token_records.index(spark, path).orderBy("part", "piece", "record").collect()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(d, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    start = 0
    for r in got:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    shuffled = token_records.read(spark, path, seed=3).collect()
    assert sorted(len(r.ids) for r in shuffled) == sorted(r.n_tokens for r in got)
    some = token_records.index(spark, path).where("doc_id = 41")
    assert token_records.read(spark, path, some).collect()[0].ids == [*tokenizer.encode("tail space ").ids, 0]


def test_token_records_of_an_empty_table_and_a_damaged_frame(spark):
    path = token_records.new_folder(spark)
    token_records.write(docs(spark, []), path, queries.tokenizer_path())
    assert token_records.index(spark, path).collect() == []
    data = token_records.frame(5, b"\1\0\2\0", 2) + b"\n"
    assert token_records.unframe(data)[0] == 5
    for k in range(len(data)):
        with pytest.raises((ValueError, struct.error)):
            token_records.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])


@pytest.mark.parametrize("slots", [21, 9])
def test_encoder_equals_whole_texts(slots, monkeypatch):
    """slots: a small table is emptied again and again."""
    monkeypatch.setattr(token_records, "SLOT_BITS", slots)
    monkeypatch.setattr(token_records, "SLOTS", 1 << slots)
    coder = token_records.Encoder(queries.tokenizer_path())
    rnd = random.Random(3)
    parts = [*"ab é'ñ.,\n\t  \r!5ſK\u0085\u2028\u200b\u00a0日😀İʰ$|×÷ɏɐ\u0301٣Ⅷ", "'s", " \n", "\n\n", "don't", "word ", " 12", "\n"]
    for group in range(60):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(60)]
        if group % 10 == 9:
            texts.append("x <|endoftext|> y")
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, at = coder.encode(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == coder.whole(texts)
    assert coder.by_piece


def labelled(n=900):
    rnd = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        bad, toxic = k % 4 == 0, k % 11 == 0
        text = " ".join((w.upper() + "!!") if bad else w for w in words(k, rnd.randrange(20, 120), 3000).split())
        if toxic:
            text += " zounds vile " + words(k, 10)
        rows.append((k, text, "junk" if bad else "s"))
        if k % 3:
            labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_quality_on_held_out_documents(spark):
    rows, labels = labelled()
    table = docs(spark, [*rows, (5000, None), (5001, ""), (None, "a b")])
    got = quality.classify(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    unseen = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 0]
    good = [r.keep for r in unseen if r.doc_id % 4 and r.doc_id % 11]
    bad = [r.keep for r in unseen if not (r.doc_id % 4 and r.doc_id % 11)]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_without_usable_labels(spark):
    table = docs(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.keep for r in quality.classify(table, none).collect()] == [True, True]
    one = spark.createDataFrame([(1, 1, None), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(table, one).collect()] == [1.0, 1.0]
    assert quality.classify(docs(spark, []), one).collect() == []


def test_quality_fits_one_view_at_a_time(spark, monkeypatch):
    fit, open_fits, seen = quality._fit, [], []

    def watched(rows, view):
        open_fits.append(view)
        seen.append((len(open_fits), rows.rdd.getNumPartitions()))
        try:
            return fit(rows, view)
        finally:
            open_fits.remove(view)

    monkeypatch.setattr(quality, "_fit", watched)
    rows, labels = labelled()
    quality.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(seen) == 2 * (1 + quality.ROUNDS)
    assert all(n == 1 and parts <= quality.SAMPLE_PARTITIONS for n, parts in seen), seen


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + rnd.randrange(200), 1000 + rnd.randrange(200)) for _ in range(120)] + [(5, 5)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = up[min(a, b)] = min(a, b)
    got = defaultdict(set)
    for r in components(spark.createDataFrame(edges, "src long, dst long")).collect():
        got[r.root].add(r.node)
    want = defaultdict(set)
    for x in up:
        want[find(x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_mixing_keeps_rows_without_or_with_shared_ids(spark):
    rows = [(None, words(k, 30), "a") for k in range(200)] + [(7, words(1000 + k, 30), "a") for k in range(200)] + [(k, words(2000 + k, 30), "b") for k in range(100)]
    table = docs(spark, rows)
    got = mixing.take(table, weight=mixing.length_weight())
    assert got.columns == table.columns
    size = {"a": 400 * 30, "b": 100 * 30}
    taken = {r.source: r.n * 30 for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for s, target in brute_targets(size).items():
        assert abs(taken[s] - target) <= 30
    assert got.where("doc_id is null").count() > 100 and got.where("doc_id = 7").count() > 100
    assert max(r["count"] for r in got.groupBy("text").count().collect()) <= 2


def test_mixing_inclusion_follows_the_probabilities(spark):
    """Documents of one size and two weights: each is drawn about as often as its inclusion probability says."""
    rows = [(k, words(k, 20), "a") for k in range(300)]
    weight = F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0)
    draws = [mixing.mix(docs(spark, rows), weights=(1.0,), share=0.3, seed=seed, weight=weight).select((F.col("doc_id") % 3 == 0).alias("heavy"), "copies") for seed in range(6)]
    every = draws[0]
    for more in draws[1:]:
        every = every.unionByName(more)
    share = {r.heavy: r.m for r in every.groupBy("heavy").agg(F.avg("copies").alias("m")).collect()}
    # p is 0.3 w over the mean weight of 4 / 3
    assert abs(share[True] - 0.45) < 0.05 and abs(share[False] - 0.225) < 0.04


def test_token_files_are_bounded_by_bytes(spark):
    path = token_records.new_folder(spark)
    rows = [(k, words(k, 5 if k % 7 else 3000)) for k in range(200)] + [(None, words(900 + k, 8)) for k in range(50)]
    token_records.write(docs(spark, rows), path, queries.tokenizer_path(), file_bytes=10_000)
    index = token_records.index(spark, path)
    sizes = index.groupBy("file").agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).collect()
    assert all(r.bytes <= 10_010 or r.n == 1 for r in sizes) and len(sizes) > 20
    got = [r.start for r in index.orderBy("part", "piece", "record").collect()]
    assert got == sorted(got) and index.count() == 250


def test_bounds_leave_out_blocks_of_gathered_vectors():
    """Vectors around ten centres: most blocks are never scored, with the same result."""
    rnd = np.random.RandomState(3)
    centres = rnd.randn(10, 16) * 1000
    vectors = np.floor(centres[rnd.randint(0, 10, 4000)] + rnd.randn(4000, 16) * 40)
    order = topk._gathered(vectors)
    ids = np.arange(4000)
    blocks = [(ids[order[k : k + 64]], vectors[order[k : k + 64]]) for k in range(0, 4000, 64)]
    best, visited = topk._Group(blocks).search(ids[:50], vectors[:50], 10, np.full(50, -np.inf))
    scores = vectors[:50] @ vectors.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    assert all(sorted(best.rows[q][0].tolist()) == np.sort(scores[q])[-10:].tolist() for q in range(50))
    assert visited < 0.3 * 50 * len(blocks)


def test_blocks_of_vectors_fall_on_all_groups(spark):
    rows = spark.range(64 * 48, numPartitions=64).select(F.col("id").alias("vec_id"), F.array(*[F.rand(3).cast("float") for _ in range(4)]).alias("embedding"))
    for n in (16, 200):
        blocks = topk._blocks(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), 1024, 4)
        sizes = [r["count"] for r in blocks.groupBy(topk._place(n).alias("place")).count().collect()]
        assert len(sizes) > 0.9 * n and max(sizes) < 3 * sum(sizes) / n + 5
