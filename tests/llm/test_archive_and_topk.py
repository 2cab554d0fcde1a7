"""WARC round trips and exact top-k against brute force."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest

from weftline.llm.topk_search import Searcher, top_k
from weftline.llm.web_archive import LoserTree, archive_pages, build_archives, parse_record, url_key


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree(iter(r) for r in runs)) == sorted(x for r in runs for x in r)


def test_url_key(spark):
    known = {"https://www.Example.com:8080/A?b=1#c": "com,example:8080)/a?b=1", None: "", "http://a.b": "b,a)/", "Mailto:x": "mailto:x", "//u:p@H/": "h)/", "": ""}
    df = spark.createDataFrame([(x,) for x in known], "url string")
    assert {r.url: r.key for r in df.select("url", url_key(df["url"]).alias("key")).collect()} == known


def test_text_ids_are_merged_in_the_order_of_the_runs(spark):
    ids = [str(i) for i in range(40)] + ["a1", "b", "10x", None]
    df = spark.createDataFrame([(i, "http://same.org/", f"p{i}") for i in ids], "page_id string, url string, html string").repartition(6)
    histories, _, _ = build_archives(df, fan_in=2)
    rows = sorted(histories.collect(), key=lambda r: (r.range, r.place))
    keys = [(r.stamp, int(r.page) if r.page.isdigit() else -1, r.page) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(ids)
    assert sorted(map(str, (r.page_id for r in archive_pages(df).collect()))) == sorted(map(str, ids))


PAGES = [(i, f"http://h{i % 3}.example.com/p {i % 7}", ["same", "x" * 70_000, None, "", f"own {i}"][min(i % 6, 4)], "clash") for i in range(60)] + [(None, None, "same", "c"), (None, "u", "alone", "c"), (5, "u", "own 5", "c")]


@pytest.mark.parametrize("fan_in,least", [(64, 0), (2, 3)])
def test_archive_round_trip(spark, fan_in, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, url_key string").repartition(7)
    out = archive_pages(df, fan_in=fan_in, least_bytes=least).collect()
    groups = {}
    for i, _, h, _ in PAGES:
        groups.setdefault((h or "").encode(), []).append(i)
    want = []
    for data, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for i in ids:
            response = i == last or len(data) < least
            want.append((i, len(data), digest, "response" if response else "revisit", None if response else last))
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out))) == sorted(map(str, want))


def test_histories_are_globally_ordered(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, url_key string").repartition(9)
    histories, folder, _ = build_archives(df, fan_in=2)
    rows = sorted(histories.collect(), key=lambda r: (r.range, r.place))
    keys = [(r.key.encode(), r.stamp) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(PAGES)
    with open(f"{folder.removeprefix('file:')}/{rows[3].file}", "rb") as f:
        f.seek(rows[3].at)
        assert parse_record(f.read(rows[3].size))["warc-record-id"] == f"<urn:page:{rows[3].page}>"
    assert archive_pages(df.limit(0)).count() == 0


def brute(rows, every, k):
    vectors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vectors if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size,block,chunk", [(0, 8192, 65536), (7, 8192, 65536), (700, 8192, 65536), (700, 9, 150)])
def test_top_k(spark, size, block, chunk):
    rng = random.Random(size)
    rows = [(i, [round(rng.gauss(0, 1) + (i % 5 == 0), 1) for _ in range(24)]) for i in range(size)]
    if size:
        rows[3:6] = [(3, None), (4, [None] * 24), (5, [math.nan] * 24)]
        rows += [(1000 + i, [0.5] * 24) for i in range(40)] + [(2000, [9.0] * 5), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, block=block, chunk=chunk).collect())
    assert got == brute(rows, 20, 20)


def test_bounds_pass_over_most_rows_of_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (30, 32))
    x = np.floor(centres[rng.integers(0, 30, 6000)] + rng.normal(0, 4, (6000, 32))).astype(np.int64)
    searcher = Searcher(np.arange(40) * 20, x[:800:20], 20, (2, 4, 8, 16))
    searcher.add(np.arange(6000), x)
    assert searcher.pairs == 40 * 6000 and searcher.computed < searcher.pairs / 2
