"""Exact deduplication and mixing against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest

from weftline.llm.exact_dedup import drop_exact, exact_dedup
from weftline.llm.mixing import mix_sources, mixed_documents

ROWS = [(1, "a", "x"), (2, "a", "y"), (3, None, "z"), (4, "", "z"), (5, "b " * 5000, None), (6, "b " * 5000, "x"), (None, "a", "x"), (7, "c", "x"), (7, "c", "x"), (None, "d", "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string").repartition(5)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    out = exact_dedup(frame(spark), keep=keep, fan_in_bits=1).collect()
    assert len(out) == len(ROWS)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows = [r for r in out if r.text_sha256 == digest]
        known = [i for i in ids if i is not None]
        best = {"min": min, "max": max}[keep](known) if known else None
        assert Counter(r.doc_id for r in rows) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in rows} == {(best, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [best]


def test_heavy_group_and_stage(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text", "'e' AS _sha")
    out = exact_dedup(df)
    assert out.filter("kept").count() == 2001
    assert {r.doc_id for r in out.filter("kept AND group_size > 1").collect()} == {0}
    left = drop_exact(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {i for i in range(3000) if i % 3 or i == 0}
    assert drop_exact(frame(spark)).count() == 5
    assert exact_dedup(df.limit(0)).count() == 0 and drop_exact(df.limit(0)).count() == 0


def sainte_lague(targets, seats):
    got = [0] * len(targets)
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_mix(spark):
    rows = [(i, "w " * (i % 90), [None, "a", "b", "c"][min(i % 10, 3)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    out = mix_sources(df, docs_per_shard=100).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = ["a", "b", "c", None]
    weights, goal, capped = dict(zip(order, [5, 2, 1, 5], strict=True)), 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (goal - sum(2 * size[s] for s in capped)) / sum(weights[s] for s in free) if free else 0
        over = [s for s in free if level * weights[s] > 2 * size[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 2 * size[s] if s in capped else level * weights[s] for s in order}
    quota = dict(zip(order, sainte_lague([target[s] for s in order], round(goal / 32)), strict=True))
    taken, by_id = Counter(), dict((r[0], r) for r in rows)
    for r in out:
        source = by_id[r.doc_id][2]
        assert r.size == len(by_id[r.doc_id][1].split()) and r.source_size == size[source]
        assert abs(r.target - target[source]) < 1e-6 * target[source]
        assert 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in order:
        assert abs(taken[s] - min(quota[s] * 32, 2 * size[s])) <= (32 * 20 if s in capped else 0)
    assert sorted(out) == sorted(mix_sources(df.repartition(7), docs_per_shard=100).collect())
    mixed = mixed_documents(df, docs_per_shard=100)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in out if r.taken})


def test_mix_edge_cases(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert mixed_documents(spark.createDataFrame([], schema)).count() == 0
    out = mix_sources(spark.createDataFrame([(1, None, None), (None, "", "a"), (2, " ", "a")], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in out] == [(0, 0, 0.0)] * 3
    one = mix_sources(spark.createDataFrame([(None, "a b c", None)] * 2, schema)).collect()
    assert sum(r.taken for r in one) == 0 or all(r.taken <= 6 for r in one)
