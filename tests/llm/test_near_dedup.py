"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from weftline.llm import near_dedup
from weftline.llm.near_dedup import drop_near, near_duplicates, shingles, sketch
from weftline.llm.word_hashes import WordHashes


def sets(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size):
    s = [sets(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            common = len(s[i] & s[j])
            if rows[i][0] == rows[j][0] and s[i] and s[j] or (s[i] and s[j] and 100 * common >= 80 * (len(s[i]) + len(s[j]) - common)):
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return sorted(((d, len(s[i]), None if d is None else best[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups=25):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = rng.choices(vocab, k=60)
    rows = []
    for g in range(groups):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 150, 400]))
        if g % 3 == 0:
            base = base + common
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 30])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,size,block", [(1, 4, 256), (2, 5, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, size, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(seed) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (None, "one two"), (5005, "z " * 30_000), (5006, "z " * 20_000), (5010, "rep a b c d e"), (5010, "rep a b c d e"), (5011, "x1 x2 x3 x4 x5 x6"), (5011, "y1 y2 y3 y4 y5 y6")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, label int").repartition(3)
    got = near_duplicates(df, shingle=size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [256, 7])
def test_hub_that_is_not_the_smallest(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(60):
        text = list(base)
        for at in rng.sample(range(0, 200, 12), 5):
            text[at] = f"n{i}-{at}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, shingle=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)
    assert drop_near(df, shingle=4).count() == len({x[2] for x in brute(rows, 4)})
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near(df.limit(0)).count() == 0


def test_near_copies_of_both_texts_of_a_repeated_id(spark):
    one, two = ([f"{x}{i}" for i in range(100)] for x in "pq")
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, " ".join([*two[:-1], "r"])), (8, " ".join([*one[:-1], "r"])), (7, " ".join([*one[:-1], "s"])), (6, "far from all of these"), (4, "a text of id four"), (4, "another of id four"), (3, "another of id four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates(df, shingle=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 4)
    assert sorted({r.doc_id for r in drop_near(df, shingle=4).collect()}) == [3, 5, 6]


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (sketch(np.unique(x)) != near_dedup._EMPTY).all()
    share = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 100).astype(np.uint64)
        share.append((sketch(np.unique(x[:90])) == sketch(np.unique(x[10:]))).mean())
    assert abs(np.mean(share) - 0.8) < 0.02


def test_shingles():
    h = WordHashes()
    assert len(shingles(h.of(b"a b c d e"), 4)) == 2 and len(shingles(h.of(b"a b"), 4)) == 1 and len(shingles(h.of(None), 4)) == 0
    assert shingles(h.of(b"A\x0bb"), 4).tolist() == shingles(h.of(b" a  B\n"), 4).tolist()
    assert shingles(h.of(b"a b"), 4).tolist() != shingles(h.of(b"b a"), 4).tolist()


def test_rounds_of_components_write_few_files(spark):
    from weftline.llm.common import Scratch
    from weftline.llm.components import components

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    scratch, written = Scratch(spark, "test"), []
    table = scratch.table
    scratch.table = lambda df, name: (written.append(df.rdd.getNumPartitions()), table(df, name))[1]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        links = spark.range(400).selectExpr("id AS a", "id - id % 4 AS b")
        assert {(r.node, r.label) for r in components(scratch, links, "x").collect()} == {(i, i - i % 4) for i in range(400) if i % 4}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(written[1:]) <= 8


def test_tables_of_pairs_are_few_files(spark, monkeypatch):
    from weftline.llm import near_dedup
    from weftline.llm.common import Scratch

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    written, table = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (written.update({name: df.rdd.getNumPartitions()}), table(self, df, name))[1])
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "x"])), (2, " ".join(words)), (3, "alone in here by itself now")]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 0, 2: 0, 3: 3}
    some = ["groups", "members", "pairs", "stars", "labelled-members", "sizes", "components", "labels-0"]
    assert all(written[x] <= 8 for x in some), written
