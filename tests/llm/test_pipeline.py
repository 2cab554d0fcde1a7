"""The pipeline against a brute-force version, on a small fixture."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(path, spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for g in range(40):
        base = rng.choices(vocab, k=rng.choice([4, 30, 120]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            text = list(base)
            if rng.random() < 0.5:
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append(" ".join(text))
    rows += [None, "", "12 34 --", "solo words here"]
    rng.shuffle(rows)
    rows = [(i, t, None if i % 9 == 0 else "xx", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    want = [(i, t, x or "xx", *rest) for i, t, x, *rest in rows if any(c.isalpha() for c in t or "")]
    assert sorted(kept["language_id"], key=lambda r: r.doc_id) == sorted(want, key=lambda r: r[0])
    first = {}
    for r in want:
        first.setdefault(r[1], r)
    assert {r.doc_id for r in kept["exact_dedup"]} == {r[0] for r in first.values()}
    alone = {d for d, _, c in brute([(r[0], r[1]) for r in first.values()], 5) if d == c}
    assert {r.doc_id for r in kept["near_dedup"]} == alone
    size = {r[0]: len(r[1].split()) for r in first.values() if r[0] in alone}
    mixed = Counter()
    for r in kept["mix"]:
        assert rows[r.doc_id][1].startswith(r.text)
        mixed[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * size[d] for d, n in mixed.items())
    assert abs(sum(mixed.values()) - 1.5 * sum(size.values())) <= 32 * 4
    ids = plain([r.text for r in kept["mix"]])
    assert sum(r.length for r in kept["pack"]) == sum(map(len, ids))
    assert Counter(r.doc_id for r in kept["pack"] if r.start == 0) == Counter(r.doc_id for r in kept["mix"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["pack"])


def test_pipeline_takes_empty_tables_and_clashing_names(spark, tmp_path):
    rows = fixture(tmp_path, spark)
    own = f"{SCHEMA}, score double, _id long, label string, c1 int, kept boolean"
    for name, some in (("empty", []), ("clash", [(*r, 1.0, 7, "x", 2, False) for r in rows[:60]])):
        docs = spark.createDataFrame(some, own)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        left = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert (left > 0) == bool(some)


def test_executors_return_their_heap_before_each_stage(spark, tmp_path):
    fixture(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()

    def full() -> int:  # a local session's executor is this JVM
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName())

    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, docs, str(tmp_path))
        assert full() >= before + 2
