"""What the queries owe to larger tables: exact shares, and copies of a text that are compared once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators import candidates, dataset, matching, metrics, ranking, retrieval
from weftline.plans import ORACLE_SQL, QUERIES


@pytest.fixture
def agree(spark, tmp_path):
    """Write the named tables, run the query and its SQL on them, compare, and give the query's rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        rows = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got.select(columns).collect()]
        assert sorted(rows, key=str) == sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want.fetchall()), key=str)
        return rows

    return run


def test_shares_of_a_split_are_decimals(spark, agree):
    rows = spark.range(90).select(F.col("id").alias("o_orderkey"), F.lit("x").alias("o_orderpriority"))
    agree("m32_stratified_split", orders=rows)
    split = dataset.stratified_split(spark.range(100), "id", [], 0.29, 0.57, "s").groupBy("split").count()
    assert {r.split: r["count"] for r in split.collect()} == {"train": 29, "val": 57, "test": 14}


def test_exact_control_at_once(spark, agree):
    suppliers = spark.range(60).select(F.col("id").alias("s_suppkey"))
    parts = spark.range(200).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).cast("int").alias("p_size"))
    assert agree("f14_f15_exact_control", supplier=suppliers, part=parts)


def _catalog(spark, copies=40):
    """Ten parts and a supplier each, so often; parts of one name differ in brand."""
    rows = [(i, ["red bolt", "large red ring", "hot plate", "old bolt", "blue ring"][i % 5], f"Brand#{i % 10 // 5 + 3}", ["SMALL", "LARGE"][i % 2], i % 10 // 3) for i in range(10 * copies)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    return part, spark.createDataFrame([(i, i % 4) for i in range(10 * copies)], "s_suppkey long, s_nationkey int")


def _scored(monkeypatch):
    """The numbers of texts that are scored on both sides."""
    seen, scores = [], retrieval.posting_scores

    def count(index, queries, query, key, weight=None):
        seen.append((queries.select(query).distinct().count(), index.select(key).distinct().count()))
        return scores(index, queries, query, key, weight)

    monkeypatch.setattr(retrieval, "posting_scores", count)
    return seen


def test_copies_are_scored_once_by_words(spark, agree, monkeypatch):
    seen, (part, supplier) = _scored(monkeypatch), _catalog(spark)
    assert len(agree("m6_m7_word_gram_tfidf", part=part, supplier=supplier)) == 5 * 400
    assert seen == [(20, 10)]


def test_copies_are_scored_once_by_characters(spark, agree, monkeypatch):
    seen, (part, supplier) = _scored(monkeypatch), _catalog(spark)
    assert len(agree("m6_m7_char_gram_tfidf", part=part, supplier=supplier)) == 5 * 400
    assert seen == [(20, 10)]


def test_tokens_of_copies_are_made_once(spark):
    """And grams that always come together are one token."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(name):
        made.add(1)
        return [] if name is None else list(name)

    docs = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 4 < 3, F.element_at(F.array(F.lit("abc"), F.lit("abcx"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))).alias("name"))
    asked = docs.withColumnRenamed("k", "q")
    got = retrieval.tfidf_search(docs, asked, "k", "q", tokens("name"), tokens("name"), 2).collect()
    assert sorted((r.q, r["rank"], r.k, r.score) for r in got if r.q < 8) == [(q, n, 4 * (n - 1) + q % 4, 1.0) for q in (0, 1, 4, 5) for n in (1, 2)]
    assert len(got) == 2 * 200 and made.value <= 40  # 800 rows of 8 texts; a plan may make them more than once


def test_grams_that_come_together_are_one_token(spark, agree, monkeypatch):
    seen, scores, (part, supplier) = [], retrieval.posting_scores, _catalog(spark, 2)

    def count(index, queries, query, key, weight=None):
        seen.append((index.count(), queries.join(index, "token").count()))
        return scores(index, queries, query, key, weight)

    monkeypatch.setattr(retrieval, "posting_scores", count)
    agree("m6_m7_char_gram_tfidf", part=part, supplier=supplier)
    assert seen[0][0] <= 10 * 7 and seen[0][1] <= 20 * 10 * 5  # of 10 texts with more than 30 grams each


@pytest.mark.parametrize("name", ["m11_rule_hits", "m12_m17_match_with_fallback", "m13_m14_cascade", "m16_merge_tiers"])
def test_copies_are_matched_once(spark, agree, monkeypatch, name):
    seen, pairs, (part, supplier) = [], matching.term_pairs, _catalog(spark, 12)

    def count(queries, terms):
        seen.append((queries.count(), terms.count()))
        return pairs(queries, terms)

    monkeypatch.setattr(matching, "term_pairs", count)
    assert agree(name, part=part, supplier=supplier)
    assert seen[0][0] <= 60 and seen[0][1] <= 3 * 20  # of 120 queries and 3 * 120 terms


def test_rules_compare_classes_of_what_they_need(spark, agree, monkeypatch):
    seen, hits, (part, supplier) = [], matching.hits_of, _catalog(spark, 12)

    def count(queries, terms, share=0.5):
        seen.append(hits(queries, terms, share).count())
        return hits(queries, terms, share)

    monkeypatch.setattr(matching, "hits_of", count)
    monkeypatch.setattr(matching, "_IDS", 4, raising=False)
    rows = agree("m11_rule_hits", part=part, supplier=supplier)
    assert sum(seen) < len(rows) / 8  # a sixth with classes of all fields together


def test_copies_contain_one_another_once(spark, agree, monkeypatch):
    seen, scores, (part, supplier) = [], retrieval.containment_scores, _catalog(spark, 12)

    def count(pairs, a, b):
        seen.append(pairs.count())
        return scores(pairs, a, b)

    monkeypatch.setattr(retrieval, "containment_scores", count)
    rows = agree("m8_whole_containment", part=part, supplier=supplier)
    assert len(rows) > 2000 and seen[0] <= 5 * 10  # pairs of different texts


def _tasks(spark, rows, n=7):
    """The number of tasks that make rows, with n partitions a shuffle."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        return rows().select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pairs_of_few_rows_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranking, "_IDS", 8, raising=False)
    part, supplier = _catalog(spark, 20)
    part.write.parquet(f"{tmp_path}/part.parquet")
    supplier.write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("f14_f15_exact_control", "m8_whole_containment"):
        assert _tasks(spark, lambda name=name: QUERIES[name](spark, str(tmp_path))) > 3  # one before, as its input is small


@pytest.mark.parametrize("name", ["m7_whole_candidates", "m7_m10_whole_keyword_features"])
def test_words_of_very_many_rows_count(spark, agree, name):
    part, supplier = _catalog(spark, 501)
    rows = agree(name, part=part, supplier=supplier.filter("s_suppkey in (0, 1, 3)"))
    if name == "m7_whole_candidates":  # brand is in 5010 rows, a size in over 1000
        assert {r[5] for r in rows if r[0] == 1 and r[2:5] == ("token", "LONG", 1)} == {1.0}


def test_all_words_count_unless_told(spark):
    asked = spark.createDataFrame([(1, "brand bolt")], "q long, name string")
    held = spark.range(5002).select(F.col("id").alias("k"), F.concat(F.lit("brand "), F.when(F.col("id") == 7, "bolt").otherwise("ring")).alias("name"))

    def best(**more):
        found = candidates.generate_candidates(asked, held, "q", "k", "name", ["name"], top_k=2, word_grams=False, containment=False, **more)
        return sorted((r.k, r.rule_score) for r in found.filter("rule = 'token'").collect())

    assert best() == [(0, round(1 / 3, 9)), (7, 1.0)]
    assert best(most_df=5000) == [(7, round(1 / 3, 9))]


def test_grid_reads_what_it_has_written(spark, agree, monkeypatch):
    plans, metric, (part, supplier) = [], metrics.ranking_metrics, _catalog(spark, 2)

    def count(queries, hits, *more, **named):
        plans.append(hits._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        return metric(queries, hits, *more, **named)

    monkeypatch.setattr(metrics, "ranking_metrics", count)
    agree("m4_m5_bm25_grid", part=part, supplier=supplier)
    assert plans[0] <= 10  # joins that one plan of all would hold, many times over


def test_exact_hits_are_made_of_lists(spark, monkeypatch):
    seen, pairs = [], ranking.each_pair

    def count(lists, by, a, b, columns=()):
        seen.append((lists.count(), _tasks(spark, lambda: pairs(lists, by, a, b, columns))))
        return pairs(lists, by, a, b, columns)

    monkeypatch.setattr(candidates, "each_pair", count, raising=False)
    part, supplier = _catalog(spark, 12)
    asked = supplier.select(F.col("s_suppkey").alias("q")).join(part, F.col("p_partkey") == F.col("q")).select("q", "p_name")
    found = candidates.generate_candidates(asked, part, "q", "p_partkey", "p_name", ["p_name"], top_k=2, word_grams=False, containment=False)
    assert found.filter("rule = 'exact'").count() == 5 * 24 * 24
    assert seen[0][0] == 5 and seen[0][1] > 1  # a pair of lists a name, in several tasks
