"""Queries over metrics, profiles and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import metrics, profile
from weftline.plans.registry import Tables, query

#: Suppliers as queries over parts: rank by price, gold where quantity is 50.
_RUN = """ranked AS (SELECT l_suppkey AS q, l_partkey AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS rank, max(l_extendedprice) AS score, bool_or(l_quantity >= 49) AS gold FROM lineitem GROUP BY l_suppkey, l_partkey),
queries AS (SELECT s_suppkey AS q, s_nationkey AS nation, s_nationkey % 3 AS family FROM supplier),
hits AS (SELECT q, min(rank) AS hit FROM ranked WHERE gold GROUP BY q)"""
_METRICS = "avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END) AS recall_10, avg(CASE WHEN hit <= 100 THEN 1.0 ELSE 0.0 END) AS recall_100, avg(CASE WHEN hit <= 100 THEN 1.0 / hit ELSE 0.0 END) AS mrr_100, count(*) AS n_queries"


def _ranked(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c")).agg(F.max("l_extendedprice").alias("score"), F.bool_or(F.col("l_quantity") >= 49).alias("gold"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c")))


def _queries(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("q"), F.col("s_nationkey").alias("nation"), (F.col("s_nationkey") % 3).alias("family"))


def _hits(t: Tables) -> DataFrame:
    ranked = _ranked(t)
    return metrics.first_hits(ranked, ranked.filter("gold"), "q", "c")


@query("a1_a6_a9_m28_metrics", f"WITH {_RUN} SELECT {_METRICS} FROM queries LEFT JOIN hits USING (q)")
def all_metrics(t: Tables) -> DataFrame:
    return metrics.ranking_metrics(_queries(t), _hits(t), "q")


@query("a3_a8_a53_strata_metrics", f"WITH {_RUN} SELECT nation, family, {_METRICS} FROM queries LEFT JOIN hits USING (q) GROUP BY nation, family")
def strata(t: Tables) -> DataFrame:
    return metrics.ranking_metrics(_queries(t), _hits(t), "q", ["nation", "family"])


@query("a4_roll_up", f"WITH {_RUN}, s AS (SELECT nation, family, {_METRICS} FROM queries LEFT JOIN hits USING (q) GROUP BY nation, family) SELECT family, sum(recall_5 * n_queries) / sum(n_queries) AS recall_5, sum(mrr_100 * n_queries) / sum(n_queries) AS mrr_100, CAST(sum(n_queries) AS BIGINT) AS n_queries FROM s GROUP BY family")
def roll_up(t: Tables) -> DataFrame:
    return metrics.weighted_roll_up(strata(t), ["family"], ["recall_5", "mrr_100"])


@query("a2_deployment", f"WITH {_RUN}, d AS (SELECT q, c, gold, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM ranked WHERE c % 10 <> 0), h AS (SELECT q, min(rank) AS hit FROM d WHERE gold GROUP BY q) SELECT {_METRICS} FROM queries LEFT JOIN h USING (q)")
def deployment(t: Tables) -> DataFrame:
    """Injected rows (ids divisible by 10) leave the ranking; their queries stay in the denominator."""
    left = _ranked(t).filter("c % 10 <> 0")
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("rank")))
    return metrics.ranking_metrics(_queries(t), metrics.first_hits(left, left.filter("gold"), "q", "c"), "q")


@query("a5_baselines", f"WITH {_RUN}, m AS (SELECT 'even' AS arm, q, min(rank) AS hit FROM ranked WHERE gold AND c % 2 = 0 GROUP BY q UNION ALL SELECT 'odd', q, min(rank) FROM ranked WHERE gold AND c % 2 = 1 GROUP BY q), a AS (SELECT * FROM (VALUES ('even'), ('odd')) v(arm), queries) SELECT arm, {_METRICS} FROM a LEFT JOIN m USING (arm, q) GROUP BY arm")
def baselines(t: Tables) -> DataFrame:
    ranked, out = _ranked(t), None
    for name, rest in (("even", 0), ("odd", 1)):
        arm = ranked.filter(F.col("c") % 2 == rest)
        one = metrics.ranking_metrics(_queries(t), metrics.first_hits(arm, arm.filter("gold"), "q", "c"), "q").withColumn("arm", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("a7_a42_rank_summary", f"WITH {_RUN} SELECT avg(coalesce(1.0 / hit, 0)) AS mrr, median(hit) AS median_rank, avg(CASE WHEN hit = 1 THEN 1.0 ELSE 0.0 END) AS top_1, avg(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS coverage FROM queries LEFT JOIN hits USING (q)")
def rank_summary(t: Tables) -> DataFrame:
    return metrics.rank_summary(_queries(t).join(_hits(t), "q", "left"))


@query("a10_a11_coverage_gains", f"WITH {_RUN}, e AS (SELECT q, bool_or(gold AND rank <= 10) AS a, bool_or(gold AND c % 2 = 0) AS b, bool_or(gold AND (rank <= 10 OR c % 2 = 0)) AS u FROM ranked GROUP BY q), n AS (SELECT count(*) AS n_queries, count(*) FILTER (a) AS a_n, count(*) FILTER (b) AS b_n, count(*) FILTER (u) AS u_n, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 4) AS a_share, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 4) AS b_share, round(avg(CASE WHEN u THEN 1.0 ELSE 0.0 END), 4) AS u_share FROM e) SELECT *, a_n + b_n - u_n AS both, u_n - b_n AS only_a, u_n - a_n AS only_b, CASE WHEN a_n > b_n THEN 'a' WHEN b_n > a_n THEN 'b' ELSE 'tie' END AS stronger, u_n - greatest(a_n, b_n) AS gain FROM n")
def coverage_gains(t: Tables) -> DataFrame:
    head, even = F.col("rank") <= 10, F.col("c") % 2 == 0
    return metrics.coverage_gains(metrics.arm_coverage(_ranked(t), "q", "gold", {"a": head, "b": even, "u": head | even}), "a", "b", "u")


_GRID = f"{_RUN}, d AS (SELECT * FROM (VALUES (5, 0), (10, 5), (20, 10)) v(depth_a, depth_b)), b AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY c) AS rank FROM ranked), g AS (SELECT DISTINCT q, c FROM ranked WHERE gold), p AS (SELECT DISTINCT depth_a, depth_b, q, c FROM (SELECT depth_a, depth_b, q, c FROM ranked, d WHERE rank <= depth_a UNION ALL SELECT depth_a, depth_b, q, c FROM b, d WHERE b.rank <= depth_b)), e AS (SELECT depth_a, depth_b, q, count(*) AS size, bool_or((q, c) IN (SELECT (q, c) FROM g)) AS covered FROM p GROUP BY ALL), r AS (SELECT depth_a, depth_b, count(*) FILTER (covered) AS covered, count(*) FILTER (covered) / (SELECT count(DISTINCT q) FROM g) AS recall, sum(size) / (SELECT count(DISTINCT q) FROM g) AS mean_size FROM e WHERE q IN (SELECT q FROM g) GROUP BY depth_a, depth_b)"


def _grid(t: Tables) -> DataFrame:
    ranked = _ranked(t)
    other = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("c")))
    depths = t.spark.createDataFrame([(5, 0), (10, 5), (20, 10)], "depth_a int, depth_b int")
    return metrics.pool_grid(ranked.filter("gold").select("q", "c"), ranked, other, depths, "q", "c")


@query("a13_a15_pool_grid", f"WITH {_GRID} SELECT * FROM r")
def pool_grid(t: Tables) -> DataFrame:
    return _grid(t)


@query("a15_pool_sizes", f"WITH {_RUN}, g AS (SELECT DISTINCT q, c FROM ranked WHERE gold), p AS (SELECT q, count(*) AS n, bool_or((q, c) IN (SELECT (q, c) FROM g)) AS hit FROM ranked WHERE rank <= 12 AND q % 7 <> 0 GROUP BY q) SELECT count(*) AS queries, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS ceiling, count(*) FILTER (n IS NULL) AS absent, avg(coalesce(n, 0)) AS mean_size, median(coalesce(n, 0)) AS median_size, min(coalesce(n, 0)) AS smallest, max(coalesce(n, 0)) AS largest, avg(CASE WHEN coalesce(n, 0) < 11 THEN 1.0 ELSE 0.0 END) AS share_small FROM (SELECT DISTINCT q FROM g) LEFT JOIN p USING (q)")
def pool_sizes(t: Tables) -> DataFrame:
    """A seventh of the queries lack a pool."""
    ranked = _ranked(t)
    return metrics.pool_sizes(ranked.filter("rank <= 12 AND q % 7 <> 0"), ranked.filter("gold"), "q", "c", least=11)


@query("a14_smallest_depth", f"WITH {_GRID} SELECT * FROM r WHERE recall >= (SELECT max(recall) FROM r) - 0.05 ORDER BY mean_size, depth_a, depth_b LIMIT 1")
def smallest_depth(t: Tables) -> DataFrame:
    """The limit is the feature: one depth is chosen."""
    return metrics.smallest_depth(_grid(t), 0.05)


@query("a16_a21_counts", "SELECT l_returnflag, l_linestatus, count(*) AS rows, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def counts(t: Tables) -> DataFrame:
    return profile.counts_by(t.lineitem, ["l_returnflag", "l_linestatus"], {"orders": "l_orderkey", "parts": "l_partkey"})


@query("a17_duplicate_keys", "SELECT l_orderkey, l_linenumber, l_extendedprice, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) WHERE copies > 1")
def duplicates(t: Tables) -> DataFrame:
    from weftline.operators.dataset import duplicate_rows

    return duplicate_rows(t.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "copies")


@query("a18_inventory", "SELECT p_brand, p_type, count(*) AS rows, count(DISTINCT p_partkey) AS keys, count(DISTINCT p_name) AS names, CAST(min(len(p_name)) AS INTEGER) AS min_length, median(len(p_name)) AS median_length, CAST(max(len(p_name)) AS INTEGER) AS max_length, 1.0::DOUBLE AS with_blank, 0.0::DOUBLE AS snake_case, 0.0::DOUBLE AS all_caps FROM part GROUP BY ALL")
def inventory(t: Tables) -> DataFrame:
    return profile.name_inventory(t.part, ["p_brand", "p_type"], "p_name", "p_partkey")


@query("a19_funnel", "SELECT 0 AS stage_no, 'all' AS stage, count(*) AS rows, count(DISTINCT user_id) AS ids FROM events UNION ALL SELECT 1, 'click', count(*), count(DISTINCT user_id) FROM events WHERE event_type = 'click' UNION ALL SELECT 2, 'large', count(*), count(DISTINCT user_id) FROM events WHERE event_type = 'click' AND value > 10")
def funnel(t: Tables) -> DataFrame:
    return profile.funnel(t.events, {"all": F.lit(True), "click": F.col("event_type") == "click", "large": F.col("value") > 10}, "user_id")


@query("a20_value_counts", "SELECT p_type, upper(p_name) AS norm, count(*) AS n FROM part GROUP BY ALL")
def value_counts(t: Tables) -> DataFrame:
    from weftline.functions.text import term_spaced

    return t.part.groupBy("p_type", term_spaced(F.col("p_name")).alias("norm")).agg(F.count(F.lit(1)).alias("n"))


@query("a22_split_overlap", "SELECT a.s AS a, b.s AS b, count(*) AS shared FROM (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders) a JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS s FROM orders) b ON a.o_custkey = b.o_custkey AND a.s < b.s GROUP BY a.s, b.s")
def overlap(t: Tables) -> DataFrame:
    return profile.overlap_counts(t.orders, "o_orderpriority", "o_custkey")


@query("a23_number_summary", "SELECT event_type, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type")
def number_summary(t: Tables) -> DataFrame:
    return profile.number_summary(t.events, "value", ["event_type"])


@query("a24_a25_a26_rates", "SELECT avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS positive, avg(CASE WHEN c_acctbal > 0 THEN CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END END) AS large_of_positive, count(*) - count(DISTINCT c_name) AS repeated FROM customer")
def rates(t: Tables) -> DataFrame:
    c = F.col("c_acctbal")
    return t.customer.agg(*profile.rates({"positive": c > 0}), *profile.rates({"large_of_positive": c > 5000}, c > 0), (F.count(F.lit(1)) - F.countDistinct("c_name")).alias("repeated"))


@query("a27_grouped_with_total", "SELECT coalesce(o_orderpriority, 'ALL') AS o_orderpriority, count(*) AS rows, avg(o_totalprice) AS mean FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority)) HAVING count(*) >= 100")
def with_total(t: Tables) -> DataFrame:
    return profile.grouped_with_total(t.orders, "o_orderpriority", [F.avg("o_totalprice").alias("mean")], 100)


@query("a28_characterise", r"SELECT source, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS english, avg(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS mean_words, arg_max(lang, n) AS top_lang FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) * 1000 + CASE lang WHEN 'de' THEN 4 WHEN 'en' THEN 3 WHEN 'es' THEN 2 ELSE 1 END AS n FROM documents) GROUP BY source")
def characterise(t: Tables) -> DataFrame:
    from weftline.functions.text import word_count

    by = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(word_count(F.col("text"))).alias("w"))
    english = F.sum(F.when(F.col("lang") == "en", F.col("n")).otherwise(0)) / F.sum("n")
    top = F.min_by("lang", F.struct(-F.col("n"), F.col("lang")))
    return by.groupBy("source").agg(english.alias("english"), (F.sum("w") / F.sum("n")).alias("mean_words"), top.alias("top_lang"))


@query("a29_divergence", "WITH a AS (SELECT unnest(string_split(p_name, ' ')) AS t FROM part WHERE p_size > 25), b AS (SELECT unnest(string_split(p_name, ' ')) AS t FROM part WHERE p_size <= 25 AND p_type <> 'PROMO'), c AS (SELECT coalesce(x.t, y.t) AS t, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT t, count(*) AS n FROM a GROUP BY t) x FULL JOIN (SELECT t, count(*) AS m FROM b GROUP BY t) y ON x.t = y.t), s AS (SELECT (n + 1e-8) / (sum(n) OVER () + 1e-8 * count(*) OVER ()) AS p, (m + 1e-8) / (sum(m) OVER () + 1e-8 * count(*) OVER ()) AS q FROM c) SELECT round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 9) AS divergence FROM s")
def divergence(t: Tables) -> DataFrame:
    def tokens(d: DataFrame) -> DataFrame:
        return d.select(F.explode(F.split("p_name", " ")).alias("token"))

    return profile.token_divergence(tokens(t.part.filter("p_size > 25")), tokens(t.part.filter("p_size <= 25 AND p_type <> 'PROMO'"))).select(F.round("divergence", 9).alias("divergence"))


@query("a30_a31_a33_a48_a52_over_seeds", "SELECT p_brand, p_type, avg(p_size) AS p_size_mean, coalesce(stddev_samp(p_size), 0) AS p_size_sd, count(*) AS n FROM part GROUP BY ALL")
def over_seeds(t: Tables) -> DataFrame:
    return profile.over_seeds(t.part, ["p_brand", "p_type"], ["p_size"], 0.0)


@query("a32_a51_pivot", "SELECT p_brand, avg(p_size) FILTER (p_type = 'SMALL') AS small, avg(p_size) FILTER (p_type = 'LARGE') AS large FROM part GROUP BY p_brand")
def pivot(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").pivot("p_type", ["SMALL", "LARGE"]).agg(F.avg("p_size")).select("p_brand", F.col("SMALL").alias("small"), F.col("LARGE").alias("large"))


@query("a34_a49_seed_coverage", "SELECT l_suppkey, list_sort(list_distinct(list(l_linenumber))) AS observed, list_sort(list_filter([1, 3, 8], lambda x: NOT list_contains(list(l_linenumber), x))) AS missing, false AS complete FROM lineitem GROUP BY l_suppkey")
def seed_coverage(t: Tables) -> DataFrame:
    return profile.seed_coverage(t.lineitem, ["l_suppkey"], "l_linenumber", [1, 3, 8])


@query("a36_robustness", "SELECT l_suppkey, min(m) AS low, max(m) AS high, max(m) - min(m) AS span, max(CASE WHEN l_linenumber = 1 THEN m END) AS at_first FROM (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def robustness(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_quantity").alias("m"))
    return m.groupBy("l_suppkey").agg(F.min("m").alias("low"), F.max("m").alias("high"), (F.max("m") - F.min("m")).alias("span"), F.max(F.when(F.col("l_linenumber") == 1, F.col("m"))).alias("at_first"))


@query("a37_a38_a47_pivot_delta", "SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'N') AS delta FROM lineitem GROUP BY l_suppkey")
def pivot_delta(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N"]).agg(F.avg("l_quantity"))
    return wide.select("l_suppkey", (F.col("A") - F.col("N")).alias("delta"))


@query("a39_rule_counts", "SELECT l_shipmode_like, count(*) AS n, count(DISTINCT l_orderkey) AS queries, max(c) AS most FROM (SELECT l_linenumber % 3 AS l_shipmode_like, l_orderkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber % 3) AS c FROM lineitem) GROUP BY l_shipmode_like")
def rule_counts(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_linenumber") % 3).alias("l_shipmode_like"), "l_orderkey").groupBy("l_shipmode_like", "l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    return rows.groupBy("l_shipmode_like").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("queries"), F.max("c").alias("most"))


@query("a40_a44_feature_audit", "WITH g AS (SELECT l_orderkey AS q, count(*) AS n, bool_or(l_discount > 0.08) AS p FROM lineitem GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS queries, count(*) FILTER (NOT p) AS without_positive, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated FROM g")
def feature_audit(t: Tables) -> DataFrame:
    from weftline.operators.pool import audit

    return audit(t.lineitem.withColumn("positive", F.col("l_discount") > 0.08), "l_orderkey", "l_linenumber", "positive")


@query("a41_gold_map", "SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS golds FROM lineitem WHERE l_discount > 0.07 GROUP BY l_orderkey")
def gold_map(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_discount > 0.07").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("golds"))


@query("a45_recompute_compare", "SELECT l_suppkey FROM (SELECT l_suppkey, avg(l_quantity) AS a, CASE WHEN l_suppkey % 9 = 0 THEN avg(l_quantity) + 1 ELSE avg(l_quantity) END AS b FROM lineitem GROUP BY l_suppkey) WHERE abs(a - b) > 1e-6")
def recompute(t: Tables) -> DataFrame:
    now = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"))
    kept = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("b")).withColumn("b", F.when(F.col("l_suppkey") % 9 == 0, F.col("b") + 1).otherwise(F.col("b")))
    return now.join(kept, "l_suppkey").filter(F.abs(F.col("a") - F.col("b")) > 1e-6).select("l_suppkey")


@query("a35_a46_two_level_means", "SELECT p_brand, avg(m) AS mean_of_means, row_number() OVER (ORDER BY round(avg(m), 9) DESC, p_brand) AS place FROM (SELECT p_brand, p_type, avg(p_size) AS m FROM part GROUP BY ALL) GROUP BY p_brand")
def two_level(t: Tables) -> DataFrame:
    means = t.part.groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("m")).groupBy("p_brand").agg(F.avg("m").alias("mean_of_means"))
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("mean_of_means", 9)), "p_brand")))


@query("a50_winner_counts", "SELECT name, value, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(['brand', 'type']) AS name, unnest([p_brand, p_type]) AS value FROM part) GROUP BY name, value")
def winner_counts(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).unpivot("p_partkey", ["brand", "type"], "name", "value")
    return rows.groupBy("name", "value").agg(F.countDistinct("p_partkey").alias("n"))


@query("a54_m36_artifact_checks", f"WITH {_RUN} SELECT q, count(*) AS depth, max(rank) = count(*) AS gapless, count(*) - count(DISTINCT c) AS repeated, bool_and(score > 0) AS finite FROM ranked GROUP BY q")
def artifact_checks(t: Tables) -> DataFrame:
    return _ranked(t).groupBy("q").agg(F.count(F.lit(1)).alias("depth"), (F.max("rank") == F.count(F.lit(1))).alias("gapless"), (F.count(F.lit(1)) - F.countDistinct("c")).alias("repeated"), F.bool_and(F.col("score") > 0).alias("finite"))


@query("a55_missing_shares", "SELECT 'text' AS \"column\", avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, avg(CASE WHEN trim(coalesce(text, '')) = '' THEN 1.0 ELSE 0.0 END) AS empty_rate FROM documents UNION ALL SELECT 'lang', avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN trim(coalesce(lang, '')) = '' THEN 1.0 ELSE 0.0 END) FROM documents")
def missing(t: Tables) -> DataFrame:
    return profile.missing_shares(t.documents, ["text", "lang"])
