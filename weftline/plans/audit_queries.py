"""Queries over negatives, sweeps of a fixed scorer, imported lists and checks of exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import learn, negatives, pool, profile
from weftline.plans.registry import Tables, query
from weftline.plans.retrieval_queries import _ARMS, _arms, _gold, _pool
from weftline.sources.tables import listed_candidates

_NEGATIVES = f"""{_ARMS}, t AS (SELECT p_partkey AS c, trim(p_name) AS text FROM part WHERE trim(p_name) <> ''),
pos AS (SELECT q, min(c) AS c FROM g GROUP BY q), own AS (SELECT q, text FROM pos JOIN t USING (c)),
h AS (SELECT q, c, text, CASE WHEN rank BETWEEN 3 AND 8 THEN 0 ELSE 1 END AS tier, sha1('n|' || c) AS draw FROM a JOIN t USING (c) WHERE q IN (SELECT q FROM pos) AND (q, c) NOT IN (SELECT (q, c) FROM g) AND (q, text) NOT IN (SELECT (q, text) FROM own)),
u AS (SELECT *, row_number() OVER (PARTITION BY q, text ORDER BY tier, draw, c) AS k FROM h),
pl AS (SELECT c, text, row_number() OVER (ORDER BY sha1('n|' || c), c) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY sha1('n|' || c), c) AS k FROM t) WHERE k = 1), z AS (SELECT count(*) AS n FROM pl),
f AS (SELECT q, t.c, text, 2 AS tier, lpad(CAST((place - ('0x' || substr(sha1('n|' || q), 1, 12))::BIGINT % n + n) % n AS VARCHAR), 20, '0') || sha1('n|' || t.c) AS draw FROM pos, z, pl JOIN t USING (text) WHERE (q, t.c) NOT IN (SELECT (q, c) FROM g) AND (q, text) NOT IN (SELECT (q, text) FROM own)),
w AS (SELECT *, row_number() OVER (PARTITION BY q, text ORDER BY tier, draw, c) AS k FROM (SELECT q, c, text, tier, draw FROM u WHERE k = 1 UNION ALL SELECT * FROM f)),
s AS (SELECT q, c, text, CASE tier WHEN 0 THEN 'band' WHEN 1 THEN 'top' ELSE 'fill' END AS source, CAST(row_number() OVER (PARTITION BY q ORDER BY tier, draw, c) AS INTEGER) AS place FROM w WHERE k = 1 QUALIFY place <= 24)"""


def _negatives(t: Tables) -> tuple[DataFrame, DataFrame]:
    gold = _gold(t)
    positives = gold.groupBy("q").agg(F.min("c").alias("c"))
    names = t.part.select(F.col("p_partkey").alias("c"), F.col("p_name").alias("text"))
    return negatives.select_negatives(_arms(t)[0], gold, positives, names, "q", "c", "text", 3, 8, 24, "n"), positives


@query("m21_selected_negatives", f"WITH {_NEGATIVES} SELECT * FROM s")
def selected_negatives(t: Tables) -> DataFrame:
    return _negatives(t)[0]


@query("m21_negative_counts", f"WITH {_NEGATIVES}, e AS (SELECT pos.q, count(*) FILTER (source = 'band') AS from_band, count(*) FILTER (source = 'top') AS from_top, count(*) FILTER (source = 'fill') AS from_fill FROM pos LEFT JOIN s ON s.q = pos.q GROUP BY pos.q) SELECT *, from_top + from_fill > 0 AS fallback, from_band + from_top + from_fill < 24 AS short FROM e")
def counts_of_negatives(t: Tables) -> DataFrame:
    return negatives.negative_counts(*_negatives(t), "q", 24)


@query(
    "m35_scored_sweep",
    f"""WITH {_ARMS}, l AS (SELECT p.*, (q, c) IN (SELECT (q, c) FROM g) AS gold, ('0x' || substr(sha1('sweep|' || q), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS share FROM p),
m AS (SELECT rate, q, c, gold, coalesce(vec_score, 0) + CASE WHEN NOT gold OR rate >= 1 OR (rate > 0 AND share < rate) THEN 5000 * coalesce(lex_score, 0) ELSE 0 END AS score FROM l, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.7, 1.0]::DOUBLE[]) AS rate)),
h AS (SELECT rate, q, min(rank) FILTER (gold) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY rate, q ORDER BY score DESC, c) AS rank FROM m) GROUP BY rate, q)
SELECT rate, avg(CASE WHEN hit <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall_1, avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall_5, avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall_10, avg(CASE WHEN hit <= 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS recall_100, round(avg(CASE WHEN hit <= 100 THEN 1.0::DOUBLE / hit ELSE 0.0::DOUBLE END), 9) AS mrr_100, count(*) AS n_queries FROM h GROUP BY rate""",
)
def scored_sweep(t: Tables) -> DataFrame:
    """A fixed linear scorer, the lexical score as evidence."""
    rows = _pool(t).select("q", "c", "is_label", "vec_score", "lex_score")
    scored = learn.allowance_sweep(rows, "q", "c", "is_label", ["lex_score"], lambda df: df.withColumn("score", F.coalesce("vec_score", F.lit(0.0)) + 5000 * F.coalesce("lex_score", F.lit(0.0))), [0.0, 0.1, 0.25, 0.5, 0.7, 1.0], "sweep")
    return scored.withColumn("mrr_100", F.round("mrr_100", 9))


@query(
    "a25_pair_overlap",
    """WITH v AS (SELECT l_orderkey, coalesce(list('Flag ' || l_returnflag ORDER BY l_linenumber) FILTER (l_discount > 0.02), []) AS a, coalesce(list(CASE WHEN l_orderkey % 2 = 0 THEN 'Flag ' ELSE 'flag  ' END || l_returnflag ORDER BY l_linenumber) FILTER (l_discount > 0.01), []) AS b FROM lineitem GROUP BY l_orderkey),
n AS (SELECT a, b, list_transform(a, lambda s: lower(replace(s, '  ', ' '))) AS x, list_transform(b, lambda s: lower(replace(s, '  ', ' '))) AS y FROM v),
f AS (SELECT len(a) > 0 AND len(b) > 0 AS two, len(a) = 0 AND len(b) > 0 AS lone, a = b AS exact_block_match, x = y AS normalized_block_match, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS exact_item_match, list_sort(list_distinct(x)) = list_sort(list_distinct(y)) AS normalized_item_match, len(list_intersect(x, y)) AS s, len(list_distinct(x)) AS nx, len(list_distinct(y)) AS ny FROM n)
SELECT count(*) AS n_pairs, count(*) FILTER (two) AS both_present_n, count(*) FILTER (lone) AS query_absent_cde_present_n, """
    + ", ".join(f"count(*) FILTER (two AND {x}) AS {c}_n, count(*) FILTER (two AND {x}) / nullif(count(*) FILTER (two), 0) AS {c}_rate" for c, x in {"exact_block_match": "exact_block_match", "normalized_block_match": "normalized_block_match", "exact_item_match": "exact_item_match", "normalized_item_match": "normalized_item_match", "strict_subset": "s = nx AND nx < ny", "subset_or_equal": "s = nx", "query_shorter_than_cde": "nx < ny"}.items())
    + ", round(avg(s) FILTER (two), 9) AS overlap_mean, round(avg(s / (nx + ny - s)) FILTER (two), 9) AS item_jaccard_mean FROM f",
)
def overlap_of_pairs(t: Tables) -> DataFrame:
    def listed(least: float, word):
        kept = F.when(F.col("l_discount") > least, F.struct("l_linenumber", F.concat(word, "l_returnflag").alias("v")))
        return F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["v"])

    other = F.when(F.col("l_orderkey") % 2 == 0, "Flag ").otherwise("flag  ")
    rows = t.lineitem.groupBy("l_orderkey").agg(listed(0.02, F.lit("Flag ")).alias("a"), listed(0.01, other).alias("b"))
    return profile.pair_overlap(rows, "a", "b").withColumns({c: F.round(c, 9) for c in ("overlap_mean", "item_jaccard_mean")})


@query(
    "a26_integrity",
    """WITH e AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS q, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS p, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS c, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'N' || o_custkey % 25 ELSE 'other' END AS own FROM orders),
m AS (SELECT CAST(c_custkey AS VARCHAR) AS c, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'N' || c_nationkey END AS v, true AS f FROM customer WHERE c_acctbal > 0),
j AS (SELECT e.*, v, coalesce(f, false) AS f, trim(own) <> '' AS mine, coalesce(trim(v), '') <> '' AS theirs FROM e LEFT JOIN m USING (c))
SELECT count(*) AS n_rows, count(DISTINCT CASE WHEN trim(q) <> '' THEN q END) AS n_unique_query_id, count(*) FILTER (trim(q) <> '') - count(DISTINCT CASE WHEN trim(q) <> '' THEN q END) AS duplicate_query_id_n, count(*) FILTER (trim(q) = '') AS missing_query_id_n, count(DISTINCT p) AS n_unique_pair_id, count(p) - count(DISTINCT p) AS duplicate_pair_id_n, count(*) FILTER (p IS NULL) AS missing_pair_id_n, count(*) FILTER (c = '') AS missing_cde_id_n,
count(*) FILTER (f) AS cde_master_row_found_n, count(*) FILTER (f) / count(*) AS cde_master_row_found_rate, count(*) FILTER (mine) AS pair_cde_present_n, count(*) FILTER (theirs) AS master_cde_present_n, count(*) FILTER (mine AND theirs AND own = v) AS pair_cde_matches_master_n, count(*) FILTER (mine AND theirs AND own = v) / count(*) AS matches_rate_all_rows, count(*) FILTER (mine AND theirs AND own = v) / nullif(count(*) FILTER (mine AND theirs), 0) AS matches_rate_comparable, count(*) FILTER (NOT mine AND theirs) AS pair_cde_missing_master_present_n, count(*) FILTER (mine AND NOT theirs) AS pair_cde_present_master_missing_n FROM j""",
)
def integrity_of_export(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    own = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("N"), F.col("o_custkey") % 25)).otherwise("other")
    export = t.orders.select(F.when(k % 11 == 0, " ").otherwise(c).alias("q"), F.when(k % 13 != 0, k.cast("string")).alias("p"), F.when(k % 17 == 0, "").otherwise(c).alias("c"), own.alias("own"))
    held = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("N"), "c_nationkey")).alias("v"))
    return profile.integrity(export, "q", "p", "c", "own", held, "k", "v")


@query("a40_missing_summary", f"WITH {_ARMS}, n AS (SELECT count(*) AS n, " + ", ".join(f"count(*) - count({c}) AS {c}" for c in ("vec_rank", "lex_rank", "vec_score", "lex_score")) + " FROM p) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS missing, {c} / n AS share FROM n" for c in ("vec_rank", "lex_rank", "vec_score", "lex_score")))
def missing_in_pool(t: Tables) -> DataFrame:
    return pool.missing_summary(_pool(t), ["vec_rank", "lex_rank", "vec_score", "lex_score"])


@query("s16_listed_candidates", f"WITH {_ARMS}, v AS (SELECT p_partkey AS c, CASE WHEN p_size > 25 THEN '10.0' ELSE '2.0' END AS v FROM part WHERE p_size <> 7), r AS (SELECT q, c, score, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM a WHERE q % 4 <> 0) SELECT 'h' || q AS query_id, c || '::' || v AS cde_id, CAST(rank AS INTEGER) AS rank, score FROM r JOIN v USING (c) WHERE rank <= 10")
def listed(t: Tables) -> DataFrame:
    q = F.col("q")
    lists = _arms(t)[0].groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "c", "score"))).alias("l"))
    cells = [F.concat_ws(", ", F.transform("l", lambda x: x[n].cast("string"))).alias(name) for n, name in (("c", "top20_public_ids"), ("score", "top20_scores"))]
    rows = lists.select(q.alias("query_id"), F.when(q % 4 == 0, "False").otherwise(" True").alias("is_evaluable"), F.concat(F.lit("e"), q).alias("data_element"), *cells)
    split = lists.filter(q % 4 != 0).select(F.concat(F.lit("h"), q).alias("query_id"), q.alias("original_query_id"), F.concat(F.lit("e"), q).alias("data_element"))
    versions = F.explode(F.array(F.lit("1.0"), F.when(F.col("p_size") > 25, "10.0").otherwise("2.0")))
    return listed_candidates(rows, split, t.part.filter("p_size <> 7").select(F.col("p_partkey").alias("cde_publicid"), versions.alias("cde_version")), 10)
