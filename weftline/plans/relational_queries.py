"""Queries over filters, joins, windows, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import ids
from weftline.operators import dataset, profile, ranking
from weftline.plans.registry import Tables, query


def _catalog(t: Tables) -> DataFrame:
    """part as a catalog: names repeat, so a public id has many versions."""
    status = F.when(F.col("p_size") % 10 == 0, "Retired - done").when(F.col("p_size") % 2 == 0, "RELEASED").otherwise("draft")
    context = F.when(F.col("p_type") == "PROMO", " test ").otherwise(F.col("p_type"))
    return t.part.select(F.concat_ws("::", "p_name", F.concat("p_size", F.lit("."), "p_partkey")).alias("cde_id"), F.col("p_name").alias("pub"), F.concat("p_size", F.lit("."), "p_partkey").alias("version"), status.alias("status"), context.alias("context"), "p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")


_CATALOG = """catalog AS (SELECT p_name || '::' || p_size || '.' || p_partkey AS cde_id, p_name AS pub, p_size || '.' || p_partkey AS version,
  CASE WHEN p_size % 10 = 0 THEN 'Retired - done' WHEN p_size % 2 = 0 THEN 'RELEASED' ELSE 'draft' END AS status,
  CASE WHEN p_type = 'PROMO' THEN ' test ' ELSE p_type END AS context, p_partkey, p_size, p_brand, p_type, p_retailprice FROM part)"""


@query("f1_f2_eligible", f"WITH {_CATALOG} SELECT p_partkey FROM catalog WHERE NOT contains(upper(status), 'RETIRED') AND upper(trim(context)) NOT IN ('TEST', 'TRAINING')")
def eligible(t: Tables) -> DataFrame:
    return dataset.filter_eligible(_catalog(t), "status", "context").select("p_partkey")


@query(
    "f3_eligibility_report",
    f"""WITH {_CATALOG}, f AS (SELECT contains(upper(status), 'RETIRED') AS a, upper(trim(context)) IN ('TEST', 'TRAINING') AS b FROM catalog)
SELECT count(*) AS before, count(*) FILTER (NOT a AND NOT b) AS "after", count(*) FILTER (a AND NOT b) AS status_only, count(*) FILTER (b AND NOT a) AS context_only, count(*) FILTER (a AND b) AS both FROM f""",
)
def eligibility_report(t: Tables) -> DataFrame:
    return dataset.eligibility_report(_catalog(t), "status", "context")


@query("f4_f5_language", "SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND trim(coalesce(text, '')) <> ''")
def language(t: Tables) -> DataFrame:
    return t.documents.filter((F.lower("lang") == "en") & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("doc_id")


@query("f8_allow_list", "SELECT p_partkey FROM part WHERE (p_brand, p_type) IN (('Brand#1', 'SMALL'), ('Brand#2', 'ECONOMY'), ('Brand#7', 'LARGE'))")
def allow_list(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("Brand#1", "SMALL"), ("Brand#2", "ECONOMY"), ("Brand#7", "LARGE")], "p_brand string, p_type string")
    return dataset.allow_list(t.part, allowed, ["p_brand", "p_type"]).select("p_partkey")


@query("f9_f10_first_reason", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_type = 'PROMO' THEN 'promo' WHEN p_retailprice > 1000 THEN 'dear' END AS reason FROM part")
def first_reason(t: Tables) -> DataFrame:
    from weftline.functions.text import first_reason as reason

    return t.part.select("p_partkey", reason([("small", F.col("p_size") < 10), ("promo", F.col("p_type") == "PROMO"), ("dear", F.col("p_retailprice") > 1000)]).alias("reason"))


@query("f11_current_version", f"WITH {_CATALOG} SELECT pub, cde_id FROM (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY p_size DESC, p_partkey DESC) AS n FROM catalog) WHERE n = 1")
def current_version(t: Tables) -> DataFrame:
    return dataset.current_versions(_catalog(t), "pub", "version").select("pub", "cde_id")


@query("j19_highest_version_map", f"WITH {_CATALOG} SELECT pub, arg_max(cde_id, p_size * 1000000 + p_partkey) AS cde_id FROM catalog GROUP BY pub")
def highest_version(t: Tables) -> DataFrame:
    return dataset.highest_id(_catalog(t), "pub", "cde_id", "version")


@query("j20_m38_pick_version", f"WITH {_CATALOG} SELECT pub, cde_id FROM (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY CASE WHEN status = 'RELEASED' THEN 0 ELSE 1 END, p_size DESC, p_partkey DESC) AS n FROM catalog) WHERE n = 1")
def pick_version(t: Tables) -> DataFrame:
    return dataset.pick_version(_catalog(t), "pub", "version", "status").select("pub", "cde_id")


@query("f13_mask_record", "SELECT count(DISTINCT user_id) AS names, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS realised FROM (SELECT DISTINCT user_id, ('0x' || substr(sha1('3|' || user_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < 0.5 AS a FROM events)")
def mask_record(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events.select("user_id", ids.allowed(u, 0.5, 3).alias("a")).distinct().agg(F.countDistinct("user_id").alias("names"), F.avg(F.when(F.col("a"), 1.0).otherwise(0.0)).alias("realised"))


@query(
    "f14_f15_exact_control",
    "SELECT s.s_suppkey, p.p_partkey FROM supplier s JOIN part p ON s.s_suppkey % 25 = CAST(substr(p.p_brand, 7) AS INT) WHERE NOT (p.p_size % 5 = s.s_suppkey % 5 AND ('0x' || substr(sha1('9|' || s.s_suppkey), 1, 12))::BIGINT / 281474976710656.0::DOUBLE >= 0.4)",
)
def exact_control(t: Tables) -> DataFrame:
    """Pairs lose the hit that gives a blocked query's gold away; the catalog itself stays."""
    asked = t.supplier.select(F.col("s_suppkey"), (F.col("s_suppkey") % 25).alias("_b"), (F.col("s_suppkey") % 5).alias("_s"), ids.allowed(F.col("s_suppkey"), 0.4, 9).alias("_allowed"))
    parts = t.part.select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("_b"), F.coalesce(F.col("p_size") % 5, F.lit(-9)).alias("_p"))
    asked = ranking.id_lists(asked, ["_b", "_s", "_allowed"], "s_suppkey", "s_suppkey")
    parts = ranking.id_lists(parts, ["_b", "_p"], "p_partkey", "p_partkey")
    gives_away = F.nullif(F.col("_p"), F.lit(-9)) == F.col("_s")  # unknown without a size
    rows = asked.join(parts, "_b").filter(~(gives_away & ~F.col("_allowed")))
    return ranking.each_pair(rows, ["_b", "_s", "_allowed", "_p"], "s_suppkey", "p_partkey")


@query("f16_catalog_split", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AS kept FROM lineitem")
def catalog_split(t: Tables) -> DataFrame:
    kept, dropped = dataset.split_by_catalog(t.lineitem, t.part.filter("p_size > 20").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return kept.select(*columns, F.lit(True).alias("kept")).unionAll(dropped.select(*columns, F.lit(False).alias("kept")))


@query("f17_train_positives", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, bool_or(l_discount > 0.08) OVER (PARTITION BY l_returnflag, l_orderkey) AS h FROM lineitem) WHERE l_returnflag <> 'N' OR h")
def train_positives(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("positive", F.col("l_discount") > 0.08)
    return dataset.drop_train_without_positive(rows, "l_returnflag", "l_orderkey", "positive", "N").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("f18_whole_group_limit", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, coalesce(sum(count(*)) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders GROUP BY o_custkey) WHERE b < 500)")
def group_limit(t: Tables) -> DataFrame:
    return ranking.group_limit(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 500)


@query("f20_id_pair_names", r"SELECT c_custkey, regexp_matches(n, '^[0-9]+v[0-9]+(\.[0-9]+)+(:[0-9]+v[0-9]+(\.[0-9]+)+)+$') AS pair FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey || 'v1.0:' || c_nationkey || 'v2.1' WHEN 1 THEN c_custkey || 'v1.0' ELSE c_name END AS n FROM customer)")
def id_pairs(t: Tables) -> DataFrame:
    from weftline.functions.text import is_id_pair

    k = F.col("c_custkey")
    n = F.when(k % 3 == 0, F.concat(k, F.lit("v1.0:"), F.col("c_nationkey"), F.lit("v2.1"))).when(k % 3 == 1, F.concat(k, F.lit("v1.0"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", is_id_pair(n).alias("pair"))


@query("f22_tie_margin", "SELECT p_partkey FROM (SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand) - p_retailprice AS d FROM part) WHERE d <= 5.0 + 1e-12")
def tie_margin(t: Tables) -> DataFrame:
    d = F.max("p_retailprice").over(Window.partitionBy("p_brand")) - F.col("p_retailprice")
    return t.part.withColumn("d", d).filter(F.col("d") <= 5.0 + 1e-12).select("p_partkey")


@query(
    "j1_w16_denormalise",
    """
WITH firsts AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
SELECT c_custkey, c_name, n_name, o_orderpriority FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN firsts ON o_custkey = c_custkey AND n = 1
""",
)
def denormalise(t: Tables) -> DataFrame:
    master = t.customer.withColumn("key", F.col("c_custkey"))
    orders = t.orders.withColumnRenamed("o_custkey", "key")
    out = dataset.denormalise(master, [(orders, [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderpriority")], ["key"])
    return out.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name", "o_orderpriority")


@query(
    "j3_m31_concat_queries",
    """
WITH v AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority) AS n FROM v)
SELECT a.o_custkey, a.o_orderpriority || ' / ' || b.o_orderpriority AS text FROM r a JOIN r b USING (o_custkey) WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' AND a.n <= 2 AND b.n <= 3
""",
)
def concat_queries(t: Tables) -> DataFrame:
    return dataset.concat_queries(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority", "O", "F", 2, 3, " / ")


@query("j7_reachable", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7)")
def reachable(t: Tables) -> DataFrame:
    gold = t.lineitem.join(t.part.filter("p_size = 7").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there")), "l_partkey", "left")
    return dataset.groups_with(gold, ["l_orderkey"], F.col("there")).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "j8_leakage",
    """
WITH e AS (SELECT o_orderkey AS q, o_orderpriority AS x, o_custkey AS g FROM orders WHERE o_orderkey % 3 = 0),
r AS (SELECT o_orderkey + o_orderkey % 2 * 3 AS q, upper(o_orderpriority) || '!' AS x, o_custkey AS g FROM orders WHERE o_orderkey % 3 <> 0)
SELECT q, list_sort(list_distinct(list(reason))) AS reasons FROM (
  SELECT q, 'text_and_gold' AS reason FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.g = e.g AND trim(regexp_replace(lower(r.x), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(e.x), '[^a-z0-9]+', ' ', 'g')))
  UNION ALL SELECT q, 'query_id' FROM e WHERE q IN (SELECT q FROM r)) GROUP BY q
""",
)
def leakage(t: Tables) -> DataFrame:
    o, key = t.orders, F.col("o_orderkey")
    gold = F.concat("o_custkey", F.lit("::"), F.col("o_orderkey"))
    evaluation = o.filter(key % 3 == 0).select(key.alias("q"), F.col("o_orderpriority").alias("x"), gold.alias("g"))
    train = o.filter(key % 3 != 0).select((key + key % 2 * 3).alias("q"), F.concat(F.upper("o_orderpriority"), F.lit("!")).alias("x"), gold.alias("g"))
    return dataset.leakage_reasons(evaluation, train, "q", "x", "g")


@query("j9_overlap_audit", "SELECT count(*) AS overlapping, count(DISTINCT c_mktsegment) AS texts FROM customer WHERE lower(c_mktsegment) IN (SELECT lower(c_mktsegment) FROM customer WHERE c_acctbal > 9900)")
def overlap_audit(t: Tables) -> DataFrame:
    known = t.customer.filter("c_acctbal > 9900").select(F.lower("c_mktsegment").alias("k")).distinct()
    return t.customer.withColumn("k", F.lower("c_mktsegment")).join(known, "k", "left_semi").agg(F.count(F.lit(1)).alias("overlapping"), F.countDistinct("c_mktsegment").alias("texts"))


@query("j10_j11_indicator_join", "SELECT l_orderkey, l_linenumber, l_extendedprice, p_retailprice AS score, p_partkey IS NOT NULL AS found FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def indicator_join(t: Tables) -> DataFrame:
    scores = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("score"), F.lit(True).alias("found"))
    return dataset.indicator_join(t.lineitem, scores.drop("found"), ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "score", "found")


@query("f21_split_routing", "SELECT o_orderkey, CASE WHEN s IN ('train', 'test', 'cctg') THEN 0.7 ELSE 1.0 END AS allowance, s || CASE WHEN s IN ('train', 'test', 'cctg') THEN '_a070' ELSE '_a10' END AS candidate_table, CASE WHEN s IN ('cimac_v2', 'gdc_combined') THEN 'hydrated' ELSE 'thinned' END AS hydration FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'test' WHEN 2 THEN 'cctg' WHEN 3 THEN 'cimac_v2' WHEN 4 THEN 'gdc_combined' ELSE 'new' END AS s FROM orders)")
def split_routing(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, "train").when(k == 1, "test").when(k == 2, "cctg").when(k == 3, "cimac_v2").when(k == 4, "gdc_combined").otherwise("new")
    return dataset.route_splits(t.orders.select("o_orderkey", name.alias("s")), "s").drop("s")


@query(
    "j15_substring_join",
    "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
)
def substring_join(t: Tables) -> DataFrame:
    from weftline.operators.matching import contained_in

    return contained_in(t.benchmark.select("item_id", "text"), t.documents.select("doc_id", F.col("text").alias("body")), "item_id", "text", "doc_id", "body")


@query(
    "j22_table_parity",
    """
WITH a AS (SELECT p_partkey, p_size, p_retailprice, p_name FROM part WHERE p_partkey % 10 <> 0),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_size + 2 ELSE p_size END AS p_size, p_retailprice * 1.5 AS p_retailprice, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS p_name FROM part WHERE p_partkey % 9 <> 0),
m AS (SELECT a.p_partkey IS NULL AS ob, b.p_partkey IS NULL AS oa, a.p_size AS s1, b.p_size AS s2, a.p_retailprice AS r1, b.p_retailprice AS r2, a.p_name AS n1, b.p_name AS n2 FROM a FULL JOIN b ON a.p_partkey = b.p_partkey),
s AS (SELECT count(*) FILTER (oa) AS only_a, count(*) FILTER (ob) AS only_b FROM m)
SELECT s.*, 'p_size' AS "column", count(*) FILTER (s1 IS DISTINCT FROM s2) AS unequal, CAST(max(abs(s1 - s2)) AS DOUBLE) AS max_diff FROM m, s WHERE NOT oa AND NOT ob GROUP BY ALL
UNION ALL SELECT s.*, 'p_retailprice', count(*) FILTER (r1 IS DISTINCT FROM r2), max(abs(r1 - r2)) FROM m, s WHERE NOT oa AND NOT ob GROUP BY ALL
UNION ALL SELECT s.*, 'p_name', count(*) FILTER (n1 IS DISTINCT FROM n2), NULL FROM m, s WHERE NOT oa AND NOT ob GROUP BY ALL
""",
)
def parity(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    a = t.part.filter(k % 10 != 0)
    b = t.part.filter(k % 9 != 0).withColumns({"p_size": F.when(k % 7 == 0, F.col("p_size") + 2).otherwise(F.col("p_size")), "p_retailprice": F.col("p_retailprice") * 1.5, "p_name": F.when(k % 5 != 0, F.col("p_name"))})
    return dataset.table_parity(a, b, ["p_partkey"], ["p_size", "p_retailprice", "p_name"])


@query("j23_config_match", "SELECT p_partkey FROM part WHERE p_type IS NOT DISTINCT FROM 'SMALL' AND abs(p_retailprice - 950) <= 20")
def config_match(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("SMALL", 950.0)], "kind string, price double")
    return t.part.join(F.broadcast(wanted), F.col("p_type").eqNullSafe(F.col("kind")) & (F.abs(F.col("p_retailprice") - F.col("price")) <= 20)).select("p_partkey")  # one row


@query("j24_delta_to_anchor", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity - max(CASE WHEN l_linenumber = 1 THEN l_quantity END) OVER (PARTITION BY l_orderkey) AS delta FROM lineitem")
def delta(t: Tables) -> DataFrame:
    return profile.delta_to_anchor(t.lineitem, ["l_orderkey"], F.col("l_linenumber") == 1, "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice", "delta")


@query("j25_covering_groups", "SELECT l_suppkey, count(DISTINCT l_linenumber) AS seen FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_linenumber) = 7")
def covering(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_linenumber").alias("seen")).filter("seen = 7")


@query("w1_w2_w17_canonical_rank", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, TRY_CAST(i AS BIGINT) IS NULL, TRY_CAST(i AS BIGINT), i) AS rank FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 'X' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS i FROM part)")
def canonical_rank(t: Tables) -> DataFrame:
    i = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("X"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    rows = t.part.select("p_brand", "p_partkey", i.alias("i"), F.col("p_size").cast("double").alias("s"))
    return ranking.canonical_rank(rows, ["p_brand"], "i", "s").select("p_brand", "p_partkey", "rank")


@query("w9_distinct_score_groups", "SELECT p_brand, p_partkey, d AS score_place FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part) WHERE d <= 3")
def distinct_scores(t: Tables) -> DataFrame:
    return ranking.top_distinct_scores(t.part, ["p_brand"], "p_size", 3).select("p_brand", "p_partkey", "score_place")


@query("w10_keep_first", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n = 1")
def keep_first(t: Tables) -> DataFrame:
    return dataset.keep_first(t.part, ["p_name"], [F.desc("p_retailprice"), F.asc("p_partkey")])[0].select("p_name", "p_partkey")


@query("w10_collision_report", "SELECT p_name, count(*) AS rows FROM part GROUP BY p_name HAVING count(*) > 1")
def collisions(t: Tables) -> DataFrame:
    return dataset.keep_first(t.part, ["p_name"], [F.asc("p_partkey")])[1]


_RANKED = "r AS (SELECT l_suppkey AS q, l_partkey AS pub, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)"


def _ranked(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("pub"), F.row_number().over(w).alias("rank"))


@query("w11_m3_compact_ranks", f"WITH {_RANKED} SELECT q, pub, row_number() OVER (PARTITION BY q ORDER BY min(rank), pub) AS rank FROM r GROUP BY q, pub")
def compact(t: Tables) -> DataFrame:
    return ranking.best_version_ranks(_ranked(t), "q", "pub", "rank")


@query("w18_m37_kept_ranks", f"WITH {_RANKED} SELECT q, pub, min(rank) AS rank FROM r GROUP BY q, pub HAVING min(rank) <= 20")
def kept_ranks(t: Tables) -> DataFrame:
    return ranking.best_version_ranks(_ranked(t), "q", "pub", "rank", compact=False, depth=20)


@query(
    "w12_w13_w20_w21_tie_margin_order",
    """
WITH x AS (SELECT *, max(p_size) OVER (PARTITION BY p_brand) - p_size <= 3 + 1e-12 AS near FROM part)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY near DESC, CASE WHEN near THEN NULL ELSE p_size END DESC NULLS LAST, p_retailprice DESC, p_name, p_partkey) AS place FROM x
""",
)
def margin_order(t: Tables) -> DataFrame:
    return ranking.tie_margin_order(t.part, ["p_brand"], "p_size", "p_retailprice", 3, [F.asc("p_name"), F.asc("p_partkey")]).select("p_brand", "p_partkey", "place")


@query("w19_secondary_ties", "SELECT p_brand, count(*) AS tied FROM (SELECT p_brand, p_type, max(p_size) OVER (PARTITION BY p_brand) - p_size <= 3 AS near, max(p_type) OVER (PARTITION BY p_brand) AS top FROM part) WHERE near AND p_type = top GROUP BY p_brand HAVING count(*) > 1")
def secondary_ties(t: Tables) -> DataFrame:
    w = Window.partitionBy("p_brand")
    rows = t.part.withColumns({"near": F.max("p_size").over(w) - F.col("p_size") <= 3, "top": F.max("p_type").over(w)})
    return rows.filter("near AND p_type = top").groupBy("p_brand").agg(F.count(F.lit(1)).alias("tied")).filter("tied > 1")


@query("w14_w15_w22_seed_winners", "SELECT p_brand, p_type, m FROM (SELECT p_brand, p_type, avg(p_size) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY round(avg(p_size), 9) DESC, p_type) AS n FROM part GROUP BY p_brand, p_type HAVING count(DISTINCT p_size % 2) = 2) WHERE n = 1")
def seed_winners(t: Tables) -> DataFrame:
    means = t.part.groupBy("p_brand", "p_type").agg(F.avg("p_size").alias("m"), F.countDistinct(F.col("p_size") % 2).alias("seeds")).filter("seeds = 2")
    return ranking.first_rows(means, ["p_brand"], [F.desc(F.round("m", 9)), F.asc("p_type")]).select("p_brand", "p_type", "m")


@query("k1_k2_k7_k8_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 10")
def top_k(t: Tables) -> DataFrame:
    return ranking.first_rows(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("k5_negatives", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY least(l_quantity, l_linenumber * 5), l_extendedprice) AS n FROM lineitem WHERE l_discount < 0.05) WHERE n <= 2")
def negatives(t: Tables) -> DataFrame:
    rows = t.lineitem.filter("l_discount < 0.05").withColumn("best", F.least("l_quantity", F.col("l_linenumber") * 5.0))
    return ranking.first_rows(rows, ["l_orderkey"], [F.asc("best"), F.asc("l_extendedprice")], 2).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("k6_failure_sample", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 200")
def failures(t: Tables) -> DataFrame:
    """The limit is the feature: a report of the first failures."""
    return t.orders.filter("o_totalprice > 400000").orderBy("o_orderkey").limit(200).select("o_orderkey")


@query("u1_union_by_name", "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def union_by_name(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("u2_u3_u4_sets", "SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'except', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def sets(t: Tables) -> DataFrame:
    a, b = t.lineitem.filter("l_quantity > 45").select("l_partkey"), t.lineitem.filter("l_tax > 0.07").select("l_partkey")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = [d.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n")) for op, d in parts.items()]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("u5_u6_consistency", "SELECT count(*) FILTER (c_custkey IS NULL) AS unexpected, count(*) FILTER (o_custkey IS NULL) AS missing, count(*) FILTER (c_custkey IS NOT NULL AND o_custkey IS NOT NULL) AS shared FROM (SELECT DISTINCT o_custkey FROM orders) FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def consistency(t: Tables) -> DataFrame:
    both = t.orders.select("o_custkey").distinct().join(t.customer.filter("c_custkey % 3 > 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "full_outer")
    return both.agg(F.count_if(F.col("c_custkey").isNull()).alias("unexpected"), F.count_if(F.col("o_custkey").isNull()).alias("missing"), F.count_if(F.col("c_custkey").isNotNull() & F.col("o_custkey").isNotNull()).alias("shared"))


@query(
    "m32_stratified_split",
    "SELECT o_orderkey, CASE WHEN spot <= floor(n * 0.7) THEN 'train' WHEN spot <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha1('s|' || o_orderkey), o_orderkey) AS spot FROM orders)",
)
def stratified(t: Tables) -> DataFrame:
    return dataset.stratified_split(t.orders, "o_orderkey", ["o_orderpriority"], 0.7, 0.15, "s").select("o_orderkey", "split")


@query("m33_round_robin_sample", "SELECT o_orderkey FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS s, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY sha1('r|' || o_orderkey), o_orderkey) AS turn FROM orders) ORDER BY turn, s DESC, o_orderpriority, o_orderstatus LIMIT 100")
def round_robin(t: Tables) -> DataFrame:
    return dataset.round_robin_sample(t.orders, ["o_orderpriority", "o_orderstatus"], "o_orderkey", 100, "r").select("o_orderkey")


@query("m34_sample_per_group", "SELECT p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha1('g|' || p_name), p_name) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE n <= 5")
def sample_per_group(t: Tables) -> DataFrame:
    return dataset.sample_per_group(t.part, "p_brand", "p_name", 5, "g")


@query("a43_majority_stratum", "SELECT o_custkey, o_orderstatus, o_orderpriority, several FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) > 1 AS several, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def majority(t: Tables) -> DataFrame:
    return dataset.majority_stratum(t.orders, "o_custkey", "o_orderstatus", "o_orderpriority")


@query("s14_wide_to_long", "SELECT p_partkey, rank, cand, score FROM (SELECT p_partkey, unnest([1, 2, 3]) AS rank, unnest([p_name, CASE WHEN p_size > 25 THEN ' ' ELSE p_brand END, p_type]) AS cand, unnest([p_size * 1.0, p_retailprice, 0]::DOUBLE[]) AS score FROM part) WHERE trim(cand) <> ''")
def wide_to_long(t: Tables) -> DataFrame:
    second = F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand"))
    wide = t.part.select("p_partkey", F.col("p_name").alias("id_1"), second.alias("id_2"), F.col("p_type").alias("id_3"), F.col("p_size").cast("double").alias("s_1"), F.col("p_retailprice").alias("s_2"), F.lit(0.0).alias("s_3"))
    return profile.melt_ranks(wide, "p_partkey", ["id_1", "id_2", "id_3"], ["s_1", "s_2", "s_3"])


@query("s15_s16_lists_to_long", "WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_extendedprice DESC, l_linenumber)[1:3] AS i, list(l_extendedprice ORDER BY l_extendedprice DESC, l_linenumber)[1:3] AS s FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CAST(unnest(range(1, len(i) + 1)) AS INTEGER) AS rank, unnest(i) AS cand, unnest(s) AS score FROM l")
def lists_to_long(t: Tables) -> DataFrame:
    best = F.sort_array(F.collect_list(F.struct(F.col("l_extendedprice").alias("s"), (-F.col("l_linenumber")).alias("n"), F.col("l_partkey").alias("i"))), asc=False)
    lists = t.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", F.col("b.i").alias("ids"), F.col("b.s").alias("scores"))
    return profile.explode_lists(lists, "l_orderkey", "ids", "scores", 3)


@query("s18_s22_project_sets", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS set_name, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice <= 250000")
def project_sets(t: Tables) -> DataFrame:
    rows = t.orders.filter(F.col("o_orderstatus").isin("F", "O") & (F.col("o_totalprice") <= 250000))
    return rows.select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("set_name"), "o_orderkey")


@query("s28_first_gold", "SELECT o_custkey AS q, min(o_orderkey) AS gold FROM orders GROUP BY o_custkey")
def first_gold(t: Tables) -> DataFrame:
    return ranking.first_rows(t.orders, ["o_custkey"], [F.asc("o_orderkey")]).select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("gold"))
