"""Queries over the features of (query, candidate) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import features, pool
from weftline.plans.registry import Tables, query
from weftline.plans.retrieval_queries import _ARMS, _arms

_GENERIC = "(" + ", ".join(f"'{v}'" for v in T.GENERIC_VALUES) + ")"


def _of(values: str, cond: str) -> str:
    return f"len(list_filter({values}, lambda v: {cond}))"


_CODE = " OR ".join(f"regexp_matches(v, '{p}')" for p in (T.NUMBER, *T.CODES))


def _side(s: str, values: str) -> str:
    n = f"nullif(len({values}), 0)"
    return f"""{_of(values, f"v IN {_GENERIC}")} / {n} AS pv_generic_frac_{s}, {_of(values, f"NOT contains(v, ' ') AND ({_CODE})")} / {n} AS pv_code_like_frac_{s}, {_of(values, f"regexp_matches(v, '{T.NUMBER}')")} / {n} AS pv_numeric_frac_{s}"""


_VALUES = """v AS (SELECT l_orderkey AS k, CASE l_linenumber % 4 WHEN 0 THEN CAST(CAST(l_quantity AS INT) % 9 AS VARCHAR) WHEN 1 THEN 'Flag ' || l_returnflag WHEN 2 THEN 'Unknown' ELSE 'C' || (1000 + l_suppkey % 10) END AS a, CASE l_linenumber % 3 WHEN 0 THEN CAST(CAST(l_quantity AS INT) % 9 AS VARCHAR) || '.0' WHEN 1 THEN 'flag ' || l_linestatus ELSE 'UNKNOWN' END AS b, l_linenumber, l_discount FROM lineitem),
s AS (SELECT k, list_sort(list_distinct(list(lower(a)))) AS a, coalesce(list_sort(list_distinct(list(lower(b)) FILTER (l_discount > 0.02))), []) AS b, max(l_linenumber) % 2 = 0 AS same FROM v GROUP BY k),
o AS (SELECT *, list_intersect(a, b) AS ab, list_distinct(list_transform(list_filter(a, lambda v: regexp_matches(v, '^-?[0-9.]+$')), lambda v: CAST(v AS DOUBLE))) AS x, list_distinct(list_transform(list_filter(b, lambda v: regexp_matches(v, '^-?[0-9.]+$')), lambda v: CAST(v AS DOUBLE))) AS y FROM s)"""


@query(
    "t22_t23_t24_value_overlap",
    f"""WITH {_VALUES} SELECT k, len(a) AS pv_n_sde, len(b) AS pv_n_cde, least(len(a), len(b)) AS pv_count_min, greatest(len(a), len(b)) AS pv_count_max, abs(len(a) - len(b)) AS pv_count_abs_diff, least(len(a), len(b)) / nullif(greatest(len(a), len(b)), 0) AS pv_count_ratio_min_over_max,
len(a) > 0 AND len(b) > 0 AS pv_both_have_pvs, len(a) > 0 AND len(b) = 0 AS pv_only_sde_has_pvs, len(b) > 0 AND len(a) = 0 AS pv_only_cde_has_pvs, len(a) = 0 AND len(b) = 0 AS pv_neither_has_pvs, len(b) > 0 AND same AS pv_type_match,
len(ab) AS pv_exact_overlap_count, len(ab) / nullif(len(a) + len(b) - len(ab), 0) AS pv_exact_overlap_jaccard, len(ab) / nullif(len(a), 0) AS pv_exact_overlap_frac_sde, len(ab) / nullif(len(b), 0) AS pv_exact_overlap_frac_cde, {_of("ab", f"v NOT IN {_GENERIC}")} AS pv_exact_overlap_count_nongeneric,
len(x) AS pv_numeric_n_sde, len(y) AS pv_numeric_n_cde, len(list_intersect(x, y)) AS pv_numeric_overlap_count, len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0) AS pv_numeric_jaccard, len(list_intersect(x, y)) / nullif(len(x), 0) AS pv_numeric_sde_overlap_fraction, len(list_intersect(x, y)) / nullif(len(y), 0) AS pv_numeric_cde_overlap_fraction,
len(x) > 0 AND len(y) > 0 AS pv_numeric_both_have, len(x) > 0 AND len(y) = 0 AS pv_numeric_only_sde_has, len(y) > 0 AND len(x) = 0 AS pv_numeric_only_cde_has, {_side("sde", "a")}, {_side("cde", "b")} FROM o""",
)
def value_overlap(t: Tables) -> DataFrame:
    """Blocks of values of each order's lines, some of them without a catalog side; joined to a catalog, and filled from it."""
    n, q = F.col("l_linenumber"), (F.col("l_quantity").cast("int") % 9).cast("string")
    a = F.when(n % 4 == 0, q).when(n % 4 == 1, F.concat(F.lit("Flag "), "l_returnflag")).when(n % 4 == 2, "Unknown").otherwise(F.concat(F.lit("C"), 1000 + F.col("l_suppkey") % 10))
    b = F.when(n % 3 == 0, F.concat(q, F.lit(".0"))).when(n % 3 == 1, F.concat(F.lit("flag "), "l_linestatus")).otherwise("UNKNOWN")
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(a).alias("a"), F.collect_list(F.when(F.col("l_discount") > 0.02, b)).alias("b"), F.max(n).alias("n"))
    kind = F.when(F.col("n") % 2 == 0, "ENUM").otherwise("BINARY")
    pairs = rows.select("k", F.col("k").alias("cde_id"), F.concat(F.lit("PV_TYPE: Enum(n=9); PV: "), F.array_join("a", " | ")).alias("PV_BLOCK_SDE"))
    catalog = rows.select(F.col("k").alias("cde_id"), F.lit(" ").alias("PV_BLOCK_CDE"), F.when(F.size("b") > 0, F.concat(F.lit("PV_TYPE: "), kind, F.lit("; PV: "), F.array_join("b", " | "))).alias("PV_SUMMARY"))
    return features.add_value_overlap(pairs, catalog, hydrate=True).drop("cde_id", "PV_BLOCK_SDE")


_PAIRS = r"""p AS (SELECT doc_id, p_partkey, CASE doc_id % 3 WHEN 0 THEN trim(text) || ' | PV_TYPE: ENUM(n=3); PV: a | b' WHEN 1 THEN source || '_Code' ELSE text END AS q3, CASE doc_id % 3 WHEN 0 THEN trim(text) WHEN 1 THEN source || '_Code' ELSE trim(text) END AS x,
  CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS pv_n, CASE doc_id % 4 WHEN 0 THEN 'ENUM' WHEN 1 THEN 'BINARY' ELSE '' END AS kind, lang, source, p_name, p_brand, p_type, p_size FROM documents JOIN part ON p_partkey = doc_id),
w AS (SELECT *, list_distinct(list_transform(regexp_extract_all(x, '[A-Za-z0-9]+'), lambda v: lower(v))) AS a, list_distinct(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda v: lower(v))) AS b FROM p)"""


@query(
    "t25_t26_pair_text_features",
    rf"""WITH {_PAIRS} SELECT doc_id, len(x) AS text_query_char_len, len(regexp_extract_all(x, '[A-Za-z0-9]+')) AS text_query_word_count, doc_id % 3 = 0 AS text_query_has_pv, pv_n AS text_query_pv_n, contains(x, '?') AS text_query_has_question_mark,
regexp_matches(x, '^[A-Za-z0-9][A-Za-z0-9_]*$') AND (contains(x, '_') OR (x <> lower(x) AND x <> upper(x))) AS text_query_is_code_like, coalesce(len(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) / nullif(len(regexp_replace(x, '[^\p{{L}}]', '', 'g')), 0), 0) AS text_query_upper_ratio, coalesce(len(regexp_replace(x, '[^\p{{Nd}}]', '', 'g')) / nullif(len(x), 0), 0) AS text_query_digit_ratio,
len(x) - len(replace(x, '_', '')) AS text_query_underscore_count, len(q3) - len(replace(q3, '|', '')) AS text_query_pipe_count, lang AS text_family, source AS text_query_source, len(p_name) AS text_cde_short_name_len, len(p_name || ' ' || p_brand) AS text_cde_long_name_len, len(p_type) AS text_cde_definition_len,
p_size % 3 > 0 AS text_cde_has_pv, p_size % 3 AS text_cde_pv_n, len(x) / len(p_name) AS text_query_cde_char_len_ratio, coalesce(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0) AS text_query_cde_word_overlap, kind <> '' AND kind = CASE WHEN p_size % 2 = 0 THEN 'ENUM' ELSE 'BINARY' END AS text_query_cde_pv_type_match FROM w""",
)
def pair_text_features(t: Tables) -> DataFrame:
    """Documents as queries, each with the part of its number."""
    k = F.col("doc_id")
    q3 = F.when(k % 3 == 0, F.concat(F.trim("text"), F.lit(" | PV_TYPE: ENUM(n=3); PV: a | b"))).when(k % 3 == 1, F.concat("source", F.lit("_Code"))).otherwise(F.col("text"))
    block = F.when(k % 4 == 0, "PV_TYPE: ENUM(n=3); PV: a | b").when(k % 4 == 1, "PV_TYPE: BINARY; PV: yes | no").when(k % 4 == 2, "x | y | x")
    pairs = t.documents.join(t.part.select("p_partkey"), F.col("p_partkey") == k).select("doc_id", k.alias("cde_id"), q3.alias("query_text_q3"), block.alias("PV_BLOCK_SDE"), F.col("lang").alias("family"), F.col("source").alias("query_source"))
    kind = F.when(F.col("p_size") % 2 == 0, "Enum").otherwise("BINARY")
    catalog = t.part.select(F.col("p_partkey").alias("cde_id"), F.col("p_name").alias("SHORT_NAME"), F.concat_ws(" ", "p_name", "p_brand").alias("LONG_NAME"), F.col("p_type").alias("DEFINITION"), (F.col("p_size") % 3).alias("PV_N"), kind.alias("PV_TYPE"))
    out = features.add_text_features(pairs, catalog)
    return out.select("doc_id", *[c for c in out.columns if c.startswith("text_")])


def _table(t: Tables) -> DataFrame:
    """Suppliers ask for parts; the two arms, golds and signals come from their orders' lines."""
    split = F.when(F.col("q") % 5 == 0, "train").otherwise("test").alias("split")
    a, b = _arms(t)
    version = F.col("c") % 3 + 1
    ident = F.concat_ws("::", "c", version).alias("cde_id")
    vector = a.select(split, F.col("q").alias("query_id"), ident, "rank", "score")
    lexical = b.select(split, F.col("q").alias("query_id"), F.concat_ws("::", "c", version + 1).alias("cde_id"), "rank", "score", F.when(F.col("rank") <= 2, "exact").when(F.col("rank") <= 6, "like").otherwise("fuzzy").alias("tier"))
    lines = t.lineitem.select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c"), "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    gold = lines.filter("l_discount >= 0.1").select(split, F.col("q").alias("query_id"), ident).distinct()
    queries = t.supplier.withColumn("q", F.col("s_suppkey")).join(t.part, F.col("p_partkey") == F.col("q")).select(split, F.col("q").alias("query_id"), F.col("p_name").alias("query_text_q3"), F.concat(F.lit("PV_TYPE: ENUM; PV: "), "p_type", F.lit(" | x")).alias("PV_BLOCK_SDE"), F.col("p_brand").alias("family"), F.lit("s").alias("query_source"))
    catalog = t.part.select(F.concat_ws("::", "p_partkey", F.col("p_partkey") % 3 + 1).alias("cde_id"), F.col("p_partkey").cast("string").alias("cde_publicid"), (F.col("p_partkey") % 3 + 1).cast("string").alias("cde_version"), F.col("p_name").alias("SHORT_NAME"), F.concat_ws(" ", "p_name", "p_brand").alias("LONG_NAME"), F.col("p_type").alias("DEFINITION"), F.lit(1).alias("PV_N"), F.lit("ENUM").alias("PV_TYPE"), F.concat(F.lit("PV_TYPE: ENUM; PV: "), "p_type").alias("PV_BLOCK_CDE"))
    provenance = lines.select(F.col("q").alias("query_id"), ident, F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("field"), F.col("l_quantity").alias("score"))
    return features.fixed_k_table(queries, catalog, gold, vector, lexical, provenance, 10, 5, [("A", "F"), ("N", "O")], {"A": 3.0, "N": 1.0})


_TABLE = f"""{_ARMS}, u AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.c, b.c) AS c, a.rank AS ar, a.score AS sa, b.rank AS br, b.score AS sb FROM (SELECT * FROM a WHERE rank <= 10) a FULL JOIN (SELECT * FROM b WHERE rank <= 5) b ON a.q = b.q AND a.c = b.c),
xb AS (SELECT q, c FROM b WHERE rank <= 2), kw AS (SELECT l_suppkey AS q, l_partkey AS c, max(l_quantity) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS af, count(*) AS hits FROM lineitem GROUP BY ALL),
z AS (SELECT q, c, ar, sa, br, CASE WHEN br <= 5 AND br IS NOT NULL AND br <= 6 THEN sb END AS sb FROM u)
SELECT CASE WHEN z.q % 5 = 0 THEN 'train' ELSE 'test' END AS split, z.q AS query_id, CAST(z.c AS VARCHAR) AS cde_publicid, z.c || '::' || (z.c % 3 + 1) AS cde_id, ar IS NOT NULL AS in_biencoder, br IS NOT NULL AS in_cdematch, false AS in_keyword, CAST(ar AS INTEGER) AS biencoder_rank, CAST(br AS INTEGER) AS cdematch_rank,
 (z.q, z.c) IN (SELECT (q, c) FROM g) AS is_label, (z.q, z.c) IN (SELECT (q, c) FROM xb) AS is_exact_candidate, sa / max(sa) OVER w AS be_relative, sb / 100.0::DOUBLE AS cm_relative, count(sa) OVER w AS be_count, len(pq.p_name) AS text_query_char_len, len(pc.p_name) AS text_cde_short_name_len, len(pq.p_name) / len(pc.p_name) AS text_query_cde_char_len_ratio,
 CASE WHEN pq.p_name IS NULL THEN false ELSE true END AS text_query_cde_pv_type_match, pq.p_brand AS text_family, CASE WHEN pq.p_type IS NULL THEN 0 ELSE 2 END AS pv_n_sde, 1 AS pv_n_cde, CASE WHEN lower(pq.p_type) = lower(pc.p_type) THEN 1 ELSE 0 END AS pv_exact_overlap_count, kw.af AS "kw_A_F", kw.hits AS kw_hits
FROM z JOIN part pq ON pq.p_partkey = z.q JOIN part pc ON pc.p_partkey = z.c LEFT JOIN kw ON kw.q = z.q AND kw.c = z.c WINDOW w AS (PARTITION BY z.q)"""


@query("m28_fixed_k_table", f"WITH {_TABLE}")
def fixed_k(t: Tables) -> DataFrame:
    out = _table(t)
    names = "split query_id cde_publicid cde_id in_biencoder in_cdematch in_keyword biencoder_rank cdematch_rank is_label is_exact_candidate be_relative cm_relative be_count text_query_char_len text_cde_short_name_len text_query_cde_char_len_ratio text_query_cde_pv_type_match text_family pv_n_sde pv_n_cde pv_exact_overlap_count kw_A_F kw_hits"
    return out.select(*names.split())


@query("m28_a40_audit", f"WITH t AS ({'WITH ' + _TABLE}), e AS (SELECT query_id, count(*) AS n, bool_or(is_label) AS pos FROM t GROUP BY query_id) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS queries, count(*) FILTER (NOT pos) AS without_positive, 0 AS repeated FROM e")
def fixed_k_audit(t: Tables) -> DataFrame:
    return pool.audit(_table(t), "query_id", "cde_publicid", "is_label")
