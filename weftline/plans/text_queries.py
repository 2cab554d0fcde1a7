"""Queries over the text and id functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import ids, text
from weftline.plans.registry import Tables, query


@query(
    "t1_t2_query_normal_form",
    r"""
SELECT doc_id, trim(regexp_replace(f, '\s+', ' ', 'g')) AS normal, lower(trim(regexp_replace(f, '\s+', ' ', 'g'))) AS key
FROM (SELECT doc_id, translate(coalesce(text, ''), '‘’‚‛′‵“”„‟«»‐‑‒–—―−⁃' || chr(160), '''''''''''''""""""-------- ') AS f FROM documents)
""",
)
def normal_form(t: Tables) -> DataFrame:
    """Without the compatibility form, which SQL lacks; tests cover it."""
    c = F.col("text")
    return t.documents.select("doc_id", text.normalize_query(c, nfkc=False).alias("normal"), text.exact_key(c, nfkc=False).alias("key"))


@query("t1_normal_form_nfkc")
def normal_form_nfkc(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_query(F.col("text")).alias("normal"))


@query(
    "t3_t4_t5_tokens",
    r"""
SELECT p_partkey,
  regexp_extract_all(lower(replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')), '[a-z0-9]+') AS names,
  list_filter(regexp_extract_all(lower(n), '[a-z0-9_]+'), lambda x: len(x) >= 2) AS plain,
  list_filter(string_split(trim(regexp_replace(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 2) AS alt
FROM (SELECT p_partkey, p_name || '_Of' || p_brand || p_type AS n FROM part)
""",
)
def tokens(t: Tables) -> DataFrame:
    n = F.concat("p_name", F.lit("_Of"), "p_brand", "p_type")
    return t.part.select("p_partkey", text.TOKENIZERS["names"](n).alias("names"), text.TOKENIZERS["baseline"](n, 2).alias("plain"), text.TOKENIZERS["altaware"](n, 2).alias("alt"))


@query(
    "t6_t7_t8_keys",
    r"""
SELECT p_partkey, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS leakage,
  upper(translate(n, '();-_|:$[]''"%*&#@{}', '')) AS term, regexp_replace(upper(n), '[^ A-Z0-9]', '', 'g') AS words,
  regexp_replace(upper(n), '[^A-Z0-9]', '', 'g') AS joined, trim(regexp_replace(upper(n), '[^A-Z0-9]+', ' ', 'g')) AS spaced
FROM (SELECT p_partkey, p_name || ' (' || p_brand || '), ' || p_type || '?' AS n FROM part)
""",
)
def keys(t: Tables) -> DataFrame:
    n = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("), "), "p_type", F.lit("?"))
    forms = text.NORMALIZERS["exact"]
    return t.part.select("p_partkey", text.leakage_key(n).alias("leakage"), forms["P"](n).alias("term"), forms["A"](n).alias("words"), forms["joined"](n).alias("joined"), text.NORMALIZERS["v1"]["P"](n).alias("spaced"))


def _block():
    """A value block out of a part's row."""
    return F.concat(F.lit("PV_TYPE: Enum(n=3); PV: "), F.col("p_name"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |  "), F.upper("p_name"), F.lit(". | | Not  Reported | C"), F.col("p_partkey").cast("string"))


_BLOCK_SQL = "'PV_TYPE: Enum(n=3); PV: ' || p_name || ' | ' || p_size || ' |  ' || upper(p_name) || '. | | Not  Reported | C' || p_partkey"


@query("t9_strip_block", f"SELECT p_partkey, p_name AS name FROM (SELECT *, p_name || ' | ' || {_BLOCK_SQL} AS q FROM part)")
def strip_block(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.without_value_block(F.concat("p_name", F.lit(" | "), _block())).alias("name"))


@query(
    "t10_t11_t31_value_block",
    """
SELECT p_partkey, 'ENUM' AS kind, 3 AS declared, [p_name, CAST(p_size AS VARCHAR), 'Not  Reported', 'C' || p_partkey] AS raw,
  [p_name, CAST(p_size AS VARCHAR), 'not reported', 'c' || p_partkey] AS norm, true AS well_formed, 4 AS n_values, 1 AS n_generic,
  CASE WHEN p_partkey >= 10 THEN 2 ELSE 1 END AS n_code, false AS declared_matches
FROM part
""",
)
def value_block(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", text.parse_block(_block()).alias("b")).select("p_partkey", "b.*")
    n = F.size("norm")
    return rows.withColumns({"n_values": n, "n_generic": F.size(F.filter("norm", text.is_generic)), "n_code": F.size(F.filter("norm", text.is_code)), "declared_matches": F.col("declared") == n})


@query(
    "t12_t13_t14_value_flags",
    r"""
SELECT event_id, v, n IN ('n/a','na','n.a','not applicable','unknown','unk','not reported','not provided','not specified','unspecified','other','other, specify','none','missing') AS generic,
  regexp_matches(trim(lower(v)), '^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)$') AS number,
  CASE WHEN regexp_matches(trim(lower(v)), '^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)$') THEN TRY_CAST(trim(lower(v)) AS DOUBLE) END AS as_number,
  NOT contains(n, ' ') AND n <> '' AND (regexp_matches(n, '^-?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)$') OR regexp_matches(n, '^c[0-9]{2,7}$')
    OR regexp_matches(n, '^[a-z][0-9]{2}(\.[0-9]{1,4})?$') OR regexp_matches(n, '^[a-z]{1,4}[-_]?[0-9]{2,7}[a-z0-9]*$')) AS code
FROM (SELECT event_id, v, trim(regexp_replace(lower(v), '\s+', ' ', 'g'), ' ".,;:''' || chr(9) || chr(10) || chr(13)) AS n
  FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'N.A.' WHEN 2 THEN '.' || (event_id % 97)
    WHEN 3 THEN 'C' || event_id WHEN 4 THEN event_type WHEN 5 THEN 'Other,  specify' ELSE event_type || '-' || event_id END AS v FROM events))
""",
)
def value_flags(t: Tables) -> DataFrame:
    e, name = F.col("event_id"), F.col("event_id").cast("string")
    v = F.when(e % 7 == 0, name).when(e % 7 == 1, "N.A.").when(e % 7 == 2, F.concat(F.lit("."), (e % 97).cast("string"))).when(e % 7 == 3, F.concat(F.lit("C"), name))
    v = v.when(e % 7 == 4, F.col("event_type")).when(e % 7 == 5, "Other,  specify").otherwise(F.concat("event_type", F.lit("-"), name))
    c = F.col("v")
    return t.events.select("event_id", v.alias("v")).select("event_id", "v", text.is_generic(c).alias("generic"), text.is_number(c).alias("number"), text.to_number(c).alias("as_number"), text.is_code(c).alias("code"))


@query(
    "t15_number_overlap",
    """
WITH s AS (SELECT l_orderkey, list_distinct(list(CAST(l_linenumber AS DOUBLE))) AS a, list_distinct(list(CAST(CAST(l_quantity AS INT) % 7 AS DOUBLE))) AS b FROM lineitem GROUP BY l_orderkey),
o AS (SELECT *, len(list_intersect(a, b)) AS n FROM s)
SELECT l_orderkey, CAST(len(a) AS INTEGER) AS n_numeric_a, CAST(len(b) AS INTEGER) AS n_numeric_b, CAST(n AS INTEGER) AS n_numeric_overlap,
  n / (len(a) + len(b) - n) AS numeric_jaccard, n / len(a) AS numeric_a_fraction, n / len(b) AS numeric_b_fraction,
  true AS both_numeric, false AS only_a_numeric, false AS only_b_numeric
FROM o
""",
)
def number_overlap(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("a"), F.collect_list((F.col("l_quantity").cast("int") % 7).cast("string")).alias("b"))
    return rows.select("l_orderkey", *[c.alias(n) for n, c in text.number_overlap(F.col("a"), F.col("b")).items()])


@query(
    "t16_t18_catalog_text",
    """
SELECT p_partkey AS id, 'short_name: ' || p_name || ' | long_name: ' || p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' | question: ' || p_type END AS labelled,
  p_name || ' ; ' || p_brand || ' ; ' || CASE WHEN p_size % 3 = 0 THEN '[NONE]' ELSE p_type END AS bare
FROM part
""",
)
def catalog_text(t: Tables) -> DataFrame:
    question = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    columns = {"short_name": F.col("p_name"), "long_name": F.col("p_brand"), "question": question}
    fields = {f: columns[f] for f in text.parse_recipe("v1_v2_v6")}
    rows = t.part.select(F.col("p_partkey").alias("id"), text.labelled_text(fields).alias("labelled"), text.labelled_text(fields, " ; ", False, "[NONE]").alias("bare"))
    return rows.filter("labelled <> ''").dropDuplicates(["id"])


@query(
    "t19_value_kind",
    """
SELECT o_custkey, CASE WHEN NOT bool_or(o_orderkey % 3 = 0) THEN 'ENUM' ELSE 'ENUM' END AS status_kind,
  CASE WHEN max(m) - min(m) + 1 = count(DISTINCT m) THEN 'ORDINAL_INT_' || min(m) || '_' || max(m) ELSE 'ENUM' END AS month_kind,
  CASE WHEN NOT (bool_or(y = 'Yes') AND bool_or(y = 'no')) THEN 'ENUM' WHEN bool_or(y = 'Unknown') THEN 'BINARY_WITH_UNKNOWN' ELSE 'BINARY' END AS answer_kind
FROM (SELECT o_custkey, o_orderkey, month(o_orderdate) AS m, CASE o_orderkey % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Yes' WHEN 3 THEN 'Yes' ELSE 'no' END AS y FROM orders)
GROUP BY o_custkey
""",
)
def value_kind(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 5
    answer = F.when(k == 0, "Unknown").when(k.isin(1, 3), "Yes").otherwise("no")
    rows = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.collect_set(F.month("o_orderdate").cast("string")).alias("m"), F.collect_set(answer).alias("y"))
    return rows.select("o_custkey", text.value_kind(F.col("s")).alias("status_kind"), text.value_kind(F.col("m")).alias("month_kind"), text.value_kind(F.col("y")).alias("answer_kind"))


@query(
    "t25_t26_text_features",
    r"""
SELECT doc_id, CAST(len(x) AS INTEGER) AS n_chars, CAST(len(regexp_extract_all(x, '[A-Za-z0-9]+')) AS INTEGER) AS n_words,
  coalesce(len(regexp_replace(x, '[^A-Z]', '', 'g')) / nullif(len(regexp_replace(x, '[^A-Za-z]', '', 'g')), 0), 0) AS upper_share,
  coalesce(len(regexp_replace(x, '[^0-9]', '', 'g')) / nullif(len(x), 0), 0) AS digit_share,
  CAST(len(x) - len(replace(x, '|', '')) AS INTEGER) AS n_bars, regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9_]*$') AND (contains(source, '_') OR (source <> lower(source) AND source <> upper(source))) AS code_name
FROM (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS source FROM documents)
""",
)
def text_features(t: Tables) -> DataFrame:
    x = text.blank(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.length(x).alias("n_chars"),
        text.word_count(x).alias("n_words"),
        text.share_of(x, "A-Z", "A-Za-z").alias("upper_share"),
        text.share_of(x, "0-9").alias("digit_share"),
        (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))).alias("n_bars"),
        text.is_code_name(F.col("source")).alias("code_name"),
    )


@query(
    "t27_t28_t29_t30_set_overlap",
    """
WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus) || ['A']) AS b FROM lineitem GROUP BY l_orderkey),
o AS (SELECT *, len(list_intersect(a, b)) AS n, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS rest FROM s)
SELECT l_orderkey, n / (len(a) + len(b) - n) AS jaccard, rest = 0 AS subset, rest = 0 AND len(a) < len(b) AS proper, 0.0::DOUBLE AS of_empty, CAST(NULL AS DOUBLE) AS null_of_empty FROM o
""",
)
def set_overlap(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.array_union(F.collect_set("l_linestatus"), F.array(F.lit("A"))).alias("b"))
    a, b, none = F.col("a"), F.col("b"), F.array().cast("array<string>")
    return rows.select("l_orderkey", text.jaccard(a, b).alias("jaccard"), text.is_subset(a, b).alias("subset"), text.is_subset(a, b, True).alias("proper"), text.jaccard(none, none).alias("of_empty"), text.jaccard(none, none, None).alias("null_of_empty"))


@query(
    "t32_f6_f7_labels",
    """
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)^eco') THEN 'CHEAP' WHEN regexp_matches(p_type, 'A') THEN 'HAS_A' ELSE 'OTHER' END AS label,
  starts_with(p_brand, 'Brand#1') OR p_type IN ('SMALL', 'LARGE') OR regexp_matches(p_name, '(?i)^red') AS excluded,
  CASE WHEN regexp_matches(p_name, '^[a-z]+ [a-z]+$') THEN CASE WHEN len(p_name) > 9 THEN 2 ELSE 1 END ELSE 0 END AS quality
FROM part
""",
)
def labels(t: Tables) -> DataFrame:
    name = F.col("p_name")
    excluded = F.col("p_brand").startswith("Brand#1") | F.col("p_type").isin("SMALL", "LARGE") | name.rlike("(?i)^red")
    quality = F.when(name.rlike("^[a-z]+ [a-z]+$"), F.when(F.length(name) > 9, 2).otherwise(1)).otherwise(0)
    return t.part.select("p_partkey", text.first_label(F.col("p_type"), [("(?i)^eco", "CHEAP"), ("A", "HAS_A")]).alias("label"), excluded.alias("excluded"), quality.alias("quality"))


@query(
    "t33_t34_t35_t36_tiers",
    """
WITH s AS (SELECT *, CAST(floor(l_quantity) AS INT) % 6 AS v, CAST(floor(l_extendedprice) AS INT) % 6 AS m, l_linenumber AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 6 END AS status_rank, n > 3 AS enumerated,
  CASE WHEN v <= 0 THEN NULL WHEN v >= n THEN 0.0 WHEN v >= n * 0.5 THEN -0.01 ELSE -0.02 END::DOUBLE AS tier,
  CASE WHEN v >= n OR m >= n THEN 0.0 WHEN (v > 0 AND v >= n * 0.5) OR (m > 0 AND m >= n * 0.5) THEN -0.01 WHEN v > 0 OR m > 0 THEN -0.02 END::DOUBLE AS separate,
  CASE WHEN v >= n THEN 'PV' WHEN m >= n THEN 'VM' WHEN v > 0 AND v >= n * 0.5 THEN 'PV' WHEN m > 0 AND m >= n * 0.5 THEN 'VM' WHEN v > 0 THEN 'PV' WHEN m > 0 THEN 'VM' END AS part
FROM s
""",
)
def tiers(t: Tables) -> DataFrame:
    v, m, n = F.floor("l_quantity").cast("int") % 6, F.floor("l_extendedprice").cast("int") % 6, F.col("l_linenumber")
    status = F.when(F.col("l_returnflag") == "A", "Standard ").when(F.col("l_returnflag") == "R", "QUALIFIED").otherwise("Historical")
    both = text.value_tier_separate(v, m, n)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", text.status_rank(status).alias("status_rank"), (n > 3).alias("enumerated"), text.value_tier(v, n).alias("tier"), both["adjust"].alias("separate"), both["part"].alias("part"))


@query(
    "t38_t39_t45_t49_small_functions",
    """
SELECT c_custkey, CAST(CAST(floor(c_nationkey * 1000.0 / 24 + 0.5) / 1000 AS DECIMAL(20,3)) AS VARCHAR) AS ratio,
  regexp_matches(c_name, '^[A-Za-z0-9_.:-]+$') AS safe, c_mktsegment IN ('MACHINERY') AS flag,
  CASE WHEN c_acctbal > 0 THEN (c_acctbal + c_nationkey) / 2 ELSE c_nationkey END::DOUBLE AS mean
FROM customer
""",
)
def small_functions(t: Tables) -> DataFrame:
    flag = F.when(F.col("c_mktsegment") == "MACHINERY", " True ").otherwise("no")
    balance = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return t.customer.select("c_custkey", text.half_up(F.col("c_nationkey"), F.lit(24)).alias("ratio"), text.safe_token(F.col("c_name")).alias("safe"), text.to_bool(flag).alias("flag"), text.row_mean(balance, F.col("c_nationkey").cast("double")).alias("mean"))


@query(
    "t37_t42_t43_f12_ids",
    """
SELECT event_id, sha1('ALT::' || event_id) AS query_id, ('0x' || substr(sha1('7|' || event_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS share,
  ('0x' || substr(sha1('7|' || event_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < 0.3 AS allowed,
  ('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT % 2147483647 AS stable, CAST(user_id AS VARCHAR) AS public_id, [CAST(event_id % 10 AS INT), -1, 3] AS version
FROM events
""",
)
def id_functions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    name, version = F.concat_ws("::", "user_id", "event_id"), F.concat((e % 10).cast("string"), F.lit(".x.3"))
    return t.events.select("event_id", ids.sha_id("ALT", e).alias("query_id"), ids.hash_share(e, 7).alias("share"), ids.allowed(e, 0.3, 7).alias("allowed"), ids.stable_int(e.cast("string")).alias("stable"), ids.public_id(name).alias("public_id"), ids.version_key(version).alias("version"))


@query(
    "t40_t41_query_variants",
    """
SELECT p_partkey, 'ALT_NAME: ' || p_name || ' | ' || b AS q2, p_name || ' | ' || b AS q3, p_name || ' | ' || CASE WHEN p_size % 2 = 0 THEN b ELSE '[PV]' END AS q4, p_name AS style
FROM (SELECT *, 'PV_TYPE: ENUM(n=1); PV: ' || p_type AS b FROM part)
""",
)
def query_variants(t: Tables) -> DataFrame:
    block = F.concat(F.lit("PV_TYPE: ENUM(n=1); PV: "), "p_type")
    q2 = F.concat_ws(" | ", F.concat(F.lit("ALT_NAME: "), "p_name"), block)
    bare = F.trim(F.regexp_replace(text.without_value_block(q2), "^(ALT_NAME|REF_TEXT):", ""))
    return t.part.select("p_partkey", q2.alias("q2"), F.concat_ws(" | ", "p_name", block).alias("q3"), F.concat_ws(" | ", "p_name", F.when(F.col("p_size") % 2 == 0, block).otherwise("[PV]")).alias("q4"), bare.alias("style"))


@query(
    "t47_t48_grid",
    """
SELECT c_custkey, CASE WHEN d <= 2 THEN 1.0 WHEN d <= 6.5 THEN 3.0 ELSE 10.0 END::DOUBLE AS nearest,
  CASE WHEN d <= 2 THEN NULL WHEN d <= 6.5 THEN 1.0 ELSE 3.0 END::DOUBLE AS below, CASE WHEN d <= 2 THEN 3.0 WHEN d <= 6.5 THEN 10.0 END::DOUBLE AS above,
  CAST(ceil(2.0 * 64 / (d + 2)) AS BIGINT) AS batch
FROM (SELECT c_custkey, CAST(c_nationkey % 12 AS DOUBLE) AS d FROM customer)
""",
)
def grid(t: Tables) -> DataFrame:
    from weftline.operators.ranking import nearest_grid

    d = (F.col("c_nationkey") % 12).cast("double")
    g = nearest_grid(d, [1, 3, 10])
    return t.customer.select("c_custkey", g["nearest"].alias("nearest"), g["below"].alias("below"), g["above"].alias("above"), F.ceil(F.lit(128.0) / (d + 2)).alias("batch"))
