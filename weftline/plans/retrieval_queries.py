"""Queries over retrieval, matching, pools and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import matching, metrics, pool, ranking, retrieval
from weftline.plans.registry import Tables, query

_BM25 = """
dt AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM dt),
tf AS (SELECT doc_id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(t) AS l, unnest(t) AS token FROM dt) GROUP BY doc_id, token),
d AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM q JOIN tf USING (token) JOIN d USING (token), n GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def bm25(t: Tables, k: int = 10) -> DataFrame:
    return retrieval.bm25_search(t.documents, t.benchmark.withColumnRenamed("text", "q"), "doc_id", "item_id", "text", "q", k)


@query("m1_m2_j17_bm25", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_top(t: Tables) -> DataFrame:
    return bm25(t)


@query("m2_score_margins", f"WITH {_BM25} SELECT item_id, max(score) AS s1, max(score) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS margin_2, max(score) - coalesce(max(CASE WHEN rank = 10 THEN score END), 0) AS margin_10 FROM r WHERE rank <= 10 GROUP BY item_id")
def margins(t: Tables) -> DataFrame:
    return retrieval.score_margins(bm25(t), "item_id")


@query(
    "flagship_bm25_recall",
    f"""WITH {_BM25}, g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT item_id, min(rank) AS hit FROM r JOIN g USING (item_id, doc_id) WHERE rank <= 10 GROUP BY item_id)
SELECT avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END) AS recall_1, avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END) AS recall_5, avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END) AS recall_10,
  avg(CASE WHEN hit <= 100 THEN 1.0 / hit ELSE 0.0 END) AS mrr_100, count(*) AS n_queries
FROM (SELECT DISTINCT item_id FROM g) LEFT JOIN h USING (item_id)""",
)
def flagship(t: Tables) -> DataFrame:
    """Recall of BM25 over the queries that some document contains."""
    gold = matching.contained_in(t.benchmark, t.documents.select("doc_id", F.col("text").alias("body")), "item_id", "text", "doc_id", "body")
    hits = metrics.first_hits(bm25(t), gold, "item_id", "doc_id")
    return metrics.ranking_metrics(gold.select("item_id").distinct(), hits, "item_id", ks=(1, 5, 10))


#: Catalog forms by the part's name, brand, type and size, and whether they are labelled.
_FORMS = {"n": False, "b": False, "t": False, "n_b": False, "n_t": False, "b_t": False, "n_b_t": False, "n_s": False, "b_s": False, "n_b_t_s": False, "n_b_t_s_labels": True}
_FIELDS = {"n": "p_name", "b": "p_brand", "t": "p_type", "s": "'size' || p_size"}


def _form_sql(form: str, labels: bool) -> str:
    parts = [f"'{f}: ' || {_FIELDS[f]}" if labels else _FIELDS[f] for f in form.removesuffix("_labels").split("_")]
    return f"SELECT p_partkey AS c, '{form}' AS form, concat_ws(' | ', {', '.join(parts)}) AS x FROM part"


_GRID_SQL = f"""qs AS (SELECT s_suppkey AS q, unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS qf, unnest([p_name, p_name || ' ' || p_brand, p_name || ' | PV_TYPE: ENUM; PV: size' || p_size, p_name || ' | PV: MISSING']) AS x FROM supplier JOIN part ON p_partkey = s_suppkey),
ds AS ({" UNION ALL ".join(_form_sql(f, x) for f, x in _FORMS.items())}),
dt AS (SELECT c, form, regexp_extract_all(lower(x), '[a-z0-9_]+') AS t FROM ds), n AS (SELECT form, count(*) AS n, avg(len(t)) AS a FROM dt GROUP BY form),
tf AS (SELECT c, form, token, count(*) AS tf, any_value(l) AS l FROM (SELECT c, form, len(t) AS l, unnest(t) AS token FROM dt) GROUP BY c, form, token),
d AS (SELECT form, token, count(*) AS df FROM tf GROUP BY ALL), qt AS (SELECT DISTINCT q, qf, unnest(regexp_extract_all(lower(x), '[a-z0-9_]+')) AS token FROM qs),
s AS (SELECT q, qf, form, c, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 9) AS score FROM qt JOIN tf USING (token) JOIN d USING (form, token) JOIN n USING (form) GROUP BY q, qf, form, c),
r AS (SELECT *, row_number() OVER (PARTITION BY q, qf, form ORDER BY score DESC, c) AS rank FROM s),
h AS (SELECT q, qf, form, rank AS hit FROM r WHERE rank <= 10 AND c = q),
k AS (SELECT * FROM (SELECT DISTINCT q FROM qs) CROSS JOIN (SELECT DISTINCT qf FROM qs) CROSS JOIN (SELECT DISTINCT form FROM ds)),
m AS (SELECT qf, form, avg(CASE WHEN hit <= 1 THEN 1.0 ELSE 0.0 END) AS r1, avg(CASE WHEN hit <= 5 THEN 1.0 ELSE 0.0 END) AS r5, round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 / hit ELSE 0.0 END), 9) AS mrr, count(*) AS n_queries FROM k LEFT JOIN h USING (q, qf, form) GROUP BY qf, form)
SELECT qf AS query_form, form AS catalog_form, r1 AS recall_1, r5 AS recall_5, mrr AS mrr_100, n_queries, row_number() OVER (ORDER BY r5 DESC, mrr DESC, r1 DESC, qf, form) AS place FROM m"""


@query("m4_m5_bm25_grid", f"WITH {_GRID_SQL}")
def bm25_grid(t: Tables) -> DataFrame:
    """Four forms of the query against eleven of the catalog text, one of them labelled, best first."""
    fields = {"n": F.col("p_name"), "b": F.col("p_brand"), "t": F.col("p_type"), "s": F.concat(F.lit("size"), "p_size")}
    texts = {(form, "labelled" if labels else "raw"): T.labelled_text({f: fields[f] for f in form.removesuffix("_labels").split("_")}, labels=labels) for form, labels in _FORMS.items()}
    name = F.col("p_name")
    forms = {"Q1": name, "Q2": F.concat_ws(" ", name, "p_brand"), "Q3": F.concat(name, F.lit(" | PV_TYPE: ENUM; PV: size"), "p_size"), "Q4": F.concat(name, F.lit(" | PV: MISSING"))}
    asked = t.supplier.select("s_suppkey").join(t.part, F.col("p_partkey") == F.col("s_suppkey"))
    gold = asked.select("s_suppkey", "p_partkey")
    catalog = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    out = retrieval.bm25_grid(catalog, asked, gold, "p_partkey", "s_suppkey", texts, forms, 10)
    return out.select("query_form", "catalog_form", "recall_1", "recall_5", "mrr_100", "n_queries", "place")


_NAMES = """c AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part), q AS (SELECT s_suppkey, (SELECT p_name FROM part WHERE p_partkey = s_suppkey) || ' Brand' || s_nationkey AS name FROM supplier)"""


def _catalog(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))


def _asked(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    return t.supplier.join(p, "s_suppkey", "left").select("s_suppkey", F.concat("p_name", F.lit(" Brand"), "s_nationkey").alias("name"))


_TOKENS = r"regexp_extract_all(lower(replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ')), '[a-z0-9]+')"


@query(
    "m6_j16_token_overlap",
    f"""WITH {_NAMES}, ct AS (SELECT DISTINCT p_partkey, unnest({_TOKENS}) AS t FROM c), rare AS (SELECT t FROM ct GROUP BY t HAVING count(*) <= 5000),
qt AS (SELECT s_suppkey, list_distinct({_TOKENS}) AS l FROM q), qe AS (SELECT s_suppkey, len(l) AS n, unnest(l) AS t FROM qt),
s AS (SELECT s_suppkey, p_partkey, count(*) / any_value(n) AS score FROM qe JOIN rare USING (t) JOIN ct USING (t) GROUP BY s_suppkey, p_partkey)
SELECT s_suppkey, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, p_partkey) AS rank FROM s) WHERE rank <= 5""",
)
def token_overlap(t: Tables) -> DataFrame:
    tokens = T.name_tokens(F.col("name"))
    return retrieval.token_overlap_search(_catalog(t), _asked(t), "p_partkey", "s_suppkey", tokens, tokens, 5)


_TFIDF = """n AS (SELECT count(DISTINCT p_partkey) AS n FROM ct), idf AS (SELECT t, ln((1 + n) / (1 + count(DISTINCT p_partkey))) + 1 AS idf FROM ct, n GROUP BY t, n),
cw AS (SELECT p_partkey, t, count(*) * any_value(idf) AS w FROM ct JOIN idf USING (t) GROUP BY p_partkey, t), cn AS (SELECT p_partkey, t, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS w FROM cw),
qw AS (SELECT s_suppkey, t, count(*) * any_value(idf) AS w FROM qt JOIN idf USING (t) GROUP BY s_suppkey, t), qn AS (SELECT s_suppkey, t, w / sqrt(sum(w * w) OVER (PARTITION BY s_suppkey)) AS v FROM qw),
s AS (SELECT s_suppkey, p_partkey, round(sum(w * v), 9) AS score FROM qn JOIN cn USING (t) GROUP BY s_suppkey, p_partkey)
SELECT s_suppkey, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, p_partkey) AS rank FROM s) WHERE rank <= 5"""


@query(
    "m6_m7_word_gram_tfidf",
    f"""WITH {_NAMES}, cl AS (SELECT p_partkey, {_TOKENS} AS l FROM c), ql AS (SELECT s_suppkey, {_TOKENS} AS l FROM q),
ct AS (SELECT p_partkey, unnest(l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS t FROM cl), qt AS (SELECT s_suppkey, unnest(l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS t FROM ql), {_TFIDF}""",
)
def word_tfidf(t: Tables) -> DataFrame:
    grams = retrieval.word_grams(F.col("name"))
    return retrieval.tfidf_search(_catalog(t), _asked(t), "p_partkey", "s_suppkey", grams, grams, 5)


@query(
    "m6_m7_char_gram_tfidf",
    f"""WITH {_NAMES}, cl AS (SELECT p_partkey, ' ' || unnest(string_split(lower(name), ' ')) || ' ' AS x FROM c), ql AS (SELECT s_suppkey, ' ' || unnest(string_split(lower(name), ' ')) || ' ' AS x FROM q),
ct AS (SELECT p_partkey, unnest(list_transform(range(1, len(x) - 1), lambda i: substr(x, i, 3)) || list_transform(range(1, greatest(len(x) - 2, 1)), lambda i: substr(x, i, 4)) || list_transform(range(1, greatest(len(x) - 3, 1)), lambda i: substr(x, i, 5))) AS t FROM cl),
qt AS (SELECT s_suppkey, unnest(list_transform(range(1, len(x) - 1), lambda i: substr(x, i, 3)) || list_transform(range(1, greatest(len(x) - 2, 1)), lambda i: substr(x, i, 4)) || list_transform(range(1, greatest(len(x) - 3, 1)), lambda i: substr(x, i, 5))) AS t FROM ql), {_TFIDF}""",
)
def char_tfidf(t: Tables) -> DataFrame:
    grams = retrieval.char_grams(F.col("name"))
    return retrieval.tfidf_search(_catalog(t), _asked(t), "p_partkey", "s_suppkey", grams, grams, 5)


@query("j14_exact_key_join", "SELECT s_suppkey, c.p_partkey FROM supplier JOIN part p ON p.p_partkey = s_suppkey JOIN part c ON lower(p.p_name) = lower(c.p_name)")
def exact_join(t: Tables) -> DataFrame:
    """Suppliers ask by a part's name, in capitals and with wide blanks; all parts of that name answer."""
    asked = t.supplier.join(t.part.withColumnRenamed("p_partkey", "s_suppkey"), "s_suppkey").select("s_suppkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t")).alias("name"))
    return retrieval.exact_join(asked, t.part, "s_suppkey", "p_partkey", "name", "p_name", nfkc=False)


@query(
    "m8_whole_containment",
    """WITH q AS (SELECT s_suppkey, lower(p_name) AS a FROM supplier JOIN part ON p_partkey = s_suppkey), c AS (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS b FROM part)
SELECT s_suppkey, p_partkey, CASE WHEN contains(b, a) THEN len(a) / len(b) END AS contained, CASE WHEN contains(a, b) THEN len(b) / len(a) END AS containing FROM q JOIN c ON a <> b AND (contains(a, b) OR contains(b, a))""",
)
def whole_containment(t: Tables) -> DataFrame:
    """All pairs of which one name contains the other, whatever their ids."""
    asked = t.supplier.join(t.part.select(F.col("p_partkey").alias("s_suppkey"), "p_name"), "s_suppkey").select("s_suppkey", F.col("p_name").alias("name"))
    return retrieval.containments(asked, _catalog(t), "s_suppkey", "p_partkey", "name", "name")


_VECTORS = """v AS (SELECT a.vec_id AS q, b.vec_id AS k, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, k) AS rank FROM v)"""


@query("j18_k3_k4_vector_search", f"WITH {_VECTORS} SELECT q, k, round(score, 6) AS score FROM vr WHERE rank <= 20")
def vector_search(t: Tables) -> DataFrame:
    """A query set, the ids divisible by 100, against all rows."""
    found = retrieval.vector_search(t.embeddings, t.embeddings.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "q"), "vec_id", "q", "embedding", 20)
    return found.select("q", F.col("vec_id").alias("k"), F.round("score", 6).alias("score"))


@query("m19_vector_margins", f"WITH {_VECTORS}, g AS (SELECT vec_id AS q, (vec_id + 1) % (SELECT count(*) FROM embeddings) AS k FROM embeddings WHERE vec_id % 100 = 0), t AS (SELECT q, score AS s, g.k IS NOT NULL AS gold, rank FROM vr LEFT JOIN g USING (q, k)) SELECT q, CAST(min(rank) FILTER (gold AND rank <= 20) AS INTEGER) AS gold_rank, round(max(s) FILTER (gold), 6) AS true_score, round(max(s) FILTER (NOT gold AND rank <= 20), 6) AS best_other, round(max(s) FILTER (gold) - max(s) FILTER (NOT gold AND rank <= 20), 6) AS margin FROM t GROUP BY q")
def margins_of_vectors(t: Tables) -> DataFrame:
    """The next id is taken as gold; queries as in the search."""
    n = t.embeddings.count()
    asked = t.embeddings.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "q")
    found = retrieval.vector_search(t.embeddings, asked, "vec_id", "q", "embedding", 20)
    gold = asked.select("q", ((F.col("q") + 1) % n).alias("vec_id"))
    out = retrieval.vector_margins(found, t.embeddings, asked, gold, "vec_id", "q", "embedding")
    return out.select("q", "gold_rank", *[F.round(c, 6).alias(c) for c in ("true_score", "best_other", "margin")])


@query("m9_rrf", "WITH a AS (SELECT l_suppkey AS q, l_partkey AS c, l_returnflag AS s, min(row) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS row FROM lineitem) GROUP BY ALL) SELECT q, c, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, row_number() OVER (PARTITION BY q ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, c) AS rrf_rank FROM a GROUP BY q, c")
def rrf(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = t.lineitem.select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c"), F.col("l_returnflag").alias("s"), F.row_number().over(w).alias("rank"))
    return ranking.reciprocal_rank_fusion(rows, "q", "c", "s", "rank")


_ARMS = """x AS (SELECT l_suppkey AS q, l_partkey AS c, max(l_extendedprice) AS score FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), y AS (SELECT l_suppkey AS q, l_partkey AS c, max(l_quantity) AS score FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM x) WHERE rank <= 20), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM y) WHERE rank <= 10),
g AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS c FROM lineitem WHERE l_discount >= 0.1),
p AS (SELECT coalesce(a.q, b.q) AS q, coalesce(a.c, b.c) AS c, a.q IS NOT NULL AS in_vec, b.q IS NOT NULL AS in_lex, a.rank AS vec_rank, b.rank AS lex_rank, a.score AS vec_score, b.score AS lex_score FROM a FULL JOIN b ON a.q = b.q AND a.c = b.c)"""


def _arms(t: Tables) -> tuple[DataFrame, DataFrame]:
    def arm(rows: DataFrame, score: str, k: int) -> DataFrame:
        best = rows.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c")).agg(F.max(score).alias("score"))
        return retrieval.top_ranked(best, "q", "c", k)

    return arm(t.lineitem.filter("l_returnflag = 'A'"), "l_extendedprice", 20), arm(t.lineitem.filter("l_returnflag <> 'A'"), "l_quantity", 10)


def _gold(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_discount >= 0.1").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c")).distinct()


def _pool(t: Tables) -> DataFrame:
    a, b = _arms(t)
    return pool.label(pool.union_arms({"vec": a, "lex": b}, "q", "c"), _gold(t), "q", "c")


@query("j4_j12_j13_j21_union_label", f"WITH {_ARMS} SELECT p.q, p.c, in_vec, in_lex, CAST(vec_rank AS INTEGER) AS vec_rank, CAST(lex_rank AS INTEGER) AS lex_rank, vec_score, lex_score, (p.q, p.c) IN (SELECT (q, c) FROM g) AS is_label, CASE WHEN in_vec AND in_lex THEN 'both' WHEN in_vec THEN 'vec' ELSE 'lex' END AS source FROM p")
def union_label(t: Tables) -> DataFrame:
    return _pool(t).withColumn("source", pool.source_name("vec", "lex"))


@query("j6_inject_gold", f"WITH {_ARMS}, cov AS (SELECT DISTINCT q FROM p WHERE (q, c) IN (SELECT (q, c) FROM g)) SELECT q, c, false AS injected FROM p UNION ALL SELECT q, min(c), true FROM g WHERE q NOT IN (SELECT q FROM cov) GROUP BY q")
def inject(t: Tables) -> DataFrame:
    return pool.inject_gold(_pool(t), _gold(t), t.part.select(F.col("p_partkey").alias("c")), "q", "c")


@query("j5_canonical_ids", "WITH s AS (SELECT p_partkey % 40 AS q, p_name AS pub, min(p_name || '::' || p_size) AS seen FROM part GROUP BY ALL), g AS (SELECT p_partkey % 40 AS q, p_name AS pub, min(p_name || '::' || p_size) AS gold_id FROM part WHERE p_size = 50 GROUP BY ALL), h AS (SELECT p_name AS pub, arg_max(p_name || '::' || p_size, p_size) AS best FROM part WHERE p_size < 30 GROUP BY p_name) SELECT q, pub, coalesce(gold_id, best, seen) AS cde_id FROM s LEFT JOIN g USING (q, pub) LEFT JOIN h USING (pub)")
def canonical(t: Tables) -> DataFrame:
    from weftline.operators.dataset import highest_id

    rows = t.part.select((F.col("p_partkey") % 40).alias("q"), F.col("p_name").alias("pub"), F.concat_ws("::", "p_name", "p_size").alias("cde_id"), "p_size")
    seen = rows.groupBy("q", "pub").agg(F.min("cde_id").alias("seen"))
    gold = rows.filter("p_size = 50").withColumnRenamed("cde_id", "gold_id")
    return pool.canonical_ids(seen, gold, highest_id(rows.filter("p_size < 30"), "pub", "cde_id", "p_size"), "q", "pub", "seen").select("q", "pub", "cde_id")


@query(
    "w3_w4_w8_arm_features",
    f"""WITH {_ARMS} SELECT q, c, vec_score / max(vec_score) OVER w AS v_relative, ln(1 + vec_rank - 1) AS v_log_rank, 1.0::DOUBLE / vec_rank AS v_reciprocal, CASE WHEN vec_rank IS NOT NULL THEN CAST(vec_rank <= 5 AS INT) END AS v_in_5, CASE WHEN vec_rank IS NOT NULL THEN CAST(vec_rank <= 10 AS INT) END AS v_in_10,
  max(CASE WHEN vec_rank = 1 THEN vec_score END) OVER w AS v_top, max(CASE WHEN vec_rank = 1 THEN vec_score END) OVER w - vec_score AS v_to_top, max(CASE WHEN vec_rank = 1 THEN vec_score END) OVER w - max(CASE WHEN vec_rank = 2 THEN vec_score END) OVER w AS v_lead,
  round(CASE WHEN stddev_samp(vec_score) OVER w > 0 THEN (vec_score - avg(vec_score) OVER w) / stddev_samp(vec_score) OVER w END, 6) AS v_z, count(vec_score) OVER w AS v_count FROM p WINDOW w AS (PARTITION BY q)""",
)
def arm_features(t: Tables) -> DataFrame:
    out = pool.arm_features(_pool(t), "q", "vec_rank", "vec_score", "v")
    return out.select("q", "c", *[F.round(x, 6).alias(x) if x == "v_z" else x for x in out.columns if x.startswith("v_")])


@query(
    "w5_score_features",
    f"""WITH {_ARMS} SELECT q, c, row_number() OVER o AS s_rank, max(lex_score) OVER w - lex_score AS s_to_top, coalesce(lex_score - lead(lex_score) OVER o, 0) AS s_to_next,
  round(CASE WHEN stddev_samp(lex_score) OVER w > 0 THEN (lex_score - avg(lex_score) OVER w) / stddev_samp(lex_score) OVER w ELSE 0 END, 6) AS s_z, CAST(lex_score IS NULL AS INT) AS s_missing
FROM p WINDOW w AS (PARTITION BY q), o AS (PARTITION BY q ORDER BY lex_score DESC NULLS LAST, c)""",
)
def score_features(t: Tables) -> DataFrame:
    out = pool.score_features(_pool(t), "q", "c", "lex_score")
    return out.select("q", "c", "s_rank", "s_to_top", "s_to_next", F.round("s_z", 6).alias("s_z"), "s_missing")


@query("w6_w7_per_source_rank", "SELECT q, c, r, row_number() OVER (PARTITION BY q, r ORDER BY s DESC, c) AS rank FROM (SELECT l_suppkey AS q, l_partkey AS c, l_returnflag AS r, max(l_quantity) AS s FROM lineitem GROUP BY ALL)")
def per_source(t: Tables) -> DataFrame:
    best = t.lineitem.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c"), F.col("l_returnflag").alias("r")).agg(F.max("l_quantity").alias("s"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q", "r").orderBy(F.desc("s"), "c"))).drop("s")


@query(
    "m10_keyword_features",
    """WITH v AS (SELECT l_suppkey AS q, l_partkey AS c, l_returnflag AS rule, l_linestatus AS field, l_quantity AS score, round(CASE l_returnflag WHEN 'A' THEN 3.0 WHEN 'N' THEN 1.0 ELSE 0 END::DOUBLE * l_quantity, 9) AS w FROM lineitem),
b AS (SELECT q, c, rule, field, row_number() OVER (PARTITION BY q, c ORDER BY w DESC, score DESC, rule DESC, field DESC) AS n FROM v)
SELECT q, c, max(score) FILTER (v.rule = 'A' AND v.field = 'F') AS "A_F", max(score) FILTER (v.rule = 'A' AND v.field = 'O') AS "A_O", max(score) FILTER (v.rule = 'N' AND v.field = 'O') AS "N_O", count(*) AS hits, count(DISTINCT v.rule) AS rules,
 any_value(b.rule) AS best_rule, any_value(b.field) AS best_field, CASE WHEN "A_F" IS NULL THEN "A_O" WHEN "A_O" IS NULL THEN "A_F" ELSE ("A_F" + "A_O") / 2 END AS "A_mean", "N_O" AS "N_mean"
FROM v JOIN (SELECT * FROM b WHERE n = 1) b USING (q, c) GROUP BY q, c""",
)
def keyword_features(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c"), F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("field"), F.col("l_quantity").alias("score"))
    return pool.keyword_features(rows, "q", "c", [("A", "F"), ("A", "O"), ("N", "O")], {"A": 3.0, "N": 1.0})


@query("m15_fuzzy_candidates", "SELECT q, c, rule, field, score FROM (SELECT l_suppkey AS q, l_partkey AS c, l_returnflag AS rule, l_linestatus AS field, l_quantity AS score, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_quantity DESC, l_returnflag, l_linestatus) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))) WHERE n = 1")
def fuzzy(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("c"), F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("field"), F.col("l_quantity").alias("score"))
    signals = t.spark.createDataFrame([("A", "F"), ("N", "O")], "rule string, field string")
    return retrieval.fuzzy_candidates(rows, signals, "q", "c").select("q", "c", "rule", "field", "score")


@query("m29_vocabulary", "SELECT p_partkey, coalesce(code, 0) AS code FROM part LEFT JOIN (SELECT p_type, row_number() OVER (ORDER BY p_type) AS code FROM (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO')) USING (p_type)")
def vocabulary(t: Tables) -> DataFrame:
    v = pool.fixed_vocabulary(t.part.filter("p_type <> 'PROMO'"), "p_type")
    return pool.encode(t.part, v, "p_type", "code").select("p_partkey", "code")


@query("m35_allowance_sweep", "SELECT rate, count(*) FILTER (rate >= 1 OR (rate > 0 AND share < rate)) AS allowed FROM (SELECT ('0x' || substr(sha1('sweep|' || event_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS share FROM events), (SELECT unnest([0.0, 0.25, 0.5, 1.0]::DOUBLE[]) AS rate) GROUP BY rate")
def sweep(t: Tables) -> DataFrame:
    from weftline.functions.ids import hash_share

    rates = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])
    rows = t.events.select(hash_share(F.col("event_id"), "sweep").alias("share"), F.explode(rates).alias("rate"))
    return rows.groupBy("rate").agg(F.count_if((F.col("rate") >= 1) | ((F.col("rate") > 0) & (F.col("share") < F.col("rate")))).alias("allowed"))


@query("m23_training_pairs", "SELECT count(*) AS rows, count(*) FILTER (c_custkey IS NULL) AS no_text, count(*) FILTER (o_totalprice < 1000) AS empty_query FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def training_pairs(t: Tables) -> DataFrame:
    both = t.orders.join(t.customer.filter("c_acctbal > 0").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("c_custkey").isNull()).alias("no_text"), F.count_if(F.col("o_totalprice") < 1000).alias("empty_query"))


@query("m20_m21_m40_hard_negatives", f"WITH {_ARMS} SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN rank BETWEEN 3 AND 8 THEN 0 ELSE 1 END, sha1('n|' || c), c) AS n FROM a WHERE (q, c) NOT IN (SELECT (q, c) FROM g)) WHERE n <= 8")
def hard_negatives(t: Tables) -> DataFrame:
    return retrieval.hard_negatives(_arms(t)[0], _gold(t), "q", "c", 3, 8, 8, "n").select("q", "c")


@query("m41_m42_rank_band", f"WITH {_ARMS} SELECT q, list(c ORDER BY rank)[3:8] AS band FROM a GROUP BY q")
def rank_band(t: Tables) -> DataFrame:
    lists = _arms(t)[0].groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("l"))
    return lists.select("q", F.slice("l", 3, 6).alias("band"))


@query("t22_t23_t24_value_features", """WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus) || ['A']) AS b FROM lineitem GROUP BY 1), o AS (SELECT *, len(list_intersect(a, b)) AS n FROM s)
SELECT l_orderkey, true AS both_present, CAST(n AS INTEGER) AS shared, n / (len(a) + len(b) - n) AS value_jaccard, n / len(a) AS a_covered, n / len(b) AS b_covered, n = len(a) AND n = len(b) AS same_set, least(len(a), len(b)) / greatest(len(a), len(b)) AS size_ratio, 0.0::DOUBLE AS generic_a FROM o""")
def value_features(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.array_union(F.collect_set("l_linestatus"), F.array(F.lit("A"))).alias("b"))
    features = pool.value_features(F.col("a"), F.col("b"))
    return rows.select("l_orderkey", *[features[n].alias(n) for n in ("both_present", "shared", "value_jaccard", "a_covered", "b_covered", "same_set", "size_ratio", "generic_a")])


@query("m20_m40_mined_lists", f"WITH {_ARMS}, k AS (SELECT s_suppkey AS q, 'group ' || s_nationkey AS x FROM supplier), gl AS (SELECT x, list_sort(list_distinct(list(c))) AS golds FROM g JOIN k USING (q) GROUP BY x), bs AS (SELECT x, c, max(score) AS score FROM a JOIN k USING (q) GROUP BY x, c), o AS (SELECT x, list(c ORDER BY score DESC, c) AS candidates FROM bs WHERE (x, c) NOT IN (SELECT (x, c) FROM g JOIN k USING (q)) GROUP BY x) SELECT x AS query_key, golds, candidates FROM gl LEFT JOIN o USING (x)")
def mined(t: Tables) -> DataFrame:
    asked = t.supplier.select(F.col("s_suppkey").alias("q"), F.concat(F.lit(" GROUP  "), "s_nationkey").alias("x"))
    return retrieval.mined_lists(_arms(t)[0], asked, _gold(t), "c", "q", "x", nfkc=False).drop("scores")
