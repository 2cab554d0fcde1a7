"""Features of (query, candidate) pairs from their texts and value blocks, and the table of a fixed-size candidate pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import pool as P
from weftline.operators.dataset import forbid_columns, highest_id

#: Columns that tell the answer and are no features (fixed values).
FORBIDDEN = ("true_cde_id", "is_injected_gold", "true_rank", "true_score", "gold_cde_id", "gold_rank", "gold_score")


def _share(part: Column, whole: Column) -> Column:
    """Null of nothing."""
    return F.try_divide(part, whole)


def value_overlap(query: Column, catalog: Column) -> dict[str, Column]:
    """31 features of two parsed value blocks (see text.parse_block): how many there are, which are shared, the numbers among them, and what they are like.

    Counts and conditions are never null; a similarity is null where both sides are empty, a share where its side is.
    """
    a, b = query["norm"], catalog["norm"]
    n, m = F.size(a), F.size(b)
    both = F.array_intersect(a, b)
    x, y = T.number_set(a), T.number_set(b)
    nx, ny, nxy = F.size(x), F.size(y), F.size(F.array_intersect(x, y))

    def among(values: Column, kind) -> Column:
        return _share(F.size(F.filter(values, kind)), F.size(values))

    return {
        "pv_n_sde": n,
        "pv_n_cde": m,
        "pv_count_min": F.least(n, m),
        "pv_count_max": F.greatest(n, m),
        "pv_count_abs_diff": F.abs(n - m),
        "pv_count_ratio_min_over_max": _share(F.least(n, m), F.greatest(n, m)),
        "pv_both_have_pvs": (n > 0) & (m > 0),
        "pv_only_sde_has_pvs": (n > 0) & (m == 0),
        "pv_only_cde_has_pvs": (m > 0) & (n == 0),
        "pv_neither_has_pvs": (n == 0) & (m == 0),
        "pv_type_match": (query["kind"] != "") & (query["kind"] == catalog["kind"]),
        "pv_exact_overlap_count": F.size(both),
        "pv_exact_overlap_jaccard": T.jaccard(a, b, None),
        "pv_exact_overlap_frac_sde": _share(F.size(both), n),
        "pv_exact_overlap_frac_cde": _share(F.size(both), m),
        "pv_exact_overlap_count_nongeneric": F.size(F.filter(both, lambda v: ~T.is_generic(v))),
        "pv_numeric_n_sde": nx,
        "pv_numeric_n_cde": ny,
        "pv_numeric_overlap_count": nxy,
        "pv_numeric_jaccard": T.jaccard(x, y, None),
        "pv_numeric_sde_overlap_fraction": _share(nxy, nx),
        "pv_numeric_cde_overlap_fraction": _share(nxy, ny),
        "pv_numeric_both_have": (nx > 0) & (ny > 0),
        "pv_numeric_only_sde_has": (nx > 0) & (ny == 0),
        "pv_numeric_only_cde_has": (ny > 0) & (nx == 0),
        "pv_generic_frac_sde": among(a, T.is_generic),
        "pv_code_like_frac_sde": among(a, T.is_code),
        "pv_numeric_frac_sde": among(a, T.is_number),
        "pv_generic_frac_cde": among(b, T.is_generic),
        "pv_code_like_frac_cde": among(b, T.is_code),
        "pv_numeric_frac_cde": among(b, T.is_number),
    }


def catalog_block(block: Column, summary: Column | None, hydrate: bool = False, prefer_summary: bool = False) -> Column:
    """The catalog's value block to compare with: its own, or, if that is allowed, the summary where the block is empty or always.

    Core splits have thinned blocks on purpose, so filling them from the summary must be asked for.
    """
    own = F.when(F.trim(T.blank(block)) != "", block)
    if summary is None:
        return own
    other = F.when(F.trim(T.blank(summary)) != "", summary)
    return F.coalesce(other, own) if prefer_summary else F.coalesce(own, other) if hydrate else own


def add_value_overlap(pairs: DataFrame, catalog: DataFrame | None = None, cand: str = "cde_id", query_block: str = "PV_BLOCK_SDE", block: str = "PV_BLOCK_CDE", summary: str = "PV_SUMMARY", hydrate: bool = False, prefer_summary: bool = False) -> DataFrame:
    """pairs with the features of value_overlap; catalog (unique by cand) gives blocks or summaries that pairs lack."""
    rows = pairs
    if catalog is not None:
        extra = [c for c in (block, summary) if c in catalog.columns and c not in pairs.columns]
        rows = rows.join(catalog.select(cand, *extra), cand, "left")
    own = F.col(block) if block in rows.columns else F.lit(None).cast("string")
    chosen = catalog_block(own, F.col(summary) if summary in rows.columns else None, hydrate, prefer_summary)
    parsed = F.struct(T.parse_block(F.col(query_block)).alias("a"), T.parse_block(chosen).alias("b"))
    rows = rows.withColumn("_p", F.explode(F.array(parsed)))  # parsed once: projections are not merged across a generator
    return rows.select(*pairs.columns, *[c.alias(k) for k, c in value_overlap(F.col("_p.a"), F.col("_p.b")).items()])


def block_disagreement(rows: DataFrame, block: str = "PV_BLOCK_CDE", summary: str = "PV_SUMMARY") -> DataFrame:
    """One row: pairs that have both sources of values, and those whose values differ."""
    a, b = T.parse_block(F.col(block))["norm"], T.parse_block(F.col(summary))["norm"]
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return rows.agg(F.count_if(both).alias("both"), F.count_if(both & (F.sort_array(a) != F.sort_array(b))).alias("differ"))


def query_body(text: Column) -> Column:
    """A query's text without its value block."""
    return F.trim(F.regexp_replace(F.trim(T.blank(text)), r"(?s)\s*\|\s*PV_TYPE:.*$", ""))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def text_features(columns: Sequence[str], text: str = "query_text_q3", with_catalog: bool = False, block: Column | None = None) -> dict[str, Column]:
    """The features of a query's text, and with_catalog those of SHORT_NAME, LONG_NAME, DEFINITION, PV_N, PV_TYPE and of the pair.

    columns: the names that are there. Without pv_attached the text tells whether it has values; without PV_BLOCK_SDE
    there are 0 of them; without family or query_source these are empty.
    """
    have = set(columns)
    raw, body = F.trim(T.blank(F.col(text))), query_body(F.col(text))
    block = T.parse_block(F.trim(T.blank(F.col("PV_BLOCK_SDE")))) if block is None else block
    letters = F.length(F.regexp_replace(body, r"[^\p{L}]", ""))

    def trimmed(name: str) -> Column:
        return F.trim(T.blank(F.col(name))) if name in have else F.lit("")

    out = {
        "text_query_char_len": F.length(body),
        "text_query_word_count": T.word_count(body),
        "text_query_has_pv": F.coalesce(F.col("pv_attached").cast("boolean"), F.lit(False)) if "pv_attached" in have else raw.contains("| PV_TYPE:"),
        "text_query_pv_n": F.coalesce(block["declared"], F.size(block["norm"])) if "PV_BLOCK_SDE" in have else F.lit(0),
        "text_query_has_question_mark": body.contains("?"),
        "text_query_is_code_like": T.is_code_name(body),
        "text_query_upper_ratio": F.coalesce(_share(F.length(F.regexp_replace(body, r"[^\p{Lu}]", "")), letters), F.lit(0.0)),
        "text_query_digit_ratio": F.coalesce(_share(F.length(F.regexp_replace(body, r"[^\p{Nd}]", "")), F.length(body)), F.lit(0.0)),
        "text_query_underscore_count": _count(body, "_"),
        "text_query_pipe_count": _count(raw, "|"),
        "text_family": trimmed("family"),
        "text_query_source": trimmed("query_source"),
    }
    if not with_catalog:
        return out
    short, n = trimmed("SHORT_NAME"), F.coalesce(F.col("PV_N").cast("string").try_cast("int"), F.lit(0)) if "PV_N" in have else F.lit(0)
    kind = F.upper(trimmed("PV_TYPE"))
    return out | {
        "text_cde_short_name_len": F.length(short),
        "text_cde_long_name_len": F.length(trimmed("LONG_NAME")),
        "text_cde_definition_len": F.length(trimmed("DEFINITION")),
        "text_cde_has_pv": n > 0,
        "text_cde_pv_n": n,
        "text_query_cde_char_len_ratio": _share(F.length(body), F.length(short)),
        "text_query_cde_word_overlap": T.jaccard(_words(body), _words(short)),
        "text_query_cde_pv_type_match": (block["kind"] != "") & (block["kind"] == kind) if "PV_BLOCK_SDE" in have else F.lit(False),
    }


def add_text_features(pairs: DataFrame, catalog: DataFrame | None = None, cand: str = "cde_id", text: str = "query_text_q3") -> DataFrame:
    """pairs with the features of text_features; catalog (its first row by cand counts) adds those of the candidate."""
    made = text_features(pairs.columns, text, catalog is not None)
    if there := [c for c in made if c in pairs.columns]:
        raise ValueError(f"{there} are there already")
    rows = pairs
    if catalog is not None:
        columns = [c for c in ("SHORT_NAME", "LONG_NAME", "DEFINITION", "PV_N", "PV_TYPE") if c in catalog.columns]
        rows = rows.join(catalog.select(cand, *columns).dropDuplicates([cand]), cand, "left")
    columns, block = rows.columns, None
    if "PV_BLOCK_SDE" in columns:
        rows, block = rows.withColumn("_p", F.explode(F.array(T.parse_block(F.trim(T.blank(F.col("PV_BLOCK_SDE"))))))), F.col("_p")
    features = text_features(columns, text, catalog is not None, block)
    return forbid_columns(rows.select(*pairs.columns, *[c.alias(k) for k, c in features.items()]), FORBIDDEN)


def fixed_k_table(queries: DataFrame, catalog: DataFrame, gold: DataFrame, vector: DataFrame, lexical: DataFrame, provenance: DataFrame | None = None, vector_k: int = 20, lexical_k: int = 10, signals: Sequence[tuple[str, str]] = (), weights: dict[str, float] | None = None, hydrate: bool = False) -> DataFrame:
    """One row a (split, query_id, cde_publicid) of the pool, with flags, ranks, labels and all features.

    vector: split, query_id, cde_id, rank, score; lexical: the same and tier (exact, like, fuzzy); provenance: query_id,
    cde_id, rule, field, score; queries: split, query_id, query_text_q3, PV_BLOCK_SDE, family, query_source; catalog:
    cde_id, cde_publicid, cde_version and texts; gold: split, query_id, cde_id, any number a query. An id is
    publicid::version. The pool is the vector_k best and the lexical_k best, joined by public id; a candidate's version is
    the gold's, else the catalog's highest, else the one retrieved. Nothing is injected. A query's positive is any of its
    golds. is_exact_candidate comes from the whole lexical table and, like the label, is no feature.
    """
    keys = ["split", "query_id", "cde_publicid"]

    def public(df: DataFrame) -> DataFrame:
        return df.withColumn("cde_publicid", F.substring_index("cde_id", "::", 1))

    def best(df: DataFrame, prefix: str) -> list[Column]:
        mine = F.col("_arm") == prefix
        return [F.bool_or(mine).alias(f"in_{prefix}"), F.min(F.when(mine, F.col("rank"))).alias(f"{prefix}_rank"), F.max(F.when(mine, F.col("score").cast("double"))).alias(f"{prefix}_score")]

    columns = [*keys, "cde_id", F.col("rank").cast("int").alias("rank"), "score"]
    top = public(lexical).filter(F.col("rank") <= lexical_k)
    arm = F.when(F.col("tier") == "fuzzy", "keyword").otherwise("cdematch")
    rows = public(vector).filter(F.col("rank") <= vector_k).select(*columns, F.lit("biencoder").alias("_arm")).unionAll(top.select(*columns, arm.alias("_arm")))
    rows = rows.groupBy(*keys).agg(*best(rows, "biencoder"), *best(rows, "cdematch"), F.bool_or(F.col("_arm") == "keyword").alias("in_keyword"), F.min("cde_id").alias("_seen"))
    golds = public(gold).groupBy(*keys).agg(F.min("cde_id").alias("_gold"))
    highest = highest_id(catalog, "cde_publicid", "cde_id", "cde_version").select("cde_publicid", F.col("cde_id").alias("_high"))
    exact = public(lexical).filter("tier = 'exact'").select(*keys, F.lit(True).alias("is_exact_candidate")).distinct()
    rows = rows.join(golds, keys, "left").join(exact, keys, "left").join(highest, "cde_publicid", "left")
    rows = rows.withColumns({"cde_id": F.coalesce("_gold", "_high", "_seen"), "is_label": F.col("_gold").isNotNull(), "is_exact_candidate": F.coalesce("is_exact_candidate", F.lit(False))}).drop("_gold", "_high", "_seen")
    one = queries.dropDuplicates(["split", "query_id"])  # a query has a row a gold
    rows = rows.join(one.drop("cde_id", "cde_publicid"), ["split", "query_id"], "left").withColumn("_query", F.struct("split", "query_id"))
    rows = P.arm_features(rows, "_query", "biencoder_rank", "biencoder_score", "be")
    rows = P.arm_features(rows, "_query", "cdematch_rank", "cdematch_score", "cm", scale=100.0).drop("_query")
    rows = add_text_features(rows, catalog)
    if "PV_BLOCK_SDE" in rows.columns:
        rows = add_value_overlap(rows, catalog, hydrate=hydrate)
    if provenance is not None:
        found = P.keyword_features(public(provenance), "query_id", "cde_publicid", list(signals), weights or {})
        rows = rows.join(found.withColumnsRenamed({c: f"kw_{c}" for c in found.columns if c not in ("query_id", "cde_publicid")}), ["query_id", "cde_publicid"], "left")
    return rows
