"""Catalog and query sets: filters with reports, allow-lists, dedup, denormalising, splits, leakage."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ids import public_id, version_key
from weftline.functions.text import blank, leakage_key
from weftline.operators.ranking import first_rows


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def forbid_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if found := [c for c in columns if c in df.columns]:
        raise ValueError(f"these columns tell the answer: {found}")
    return df


def retired(status: Column) -> Column:
    return F.upper(blank(status)).contains("RETIRED")


def trial(context: Column) -> Column:
    return F.upper(F.trim(blank(context))).isin("TEST", "TRAINING")


def filter_eligible(df: DataFrame, status: str, context: str, mode: str = "production") -> DataFrame:
    """mode none keeps all rows; production drops retired ones and those of trial contexts."""
    if mode not in ("none", "production"):
        raise ValueError(f"unknown mode {mode}")
    return df if mode == "none" else df.filter(~retired(F.col(status)) & ~trial(F.col(context)))


def eligibility_report(df: DataFrame, status: str, context: str) -> DataFrame:
    """One row: rows before and after, and those dropped for the status only, the context only, both."""
    a, b = retired(F.col(status)), trial(F.col(context))
    return df.agg(F.count(F.lit(1)).alias("before"), F.count_if(~a & ~b).alias("after"), F.count_if(a & ~b).alias("status_only"), F.count_if(~a & b).alias("context_only"), F.count_if(a & b).alias("both"))


def current_versions(df: DataFrame, public: str, version: str, mode: str = "highest", flag: str | None = None) -> DataFrame:
    """mode off: all rows; highest: the highest dotted version of each public id; flag: rows where that column is true."""
    if mode == "off":
        return df
    if mode == "flag":
        return df.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return first_rows(df, [public], [version_key(F.col(version)).desc()])


def pick_version(df: DataFrame, public: str, version: str, status: str) -> DataFrame:
    """A version per public id, released ones before others, then the highest."""
    return first_rows(df, [public], [F.desc(F.upper(blank(F.col(status))) == "RELEASED"), version_key(F.col(version)).desc()])


def highest_id(df: DataFrame, public: str, name: str, version: str) -> DataFrame:
    return df.groupBy(public).agg(F.max_by(name, version_key(F.col(version))).alias(name))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, report of keys with several rows and how many)."""
    return first_rows(df, keys, order), df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("copies > 1")


def denormalise(master: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[Column], str]], keys: Sequence[str]) -> DataFrame:
    """Left joins of parts (table, order, column), the first row of each key of a part."""
    for part, order, column in parts:
        master = master.join(first_rows(part, keys, order).select(*keys, column), list(keys), "left")
    return master


def split_by_catalog(df: DataFrame, catalog: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    ids = catalog.select(key).distinct()
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")


def groups_with(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """Rows of the groups in which condition holds for a row."""
    return df.withColumn("_any", F.bool_or(F.coalesce(condition, F.lit(False))).over(Window.partitionBy(*keys))).filter("_any").drop("_any")


def drop_train_without_positive(df: DataFrame, split: str, query: str, label: str, train: str = "train") -> DataFrame:
    """Train queries without a positive row leave; other splits stay as they are."""
    have = F.bool_or(F.coalesce(F.col(label), F.lit(False))).over(Window.partitionBy(split, query))
    return df.withColumn("_have", have).filter((F.col(split) != train) | F.col("_have")).drop("_have")


def allow_list(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in allowed, a short curated list; blanks and repeats in it are errors."""
    blanks = allowed.filter(F.greatest(*[(F.trim(blank(F.col(k))) == "").cast("int") for k in keys]) == 1).count() if len(keys) > 1 else allowed.filter(F.trim(blank(F.col(keys[0]))) == "").count()
    if blanks or allowed.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("the allow-list has blank or repeated rows")
    return df.join(allowed.select(*keys), list(keys), "left_semi")


def leakage_reasons(evaluation: DataFrame, train: DataFrame, query: str, text: str, gold: str) -> DataFrame:
    """(query, reasons) of evaluation queries that train knows: by (normal text, public gold id) or by id."""
    mine = evaluation.select(query, leakage_key(F.col(text)).alias("_t"), public_id(F.col(gold)).alias("_g"))
    other = train.select(F.col(query), leakage_key(F.col(text)).alias("_t"), public_id(F.col(gold)).alias("_g"))
    text_hits = mine.join(other.select("_t", "_g").distinct(), ["_t", "_g"], "left_semi").select(query, F.lit("text_and_gold").alias("reason"))
    id_hits = mine.join(other.select(query).distinct(), query, "left_semi").select(query, F.lit("query_id").alias("reason"))
    return text_hits.unionAll(id_hits).groupBy(query).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def without_leakage(evaluation: DataFrame, train: DataFrame, query: str, text: str, gold: str) -> DataFrame:
    """Whole queries leave as soon as one of their rows is known to train."""
    return evaluation.join(leakage_reasons(evaluation, train, query, text, gold), query, "left_anti")


def concat_queries(df: DataFrame, key: str, kind: str, value: str, a: str, b: str, most_a: int, most_b: int, joiner: str = " ") -> DataFrame:
    """(key, text) for the first most_a values of kind a times the first most_b of kind b of the same key."""
    w = Window.partitionBy(key, kind).orderBy(value)
    ranked = df.filter(F.col(kind).isin(a, b)).select(key, kind, value).distinct().withColumn("_n", F.row_number().over(w))
    left = ranked.filter((F.col(kind) == a) & (F.col("_n") <= most_a)).select(key, F.col(value).alias("_a"))
    right = ranked.filter((F.col(kind) == b) & (F.col("_n") <= most_b)).select(key, F.col(value).alias("_b"))
    return left.join(right, key).select(key, F.concat_ws(joiner, "_a", "_b").alias("text"))


def majority_stratum(df: DataFrame, query: str, source: str, family: str) -> DataFrame:
    """A query's most frequent (source, family), ties by name, and whether it has several."""
    counts = df.groupBy(query, source, family).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy(query)) > 1)
    return first_rows(counts, [query], [F.desc("_n"), F.asc(source), F.asc(family)]).drop("_n")


def stratified_split(df: DataFrame, name: str, strata: Sequence[str], train: float, val: float, seed: str) -> DataFrame:
    """split: in each stratum, in seeded hash order, the first floor(n * train) names train, the next floor(n * val) val, the rest test.

    The shares count as the decimals they are written as: as doubles, 10 * 0.7 may fall short of 7.
    """
    by = Window.partitionBy(*strata)
    order = by.orderBy(F.sha1(F.concat_ws("|", F.lit(seed), F.col(name).cast("string"))), name)
    n, at = F.count(F.lit(1)).over(by), F.row_number().over(order)
    first, then = (F.floor(n.cast("decimal(19,0)") * F.lit(Decimal(str(share)))) for share in (train, val))
    return df.withColumn("split", F.when(at <= first, "train").when(at <= first + then, "val").otherwise("test"))


def seeded_order(name: str, seed: str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(seed), F.col(name).cast("string")))


def round_robin_sample(df: DataFrame, buckets: Sequence[str], name: str, n: int, seed: str) -> DataFrame:
    """n rows (the feature: a sample), one of each bucket in turn, larger buckets first, in seeded order within a bucket."""
    w = Window.partitionBy(*buckets)
    df = df.withColumns({"_size": F.count(F.lit(1)).over(w), "_turn": F.row_number().over(w.orderBy(seeded_order(name, seed), name))})
    return df.orderBy("_turn", F.desc("_size"), *buckets).limit(n).drop("_size", "_turn")


def sample_per_group(df: DataFrame, group: str, value: str, n: int, seed: str) -> DataFrame:
    """Up to n different values of each group, in seeded order."""
    return first_rows(df.select(group, value).distinct(), [group], [seeded_order(value, seed), F.asc(value)], n)


def table_parity(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a column: cells that differ (null equals null), largest difference of numbers, keys missing on either side."""
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    found = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    aggs = [F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_b").isNull()).alias("only_a")]
    for c in columns:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        aggs += [F.count_if(found & ~x.eqNullSafe(y)).alias(f"d_{c}"), F.max(F.when(found, F.abs(x.try_cast("double") - y.try_cast("double")))).alias(f"m_{c}")]
    one = both.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("unequal"), F.col(f"m_{c}").alias("max_diff")) for c in columns]))
    return one.select("only_a", "only_b", rows.alias("r")).select("only_a", "only_b", "r.*")


#: Splits made from the main registry; their exact matches are withheld in part (fixed values).
REGISTRY_SPLITS = (
    "train", "train_noleak", "train_natural", "train_natural_noleak", "val_train", "val_dev", "test", "natural_internal_eval",
    "external_holdout_org", "external_holdout_standard", "external_holdout_refslice", "cctg", "oid_alt", "cdash",
)
#: Splits whose catalog values may be filled in from the summary (fixed values).
HYDRATED_SPLITS = ("external_holdout_gdc_altnames", "external_holdout_gdc_questiontext", "cimac_appendix_a_eval", "cimac_v2", "theradex6_test", "gdc_combined")
#: The share of exact matches that registry splits and others may use (fixed values).
REGISTRY_ALLOWANCE, OTHER_ALLOWANCE = 0.70, 1.0


def route_splits(df: DataFrame, split: str) -> DataFrame:
    """df with a split's allowance, the suffix of its candidate tables, and whether its catalog values are thinned or hydrated."""
    own = F.col(split).isin(*REGISTRY_SPLITS)
    return df.withColumns({"allowance": F.when(own, REGISTRY_ALLOWANCE).otherwise(OTHER_ALLOWANCE), "candidate_table": F.concat(F.col(split), F.when(own, "_a070").otherwise("_a10")), "hydration": F.when(F.col(split).isin(*HYDRATED_SPLITS), "hydrated").otherwise("thinned")})


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself; an error where rows share keys."""
    if not duplicate_rows(df, keys).isEmpty():
        raise ValueError(f"rows repeat {list(keys)}")
    return df


def indicator_join(df: DataFrame, other: DataFrame, keys: Sequence[str], found: str = "found", validate: bool = True) -> DataFrame:
    """Each row of df with other's columns, null where there is none, and whether there is one; other must be unique by keys, so no row is added."""
    other = require_unique(other, keys) if validate else other
    return df.join(other.withColumn(found, F.lit(True)), list(keys), "left").withColumn(found, F.coalesce(found, F.lit(False)))


def merge_scores(df: DataFrame, scores: DataFrame, keys: Sequence[str], score: str, injected: str | None = None) -> DataFrame:
    """df with a score column; both sides must be unique by keys, and, where injected names a flag, just its rows must lack a score."""
    require_unique(df, keys)
    out = indicator_join(df, scores.select(*keys, score), keys, "_scored")
    if injected and not out.filter(F.col("_scored") == F.col(injected)).isEmpty():
        raise ValueError("rows without a score are not the injected ones")
    return out.drop("_scored")


def overlap_audit(df: DataFrame, train: DataFrame, text: str, train_text: str, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    """(one row: overlapping rows and distinct texts; the first samples of these texts): texts of df that train has in equal normal form. The limit is the feature: a report."""
    from weftline.functions.text import exact_key

    known = train.select(exact_key(F.col(train_text), nfkc=False).alias("_k")).distinct()
    both = df.withColumn("_k", exact_key(F.col(text), nfkc=False)).join(known, "_k", "left_semi")
    return both.agg(F.count(F.lit(1)).alias("overlapping"), F.countDistinct(text).alias("texts")), both.select(text).distinct().orderBy(text).limit(samples)
