"""Candidate pools: unions of arms, labels, and the features of a query's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T


def union_arms(arms: dict[str, DataFrame], query: str, cand: str) -> DataFrame:
    """One row per (query, cand) with in_<arm>, <arm>_rank and <arm>_score of each arm (query, cand, rank, score); one shuffle."""
    parts = None
    for name, arm in arms.items():
        part = arm.select(query, cand, F.lit(name).alias("_arm"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))
        parts = part if parts is None else parts.unionAll(part)
    aggs = []
    for name in arms:
        mine = F.col("_arm") == name
        aggs += [F.bool_or(mine).alias(f"in_{name}"), F.min(F.when(mine, F.col("rank"))).alias(f"{name}_rank"), F.max(F.when(mine, F.col("score"))).alias(f"{name}_score")]
    return parts.groupBy(query, cand).agg(*aggs)


def label(pool: DataFrame, gold: DataFrame, query: str, cand: str) -> DataFrame:
    return pool.join(gold.select(query, cand, F.lit(True).alias("is_label")).distinct(), [query, cand], "left").withColumn("is_label", F.coalesce("is_label", F.lit(False)))


def canonical_ids(pool: DataFrame, gold: DataFrame, highest: DataFrame, query: str, public: str, seen: str) -> DataFrame:
    """cde_id of a pool row: the gold's own version, else the catalog's highest, else the one seen first."""
    own = gold.groupBy(query, public).agg(F.min("gold_id").alias("_gold"))
    best = highest.select(public, F.col("cde_id").alias("_best"))
    rows = pool.join(own, [query, public], "left").join(best, public, "left")
    return rows.withColumn("cde_id", F.coalesce("_gold", "_best", F.col(seen))).drop("_gold", "_best")


def source_name(a: str, b: str) -> Column:
    return F.when(F.col(f"in_{a}") & F.col(f"in_{b}"), "both").when(F.col(f"in_{a}"), a).otherwise(b)


def inject_gold(pool: DataFrame, gold: DataFrame, catalog: DataFrame, query: str, cand: str) -> DataFrame:
    """(query, cand, injected): the pool, and for queries without a gold candidate their smallest gold that the catalog has."""
    covered = pool.join(gold, [query, cand], "left_semi").select(query).distinct()
    missing = gold.join(covered, query, "left_anti").join(catalog.select(cand).distinct(), cand, "left_semi")
    extra = missing.groupBy(query).agg(F.min(cand).alias(cand))
    return pool.select(query, cand, F.lit(False).alias("injected")).unionAll(extra.select(query, cand, F.lit(True).alias("injected")))


def arm_features(df: DataFrame, query: str, rank: str, score: str, prefix: str, scale: float | None = None) -> DataFrame:
    """Scores against their query's others: share of the maximum (or of scale), log and reciprocal rank, head flags, margins, z, count; null without a rank."""
    w = Window.partitionBy(query)
    s, r = F.col(score).cast("double"), F.col(rank)

    def at(n: int) -> Column:
        return F.max(F.when(r == n, s)).over(w)

    sd = F.stddev_samp(s).over(w)
    out = {
        "relative": F.try_divide(s, F.lit(scale) if scale else F.max(s).over(w)),
        "log_rank": F.log1p(r - 1),
        "reciprocal": 1 / r,
        "in_5": F.when(r.isNotNull(), (r <= 5).cast("int")),
        "in_10": F.when(r.isNotNull(), (r <= 10).cast("int")),
        "top": at(1),
        "to_top": at(1) - s,
        "lead": at(1) - at(2),
        "z": F.when(sd > 0, (s - F.avg(s).over(w)) / sd),
        "count": F.count(s).over(w),
    }
    return df.withColumns({f"{prefix}_{k}": c for k, c in out.items()})


def score_features(df: DataFrame, query: str, cand: str, score: str) -> DataFrame:
    """Rank, margin to the best and to the next (0 for the last), z (0 without spread), and whether the score is missing."""
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last(score), cand)
    w, s = Window.partitionBy(query), F.col(score)
    sd = F.stddev_samp(s).over(w)
    return df.withColumns({"s_rank": F.row_number().over(order), "s_to_top": F.max(s).over(w) - s, "s_to_next": F.coalesce(s - F.lead(s).over(order), F.lit(0.0)), "s_z": F.when(sd > 0, (s - F.avg(s).over(w)) / sd).otherwise(F.lit(0.0)), "s_missing": s.isNull().cast("int")})


def keyword_features(provenance: DataFrame, query: str, cand: str, signals: list[tuple[str, str]], weights: dict[str, float]) -> DataFrame:
    """A column per (rule, field) signal with its best score, and counts, the best rule and field, and field means."""
    weight = F.lit(0.0)
    for rule, x in weights.items():
        weight = F.when(F.col("rule") == rule, x).otherwise(weight)
    rows = provenance.withColumn("_w", F.round(weight * F.col("score"), 9))
    best = F.max_by(F.struct("rule", "field"), F.struct("_w", "score", "rule", "field"))
    columns = [F.max(F.when((F.col("rule") == r) & (F.col("field") == f), F.col("score"))).alias(f"{r}_{f}") for r, f in signals]
    out = rows.groupBy(query, cand).agg(*columns, F.count(F.lit(1)).alias("hits"), F.countDistinct("rule").alias("rules"), best.alias("_b"))
    rules = sorted({r for r, _ in signals})
    out = out.withColumns({"best_rule": F.col("_b.rule"), "best_field": F.col("_b.field")}).drop("_b")
    return out.withColumns({f"{r}_mean": T.row_mean(*[F.col(f"{r}_{f}") for x, f in signals if x == r]) for r in rules})


def value_features(a: Column, b: Column) -> dict[str, Column]:
    """Availability, exact overlap and number overlap of two value lists; fractions of nothing are null."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    share = F.try_divide(both, F.size(F.array_union(a, b)))
    out = {"a_missing": n == 0, "b_missing": m == 0, "both_present": (n > 0) & (m > 0), "a_size": n, "b_size": m, "size_ratio": F.try_divide(F.least(n, m), F.greatest(n, m)), "shared": both, "value_jaccard": share, "a_covered": F.try_divide(both, n), "b_covered": F.try_divide(both, m), "same_set": (n > 0) & (both == n) & (both == m)}
    out |= {f"generic_{k}": F.try_divide(F.size(F.filter(v, T.is_generic)), F.size(v)) for k, v in (("a", a), ("b", b))}
    out |= {f"code_{k}": F.try_divide(F.size(F.filter(v, T.is_code)), F.size(v)) for k, v in (("a", a), ("b", b))}
    return out | T.number_overlap(a, b)


def fixed_vocabulary(train: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values in order from 1; what isn't there has code 0."""
    values = train.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")))


def encode(df: DataFrame, vocabulary: DataFrame, column: str, out: str) -> DataFrame:
    v = vocabulary.select(F.col("value").alias(column), F.col("code").alias(out))
    return df.join(v, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def audit(df: DataFrame, query: str, cand: str, label_col: str) -> DataFrame:
    """One row: rows, queries, queries without a positive, keys that repeat."""
    each = df.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.bool_or(label_col).alias("any"))
    keys = df.groupBy(query, cand).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    return each.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("queries"), F.count_if(~F.col("any")).alias("without_positive")).crossJoin(keys)  # one row each


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, missing, share): null or NaN values of each column, in one pass over df."""
    kinds = dict(df.dtypes)
    gone = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in columns}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(g).alias(f"_m{i}") for i, g in enumerate(gone.values())])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing")) for i, c in enumerate(columns)])).alias("x")
    return one.select("_n", cells).select("x.column", "x.missing", F.try_divide(F.col("x.missing"), F.col("_n")).alias("share"))
