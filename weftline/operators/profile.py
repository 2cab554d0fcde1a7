"""Counts, summaries and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T


def counts_by(df: DataFrame, by: Sequence[str], distinct: dict[str, str]) -> DataFrame:
    """Rows and distinct values of columns (name -> column) by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()])


def overlap_counts(df: DataFrame, split: str, name: str) -> DataFrame:
    """(a, b, shared): names that two splits have in common, for splits a < b with any."""
    each = df.select(name, split).distinct().groupBy(name).agg(F.array_sort(F.collect_set(split)).alias("_s"))
    pairs = F.flatten(F.transform("_s", lambda x, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return each.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))


def number_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, 90th and 95th percentile and maximum of the finite values."""
    x = F.col(column).cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    q = F.percentile(x, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), q.alias("_q"), F.max(x).alias("max"))
    return out.select(*by, "n", "mean", *[F.get("_q", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p90", "p95"))], "max")


def rates(flags: dict[str, Column], present: Column | None = None) -> list[Column]:
    """The share of rows, or of present ones, in which each flag holds."""
    out = []
    for name, flag in flags.items():
        one = F.when(flag, 1.0).otherwise(0.0)
        out.append(F.avg(one if present is None else F.when(present, one)).alias(name))
    return out


def grouped_with_total(df: DataFrame, by: str, aggs: Sequence[Column], least: int, total: str = "ALL") -> DataFrame:
    """A row for all rows and one for each group of at least least rows."""
    out = df.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_all"), *aggs)
    return out.filter((F.col("_all") == 1) | (F.col("rows") >= least)).withColumn(by, F.when(F.col("_all") == 1, total).otherwise(F.col(by))).drop("_all")


def funnel(df: DataFrame, stages: dict[str, Column], distinct: str) -> DataFrame:
    """Rows and distinct values left after each stage, a stage being all conditions so far; one pass."""
    so_far, aggs = F.lit(True), []
    for name, cond in stages.items():
        so_far = so_far & F.coalesce(cond, F.lit(False))
        aggs += [F.count_if(so_far).alias(f"{name}_rows"), F.countDistinct(F.when(so_far, F.col(distinct))).alias(f"{name}_ids")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(f"{n}_rows").alias("rows"), F.col(f"{n}_ids").alias("ids")) for i, n in enumerate(stages)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def token_divergence(a: DataFrame, b: DataFrame, alpha: float = 1e-8) -> DataFrame:
    """Jensen-Shannon divergence of two token columns' distributions, each smoothed by alpha over both vocabularies."""
    counts = a.groupBy("token").agg(F.count(F.lit(1)).alias("x")).join(b.groupBy("token").agg(F.count(F.lit(1)).alias("y")), "token", "full_outer").na.fill(0)
    total = counts.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"), F.count(F.lit(1)).alias("v"))
    p, q = (F.col("x") + alpha) / (F.col("nx") + alpha * F.col("v")), (F.col("y") + alpha) / (F.col("ny") + alpha * F.col("v"))
    m = (p + q) / 2
    return counts.crossJoin(F.broadcast(total)).agg((F.sum(p * F.log(p / m)) / 2 + F.sum(q * F.log(q / m)) / 2).alias("divergence"))  # one row


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_rate, empty_rate); empty counts null and white space."""
    aggs = [x for c in columns for x in (F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(f"n_{c}"), F.avg(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", 1.0).otherwise(0.0)).alias(f"e_{c}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("null_rate"), F.col(f"e_{c}").alias("empty_rate")) for c in columns])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def name_inventory(df: DataFrame, by: Sequence[str], name: str, key: str) -> DataFrame:
    """Rows, distinct keys and names, length spread, and shares of names with blanks, in snake case, all capitals."""
    n, x = F.length(name), F.col(name)
    shares = rates({"with_blank": x.contains(" "), "snake_case": x.rlike("^[a-z0-9]+(_[a-z0-9]+)+$"), "all_caps": x.rlike("^[A-Z0-9]+$")})
    shares = [F.round(s, 3).alias(k) for s, k in zip(shares, ("with_blank", "snake_case", "all_caps"), strict=True)]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.countDistinct(name).alias("names"), F.min(n).alias("min_length"), F.percentile(n, 0.5).alias("median_length"), F.max(n).alias("max_length"), *shares)


def over_seeds(df: DataFrame, by: Sequence[str], metrics: Sequence[str], sd_of_one: float | None = None) -> DataFrame:
    """Mean, sample deviation and n of each metric; the deviation of one value is sd_of_one."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(sd_of_one).cast("double")).alias(f"{m}_sd")]
    return df.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n"))


def seed_coverage(df: DataFrame, by: Sequence[str], seed: str, expected: Sequence[int]) -> DataFrame:
    out = df.groupBy(*by).agg(F.array_sort(F.collect_set(seed)).alias("observed"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in expected]), "observed"))
    return out.withColumns({"missing": missing, "complete": F.size(missing) == 0})


def delta_to_anchor(df: DataFrame, by: Sequence[str], anchor: Column, metric: str) -> DataFrame:
    """metric less that of its group's anchor row."""
    from pyspark.sql import Window

    base = F.max(F.when(anchor, F.col(metric))).over(Window.partitionBy(*by))
    return df.withColumn("delta", F.col(metric) - base)


def melt_ranks(df: DataFrame, key: str, ids: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Wide columns id_1.., score_1.. to (key, rank, cand, score); blank ids leave."""
    parts = [F.struct(F.lit(i).alias("rank"), F.col(a).alias("cand"), F.col(b).alias("score")) for i, (a, b) in enumerate(zip(ids, scores, strict=True), 1)]
    return df.select(key, F.explode(F.array(*parts)).alias("r")).select(key, "r.*").filter(F.trim(F.coalesce(F.col("cand").cast("string"), F.lit(""))) != "")


def explode_lists(df: DataFrame, key: str, ids: str, scores: str, depth: int) -> DataFrame:
    """List columns to (key, rank, cand, score), the first depth entries."""
    rows = df.select(key, F.posexplode(F.slice(F.arrays_zip(F.col(ids).alias("cand"), F.col(scores).alias("score")), 1, depth)).alias("at", "r"))
    return rows.select(key, (F.col("at") + 1).alias("rank"), "r.cand", "r.score")


def pair_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row over value lists a and b of pairs: how many pairs have both and only b, and of those with both, counts and shares of equal and of equally normalised lists in order, of equal sets, of subsets and of shorter a, and mean overlap.

    Null and empty lists are absent; shares are null where no pair has both.
    """
    x, y = F.coalesce(F.col(a), F.array().cast("array<string>")), F.coalesce(F.col(b), F.array().cast("array<string>"))
    norm = {"x": F.transform(x, T.normalize_value), "y": F.transform(y, T.normalize_value)}
    rows = df.select(x.alias("a"), y.alias("b"), norm["x"].alias("x"), norm["y"].alias("y"))
    both = (F.size("a") > 0) & (F.size("b") > 0)
    shared = F.size(F.array_intersect("x", "y"))
    nx, ny = F.size(F.array_distinct("x")), F.size(F.array_distinct("y"))
    flags = {
        "exact_block_match": F.col("a") == F.col("b"), "normalized_block_match": F.col("x") == F.col("y"),
        "exact_item_match": F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b")), "normalized_item_match": (shared == nx) & (shared == ny),
        "strict_subset": (shared == nx) & (nx < ny), "subset_or_equal": shared == nx, "query_shorter_than_cde": nx < ny,
    }
    n = F.count_if(both)
    out = [F.count(F.lit(1)).alias("n_pairs"), n.alias("both_present_n"), F.count_if((F.size("a") == 0) & (F.size("b") > 0)).alias("query_absent_cde_present_n")]
    for name, f in flags.items():
        out += [F.count_if(both & f).alias(f"{name}_n"), F.try_divide(F.count_if(both & f), n).alias(f"{name}_rate")]
    return rows.agg(*out, F.avg(F.when(both, shared)).alias("overlap_mean"), F.avg(F.when(both, shared / (nx + ny - shared))).alias("item_jaccard_mean"))


def integrity(df: DataFrame, query: str, pair: str, cand: str, own: str, master: DataFrame, master_key: str, master_value: str) -> DataFrame:
    """One row of checks of an export against the catalog master (unique by master_key): rows, different, repeated and missing ids, rows whose catalog row is there, and how many of their values own equal the catalog's, of all rows and of those where both are there.

    Blank values are missing. A repeat is each row of an id but one.
    """
    def there(c: str):
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""

    held = master.select(F.col(master_key).alias("_k"), F.col(master_value).alias("_m"), F.lit(True).alias("_found"))
    rows = df.join(held, F.col(cand) == F.col("_k"), "left")
    found, mine, theirs = F.col("_found").isNotNull(), there(own), there("_m")
    same = mine & theirs & (F.col(own) == F.col("_m"))
    n = F.count(F.lit(1))
    out = [n.alias("n_rows")]
    for name, c in (("query_id", query), ("pair_id", pair)):
        out += [F.count_distinct(F.when(there(c), F.col(c))).alias(f"n_unique_{name}"), (F.count_if(there(c)) - F.count_distinct(F.when(there(c), F.col(c)))).alias(f"duplicate_{name}_n"), F.count_if(~there(c)).alias(f"missing_{name}_n")]
    out += [F.count_if(~there(cand)).alias("missing_cde_id_n"), F.count_if(found).alias("cde_master_row_found_n"), F.try_divide(F.count_if(found), n).alias("cde_master_row_found_rate"), F.count_if(mine).alias("pair_cde_present_n"), F.count_if(theirs).alias("master_cde_present_n")]
    out += [F.count_if(same).alias("pair_cde_matches_master_n"), F.try_divide(F.count_if(same), n).alias("matches_rate_all_rows"), F.try_divide(F.count_if(same), F.count_if(mine & theirs)).alias("matches_rate_comparable")]
    return rows.agg(*out, F.count_if(~mine & theirs).alias("pair_cde_missing_master_present_n"), F.count_if(mine & ~theirs).alias("pair_cde_present_master_missing_n"))
