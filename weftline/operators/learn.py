"""Learned re-ranking: a gradient-boosted model of pool features, a grid of settings, and scorers from outside."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weftline.operators import metrics, ranking


def with_missing_flags(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Nulls and NaN as 0 with a flag of their own; the model has no route for missing values."""
    columns, names = {}, []
    for f in features:
        x = F.col(f).cast("double")
        gone = x.isNull() | F.isnan(x)
        columns |= {f"_x_{f}": F.when(gone, 0.0).otherwise(x), f"_m_{f}": gone.cast("double")}
        names += [f"_x_{f}", f"_m_{f}"]
    return df.withColumns(columns), names


def fit_ranker(train: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 3, step: float = 0.1, seed: int = 7) -> GBTClassificationModel:
    df, names = with_missing_flags(train, features)
    data = VectorAssembler(inputCols=names, outputCol="_f").transform(df).select("_f", F.col(label).cast("double").alias("_y"))
    return GBTClassifier(featuresCol="_f", labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(data)


def score(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    rows, names = with_missing_flags(df, features)
    rows = model.transform(VectorAssembler(inputCols=names, outputCol="_f").transform(rows))
    return rows.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def rank_and_measure(scored: DataFrame, query: str, cand: str, label: str, score_col: str = "score") -> DataFrame:
    ranked = ranking.canonical_rank(scored, [query], cand, score_col, check=False)
    hits = metrics.first_hits(ranked, ranked.filter(label), query, cand)
    return metrics.ranking_metrics(scored.select(query).distinct(), hits, query)


def allowance_sweep(df: DataFrame, query: str, cand: str, label: str, evidence: Sequence[str], scored: Callable[[DataFrame], DataFrame], rates: Sequence[float], seed: str | int) -> DataFrame:
    """Metrics of one fixed scorer at each rate of allowed evidence, a row a rate.

    At a rate, the evidence columns of gold rows are null for the queries that the mask doesn't let through, so what a
    smaller rate allows, a larger one does. scored adds a column score to the rows of all rates at once.
    """
    from weftline.functions.ids import hash_share

    share, rate = hash_share(F.col(query), seed), F.col("rate")
    keep = ~F.col(label) | (rate >= 1) | ((rate > 0) & (share < rate))
    rows = df.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    rows = scored(rows.withColumns({c: F.when(keep, F.col(c)) for c in evidence}))
    ranked = ranking.canonical_rank(rows, ["rate", query], cand, "score", out="_rank", check=False)
    hits = ranked.groupBy("rate", query).agg(F.min(F.when(F.col(label), F.col("_rank"))).alias("hit"))
    return hits.groupBy("rate").agg(*metrics.metric_columns(F.col("hit")))


def grid_search(train: DataFrame, tune: DataFrame, features: Sequence[str], query: str, cand: str, label: str, grid: Sequence[dict]) -> tuple[dict, GBTClassificationModel, list[dict]]:
    """(best setting, its model, all results) by recall at 5, then reciprocal rank; of equals the first."""
    results, best = [], None
    for setting in grid:
        model = fit_ranker(train, features, label, **setting)
        row = rank_and_measure(score(model, tune, features), query, cand, label).first().asDict()
        results.append(setting | row)
        key = (row["recall_5"], row["mrr_100"])
        if best is None or key > best[0]:
            best = key, setting, model
    return best[1], best[2], results


def ablation_features(families: dict[str, Sequence[str]], without: str | None) -> list[str]:
    """All families' features but those of one; families must not share any."""
    names = [f for fs in families.values() for f in fs]
    if len(set(names)) < len(names):
        raise ValueError("families share features")
    return [f for k, fs in families.items() if k != without for f in fs]


def score_pairs(df: DataFrame, query_text: str, cand_text: str, make_scorer: Callable[[], Callable[[list[str], list[str]], Sequence[float]]], out: str = "score") -> DataFrame:
    """Scores of (query, candidate) texts by a scorer that each worker makes once; texts go to it in Arrow batches."""
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def work(frames):
        scorer = make_scorer()
        for frame in frames:
            yield frame.assign(**{out: [float(x) for x in scorer(frame[query_text].fillna("").tolist(), frame[cand_text].fillna("").tolist())]})

    return df.mapInPandas(work, schema)
