"""Quality scores: a classifier's evidence with posteriors of host and path, shrunk towards the levels above."""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, attach_groups

#: The word weights are fitted on about this many labelled rows, chosen by a hash of the id, or on all where fewer.
MOST_TRAINING_ROWS = 20_000
#: Rows that the weights are fitted on get their own evidence from weights of the other folds.
FOLDS = 5
#: Words and runs of symbols are hashed to so many features; the model is one number each.
FEATURES = 1 << 16
_RUN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")


def features(token: str) -> list[int]:
    """The features of a token between white space: its runs of letters, digits and symbols."""
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in _RUN.findall(token.lower())]


class _Evidence(dict):
    """Token -> (sum of its features' weights, number of features); emptied as it grows."""

    def __init__(self, weights):
        super().__init__()
        self._weights = weights

    def __missing__(self, token: str) -> tuple[float, int]:
        found = features(token)
        out = (float(self._weights[found].sum()) if found else 0.0, len(found))
        if len(token) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[token] = out
        return out

    def of(self, text: str | None) -> float:
        """The mean weight of a text's features; 0 without any."""
        found = [self[t] for t in (text or "").split()]
        n = sum(x[1] for x in found)
        return sum(x[0] for x in found) / n if n else 0.0


def fit_weights(labelled: DataFrame):
    """log(P(feature | 1) / P(feature | 0)) by feature, from (text, y, fold); counting is grouped by feature.

    Row f, below FOLDS, leaves out the texts of fold f; the last row is of all.
    """
    import numpy as np

    def count(batches):
        import pyarrow as pa

        table = np.zeros((FOLDS, 2, FEATURES), np.int64)
        for b in batches:
            words: dict[tuple[int, int], Counter] = {}
            for text, y, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words.setdefault((fold, y), Counter()).update((text or "").split())
            for (fold, y), found in words.items():
                for token, n in found.items():
                    for f in features(token):
                        table[fold, y, f] += n
        at = np.nonzero(table)
        if len(at[0]):
            yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in at), pa.array(table[at])], names=["fold", "y", "feature", "n"])

    counts = labelled.select("_text", "y", "fold").mapInArrow(count, "fold long, y long, feature long, n long").groupBy("fold", "y", "feature").agg(F.sum("n")).toArrow()
    table = np.zeros((FOLDS, 2, FEATURES))
    table[tuple(np.asarray(counts.column(i)).astype(np.int64) for i in range(3))] = np.asarray(counts.column(3))
    table = np.concatenate([table.sum(0) - table, table.sum(0)[None]])
    p = (table + 0.5) / (table.sum(2, keepdims=True) + 0.5 * FEATURES)
    return np.log(p[:, 1] / p[:, 0])


def site_posteriors(rows: DataFrame) -> DataFrame:
    """(host, path, prior, host_rate, path_rate, and what a row's own label is left out of them with) from rows of (host, path, y), y null where not known.

    Beta-binomial by moments: the rates of hosts vary around the global rate, and those of paths around their host's;
    the variance between them beyond what sampling gives sets how many rows' worth the level above counts. A site with
    few labels stays near its host, a host with few near the global rate.
    """
    paths = rows.groupBy("host", "path").agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good"), F.count(F.lit(1)).alias("rows"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    prior = hosts.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("prior"))

    def strength(sites: DataFrame, centre: str, name: str) -> DataFrame:
        """Rows that the level above counts as: between 1 and 1000."""
        rate, n = F.col("good") / F.col("n"), F.col("n")
        spread = F.sum(n * F.pow(rate - F.col(centre), 2)) / F.sum(n)
        noise = F.sum(F.col(centre) * (1 - F.col(centre))) / F.sum(n)
        level = F.sum(n * F.col(centre) * (1 - F.col(centre))) / F.sum(n)
        k = F.try_divide(level, F.greatest(spread - noise, F.lit(1e-9)))
        return sites.filter("n > 0").agg(F.least(F.greatest(F.coalesce(k, F.lit(1000.0)), F.lit(1.0)), F.lit(1000.0)).alias(name))

    hosts = hosts.crossJoin(F.broadcast(prior))  # one row
    hosts = hosts.crossJoin(F.broadcast(strength(hosts, "prior", "host_strength")))  # one row
    hosts = hosts.select("host", "prior", "host_strength", F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("good") + F.col("host_strength") * F.col("prior")) / (F.col("n") + F.col("host_strength"))).alias("host_rate"))
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    paths = paths.crossJoin(F.broadcast(strength(paths, "host_rate", "strength")))  # one row
    rate = (F.col("good") + F.col("strength") * F.col("host_rate")) / (F.col("n") + F.col("strength"))
    return paths.select("host", "path", "prior", "host_strength", "host_n", "host_good", "host_rate", rate.alias("path_rate"), F.col("n").alias("labelled"), "good", "strength", "rows")


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, most_rows: int = MOST_TRAINING_ROWS) -> DataFrame:
    """id_col, evidence, host_rate, path_rate, score, keep for every row of df.

    evidence is the text's mean word weight; a row that the weights are fitted on gets it from weights fitted on the
    other folds. Two normal distributions, one a class, by grouped moments over all labelled rows, make log odds of it;
    the log odds of the path's posterior are added. A row's own label is left out of its host's and its path's counts
    there. score is the probability of label 1; keep: score >= threshold.

    Labels other than 0 and 1 are ignored; an id labelled more than once counts by its larger label. Null hosts and paths
    are a host and a path. A null or empty text has evidence 0; without labels every score is the global rate of 0.5.
    Rows that repeat an id are scored each, ties get equal scores, null ids have no label. Whole texts count. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "quality")
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter("_id IS NOT NULL AND y IN (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    labels = scratch.table(labels, "labels")
    share = min(1.0, most_rows / max(labels.count(), 1))
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 52)) / float(1 << 52)
    some = labels.filter(drawn < share).withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(FOLDS)).cast("long"))
    some = scratch.table(some, "some")
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"))
    rows = rows.join(F.broadcast(some.withColumnRenamed("y", "_y")), "_id", "left")  # about most_rows rows at most
    weights = fit_weights(rows.filter("fold IS NOT NULL").select("_text", F.col("_y").alias("y"), "fold"))
    sent = spark.sparkContext.broadcast(weights)

    def weigh(batches):
        import pyarrow as pa

        evidence = [_Evidence(w) for w in sent.value]
        for b in batches:
            found = [evidence[FOLDS if f is None else f].of(t) for t, f in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64()), b.column(2), b.column(3)], names=["_id", "evidence", "host", "path"])

    rows = rows.select("_id", "_text", "host", "path", "fold")
    seen = scratch.table(rows.mapInArrow(weigh, f"_id {rows.dtypes[0][1]}, evidence double, host string, path string").withColumn("_salt", F.xxhash64("_id", "evidence")), "evidence")
    total = seen.count()
    seen = attach_groups(seen, labels.withColumn("n", F.lit(1).cast("long")), ["_id"], "_salt", total).drop("n")  # null ids are dealt out
    seen = scratch.table(seen, "labelled")
    scratch.drop("evidence")
    shape = seen.filter("y IS NOT NULL").groupBy("y").agg(F.avg("evidence").alias("mean"), F.coalesce(F.var_pop("evidence"), F.lit(0.0)).alias("var"), F.count(F.lit(1)).alias("n"))
    found = {r.y: r for r in shape.collect()}  # two rows
    log_odds = F.lit(0.0)
    if len(found) == 2:
        zero, one = found[0], found[1]
        var = max((zero.var * zero.n + one.var * one.n) / (zero.n + one.n), 1e-12)
        log_odds = (F.col("evidence") - (one.mean + zero.mean) / 2) * ((one.mean - zero.mean) / var)
    sites = site_posteriors(seen.select("host", "path", "y"))
    keyed = F.encode(F.to_json(F.struct("host", "path")), "utf-8").alias("site")
    sites = sites.select(keyed, "prior", "host_strength", "host_n", "host_good", "host_rate", "path_rate", "labelled", "good", "strength", F.col("rows").alias("n"))
    out = attach_groups(seen.withColumn("site", keyed), scratch.table(sites, "sites"), ["site"], "_salt", total)
    own, one = F.coalesce("y", F.lit(0)), F.when(F.col("y").isNull(), 0).otherwise(1)
    host = (F.col("host_good") - own + F.col("host_strength") * F.col("prior")) / (F.col("host_n") - one + F.col("host_strength"))
    path = (F.col("good") - own + F.col("strength") * host) / (F.col("labelled") - one + F.col("strength"))
    path = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.least(F.greatest(log_odds, F.lit(-30.0)), F.lit(30.0)) + F.log(path / (1 - path))
    score = 1 / (1 + F.exp(-odds))
    return out.select(F.col("_id").alias(id_col), "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
