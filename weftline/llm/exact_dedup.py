"""Exact deduplication by a tree of merges over digest runs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, attach_groups

_KEYS = ["_sha", "_hash", "_bytes"]


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return rows.select("_id", "_row", F.unhex(F.sha2(F.encode("_text", "utf-8"), 256)).alias("_sha"), F.xxhash64("_text").alias("_hash"), F.octet_length("_text").alias("_bytes"))


def merge_runs(scratch: Scratch, rows: DataFrame, keep: str = "min", fan_in_bits: int = 4) -> tuple[DataFrame, int]:
    """(one row per distinct text, number of rows).

    A run is what one input partition holds; its number is the upper part of _row. In round r, the runs whose numbers
    agree but for the lowest r * fan_in_bits bits become one: each merged run has every digest once, in digest order,
    with the smallest (or largest) identifier so far. A run is sliced over tasks by digest, so the last one, too, is
    spread over the cluster. Entries only merge if SHA-256, a second hash and the byte length agree.
    """
    total, last = rows.agg(F.count(F.lit(1)), F.max(F.shiftright("_row", 33))).first()
    best = F.max if keep == "max" else F.min
    runs = rows.select(F.shiftright("_row", 33).alias("_run"), *_KEYS, F.struct("_id", "_row").alias("best"), F.lit(1).cast("long").alias("n"))
    if keep == "min":  # a null id would be the smallest
        runs = runs.withColumn("best", F.struct(F.col("best._id").isNull().alias("_none"), "best._id", "best._row"))
    last, level = last or 0, 0
    while True:
        level += 1
        last >>= fan_in_bits
        merged = runs.withColumn("_run", F.shiftright("_run", fan_in_bits)).groupBy("_run", *_KEYS).agg(best("best").alias("best"), F.sum("n").alias("n"))
        runs = scratch.table(merged.sortWithinPartitions("_run", *_KEYS), f"runs{level}")
        if level > 1:
            scratch.drop(f"runs{level - 1}")
        if not last:
            return runs.select(*_KEYS, F.col("best._id").alias("keep_id"), F.col("best._row").alias("keep_row"), "n"), total


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in_bits: int = 4) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Equal means identical texts; a null text counts as empty. Of equal rows, the one with the smallest id (keep="max":
    the largest) stays; rows that repeat an id, too, leave one of them kept. A null id stays only where its group has
    no other. Very long texts count whole. An empty table gives an empty result. Other columns, whatever their names,
    are not read.
    """
    scratch = Scratch(df.sparkSession, "exact")
    rows = scratch.table(_digests(df, id_col, text_col), "rows")
    groups, total = merge_runs(scratch, rows, keep, fan_in_bits)
    out = attach_groups(rows, groups.filter("n > 1"), _KEYS, "_row", total)
    single = F.col("n").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of df with the first of each set of equal texts, all columns; see exact_dedup for what equal and first mean.

    Rows of heavy groups that don't stay leave before the shuffle.
    """
    scratch = Scratch(df.sparkSession, "exact")
    rows = scratch.table(_digests(df, id_col, text_col), "rows")
    groups, total = merge_runs(scratch, rows, keep)
    scratch.drop("rows")
    # under names of their own, so that no column of df can clash
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    docs = df.toDF(*names.values()).withColumns({"_sha": F.unhex(F.sha2(F.encode(text, "utf-8"), 256)), "_hash": F.xxhash64(text), "_bytes": F.octet_length(text)})
    limit = max(total // 256, 1)
    heavy = groups.filter(F.col("n") > limit).select(*_KEYS, F.col("keep_id").alias("_first"), F.lit(True).alias("_heavy"))
    docs = docs.join(F.broadcast(heavy), _KEYS, "left").filter(F.col("_heavy").isNull() | F.col("_first").eqNullSafe(F.col(names[id_col]))).drop("_first", "_heavy")
    docs = docs.join(groups.select(*_KEYS, F.col("keep_id").alias("_first")), _KEYS).filter(F.col("_first").eqNullSafe(F.col(names[id_col])))
    return docs.dropDuplicates(_KEYS).select(*[F.col(x).alias(c) for c, x in names.items()])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
