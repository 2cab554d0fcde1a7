"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, words_in

#: Tables of sources up to this many rows are broadcast.
BROADCAST_SOURCES = 10_000


def apportion(df: DataFrame, weight: str, seats: Column, group: Sequence[str], order: str, out: str) -> DataFrame:
    """Give seats (the same in every row of a group) to the rows of each group by the highest quotients weight / (2k + 1).

    No seat is handed out singly. With divisor d a row gets round(weight / d) seats; the two divisors
    sum / (seats -+ rows / 2) give too few and too many, and differ by at most two seats a row on average. Only the seats
    between them are ranked, ties by order.
    """
    whole = Window.partitionBy(*group)
    df = df.withColumns({"_sum": F.sum(weight).over(whole), "_rows": F.count(F.lit(1)).over(whole), "_seats": seats})

    def rounded(total: Column) -> Column:
        return F.greatest(F.floor(F.coalesce(F.try_divide(F.col(weight) * total, F.col("_sum")), F.lit(0.0)) + 0.5), F.lit(0)).cast("long")

    df = df.withColumn("_low", F.when(F.col("_seats") > F.col("_rows") / 2, rounded(F.col("_seats") - F.col("_rows") / 2)).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_high", F.greatest("_low", rounded(F.col("_seats") + F.col("_rows") / 2)))
    df = df.withColumn("_open", F.col("_seats") - F.sum("_low").over(whole))
    between = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<bigint>"))
    extra = df.select(*group, order, "_open", F.col(weight).alias("_w"), F.explode(between).alias("_k"))
    ranked = Window.partitionBy(*group).orderBy(F.desc(F.col("_w") / (2 * F.col("_k") + 1)), F.col(order), F.col("_k"))
    extra = extra.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= F.col("_open"))
    extra = extra.groupBy(*group, order).agg(F.count(F.lit(1)).alias("_extra"))
    df = df.join(extra, [*group, order], "left")
    return df.withColumn(out, F.col("_low") + F.coalesce("_extra", F.lit(0))).drop("_sum", "_rows", "_seats", "_low", "_high", "_open", "_extra")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add no, weight and target to (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets share share * all sizes by weight; none is above
    most * its source's size. With rising cap / weight, a source is at its cap as long as the level that the others
    would share is not below its own cap / weight; the first that isn't gives the level of the rest.
    """
    by_name, everything = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy(F.lit(0))
    df = sources.withColumn("no", F.row_number().over(by_name))
    df = df.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("no") - 1) % len(weights)).cast("int")))
    df = df.withColumns({"_cap": F.col("source_size") * most, "_goal": F.sum("source_size").over(everything) * share})
    rising = Window.orderBy(F.col("_cap") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    df = df.withColumn("_level", (F.col("_goal") - F.coalesce(F.sum("_cap").over(rising), F.lit(0.0))) / left)
    df = df.withColumn("_free", F.col("_cap") / F.col("weight") > F.col("_level"))
    level = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    return df.withColumn("target", F.when(F.col("_free"), F.least("_cap", F.col("weight") * level)).otherwise(F.col("_cap"))).drop("_cap", "_goal", "_level", "_free")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 32, docs_per_shard: int = 32_768, seed: str = "mix") -> DataFrame:
    """One row per input row: id_col, size, source_size, target, taken, source_no, shard.

    The mix is cut into blocks of block_words words. Sainte-Lague apportionment gives whole blocks to sources by target
    and each source's blocks to its shards by size. A shard is a hash bucket of about docs_per_shard documents in seeded
    order; the words of its documents, end to end, make its blocks, and it gives the first blocks of its quota, starting
    over up to most times. So documents are taken whole, but for the one where a shard's quota ends.

    size counts words; a null or empty text has none and takes nothing. A null source is a source, the last. A null id
    is hashed as such. Rows that repeat are mixed one by one. Reruns agree, as all orders come from a hash of the id. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("null"))))
    rows = df.select(F.col(id_col).alias("doc"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"))
    rows = scratch.table(rows.withColumn("seeded", seeded), "rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    sources = source_targets(sources, weights, share, most)
    blocks = F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share / block_words).cast("long")
    sources = apportion(sources.withColumn("_all", F.lit(0)), "target", blocks, ["_all"], "no", "blocks").drop("_all")
    sources = scratch.table(sources.withColumn("shards", F.ceil(F.col("docs") / docs_per_shard).cast("long")), "sources")
    small = sources.select(F.col("source").alias("_source"), "no", "source_size", "target", "blocks", "shards")
    if sources.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    rows = rows.join(small, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    rows = rows.withColumn("shard", F.conv(F.substring("seeded", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = rows.groupBy("no", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("_blocks"))
    shards = apportion(shards, "shard_size", F.col("_blocks"), ["no"], "shard", "quota")
    shards = shards.select("no", "shard", "shard_size", F.least(F.col("quota") * block_words, F.col("shard_size") * most).alias("quota"))
    rows = rows.join(shards, ["no", "shard"])
    before = Window.partitionBy("no", "shard").orderBy("seeded", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    taken = F.lit(0).cast("long")
    for turn in range(most):
        taken = taken + F.least(F.greatest(F.col("quota") - F.col("shard_size") * turn - F.col("_at"), F.lit(0)), F.col("size"))
    return rows.select(F.col("doc").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), F.col("no").alias("source_no"), "shard")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 2, **options) -> DataFrame:
    """The mix itself: df's rows as often as they are taken, the last time perhaps with only the text's first words.

    Rows without words are in no block and leave. Equal ids must have equal texts sizes to be told apart; rows that
    repeat an id each get what the mix gives that id and size. Null and empty texts have no words; null sources and ids
    are taken as mix_sources does. A very long text is taken whole or its leading words. An empty table gives an empty
    result. Columns may have any names.
    """
    plan = mix_sources(df, id_col, text_col, source_col, most=most, **options)
    plan = plan.filter("taken > 0").groupBy(F.col(id_col).alias("_doc"), F.col("size").alias("_size")).agg(F.sum("taken").alias("_taken"), F.count(F.lit(1)).alias("_same"))
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    docs = df.toDF(*names.values())
    text = F.col(names[text_col])
    docs = docs.withColumn("_words", words_in(text))
    docs = docs.join(plan, F.col(names[id_col]).eqNullSafe(F.col("_doc")) & (F.col("_words") == F.col("_size")))
    docs = docs.withColumn("_taken", F.ceil(F.col("_taken") / F.col("_same")).cast("long"))
    whole, rest = F.floor(F.col("_taken") / F.col("_words")).cast("int"), (F.col("_taken") % F.col("_words")).cast("int")
    docs = docs.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    tail = F.element_at(F.split(text, F.lit(r"[\x20\x09-\x0D]+"), F.col("_part") + 1 + lead), -1)
    cut = F.when(F.col("_part") > 0, F.substring(text, F.lit(1), F.length(text) - F.length(tail))).otherwise(text)
    return docs.select(*[(cut if c == text_col else F.col(x)).alias(c) for c, x in names.items()])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Hands out the seats one by one; holds where no source has more documents than a shard takes.
OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS seeded
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no
  FROM docs GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][(no - 1) % 3 + 1] AS DOUBLE) AS weight FROM src),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER rising, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0)) AS level
  FROM weighed
  WINDOW rising AS (ORDER BY 2.0::DOUBLE * source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, CASE WHEN cap / weight > level
    THEN least(cap, weight * max(CASE WHEN cap / weight > level THEN level END) OVER ()) ELSE cap END AS target
  FROM levels),
seats AS (
  SELECT no, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no, k) AS place
  FROM targets, LATERAL (SELECT unnest(range(CAST(ceil(target / 32) AS BIGINT) + 2)) AS k)),
quota AS (
  SELECT no, count(*) AS blocks FROM seats
  WHERE place <= (SELECT CAST(round(1.5::DOUBLE * sum(source_size) / 32) AS BIGINT) FROM src) GROUP BY no),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(coalesce(q.blocks, 0) * 32, 2 * t.source_size) AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY t.no ORDER BY d.seeded, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, t.no
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN quota q ON q.no = t.no)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(greatest(quota - ahead, 0), size) + least(greatest(quota - source_size - ahead, 0), size) AS BIGINT) AS taken,
  CAST(no AS INTEGER) AS source_no, CAST(0 AS BIGINT) AS shard
FROM placed
"""
