"""Negatives of training queries: a band of ranks, the other ranks, then a fill from the catalog, unique by id and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.dataset import seeded_order
from weftline.operators.ranking import first_rows

#: Hex digits of a seeded order by which the catalog is numbered piece by piece.
_DIGITS = 3


def _numbered(pool: DataFrame, order: Column) -> DataFrame:
    """pool with its place (from 0) by order, a text of hex digits, then key; counted by the order's leading digits, so that no task sorts all rows."""
    rows = pool.withColumns({"_o": order, "_p": F.substring(order, 1, _DIGITS)})
    sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # 16 ** _DIGITS rows at most
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_o", "key")) - 1
    return rows.withColumn("_own", own).join(F.broadcast(before), "_p").select("key", "text", (F.col("_own") + F.col("_before")).alias("place"))


def select_negatives(ranked: DataFrame, gold: DataFrame, positives: DataFrame, catalog: DataFrame, query: str, key: str, text: str, low: int, high: int, n: int, seed: str) -> DataFrame:
    """(query, key, text, source, place): n negatives a query of positives (query, key: a positive each).

    Ranks low to high come first (source band), then the other ranks (top), then catalog rows that the query hasn't ranked
    (fill); each in seeded order. Never a gold, a positive, a blank text, a positive's text or a text twice; of equal texts
    the first in this order counts. catalog: key, a row each, and text. The fill starts at a place of the seeded catalog
    that the query's hash names and goes round, over the catalog's different texts; see negative_counts for queries that
    get fewer than n. Null ids leave. Empty tables give empty results.
    """
    texts = catalog.select(F.col(key).alias("key"), F.trim(F.col(text)).alias("text")).filter("key IS NOT NULL AND text <> ''")
    asked = positives.select(F.col(query).alias("q"), F.col(key).alias("key")).filter("q IS NOT NULL").distinct()
    blocked = gold.select(F.col(query).alias("q"), F.col(key).alias("key")).unionAll(asked).distinct()
    own_texts = asked.join(texts, "key").select("q", "text").distinct()
    queries = asked.select("q").distinct()
    order = [F.asc("tier"), F.asc("draw"), F.asc("key")]

    def usable(rows: DataFrame) -> DataFrame:
        """(q, key, text, tier, draw) that may be taken, one a text."""
        kept = rows.join(blocked, ["q", "key"], "left_anti").join(own_texts, ["q", "text"], "left_anti")
        return first_rows(kept, ["q", "text"], order)

    tier = F.when(F.col("rank").between(low, high), 0).otherwise(1)
    held = ranked.select(F.col(query).alias("q"), F.col(key).alias("key"), "rank").join(queries, "q", "left_semi").join(texts, "key")
    held = first_rows(held, ["q", "key"], [F.asc("rank")]).select("q", "key", "text", tier.alias("tier"), seeded_order("key", seed).alias("draw"))
    top = first_rows(usable(held), ["q"], order, n)

    pool = _numbered(first_rows(texts.withColumn("draw", seeded_order("key", seed)), ["text"], [F.asc("draw"), F.asc("key")]).select("key", "text"), seeded_order("key", seed))
    size = pool.agg(F.count(F.lit(1)).alias("_size"))
    counted = top.groupBy("q").agg(F.count(F.lit(1)).alias("_has"))
    # Of so many different texts, at most those of the blocked and the ranked rows and the positives' can't be taken.
    odd = blocked.unionAll(held.select("q", "key")).groupBy("q").agg((2 * F.count(F.lit(1))).alias("_odd"))
    short = queries.join(counted, "q", "left").filter(F.coalesce("_has", F.lit(0)) < n).join(odd, "q", "left").crossJoin(F.broadcast(size))  # one row
    start = F.conv(F.substring(seeded_order("q", seed), 1, 12), 16, 10).cast("bigint") % F.col("_size")
    window = F.least(n + F.coalesce("_odd", F.lit(0)), F.col("_size"))
    drawn = short.filter("_size > 0").select("q", "_size", start.alias("_start"), F.explode(F.sequence(F.lit(0).cast("bigint"), window - 1)).alias("_i"))
    drawn = drawn.select("q", "_i", ((F.col("_start") + F.col("_i")) % F.col("_size")).alias("place")).join(pool, "place")
    others = drawn.join(blocked, ["q", "key"], "left_semi").drop("key").join(texts, "text")  # other ids of a text whose first id is blocked
    draw = F.concat(F.lpad(F.col("_i").cast("string"), 20, "0"), seeded_order("key", seed))
    fill = drawn.unionByName(others).select("q", "key", "text", F.lit(2).alias("tier"), draw.alias("draw"))
    taken = first_rows(usable(top.unionByName(fill)), ["q"], order, n)
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    source = F.element_at(F.array(F.lit("band"), F.lit("top"), F.lit("fill")), F.col("tier") + 1)
    return taken.select(F.col("q").alias(query), F.col("key").alias(key), F.col("text").alias(text), source.alias("source"), place.alias("place"))


def negative_counts(negatives: DataFrame, positives: DataFrame, query: str, n: int) -> DataFrame:
    """(query, from_band, from_top, from_fill, fallback, short): where each query's negatives come from, and whether it has fewer than n."""
    each = negatives.groupBy(query).agg(*[F.count_if(F.col("source") == s).alias(f"from_{s}") for s in ("band", "top", "fill")])
    rows = positives.select(query).filter(F.col(query).isNotNull()).distinct().join(each, query, "left").na.fill(0, ["from_band", "from_top", "from_fill"])
    return rows.withColumns({"fallback": F.col("from_top") + F.col("from_fill") > 0, "short": F.col("from_band") + F.col("from_top") + F.col("from_fill") < n})


def band_of_epoch(epoch: int, bands: Sequence[tuple[int, int]], default: tuple[int, int]) -> tuple[int, int]:
    """The rank band of an epoch (from 0): bands in turn, the last one from there on; default where there are none."""
    return tuple(bands[min(max(epoch, 0), len(bands) - 1)]) if bands else default
