"""Two summaries of an entry's values, one for the query side and one for the catalog side, drawn by hashes so that reruns agree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Meanings that many entries share, and their concepts (fixed values).
GENERIC_CONCEPTS = {
    "UNKNOWN": ("unknown", "unk", "not known", "don't know", "do not know"),
    "NA": ("not applicable", "n/a", "na", "notapplicable"),
    "NOT_REPORTED": ("not reported", "notreported"),
    "NOT_TESTED": ("not tested", "nottested"),
    "YES": ("yes", "true"),
    "NO": ("no", "false"),
    "NORMAL": ("normal",),
    "ABNORMAL": ("abnormal",),
    "POSITIVE": ("positive", "pos"),
    "NEGATIVE": ("negative", "neg"),
    "PRESENT": ("present",),
    "ABSENT": ("absent",),
}
#: The columns that may hold a value's meaning, the first non-empty one counts (fixed values).
MEANINGS = ("value_meaning_long_name", "value_meaning", "meaning_description")
SCHEMA = (
    "cde_publicid string, cde_version string, n int, kind string, catalog_summary string, query_summary string, n_generic int, drawn_query int, drawn_catalog int, n_query int, n_catalog int, "
    "shared int, token_jaccard double, omitted boolean, rule string, redraws int, same_before boolean, same_after boolean, within_catalog boolean, mostly_generic boolean"
)


@dataclass(frozen=True)
class Policy:
    """How summaries are drawn. strict: small sets with a telling value, and draws within the catalog's, show no query side."""

    share: float = 0.5
    least: int = 2
    most_query: int = 8
    most_catalog: int = 10
    generic_boost: float = 0.10
    generic_cap: float = 0.70
    label_share: float = 0.30
    generic_threshold: float = 0.5
    redraws: int = 3
    strict: bool = False
    placeholder: str = ""
    salt: str = "demap"
    sep: str = " | "


class Value(NamedTuple):
    """A permitted value: its text, its meaning, its generic concept or none, display order and place."""

    value: str
    label: str
    concept: str | None
    rank: float
    place: int

    @property
    def key(self) -> str:
        return f"{self.concept or ''}::{self.value}::{self.label}::{self.rank}::{self.place}"

    @property
    def shown(self) -> tuple:
        """Its place on either side."""
        return self.rank, self.place, self.label, self.value


def _hash(*parts: object) -> str:
    return hashlib.sha1("::".join(map(str, parts)).encode()).hexdigest()


def _distinct(texts: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t for t in texts if t))


def side_size(n: int, most: int, policy: Policy, seed: str) -> int:
    """Half of n (halves to the even number), within the least and most; from 4 values on one less or more by the seed's hash."""
    if n < 2:
        return n

    def fit(x: int) -> int:
        return max(policy.least, min(most, x))

    middle = fit(round(policy.share * n))
    if n < 4:
        return middle
    options = list(dict.fromkeys(fit(middle + d) for d in (-1, 0, 1)))
    return options[int(_hash(seed, "k"), 16) % len(options)]


def strata(k: int, n: int, concepts: int, others: int, policy: Policy) -> tuple[int, int]:
    """(generic concepts, other values) of a draw of k of n values: the concepts' share and a boost; what one side lacks the other gives."""
    share = min(concepts / n + policy.generic_boost, policy.generic_cap)
    generic = max(0, min(round(k * share), concepts, k))
    other = min(k - generic, others)
    return min(k - other, concepts), other


def draw(items: Sequence, k: int, seed: str, key: Callable = str) -> list:
    """k items by hash order, back in key order; all as they are where there are no more."""
    if len(items) <= k:
        return list(items) if k > 0 else []
    return sorted(sorted(items, key=lambda x: (_hash(seed, key(x)), key(x)))[:k], key=key)


def draw_rows(df: DataFrame, by: Sequence[str], key: str, k: int, seed: str) -> DataFrame:
    """draw of the rows of each group."""
    order = Window.partitionBy(*by).orderBy(F.sha1(F.concat_ws("::", F.lit(seed), F.col(key).cast("string"))), F.col(key).cast("string"))
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def draw_side(pool: Sequence[Value], k: int, policy: Policy, seed: str) -> list[Value]:
    """k values: the first of each drawn concept, drawn others, and more of any if that isn't enough, in display order."""
    if k <= 0:
        return []
    first: dict[str, Value] = {}
    for v in sorted(pool, key=lambda v: (v.rank, v.place, v.value, v.label)):
        if v.concept:
            first.setdefault(v.concept, v)
    concepts = list(dict.fromkeys(v.concept for v in pool if v.concept))
    others = [v for v in pool if not v.concept]
    generic, other = strata(k, len(pool), len(concepts), len(others), policy)
    chosen = [first[c] for c in draw(concepts, generic, f"{seed}::generic")] + draw(others, other, f"{seed}::nongeneric", lambda v: v.key)
    chosen += draw([v for v in pool if v not in chosen], k - len(chosen), f"{seed}::fill", lambda v: v.key)
    return sorted(chosen, key=lambda v: v.shown)[:k]


def catalog_items(values: Sequence[Value]) -> list[str]:
    return _distinct([v.label or v.value for v in values])


def query_items(values: Sequence[Value], policy: Policy, seed: str) -> list[str]:
    """Values as they are; of generic ones a share, by hash of the concept, as their meaning."""

    def as_label(concept: str) -> bool:
        return policy.label_share > 0 and (policy.label_share >= 1 or int(_hash(seed, concept), 16) % 10_000 < round(policy.label_share * 10_000))

    return _distinct([(v.label if v.concept and as_label(v.concept) else v.value) or v.value or v.label for v in values])


def small_rule(n: int, concepts: int, others: int, shown: tuple[int, int], policy: Policy) -> tuple[str | None, bool]:
    """(rule, whether the query side is left out) of up to three values; shown: items on the query and the catalog side."""
    if policy.strict and n <= 3 and others:
        return "strict_small", True
    if n == 1:
        return "n1", True
    if n == 2:
        return ("n2_telling", True) if others else ("n2_generic", False)
    if n == 3:
        if concepts / n >= policy.generic_threshold:
            return "n3_generic", False
        return ("n3_telling_too_few", True) if min(shown) < 2 else ("n3_telling", False)
    return None, False


def _within(a: Sequence[str], b: Sequence[str]) -> bool:
    return 0 < len(a) < len(b) and set(a) < set(b)


def summarise(pool: Sequence[Value], kind: str, name: str, policy: Policy) -> tuple:
    """SCHEMA's columns from n on, of an entry's values in display order.

    If the query side would show just what the catalog side does, it is drawn again, and left out if that doesn't help;
    of up to three values that are mostly telling (strict: of any number), a query side within the catalog's is left out.
    """
    n, concepts, others = len(pool), len({v.concept for v in pool if v.concept}), sum(not v.concept for v in pool)
    seeds = {side: f"{policy.salt}::{name}::{side}" for side in ("query", "cde")}
    sizes = [side_size(n, most, policy, seeds[side]) for side, most in (("query", policy.most_query), ("cde", policy.most_catalog))]
    query = query_items(draw_side(pool, sizes[0], policy, seeds["query"]), policy, seeds["query"])
    catalog = catalog_items(draw_side(pool, sizes[1], policy, seeds["cde"]))
    generic = n > 0 and concepts / n >= 0.5
    rule, omitted = small_rule(n, concepts, others, (len(query), len(catalog)), policy)
    redraws, before, after, within = 0, False, False, False
    if omitted:
        query = []
    elif query == catalog:
        before, k = True, len(query)
        while query == catalog and redraws < policy.redraws:
            redraws += 1
            query = query_items(draw_side(pool, k, policy, f"{seeds['query']}::resample::{redraws}"), policy, f"{seeds['query']}::render::{redraws}")
        after = query == catalog
        if after:
            query = []
    if not omitted and not after and _within(query, catalog) and (policy.strict or n <= 3 and not generic and len(query) <= 2):
        query, within = [], True
    omitted = omitted or (not query and n > 0)
    words = [set(" ".join(x).split()) for x in (query, catalog)]
    jaccard = len(words[0] & words[1]) / len(words[0] | words[1]) if all(words) else 0.0

    def block(items: list[str]) -> str:
        head = f"PV_TYPE: {kind}(n={n})"
        return f"{head}; PV: {policy.sep.join(items)}" if items else head

    return n, kind, block(catalog), policy.placeholder if omitted else block(query), concepts, *sizes, len(query), len(catalog), len(set(query) & set(catalog)), jaccard, omitted, rule, redraws, before, after, within, generic


def value_pools(values: DataFrame, order: str | None = None) -> DataFrame:
    """(cde_publicid, cde_version, kind, pool): each entry's distinct (value, meaning), in display order, then by order (a column; the texts, if none)."""
    have = values.columns
    meanings = [T.normalize_query(F.col(c)) for c in MEANINGS if c in have]
    if not meanings:
        raise ValueError(f"one of {MEANINGS} is needed")
    label = F.coalesce(*[F.when(m != "", m) for m in meanings], F.lit(""))
    value = T.normalize_query(F.col("valid_value")) if "valid_value" in have else F.lit("")
    concept = F.lit(None).cast("string")
    for name, texts in GENERIC_CONCEPTS.items():
        concept = F.when(F.lower("label").isin(*texts), name).otherwise(concept)
    if "generic_concept_code" in have:
        concept = F.coalesce(F.when(F.col("_code") != "", F.col("_code")), concept)
    if "is_generic" in have:
        concept = F.when(F.coalesce(F.col("is_generic").cast("boolean"), F.lit(True)), concept)
    rows = values.withColumns({"label": label, "value": value, "_code": T.normalize_query(F.col("generic_concept_code")) if "generic_concept_code" in have else F.lit("")})
    rank = F.col("meaning_concept_display_order").try_cast("double") if "meaning_concept_display_order" in have else F.lit(None).cast("double")
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    rows = rows.filter("value <> '' OR label <> ''").select("cde_publicid", "cde_version", "value", "label", concept.alias("concept"), F.coalesce(rank, F.lit(float("inf"))).alias("rank"), place.alias("place"))
    first = F.min_by(F.struct("concept", "rank", "place"), F.struct("place", "rank", "concept"))
    rows = rows.groupBy("cde_publicid", "cde_version", "value", "label").agg(first.alias("f")).select("cde_publicid", "cde_version", F.struct("f.rank", "f.place", "label", "value", "f.concept").alias("v"))
    pools = rows.groupBy("cde_publicid", "cde_version").agg(F.array_sort(F.collect_list("v")).alias("pool"))
    return pools.withColumn("kind", T.value_kind(F.col("pool.label")))


def value_summaries(values: DataFrame, policy: Policy | None = None, order: str | None = None) -> DataFrame:
    """Both summaries of each (cde_publicid, cde_version) and how they came about; SCHEMA's columns. A group handed to Python is one entry's distinct values."""
    policy = policy or Policy()

    def work(batches) -> Iterator:
        import pyarrow as pa

        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]
        for b in batches:
            out = []
            for r in b.to_pylist():
                pool = [Value(x["value"], x["label"], x["concept"], x["rank"], x["place"] if order else i) for i, x in enumerate(r["pool"])]
                out.append((r["cde_publicid"], r["cde_version"], *summarise(pool, r["kind"], f"{r['cde_publicid']}::{r['cde_version']}", policy)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    pools = value_pools(values, order)
    return pools.select(F.col("cde_publicid").cast("string"), F.col("cde_version").cast("string"), "kind", "pool").mapInArrow(work, SCHEMA)


def summary_blocks(values: DataFrame, policy: Policy | None = None, order: str | None = None) -> DataFrame:
    """The summaries alone, under the catalog's column names."""
    names = {"n": "PV_N", "kind": "PV_TYPE", "catalog_summary": "PV_BLOCK_CDE", "query_summary": "PV_BLOCK_SDE"}
    return value_summaries(values, policy, order).select("cde_publicid", "cde_version", *[F.col(a).alias(b) for a, b in names.items()])


def summary_report(summaries: DataFrame) -> DataFrame:
    """One row: entries, and the rates of omission, of equal sides before and after redraws, and of query sides within the catalog's."""
    rates = {"omission_rate": "omitted", "same_before_rate": "same_before", "same_after_rate": "same_after", "within_rate": "within_catalog"}
    means = {"mean_query": "n_query", "mean_catalog": "n_catalog"}
    return summaries.agg(F.count(F.lit(1)).alias("entries"), *[F.avg(F.col(c).cast("double")).alias(a) for a, c in (rates | means).items()])
