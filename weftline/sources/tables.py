"""Files in and out: Parquet merges, CSV allow-lists, run folders, fingerprints."""

from __future__ import annotations

import hashlib
import shutil
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.text import blank, to_bool


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and filter reach the scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(*columns) if columns else df


def merge_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Many tables under the first one's schema: its columns in its types, missing ones null."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more.select(*[(F.col(c) if c in more.columns else F.lit(None)).cast(t).alias(c) for c, t in tables[0].dtypes]))
    return out


def merge_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Many files under the first one's schema."""
    return merge_tables([spark.read.parquet(p) for p in paths])


def write_rankings(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def read_allow_list(spark: SparkSession, path: str, required: Sequence[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """A curated CSV, white space and case as they are; missing columns, blanks and repeated rows are errors. A column enabled, if there, drops rows."""
    df = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    for c, value in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in df.columns else F.lit(value))
    if "enabled" in df.columns:
        df = df.filter(to_bool(F.col("enabled")))
    blanks = df.filter(" OR ".join(f"trim(coalesce(`{c}`, '')) = ''" for c in required)).limit(1).count()
    if blanks or df.groupBy(*required).count().filter("count > 1").limit(1).count():
        raise ValueError("the allow-list has blank or repeated rows")
    return df


def grouped_import(df: DataFrame, keys: Sequence[str], order: str, entity: str, value: str, gold: str) -> DataFrame:
    """Rows of a curation sheet to one query a key: the first entity that isn't blank, values in order, gold ids."""
    some = F.nullif(F.trim(F.col(entity)), F.lit(""))
    rows = df.groupBy(*keys).agg(
        F.min_by(some, F.when(some.isNotNull(), F.col(order))).alias("entity"),
        F.array_sort(F.collect_list(F.when(F.trim(blank(F.col(value))) != "", F.struct(F.col(order).alias("o"), F.trim(F.col(value)).alias("v"))))).alias("_v"),
        F.array_sort(F.collect_set(F.col(gold))).alias("golds"),
    )
    values = F.transform("_v", lambda x: x["v"])
    return rows.withColumns({"values": values, "block": F.concat(F.lit("PV_TYPE: ENUM(n="), F.size(values).cast("string"), F.lit("); PV: "), F.array_join(values, " | "))}).drop("_v")


def sheet_rows(df: DataFrame, position: str, first: str, header: str, search: int = 20) -> DataFrame:
    """Rows below the header, which is the first of the leading search rows whose first cell is header; blank separators leave."""
    at = df.filter((F.col(position) < search) & (F.lower(F.trim(F.col(first))) == header.lower())).agg(F.min(position).alias("_at"))
    return df.crossJoin(F.broadcast(at)).filter((F.col(position) > F.col("_at")) & (F.trim(blank(F.col(first))) != "")).drop("_at")  # one row


def ids_in_cell(df: DataFrame, column: str) -> DataFrame:
    """One row a number in the cell, in order."""
    return df.select("*", F.posexplode(F.regexp_extract_all(blank(F.col(column)), F.lit(r"[0-9]+"), F.lit(0))).alias("at", "id"))


def read_runs(spark: SparkSession, pattern: str, fallback: str | None = None) -> DataFrame:
    """(run, config, metrics) of run folders with a config and a metrics JSON; both as maps of text; unreadable or single files are skipped.

    pattern has {file} where run_config or metrics goes; fallback is the same for another place of the metrics.
    """

    def read(file: str, place: str) -> DataFrame:
        raw = spark.read.text(place.format(file=file), wholetext=True).withColumn("path", F.col("_metadata.file_path"))
        return raw.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("run"), F.from_json("value", "map<string,string>").alias(file)).filter(F.col(file).isNotNull())

    metrics = read("metrics", pattern)
    if fallback:
        metrics = metrics.unionByName(read("metrics", fallback).join(metrics.select("run"), "run", "left_anti"))
    return read("run_config", pattern).join(metrics, "run").select("run", F.col("run_config").alias("config"), "metrics")


def long_metrics(runs: DataFrame) -> DataFrame:
    """(run, split, metric, value) of metrics that hold a JSON object a split; finite numbers only."""
    rows = runs.select("run", F.explode("metrics").alias("split", "_m")).select("run", "split", F.explode(F.from_json("_m", "map<string,string>")).alias("metric", "_v"))
    value = F.col("_v").try_cast("double")
    return rows.select("run", "split", "metric", value.alias("value")).filter(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))


def wide_metrics(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row a run and split."""
    return long_metrics(runs).groupBy("run", "split").pivot("metric", list(metrics)).agg(F.first("value"))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """A digest of a table's rows in any order: number, sum and exclusive or of row hashes."""
    h = F.xxhash64(*columns)
    row = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).first()
    return hashlib.sha1(repr(tuple(row)).encode()).hexdigest()


def cached_if_same(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame | None:
    """A cached table if each of wanted equals the one value of its column; else None."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if any(c not in df.columns for c in wanted):
        return None
    seen = df.select(*wanted).distinct().limit(2).collect()
    return df if len(seen) == 1 and all(seen[0][c] == v for c, v in wanted.items()) else None


def first_of_splits(frames: Sequence[DataFrame], query: str, gold: str) -> DataFrame:
    """Splits with differing columns as one table, the smallest gold of each query."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    w = Window.partitionBy(query).orderBy(gold)
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def listed_candidates(rows: DataFrame, split: DataFrame, catalog: DataFrame, depth: int, original: str = "query_id", split_original: str = "original_query_id", element: str = "data_element", complete: bool = True) -> DataFrame:
    """(query_id, cde_id, rank, score) of an imported table of comma lists, depth candidates a row.

    rows: original, is_evaluable, element, top20_public_ids, top20_scores; split: query_id, split_original, element;
    catalog: cde_publicid, cde_version. Rows that aren't evaluable or not in the split leave; public ids get the catalog's
    highest version, unknown ones leave and their rank stays free. Errors: lists of unequal length, an element that differs
    from the split's, and, with complete, a split row without an imported one.
    """
    from weftline.functions.ids import version_key

    def cells(c: str):
        return F.filter(F.transform(F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")

    kept = rows.filter(F.lower(F.trim(F.col("is_evaluable").cast("string"))) == "true")
    kept = kept.select(F.col(original).cast("bigint").alias("_o"), F.trim(element).alias("_e"), cells("top20_public_ids").alias("ids"), cells("top20_scores").alias("scores"))
    wanted = split.select(F.col(split_original).cast("bigint").alias("_o"), F.col("query_id").cast("string").alias("query_id"), F.col(element).alias("_want"))
    if complete and (lost := wanted.join(kept, "_o", "left_anti").limit(5).collect()):
        raise ValueError(f"no imported row for {sorted(r['_o'] for r in lost)} and perhaps others")
    both = kept.join(wanted, "_o")
    odd = both.filter((F.size("ids") != F.size("scores")) | ((F.col("_e") != "") & (F.col("_e") != F.col("_want")))).limit(1).collect()
    if odd:
        raise ValueError(f"row {odd[0]['_o']}: lists of unequal length, or another element than the split's")
    best = catalog.groupBy(F.col("cde_publicid").cast("string").alias("public_id")).agg(F.max_by("cde_version", F.struct(version_key(F.col("cde_version")), "cde_version")).alias("_v"))
    long = both.select("query_id", F.posexplode(F.slice(F.arrays_zip("ids", "scores"), 1, depth)).alias("_i", "_x"))
    long = long.select("query_id", F.col("_x.ids").alias("public_id"), (F.col("_i") + 1).alias("rank"), F.col("_x.scores").cast("double").alias("score"))
    return long.join(best, "public_id").select("query_id", F.concat_ws("::", "public_id", "_v").alias("cde_id"), "rank", "score")


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def pinned_copies(source: str, target: str, pins: dict[str, tuple[str, str]], dry_run: bool = False) -> dict[str, str]:
    """Copy files under names of their own: pins holds name -> (file in source, its SHA-256). Returns name -> copied or kept.

    Driver-side, for small frozen inputs. A file that differs from its digest is an error, and so is a different file
    under the target's name: nothing is overwritten. A copy gets its name once it is whole and checked.
    """
    done = {}
    for name, (file, digest) in pins.items():
        at, to = Path(source, file), Path(target, f"{name}.parquet")
        if not at.is_file() or _digest(at) != digest:
            raise ValueError(f"{at} is missing or differs from its digest")
        if to.exists():
            if _digest(to) != digest:
                raise ValueError(f"{to} is another file; move it aside first")
            done[name] = "kept"
            continue
        done[name] = "copied"
        if not dry_run:
            to.parent.mkdir(parents=True, exist_ok=True)
            own = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
            shutil.copyfile(at, own)
            if _digest(own) != digest:
                own.unlink()
                raise ValueError(f"the copy of {at} differs")
            own.rename(to)
    return done
