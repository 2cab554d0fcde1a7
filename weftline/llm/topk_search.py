"""Exact top-k by inner product over integer vectors, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, open_shared, write_shared

#: Queries in one block, and rows in one chunk; a task compares a block with a chunk.
BLOCK, CHUNK = 8192, 1 << 16
_NONE = -(2**63) + 1


def segment_stats(x, segments: int):
    """Vectors (rows, 2 * segments) whose inner product bounds that of the rows of x from above.

    Within a segment of length n, x.y = n * mean_x * mean_y + (x - mean_x).(y - mean_y), and the last term is at most
    n * dev_x * dev_y.
    """
    import numpy as np

    parts = np.array_split(x, segments, axis=1)
    scale = [np.sqrt(p.shape[1]) for p in parts]
    return np.hstack([np.stack([s * p.mean(axis=1) for s, p in zip(scale, parts, strict=True)], 1), np.stack([s * p.std(axis=1) for s, p in zip(scale, parts, strict=True)], 1)])


class Searcher:
    """The best k rows so far of every query of a block; rows come in batches."""

    def __init__(self, ids, vectors, k: int, levels: Sequence[int]):
        import numpy as np

        self.ids, self.x, self.k = ids, vectors, k
        self.levels = [n for n in levels if n < vectors.shape[1]]
        self.stats = [segment_stats(vectors.astype(float), n) for n in self.levels]
        self.best = np.zeros((len(ids), 0), np.int64)
        self.who = np.zeros((len(ids), 0), np.int64)
        self.pairs = self.computed = 0

    def _dot(self, a, b):
        """Inner products, exact as integers."""
        import numpy as np

        most = max(float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1), 1.0)
        if most < 2**53:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        return a @ b.T

    def add(self, ids, x) -> None:
        import numpy as np

        for at in range(0, len(ids), 1024):
            self._add(ids[at : at + 1024], x[at : at + 1024], np)

    def _add(self, ids, x, np) -> None:
        full = self.best.shape[1] >= self.k
        self.pairs += len(self.ids) * len(ids)
        alive = np.ones((len(self.ids), len(ids)), bool)
        if full:
            floor = self.best[:, -1:].astype(float)
            for n, mine in zip(self.levels, self.stats, strict=True):
                rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                if not len(rows) or not len(cols):
                    return
                bound = mine[rows] @ segment_stats(x[cols].astype(float), n).T
                # rounding of the bound is far below one unit in 2**-20 of it
                alive[np.ix_(rows, cols)] &= bound + np.abs(bound) * 2**-20 + 1e-6 >= floor[rows]
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows) or not len(cols):
            return
        self.computed += len(rows) * len(cols)
        score = self._dot(self.x[rows], x[cols])
        least = _NONE
        score[~alive[np.ix_(rows, cols)] | (self.ids[rows][:, None] == ids[cols][None, :])] = least
        everything = np.hstack([self.best[rows], score]) if full else np.hstack([self.best, score])
        who = np.hstack([self.who[rows], np.broadcast_to(ids[cols], score.shape)])
        order = np.lexsort((who, -everything), axis=1)[:, : self.k] if everything.shape[1] <= 4 * self.k else self._few(everything, who, np)
        take = np.take_along_axis
        if full:
            self.best[rows], self.who[rows] = take(everything, order, 1), take(who, order, 1)
        else:
            self.best, self.who = take(everything, order, 1), take(who, order, 1)

    def _few(self, score, who, np):
        """Places of the best k of each row, ties to the smaller id."""
        cut = -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        out = np.empty((len(score), self.k), np.int64)
        for i in range(len(score)):
            near = np.flatnonzero(score[i] >= cut[i])
            out[i] = near[np.lexsort((who[i, near], -score[i, near]))[: self.k]]
        return out

    def rows(self) -> Iterator[tuple]:
        least = _NONE
        for q, scores, who in zip(self.ids.tolist(), self.best.tolist(), self.who.tolist(), strict=True):
            for s, w in zip(scores, who, strict=True):
                if s != least:
                    yield q, w, s


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 20, k: int = 20, scale: float = 64.0, levels: Sequence[int] = (2, 4, 8, 16), block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_every, its k best other rows.

    Components become floor(scale * x). The score is the inner product of two such vectors; ties go to the smaller id.
    All rows are searched. Queries lie in blocks and rows in chunks, in files of the shared folder, and a task takes one
    of each: it keeps each query's best k so far and passes over rows whose bound by segment means and deviations is
    below the worst of them, coarse segments first; the rows left are computed exactly. The driver sees numbers of files
    only. A shorter vector counts as padded with zeros. Null vectors, those with a null or non-finite component and rows
    without an id take no part. Rows that repeat an id are searched each, but none answers a query of its own id. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    x = F.transform(F.col("_v"), lambda v: v.cast("double"))
    bad = F.exists(F.col("_v"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).withColumn("_v", x).filter(F.col("_id").isNotNull() & F.col("_v").isNotNull() & ~bad)
    rows = rows.select("_id", F.transform("_v", lambda v: F.floor(v * scale)).alias("_v"))
    folder = scratch.folder("vectors")
    chunks = scratch.table(_write(rows, folder, chunk), "chunks")
    queries = rows.filter(F.col("_id") % query_every == 0)
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(1, -(-total // (block * query_every)))  # about the number of blocks, if ids are even
    blocks = scratch.table(_write(queries.repartition(most, F.xxhash64("_id")), folder, block), "blocks")
    jobs = chunks.select(F.col("file").alias("rows"), "width").crossJoin(blocks.select(F.col("file").alias("queries"), F.col("width").alias("_w")))  # of files
    jobs = scratch.table(jobs.select("rows", "queries", F.greatest("width", "_w").alias("width")), "jobs")
    found = _search(jobs.repartition(max(1, min(jobs.count(), 100_000))), k, list(levels))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(vectors, width: int):
    """An Arrow list array as a matrix, short rows padded with zeros."""
    import numpy as np

    begins = np.asarray(vectors.offsets)
    flat, sizes = np.asarray(vectors.values)[begins[0] : begins[-1]], np.diff(begins)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(begins[:-1] - begins[0], sizes)] = flat
    return out


def _write(rows: DataFrame, folder: str, most: int) -> DataFrame:
    """(file, n, width) of files with up to most rows (id, vector) each: ids, then a matrix as wide as the longest vector."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            ids, vectors = (table.column(i).combine_chunks() for i in (0, 1))
            width = max(int(np.diff(np.asarray(vectors.offsets)).max()), 1)
            path = f"{folder}/{uuid.uuid4().hex}"
            write_shared(path, [np.array([len(ids), width], "<i8").tobytes(), np.asarray(ids).astype("<i8").tobytes(), _matrix(vectors, width).astype("<i8").tobytes()])
            return pa.RecordBatch.from_pydict({"file": [path], "n": [len(ids)], "width": [width]})

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, most - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == most:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return rows.mapInArrow(work, "file string, n long, width long")


def _read(path: str, width: int):
    """(ids, vectors) of a file, padded to width."""
    import numpy as np

    system, path = open_shared(path)
    with system.open_input_stream(path) as f:
        data = np.frombuffer(f.read(), "<i8")
    n, own = int(data[0]), int(data[1])
    x = data[2 + n :].reshape(n, own)
    return data[2 : 2 + n], x if own == width else np.hstack([x, np.zeros((n, width - own), np.int64)])


def _search(jobs: DataFrame, k: int, levels: list[int]) -> DataFrame:
    def search(batches):
        import pyarrow as pa

        for b in batches:
            for job in b.to_pylist():
                searcher = Searcher(*_read(job["queries"], job["width"]), k, levels)
                searcher.add(*_read(job["rows"], job["width"]))
                out = list(searcher.rows())
                for at in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 50_000], strict=True)], names=["query_id", "vec_id", "score"])

    return jobs.mapInArrow(search, "query_id long, vec_id long, score long")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
