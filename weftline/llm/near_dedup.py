"""Near-duplicate detection: fast similarity sketches, banding, and exact verification of links."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, attach_groups, few_files, give_back, open_shared
from weftline.llm.components import components
from weftline.llm.word_hashes import WordHashes, combine, scramble

COORDINATES, BAND = 128, 4
#: Of a pair at the threshold 0.8, 102 of 128 coordinates agree on average; fewer than this with a chance below 1 in 50,000.
LEAST_AGREEING = 79
#: Bytes of ids to drop that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 16 << 20
#: Members of a block; larger buckets are compared a pair of blocks at a time.
BLOCK = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUND = scramble(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of size words in a row; of all words, where there are fewer; none of none."""
    if not len(words):
        return words
    n = min(size, len(words))
    out = words[: len(words) - n + 1]
    for i in range(1, n):
        out = combine(out, words[i : len(words) - n + 1 + i])
    return np.unique(out if n == size else scramble(out + np.uint64(n)))


def sketch(elements: np.ndarray) -> np.ndarray:
    """COORDINATES values; the chance that a coordinate of two sets agrees is their Jaccard similarity.

    In round i each element is thrown into one bin; a bin keeps the smallest (round, hash). Rounds go on until every bin
    is filled. Should some be empty after COORDINATES rounds, each of as many more rounds throws all elements into one
    bin, so that every coordinate fills. Small sets run several rounds at once.
    """
    out, at = np.full(COORDINATES, _EMPTY), 0
    low, top = np.uint64(COORDINATES - 1), np.uint64(56)
    while at < COORDINATES:
        step = min(max(1, 512 // len(elements)), COORDINATES - at)
        h = scramble(elements[None, :] + _ROUND[at : at + step, None])
        key = (np.arange(at, at + step, dtype=np.uint64)[:, None] << top) | (h >> np.uint64(8))
        np.minimum.at(out, (h & low).astype(np.int64).ravel(), key.ravel())
        at += step
        if (out != _EMPTY).all():
            return out
    for b in np.flatnonzero(out == _EMPTY):
        h = scramble(elements + _ROUND[COORDINATES + b])
        out[b] = (np.uint64(COORDINATES + b) << top) | (h >> np.uint64(8)).min()
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(-1, BAND)
    key = parts[:, 0]
    for i in range(1, BAND):
        key = combine(key, parts[:, i])
    return combine(key, np.arange(len(parts), dtype=np.uint64)).view(np.int64)


def sketch_documents(df: DataFrame, folder: str, size: int) -> DataFrame:
    """(id, n, digest, bands, marks, file, at) from (id, text): number of shingles, a digest of their set, band keys, a byte a coordinate, and where in the shared folder the set's sorted hashes are written."""
    kind = df.dtypes[0][1]

    def work(batches):
        import pyarrow as pa

        hashes, path, begin = WordHashes(), f"{folder}/sets-{uuid.uuid4().hex}", 0
        system, own = open_shared(path)
        with system.open_output_stream(own) as out:
            for b in batches:
                for a in range(0, b.num_rows, 500):
                    part, rows = b.slice(a, 500), []
                    for text in part.column(1):
                        elements = shingles(hashes.of(text.as_py()), size)
                        if not len(elements):
                            rows.append((0, None, None, None, None, None))
                            continue
                        data, s = elements.tobytes(), sketch(elements)
                        out.write(data)
                        rows.append((len(elements), xxhash.xxh3_128_digest(data), bands(s).tolist(), scramble(s).astype(np.uint8).tobytes(), path, begin))
                        begin += len(data)
                    if rows:
                        types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["id", "n", "digest", "bands", "marks", "file", "at"])
        hashes.clear()
        give_back()

    return df.mapInArrow(work, f"id {kind}, n long, digest binary, bands array<bigint>, marks binary, file string, at long")


class _Sets:
    """Sets read from their files, kept while they take less than most bytes."""

    def __init__(self, most: int = 32 << 20):
        self._files, self._kept, self._held, self._most = {}, {}, 0, most

    def load(self, path: str, at: int, n: int) -> np.ndarray:
        found = self._kept.get((path, at))
        if found is None:
            if path not in self._files:
                if len(self._files) > 200:
                    self._files.clear()
                system, own = open_shared(path)
                self._files[path] = system.open_input_file(own)
            if self._held > self._most:
                self._kept, self._held = {}, 0
            found = self._kept[path, at] = np.frombuffer(self._files[path].read_at(8 * n, at), np.uint64)
            self._held += 8 * n
        return found


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted arrays without repeats."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    common = int((a[at] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def verify(pairs: DataFrame, reps: DataFrame, percent: int, total: int) -> DataFrame:
    """The links among pairs (a, b), each b in one only, checked on the whole sets, which are read from their files; total: about the number of pairs."""
    place = ["n", "file", "at"]
    centres = pairs.groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("_m")).join(reps, "rep")
    centres = centres.select(F.col("rep").alias("a"), F.col("_m").alias("n"), *[F.col(c).alias(f"a_{c}") for c in place])
    pairs = attach_groups(pairs, centres, ["a"], "b", total).drop("n")
    pairs = pairs.join(reps.select(F.col("rep").alias("b"), *[F.col(c).alias(f"b_{c}") for c in place]), "b")
    kind = dict(pairs.dtypes)["a"]

    def work(batches):
        import pyarrow as pa

        sets = _Sets()
        for b in batches:
            out = []
            for r in b.to_pylist():
                n, m = r["a_n"], r["b_n"]
                if 100 * min(n, m) >= percent * max(n, m) and linked(sets.load(r["a_file"], r["a_at"], n), sets.load(r["b_file"], r["b_at"], m), percent):
                    out.append((r["a"], r["b"]))
            if out:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in out], "b": [x[1] for x in out]})

    return pairs.coalesce(few_files(pairs.sparkSession)).sortWithinPartitions("a_file", "a_at").mapInArrow(work, f"a {kind}, b {kind}")


class _Union:
    """Union-find over small integers."""

    def __init__(self, names: np.ndarray):
        self.name = names.copy()

    def join(self, i: int, j: int) -> None:
        a, b = self.name[i], self.name[j]
        self.name[self.name == b] = a


def linked_in_bucket(rows: dict, load, percent: int) -> list[tuple]:
    """Links between different components of a bucket, as many as join them; rows: rep, label, n, band, bands, marks, file, at, block.

    If rows are of two blocks of the bucket, only members of different blocks are compared. Members are compared by sizes and sketches, and what may be a link is checked on the whole sets, unless the two are
    joined by then. A pair is left to the bucket of the first band that it shares. Members that agree most with a few
    others come first, so that the middle of a group of copies joins it early.
    """
    rep, n, bands, marks, band, block = rows["rep"], rows["n"], rows["bands"], rows["marks"], rows["band"], rows["block"]
    m, out, two = len(rep), [], rows["two"]
    trees = _Union(np.unique(np.array(rows["label"]), return_inverse=True)[1])
    if (trees.name == trees.name[0]).all():
        return out
    some = np.linspace(0, m - 1, min(m, 64)).astype(int)
    order = np.argsort(-sum((marks == marks[i]).sum(1) for i in some), kind="stable")
    done = np.zeros(m, bool)
    for i in order.tolist():
        done[i] = True
        other = np.flatnonzero(~done & (trees.name != trees.name[i]) & ((block != block[i]) | (not two)))
        other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
        if not len(other):
            continue
        other = other[(marks[other] == marks[i]).sum(1) >= LEAST_AGREEING]
        if band:
            other = other[~(bands[other, :band] == bands[i, :band]).any(1)]
        if not len(other):
            continue
        mine = load(rows["file"][i], rows["at"][i], int(n[i]))
        for j in other.tolist():
            if trees.name[i] == trees.name[j]:
                continue
            if linked(mine, load(rows["file"][j], rows["at"][j], int(n[j])), percent):
                trees.join(i, j)
                out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    return out


_MEMBER = ["band", "rep", "label", "n", "bands", "marks", "file", "at"]


def _links(blocks: list, load, percent: int) -> list[tuple]:
    """The links inside one block, or between the members of two; a block is a table of _MEMBER columns."""
    band, rep, label, n, bands, marks, file, at = zip(*(row for b in blocks for row in zip(*(b.column(c).to_pylist() for c in _MEMBER), strict=True)), strict=True)
    block = np.repeat(np.arange(len(blocks)), [b.num_rows for b in blocks])
    return linked_in_bucket({"rep": rep, "label": label, "n": np.array(n), "band": band[0], "bands": np.array(bands), "marks": np.frombuffer(b"".join(marks), np.uint8).reshape(len(rep), -1), "file": file, "at": at, "block": block, "two": len(blocks) == 2}, load, percent)


def bucket_links(scratch: Scratch, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the buckets of members; see linked_in_bucket.

    First a task looks into one block of a bucket at a time. Where a bucket has several, each block is written to a
    file, and then pairs of them are read and compared, unless both are of the same component; only the blocks' places
    are joined to pairs.
    """
    kind = dict(members.dtypes)["rep"]
    folder = scratch.folder("blocks")

    def within(batches):
        import pyarrow as pa

        sets, path, begin, out = _Sets(), f"{folder}/{uuid.uuid4().hex}", 0, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

        def block(held: list):
            nonlocal begin, out
            rows = pa.Table.from_batches(held).combine_chunks()
            links = _links([rows], sets.load, percent) if rows.num_rows > 1 else []
            if links:
                a, b = (pa.array(x, rows.schema.field("rep").type) for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([a, b, *(pa.nulls(len(links), k) for k in kinds), pa.nulls(len(links), a.type)], names=names)
            if rows.column("many")[0].as_py():
                if out is None:
                    system, own = open_shared(path)
                    out = system.open_output_stream(own)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.select(_MEMBER).schema) as writer:
                    writer.write_table(rows.select(_MEMBER))
                data = sink.getvalue()
                out.write(data)
                labels = rows.column("label").unique()
                none = pa.nulls(1, labels.type)
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array([x], k) for x, k in zip([rows.column("key")[0].as_py(), rows.column("block")[0].as_py(), path, begin, data.size], kinds, strict=True)), pa.array([labels[0].as_py() if len(labels) == 1 else None], labels.type)], names=names)
                begin += data.size

        held, now = [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column("key")), np.asarray(b.column("block"))])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and tuple(keys[:, i]) != now:
                    yield from block(held)
                    held = []
                now = tuple(keys[:, i])
                held.append(b.slice(i, j - i))
        if held:
            yield from block(held)
        if out is not None:
            out.close()

    names = ["a", "b", "key", "block", "file", "at", "size", "label"]
    rows = members.select("key", "block", "many", *_MEMBER).repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    found = scratch.table(rows.mapInArrow(within, f"a {kind}, b {kind}, key long, block long, file string, at long, size long, label {kind}"), "within")
    links = found.filter("a IS NOT NULL").select("a", "b")
    refs = found.filter("file IS NOT NULL").select(names[2:])
    if refs.isEmpty():
        return links
    left, right = (refs.select("key", *[F.col(c).alias(f"{c}_{side}") for c in names[3:]]) for side in "ab")
    pairs = left.join(right, "key").filter("block_a < block_b AND NOT coalesce(label_a = label_b, false)")
    pairs = scratch.table(pairs.select("file_a", "at_a", "size_a", "file_b", "at_b", "size_b"), "block-pairs")
    n, tasks = pairs.count(), int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def across(batches):
        import pyarrow as pa

        sets = _Sets()

        def load(path: str, at: int, size: int):
            system, own = open_shared(path)
            with system.open_input_file(own) as f:
                return pa.ipc.open_stream(f.read_at(size, at)).read_all()

        for b in batches:
            for r in b.to_pylist():
                links = _links([load(r[f"file_{x}"], r[f"at_{x}"], r[f"size_{x}"]) for x in "ab"], sets.load, percent)
                if links:
                    yield pa.RecordBatch.from_pydict({"a": [x[0] for x in links], "b": [x[1] for x in links]})

    more = pairs.repartition(max(1, min(n, max(tasks, n // 64)))).mapInArrow(across, f"a {kind}, b {kind}")
    return links.unionAll(more)


def _open_buckets(scratch: Scratch, members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with what linked_in_bucket needs, dealt to blocks of about BLOCK; members of a large component have blocks of their own."""
    rows = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rows = scratch.small(rows, "labelled-members")
    sizes = scratch.small(rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    several = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("_labels"), F.sum("n").alias("n")).filter("_labels > 1").select("key", "n")
    rows = attach_groups(rows, several, ["key"], "rep", rows.count()).filter("n IS NOT NULL").withColumnRenamed("n", "_all")
    large = sizes.filter(F.col("n") > BLOCK).withColumn("_parts", F.ceil(F.col("n") / BLOCK))
    rows = attach_groups(rows, large, ["key", "label"], "rep", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).drop("n")
    own = F.xxhash64("label", F.pmod(F.xxhash64("rep"), "_parts"))
    block = F.when(F.col("_parts").isNotNull(), own).otherwise(F.pmod(F.xxhash64("label", F.lit(2)), F.ceil(F.col("_all") / BLOCK)))
    rows = rows.select("key", "band", "rep", "label", block.alias("block"), (F.col("_all") > BLOCK).alias("many"))
    return rows.join(reps, "rep")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row.

    Two texts are linked if the Jaccard similarity of their sets of shingle words in a row is at least percent / 100;
    candidates share a band of four of the sketch's 128 coordinates (a pair at 0.8 does with a chance of 1 - 5e-8) and
    each link is confirmed on the whole sets. component_id is the smallest id that can be reached by links, kept says
    whether it is the row's own.

    Texts of equal sets are one node. First each node is checked against the smallest one of its buckets, which joins
    large groups of copies by as many checks as they have members. Then only members of different components of a bucket
    are compared, by their sketches, and checked where they lie, a large bucket in blocks and pairs of blocks that go to
    tasks of their own; what leaves a pair of blocks is the links that join components, fewer than it has members.

    A null text counts as empty; texts without words are linked with nothing. A row with a null id is linked with
    nothing, its component_id is null and it is kept. Rows that repeat an id have the component of all of them. Whole
    texts count. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "near")
    texts = df.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("_text"))
    docs = scratch.table(sketch_documents(texts, scratch.folder("sets"), shingle), "docs")
    groups = docs.filter("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first(F.struct("n", "bands", "marks", "file", "at")).alias("s"))
    groups = scratch.small(groups.select("digest", "low", "copies", "s.*"), "groups")
    # an id that several texts share links them; the smallest id names a node only where there is none
    same = docs.filter("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("d1"), F.max("digest").alias("d2")).filter("d1 <> d2").select("id", "d1")
    by_digest = not same.isEmpty()
    groups = groups.withColumn("rep", F.col("digest" if by_digest else "low"))
    reps = groups.drop("digest", "low", "copies")

    keys = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    multi = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("centre")).filter("m > 1")
    nodes = reps.count()
    members = attach_groups(keys, multi.withColumnRenamed("m", "n"), ["key"], "rep", nodes * COORDINATES // BAND)
    members = scratch.small(members.filter("n IS NOT NULL").drop("n"), "members")
    stars = members.filter("rep <> centre").groupBy(F.col("rep").alias("b")).agg(F.min("centre").alias("a"))
    stars = verify(scratch.small(stars.select("a", "b"), "pairs"), reps, percent, nodes)
    if by_digest:
        stars = stars.unionAll(docs.filter("n > 0").join(same, "id").select(F.col("d1").alias("a"), F.col("digest").alias("b")).filter("a <> b").distinct())
    stars = scratch.table(stars, "stars")
    rows = _open_buckets(scratch, members.select("key", "band", "rep"), components(scratch, stars, "star-labels"), reps)
    links = scratch.small(bucket_links(scratch, rows, percent).distinct().unionAll(stars), "links")
    labels = components(scratch, links, "labels")
    groups = groups.select("digest", "low", F.col("rep").alias("node"), F.col("copies").alias("n")).join(labels, "node", "left").select("digest", "low", F.coalesce("label", "node").alias("component"), "n")
    if by_digest:
        groups = scratch.small(groups.withColumnsRenamed({"n": "copies", "digest": "own"}), "labelled")
        lowest = scratch.small(groups.groupBy(F.col("component").alias("digest")).agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")), "lowest")
        groups = attach_groups(groups.select("own", "copies", F.col("component").alias("digest"), F.xxhash64("own").alias("_salt")), lowest, ["digest"], "_salt", groups.count()).select(F.col("own").alias("digest"), F.col("least").alias("component"), F.col("copies").alias("n"))
    groups = groups.select("digest", "component", "n")
    rows = docs.select("id", F.col("n").alias("size"), "digest", F.xxhash64("id", "at").alias("_salt"))
    out = attach_groups(rows, scratch.small(groups, "components"), ["digest"], "_salt", docs.count())
    scratch.drop("sets", "groups", "members", "stars", "links", "pairs", "labelled", "lowest", "labelled-members", "sizes", "blocks", "within", "block-pairs")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """df without the rows that near_duplicates doesn't keep, all columns.

    Null, empty and wordless texts and rows with a null id stay. Ties are no matter, as ids decide; rows that repeat an id
    stay or go together, so equal rows of the smallest id of a group all stay. Whole texts count. An empty table stays
    empty. Columns may have any names.
    """
    out = near_duplicates(df, id_col, text_col, shingle, percent).filter(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    out = Scratch(df.sparkSession, "near").small(out, "gone")
    size = out.agg(F.coalesce(F.sum(F.octet_length(F.col("_gone").cast("string")) + 16), F.lit(0))).first()[0]
    out = F.broadcast(out) if size <= MOST_BROADCAST else out  # the texts needn't move then
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    docs = df.toDF(*names.values())
    docs = docs.join(out, F.col(names[id_col]) == F.col("_gone"), "left_anti")
    return docs.select(*[F.col(x).alias(c) for c, x in names.items()])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
