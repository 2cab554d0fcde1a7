"""Packing documents into training sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import few_files, give_back
from weftline.llm.token_ids import default_tokenizer, encoder

#: A group of documents that are packed together ends at this many documents or ids, whichever comes first.
GROUP_DOCS, GROUP_IDS = 2048, 8_000_000


class Tournament:
    """The room of bins in a tree whose inner nodes hold the larger room of the two below."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self._room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put size into the first bin that has room for it; return the bin."""
        room, i = self._room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        bin_, room[i] = i - self.leaves, room[i] - size
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return bin_


def pack(lengths: Sequence[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of the given lengths.

    Full pieces of capacity ids come first, as sequences of their own. The rests are packed by first-fit decreasing.
    Then the emptiest sequences are taken apart to fill the others up, with cuts; the one that is left not full is cut
    into sequences whose lengths are powers of two, which need no padding.
    """
    out, rests = [], []
    for doc, n in enumerate(lengths):
        full = n - n % capacity
        out += [[(doc, at, capacity)] for at in range(0, full, capacity)]
        if n > full:
            rests.append((n - full, doc, full))
    rests.sort(key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(max(len(rests), 1), capacity), {}
    for n, doc, at in rests:
        bins.setdefault(tree.place(n), []).append((doc, at, n))
    sized = sorted(((sum(p[2] for p in b), k) for k, b in bins.items()), key=lambda x: (-x[0], x[1]))
    lo, hi = 0, len(sized) - 1
    room = [capacity - s for s, _ in sized]
    while lo < hi:
        if not room[lo]:
            lo += 1
            continue
        source = bins[sized[hi][1]]
        doc, at, n = source.pop()
        part = min(n, room[lo])
        bins[sized[lo][1]].append((doc, at, part))
        room[lo] -= part
        if part < n:
            source.append((doc, at + part, n - part))
        if not source:
            hi -= 1
    out += [bins[k] for _, k in sized[:hi] if bins[k]]
    tail = bins[sized[hi][1]] if sized else []
    left = sum(p[2] for p in tail)
    tail = tail[::-1]
    while left:
        want = 1 << (left.bit_length() - 1)
        left, sequence = left - want, []
        while want:
            doc, at, n = tail.pop()
            part = min(n, want)
            sequence.append((doc, at, part))
            want -= part
            if part < n:
                tail.append((doc, at + part, n - part))
        out.append(sequence)
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, seed: int = 11, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, little-endian unsigned 32-bit).

    Documents are dealt to tasks by a seeded hash of id and text and packed in groups of at most GROUP_DOCS documents in
    that order, so a task holds one group's ids, however many documents share a hash. A null text counts as empty; a
    document then is its end id alone. Null and repeated ids are documents of their own. A text of any length is encoded
    whole and cut. An empty table gives an empty result. Other columns are not read.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = "string" if df.select(id_col).dtypes[0][1] == "string" else "bigint"
    fields = [f"doc_id {kind}", "start long", "length long", "ids_crc32 long", "doc_tokens long", "sequence_id long", "offset long", *["ids binary"] * with_ids]

    def packed(batches) -> Iterator:
        import pyarrow as pa

        types = [pa.string() if kind == "string" else pa.int64(), *[pa.int64()] * 6, *[pa.binary()] * with_ids]
        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 36

        def group(docs: list, ids: list) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in pack([len(x) for x in ids], capacity):
                offset = 0
                for d, at, n in pieces:
                    part = ids[d][at : at + n]
                    rows.append((docs[d], at, n, zlib.crc32(part), len(ids[d]), sequence, offset, *[part.tobytes()] * with_ids))
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in fields])

        docs, ids, held = [], [], 0
        for b in batches:
            names = iter(b.column(0).to_pylist())
            for flat, begins in enc.encode_batch(b.column(1), end_id):
                for i in range(len(begins) - 1):
                    docs.append(next(names))
                    ids.append(flat[begins[i] : begins[i + 1]])
                    held += len(ids[-1])
                    if len(docs) >= GROUP_DOCS or held >= GROUP_IDS:
                        yield group(docs, ids)
                        docs, ids, held = [], [], 0
                give_back()
        if docs:
            yield group(docs, ids)
        give_back()

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.withColumn("_deal", F.xxhash64(F.lit(seed), "_id", F.xxhash64("_text")))
    rows = rows.repartition("_deal").coalesce(few_files(df.sparkSession)).sortWithinPartitions("_deal", "_id")
    return rows.select("_id", "_text").mapInArrow(packed, ", ".join(fields))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
