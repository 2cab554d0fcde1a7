"""Token shards and packing: round trips against whole-text encoding."""

import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from weftline.llm import token_ids
from weftline.llm.common import Scratch
from weftline.llm.packing import Tournament, pack, pack_documents
from weftline.llm.token_ids import default_tokenizer, encoder
from weftline.llm.token_shards import Shard, token_shards, write_shards

ODD = [None, "", " ", "  ", " a", "a ", "a  b", "a   b", "a \n b", "\n\n a", "x\t y", "it's 's", "b 　 c", "a ᠎ b", "a \x1cb", "<|endoftext|> a", "word " * 3000]


def plain(texts):
    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3)


def test_encoder_equals_whole_text_encoding(monkeypatch):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" \n\tab.'s1é") for _ in range(rng.randint(1, 14))) for _ in range(500)]
    monkeypatch.setattr(token_ids, "_RUN", 5000)
    runs = encoder(default_tokenizer()).encode_batch(pa.array(texts), 0)
    assert [ids[a:b].tolist() for ids, begins in runs for a, b in zip(begins, begins[1:], strict=False)] == plain(texts)


def test_shards_round_trip(spark):
    rows = sorted(token_shards(frame(spark, ODD)).collect())
    at = 0
    for row, ids in zip(rows, plain(ODD), strict=True):
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        assert (row.start, row.n_tokens) == (at, len(ids))
        at += len(ids)


def test_shards_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x"), (5, "b"), (5, "a"), (-2, "c")], "doc_id long, text string")
    rows = sorted(token_shards(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -2, 5, 5]
    assert token_shards(df.limit(0)).count() == 0


def test_lookup_in_a_shard(spark):
    texts = [f"text number {i} " * 20 for i in range(3000)]
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    shards = [Shard(r.path) for r in write_shards(df, scratch.folder("files")).collect()]
    want = plain(texts[:50])
    for i in range(50):
        found = [x for x in (s.get(i * 3) for s in shards) if x is not None]
        assert len(found) == 1 and np.frombuffer(found[0], "<u2").tolist() == want[i]
    assert all(s.get(i) is None for s in shards for i in (1, 2, 4, -7, 10**9))


def test_tournament_is_first_fit():
    rng = random.Random(5)
    sizes = [rng.randint(1, 1023) for _ in range(400)]
    tree, room = Tournament(len(sizes), 1024), [1024] * len(sizes)
    for n in sizes:
        first = next(i for i, r in enumerate(room) if r >= n)
        room[first] -= n
        assert tree.place(n) == first


def test_pack_covers_each_id_once_without_padding():
    rng = random.Random(7)
    for _ in range(30):
        lengths = [rng.choice([1, 5, 300, 1023, 1024, 1025, 5000, rng.randint(1, 2000)]) for _ in range(rng.randint(0, 200))]
        seen = sorted(piece for sequence in pack(lengths, 1024) for piece in sequence)
        at = dict.fromkeys(range(len(lengths)), 0)
        for doc, start, n in seen:
            assert at[doc] == start and n > 0
            at[doc] += n
        assert list(at.values()) == lengths
        for sequence in pack(lengths, 1024):
            n = sum(p[2] for p in sequence)
            assert n <= 1024 and n & (n - 1) == 0


def test_packed_pieces_carry_the_ids(spark):
    rows = pack_documents(frame(spark, ODD), with_ids=True).collect()
    want = plain(ODD)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert ids.tolist() == want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, want))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
    assert pack_documents(frame(spark, ODD).limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b")] * 5, "doc_id long, text string")
    assert pack_documents(same).count() >= 5


def test_packing_writes_few_files(spark, tmp_path):
    held = {"spark.sql.shuffle.partitions": "160", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        pack_documents(frame(spark, [f"text {i}" for i in range(400)])).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list(tmp_path.glob("out/part-*"))) <= 20
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sum(r.length for r in rows) == sum(map(len, plain([f"text {i}" for i in range(400)])))
    spots = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(spots)) == len(spots)  # no two tasks give the same sequence
