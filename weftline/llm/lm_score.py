"""Language-model scores by a weighted backoff automaton of n-grams."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, crc_mod, give_back, open_shared, write_shared
from weftline.llm.word_hashes import WordHashes, combine

#: A word has no blank, so these are no word's hashes.
START, END = (np.uint64(int.from_bytes(x, "big")) for x in (b"\x01 start\x01", b"\x02 end\x02\x02\x02"))
#: Words in a gram, and how many occurrences the next shorter context counts as.
ORDER, STRENGTH = 3, 64.0
#: Tokens of a block of texts; grams of a shard of the model; tokens that one lane of a traversal takes.
_BLOCK, _SHARD, _LANE = 3 << 19, 1 << 23, 1 << 10
#: Parts of the model that are counted one after the other; the grams on their way to the shards are of one part only.
_ROUNDS = 2


def _pack(x: np.ndarray) -> bytes:
    """Integers, a plane of bytes after the other."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest one needs."""
    width = next(w for w in (1, 2, 4, 8) if int(n.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + _pack(n.astype(f"<u{width}"))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data[1:], f"<u{data[0]}").astype(np.int64)


def write_blocks(rows: DataFrame, folder: str, block: int) -> DataFrame:
    """(block, file, ids, sizes, learn, scored, tokens): texts in runs of about block tokens, from (id, text, learn, scored).

    The tokens of a run (of each text its start, its words and its end) go to a file of their own: the run's vocabulary
    by frequency, and each token's place there.
    """
    kind = rows.dtypes[0][1]

    def work(batches):
        import pyarrow as pa

        hashes, held, size, parts = WordHashes(), [], 0, []

        def close():
            tokens = np.concatenate(held)
            words, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            name = uuid.uuid4().hex
            write_shared(f"{folder}/{name}", [len(words).to_bytes(8, "little"), words[order].astype("<u8").tobytes(), _pack(place[at])])
            table = pa.Table.from_batches(parts).combine_chunks()
            lists = {c: table.column(c).combine_chunks() for c in ("ids", "learn", "scored")} | {"sizes": pa.array([len(x) for x in held], pa.int64())}
            arrays = {c: pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), x) for c, x in lists.items()}
            columns = {"block": pa.array([name]), "file": pa.array([f"{folder}/{name}"]), **arrays, "tokens": pa.array([len(tokens)], pa.int64())}
            return pa.RecordBatch.from_pydict({c: columns[c] for c in names})

        for b in batches:
            narrow = pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3)], names=["ids", "learn", "scored"])
            begin = 0
            for i, text in enumerate(b.column(1)):
                held.append(np.concatenate([[START], hashes.of(text.as_py()), [END]]))
                size += len(held[-1])
                if size >= block:
                    parts.append(narrow.slice(begin, i + 1 - begin))
                    yield close()
                    held, size, parts, begin = [], 0, [], i + 1
                    give_back()
            if begin < b.num_rows:
                parts.append(narrow.slice(begin))
        if held:
            yield close()
        give_back()

    names = ["block", "file", "ids", "sizes", "learn", "scored", "tokens"]
    return rows.mapInArrow(work, f"block string, file string, ids array<{kind}>, sizes array<bigint>, learn array<boolean>, scored array<boolean>, tokens long")


class Block:
    """The grams of a run of texts: of each order the distinct ones, and which of them ends at each token.

    With span, only the grams of more than a word whose hashes lie in it, both ends included.
    """

    def __init__(self, path: str, sizes: np.ndarray, order: int, span: tuple[int, int] | None = None):
        system, path = open_shared(path)
        with system.open_input_stream(path) as f:
            data = f.read()
        n = int.from_bytes(data[:8], "little")
        self.words, self.at = np.frombuffer(data, "<u8", n, 8), _unpack(data[8 + 8 * n :], "<i4")
        self.sizes, self.order = sizes, order
        self.begins = np.cumsum(sizes) - sizes
        within = np.arange(len(self.at), dtype=np.int32) - np.repeat(self.begins.astype(np.int32), sizes)
        tokens = self.words[self.at]
        #: of order k at k - 1: hashes of the distinct grams; the tokens that end one; their grams' places
        self.grams, self.ends, self.place = [self.words], [np.arange(len(self.at), dtype=np.int32)], [self.at]
        h = tokens
        for k in range(2, order + 1):
            ends = np.flatnonzero(within >= k - 1).astype(np.int32)
            h = np.concatenate([h[:1], combine(h[:-1], tokens[1:])])
            if span is not None:
                ends = ends[(h[ends] >= np.uint64(span[0])) & (h[ends] <= np.uint64(span[1]))]
            gram, place = np.unique(h[ends], return_inverse=True)
            self.grams.append(gram)
            self.ends.append(ends)
            self.place.append(place.astype(np.int32))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All grams' hashes, shorter grams first, and the order that sorts them."""
        keys = np.concatenate(self.grams)
        return keys, np.argsort(keys, kind="stable")

    def counts(self, learn: np.ndarray) -> np.ndarray:
        """How often each gram occurs in the texts to learn from, in the order of keys()[0]."""
        learn = np.repeat(learn, self.sizes)
        return np.concatenate([np.bincount(p, learn[e], len(g)) for g, e, p in zip(self.grams, self.ends, self.place, strict=True)]).astype(np.int64)


class Automaton:
    """The part of the model that the texts of a block can reach.

    States are the empty context and each context of up to order - 1 tokens seen in training. A state's arcs lead to the
    tokens seen after it, its failure arc to the context without its first token. An arc from h to w weighs
    p(w | h) = (n(hw) + strength * p(w | h')) / (n(h) + strength), with h' where the failure arc leads, a failure arc
    strength / (n(h) + strength), and the empty context gives each token (n(w) + 1) / (N + V + 1); so the probabilities
    of each state sum to 1. An arc leads to the longest seen context that ends the text read so far.
    """

    def __init__(self, block: Block, n: np.ndarray, tokens: int, types: int, strength: float):
        """n: of each gram of block its count in training, in the order of block.keys()[0]."""
        sizes = [len(g) for g in block.grams]
        offset = np.cumsum([0, *sizes])
        self.order, self.words = block.order, sizes[0]
        self.count = n[: self.words]
        p = (self.count + 1) / (tokens + types + 1)
        self.base = np.log10(p)
        self.enter = np.where(self.count > 0, np.arange(self.words), -1)
        # the last of each is the empty context's, which is state -1
        self.fail = np.full(offset[-2 if block.order > 1 else -1] + 1, -1)
        self.failure = np.zeros(len(self.fail))
        arcs, weights, targets = [], [], []
        for k in range(1, block.order):
            ends, place = block.ends[k], block.place[k]
            at = np.zeros(sizes[k], np.int32)
            at[place] = ends  # some occurrence of each gram
            shorter = np.full(len(block.at), -1, np.int32)
            shorter[block.ends[k - 1]] = block.place[k - 1]
            prefix, suffix, word = shorter[at - 1], shorter[at], block.at[at]
            del shorter, at
            own, before = n[offset[k] : offset[k + 1]], n[offset[k - 1] : offset[k]][prefix]
            p = (own + strength * p[suffix]) / (before + strength)
            seen = own > 0
            suffix = suffix + offset[k - 1]
            arcs.append((prefix[seen] + offset[k - 1]) * self.words + word[seen])
            weights.append(np.log10(p[seen]))
            if k + 1 < block.order:
                self.fail[offset[k] : offset[k + 1]] = suffix
                targets.append(np.flatnonzero(seen) + offset[k])
            else:
                targets.append(suffix[seen])
        self.failure[:-1] = np.log10(strength / (n[: len(self.failure) - 1] + strength))
        arcs, weights, targets = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (arcs, weights, targets))
        order = np.argsort(arcs)
        self.arcs = np.append(arcs[order], np.iinfo(np.int64).max)
        self.weights, self.targets = weights[order], targets[order].astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 probability) of reading a word in each state: its arc, or failure arcs until there is one."""
        state, log, after = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        rest = np.arange(len(state))
        for _ in range(self.order - 1):
            arc = state[rest] * self.words + word[rest]
            at = np.searchsorted(self.arcs, arc)
            hit = self.arcs[at] == arc
            found, at = rest[hit], at[hit]
            log[found] += self.weights[at]
            after[found] = self.targets[at]
            rest = rest[~hit]
            failed = state[rest]
            log[rest] += self.failure[failed]
            state[rest] = self.fail[failed]
        log[rest] += self.base[word[rest]]
        after[rest] = self.enter[word[rest]]
        return after, log

    def walk(self, block: Block, texts: np.ndarray, lane: int) -> np.ndarray:
        """The log10 probability of each of texts (their places in block), read from left to right.

        Many texts are read side by side. A text longer than lane is read in lanes; each starts order - 1 tokens early,
        which is all that its state depends on, so that it goes on in the state that the lane before ends in.
        """
        parts = -(-block.sizes[texts] // lane)
        text = np.repeat(np.arange(len(texts)), parts)
        first, end = block.begins[texts][text], (block.begins + block.sizes)[texts][text]
        cut = first + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * lane
        begin, end = np.maximum(cut - (self.order - 1), first), np.minimum(cut + lane, end)
        counted = np.maximum(cut, first + 1)  # a start has no probability
        by_size = np.argsort(begin - end, kind="stable")
        begin, end, counted = begin[by_size], end[by_size], counted[by_size]
        size, total, state = end - begin, np.zeros(len(text)), np.full(len(text), -1)
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t))
            at = begin[:m] + t
            state[:m], log = self.step(state[:m], block.at[at])
            total[:m] += np.where(at >= counted[:m], log, 0.0)
        return np.bincount(text[by_size], total, len(texts))


def _ask(blocks: DataFrame, order: int, bits: int, first: int, last: int) -> DataFrame:
    """(shard, block, ask, keys, counts): of each block the sorted grams of a shard, from first up to before last, with 2 * count + (whether it is a word)."""
    edges = [shard << (64 - bits) for shard in range(first, last + 1)]

    def work(batches):
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                block = Block(r["file"], np.array(r["sizes"]), order, (edges[0], edges[-1] - 1))
                keys, by_key = block.keys()
                counts = 2 * block.counts(np.array(r["learn"], bool)) + (np.arange(len(keys)) < len(block.words))
                keys, counts = keys[by_key], counts[by_key]
                cuts = [len(keys) if e >> 64 else int(np.searchsorted(keys, np.uint64(e))) for e in edges]
                ask, out = any(r["scored"]), []
                for shard, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False), first):
                    if a < z:
                        out.append((shard, r["block"], ask, _pack_sorted(keys[a:z]), _pack_counts(counts[a:z])))
                del block, keys, counts, by_key
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["shard", "block", "ask", "keys", "counts"])
                del out
                give_back()

    return blocks.select("block", "file", "sizes", "learn", "scored").mapInArrow(work, "shard long, block string, ask boolean, keys binary, counts binary")


def _answer(asked: DataFrame) -> DataFrame:
    """(block, shard, n, types): the counts in all of training of the grams that a block asked for; types (block null): a shard's distinct words."""

    def work(batches):
        import pyarrow as pa

        def answers(rows: list[dict]):
            keys = [_unpack_sorted(r["keys"]) for r in rows]
            counts = np.concatenate([_unpack_counts(r["counts"]) for r in rows])
            sizes = np.cumsum([0, *map(len, keys)])
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, at, counts >> 1)
            word = np.zeros(len(own), bool)
            word[at[(counts & 1) == 1]] = True
            out = [(None, None, None, int((word & (n > 0) & (own != START)).sum()))]
            out += [(r["block"], r["shard"], _pack_counts(n[at[a:z]]), None) for r, a, z in zip(rows, sizes, sizes[1:], strict=False) if r["ask"]]
            types = [pa.string(), pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "shard", "n", "types"])

        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["shard"] != r["shard"]:
                    yield answers(held)
                    held = []
                    give_back()
                held.append(r)
        if held:
            yield answers(held)
        give_back()

    return asked.mapInArrow(work, "block string, shard long, n binary, types long")


def score_texts(df: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: float = STRENGTH, block: int = _BLOCK, shard: int = _SHARD, lane: int = _LANE) -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score for every row of df, by a model of train's texts.

    train is a table with the same text column, or a condition: the model then learns from the rows of df that meet it,
    which are read once. Tokens are the text's words, A-Z lower-cased, and one end. base_score is the log10 probability
    by single tokens, score that by the automaton of grams of up to order tokens; see Automaton.

    Texts are read in blocks of about block tokens. A block's distinct grams with their counts go, sorted, to the shards
    of the model (about shard grams each) by their hash, are summed there over all blocks, and the totals come back; a
    block's automaton is then built of its own grams only, so no task holds more than a shard or a block. No gram is
    left out, and a common one is a row a block. The shards are served in rounds, and what was sent in one is deleted
    before the next, so that the disk holds one round's grams.

    A null or empty text has the end alone. Without training texts each token has probability 1 in both. Rows that repeat
    an id are scored each; null ids stay null. Whole texts count, however long; a text longer than a block is one of its
    own. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "lm")

    def text(frame: DataFrame):
        return F.encode(F.coalesce(frame[text_col].cast("string"), F.lit("")), "utf-8").alias("_text")

    kind = df.select(id_col).dtypes[0][1]
    if isinstance(train, Column):
        rows = df.select(F.col(id_col).alias("_id"), text(df), F.coalesce(train, F.lit(False)).alias("_learn"), F.lit(True).alias("_scored"))
    else:
        rows = df.select(F.col(id_col).alias("_id"), text(df), F.lit(False).alias("_learn"), F.lit(True).alias("_scored"))
        rows = rows.unionAll(train.select(F.lit(None).cast(kind), text(train), F.lit(True), F.lit(False)))
    blocks = scratch.table(write_blocks(rows, scratch.folder("tokens"), block), "blocks")
    learned = F.aggregate(F.zip_with("sizes", "learn", lambda n, use: F.when(use, n - 1).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    total, held, tokens = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(learned), F.lit(0))).first()
    bits = max(0, (order * held // shard).bit_length())
    edges = sorted({(1 << bits) * i // _ROUNDS for i in range(_ROUNDS + 1)})
    answers = None
    for first, last in zip(edges, edges[1:], strict=False):
        asked = _ask(blocks.repartition(max(total, 1)), order, bits, first, last).repartition(last - first, "shard").sortWithinPartitions("shard", "block")
        part = scratch.table(_answer(asked), f"answers-{first}")
        del asked
        scratch.release()  # the grams sent take most of the disk
        answers = part if answers is None else answers.unionAll(part)
    types = answers.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]

    def score(batches):
        import pyarrow as pa

        def scored(row: dict, parts: list[bytes]):
            own = Block(row["file"], np.array(row["sizes"]), order)
            by_key = own.keys()[1]
            n = np.empty(len(by_key), np.int64)
            n[by_key] = np.concatenate([_unpack_counts(x) for x in parts])
            del by_key
            model = Automaton(own, n, tokens, types, strength)
            del n, own.grams, own.ends, own.place
            texts = np.flatnonzero(np.array(row["scored"], bool))
            real = np.ones(len(own.at), bool)
            real[own.begins] = False
            sums = [np.add.reduceat(np.where(real, x[own.at], 0), own.begins)[texts] for x in (model.count > 0, model.base)]
            ids = pa.array(row["ids"], names_type).take(pa.array(texts))
            columns = [ids, own.sizes[texts] - 1, sums[0], np.full(len(texts), tokens), sums[1], model.walk(own, texts, lane)]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        head, parts = None, []
        for b in batches:
            names_type = b.schema.field("ids").type.value_type
            for r in b.to_pylist():
                if r["shard"] == -1:
                    if head is not None:
                        yield scored(head, parts)
                        give_back()
                    head, parts = r, []
                else:
                    parts.append(r["n"])
        if head is not None:
            yield scored(head, parts)
        give_back()

    heads = blocks.filter(F.exists("scored", lambda x: x)).select("block", F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("n"), "file", "ids", "sizes", "scored")
    empty = {c: F.lit(None).cast(t) for c, t in heads.dtypes if c not in answers.columns}
    both = heads.unionByName(answers.filter("block IS NOT NULL").drop("types").withColumns(empty))
    both = both.repartition(max(total, 1), "block").sortWithinPartitions("block", "shard")
    return both.mapInArrow(score, f"_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("_id", id_col)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 7) == 2
    rows = score_texts(docs, ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
