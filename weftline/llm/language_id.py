"""Language identification: known words by log frequency, unseen words by ever shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import crc_mod, give_back

#: A word: a letter, and the letters and marks that follow.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: The model is fitted on about this many labelled rows of each language, chosen by a hash of id and text, or on all where there are fewer.
MOST_TRAINING_ROWS = 1_500
LONGEST_GRAM = 5
#: Tokens that are looked up at once, and tokens that are remembered.
_CHUNK, _KEPT = 100_000, 150_000
#: A text's evidence counts as that of at most so many words, so that the posterior isn't always 1.
_EVIDENCE = 20


def _grams(word: str, n: int) -> list[str]:
    word = f"<{word}>"
    return [word[i : i + n] for i in range(len(word) - n + 1)] if n > 1 else list(word[1:-1])


def _key(gram: str, size: int) -> int:
    """A hash of a word (size 0) or an n-gram."""
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"), size)


class Model:
    """Per-language log frequencies of words and of character n-grams of 1 to LONGEST_GRAM letters.

    In each of the six tables, a gram that a language has n times out of t has log((n + 0.5) / (t + 0.5 * (grams + 1))).
    """

    def __init__(self, languages: list[str], size: np.ndarray, key: np.ndarray, language: np.ndarray, n: np.ndarray):
        """A count a row: size (0 for words, else the n-gram's), _key, place of the language, count."""
        self.languages = languages
        self.keys, self.logs = [], []
        for s in range(LONGEST_GRAM + 1):
            own = size == s
            keys, at = np.unique(key[own].astype(np.uint64), return_inverse=True)
            table = np.zeros((len(keys), len(languages)))
            np.add.at(table, (at, language[own]), n[own])
            self.keys.append(keys)
            self.logs.append(np.log((table + 0.5) / (table.sum(0) + 0.5 * (len(keys) + 1))).astype(np.float32))

    def __getstate__(self):
        return {k: v for k, v in vars(self).items() if k != "_tokens"}

    def forget(self) -> None:
        """Drop the remembered tokens."""
        vars(self).pop("_tokens", None)

    @classmethod
    def of(cls, counts: Iterable[tuple[int, str, str, int]]) -> Model:
        """From (size, gram, language, count)."""
        rows = list(counts)
        languages = sorted({r[2] for r in rows})
        return cls(languages, *(np.array([f(r) for r in rows], kind) for f, kind in ((lambda r: r[0], int), (lambda r: _key(r[1], r[0]), np.uint64), (lambda r: languages.index(r[2]), int), (lambda r: r[3], int))))

    def _find(self, size: int, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, log frequencies) of each gram; 0 where not known."""
        keys, logs = self.keys[size], self.logs[size]
        if not len(keys):
            return np.zeros(len(grams), bool), np.zeros((len(grams), len(self.languages)))
        wanted = np.fromiter((_key(g, size) for g in grams), np.uint64, len(grams))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[at] == wanted
        return known, np.where(known[:, None], logs[at], 0.0)

    def words(self, words: list[str]) -> np.ndarray:
        """Log frequencies by language of each word; those of an unseen word are the sum over its known n-grams of the longest n that has any, divided by n."""
        known, out = self._find(0, words)
        rest = np.flatnonzero(~known)
        for n in range(LONGEST_GRAM, 0, -1):
            if not len(rest):
                break
            grams = [_grams(words[i], n) for i in rest.tolist()]
            sizes = np.array([len(g) for g in grams])
            word = np.repeat(np.arange(len(rest)), sizes)
            hit, logs = self._find(n, [g for x in grams for g in x])
            found = np.bincount(word[hit], minlength=len(rest)) > 0
            sums = np.zeros((len(rest), len(self.languages)))
            np.add.at(sums, word[hit], logs[hit])
            out[rest[found]] = sums[found] / n
            rest = rest[~found]
        return out

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """(language, its posterior) of each text; (und, 0) without a letter, or where no language is known."""
        if not self.languages:
            for _ in texts:
                yield "und", 0.0
            return
        if not hasattr(self, "_tokens"):
            self._tokens = _Tokens(self)
        for sums in self._tokens.sums(texts):
            if not sums[-1]:
                yield "und", 0.0
                continue
            log = sums[:-1] * min(1.0, _EVIDENCE / sums[-1])
            p = np.exp(log - log.max())
            best = int(p.argmax())
            yield self.languages[best], float(p[best] / p.sum())


class _Tokens(dict):
    """Token between white space -> row of a table of (the sum of its words' log frequencies, its number of words)."""

    def __init__(self, model: Model):
        super().__init__()
        self._model, self._new = model, []
        self._table = np.zeros((0, len(model.languages) + 1))

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        self._new.append(token)
        return at

    def _fill(self) -> None:
        """Rows for the tokens met since the last call."""
        words, sizes = [], []
        for token in self._new:
            found = _WORD.findall(token.lower())
            words += found
            sizes.append(len(found))
        rows = np.zeros((len(sizes), self._table.shape[1]))
        np.add.at(rows, np.repeat(np.arange(len(sizes)), sizes), np.hstack([self._model.words(words), np.ones((len(words), 1))]))
        self._table = np.concatenate([self._table, rows])
        self._new = []

    def sums(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The sums over each text's tokens."""
        held, size = [], 0

        def close():
            if self._new:
                self._fill()
            for ids in held:
                yield sum((self._table[ids[i : i + _CHUNK]].sum(0) for i in range(0, len(ids), _CHUNK)), np.zeros(self._table.shape[1]))
            if len(self) > _KEPT:
                self.clear()
                self._table = self._table[:0]

        for text in texts:
            tokens = (text or "").split()
            held.append(np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens)))
            size += len(tokens)
            if size >= _CHUNK:
                yield from close()
                held, size = [], 0
        yield from close()


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", most_rows: int = MOST_TRAINING_ROWS) -> Model:
    """A model of the rows of df that have a text and a label.

    Fitted on about most_rows of them a label, by a hash of id and text, so that a rare language is learned as well as a
    common one. All words and n-grams of these rows' whole texts are in the model, so its size is bounded by theirs.
    """
    df = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(label_col).cast("string").alias("_label")).filter("_label IS NOT NULL AND _text IS NOT NULL")
    sizes = {r["_label"]: r["count"] for r in df.groupBy("_label").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model.of([])
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, most_rows / sizes[k]))])
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 52)) / float(1 << 52)
    df = df.withColumn("_share", share[F.col("_label")]).filter(draw < F.col("_share"))
    place = {k: i for i, k in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        words: dict[str, Counter] = {}

        def counted():
            for label, found in words.items():
                grams: list[Counter] = [found, *(Counter() for _ in range(LONGEST_GRAM))]
                for word, n in found.items():
                    for s in range(1, LONGEST_GRAM + 1):
                        for g in _grams(word, s):
                            grams[s][g] += n
                for s, c in enumerate(grams):
                    if c:
                        keys = np.fromiter((_key(g, s) for g in c), np.uint64, len(c)).view(np.int64)
                        yield pa.RecordBatch.from_pydict({"size": pa.array(np.full(len(c), s, np.int32)), "key": keys, "language": pa.array(np.full(len(c), place[label], np.int32)), "n": pa.array(list(c.values()), pa.int64())})
            words.clear()

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(label, Counter()).update(_WORD.findall(text.lower()))
            if sum(map(len, words.values())) > _KEPT:
                yield from counted()
        yield from counted()
        give_back()

    counts = df.select("_text", "_label").mapInArrow(count, "size int, key long, language int, n long").groupBy("size", "key", "language").agg(F.sum("n").alias("n")).toArrow()
    size, key, language, n = (np.asarray(counts.column(c)) for c in ("size", "key", "language", "n"))
    return Model(languages, size, np.ascontiguousarray(key).view(np.uint64), language, n)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score for every row.

    Only the text counts. A null, empty or letterless text is und with score 0, and so is every text where the model
    knows no language. Ties go to the first language by code point. Rows that repeat an id are each answered, null ids
    stay null. Whole texts are scored, however long. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return _predicted(rows, "_text", model).select(F.col("_id").alias(id_col), "lang_pred", "score")


def _predicted(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """df and lang_pred, score."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by its training rows

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            found = list(sent.value.predict(x.as_py() for x in b.column(b.schema.get_field_index(text_col))))
            answers = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *answers], names=[*b.schema.names, "lang_pred", "score"])
        sent.value.forget()
        give_back()

    names = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(predict, f"{names}, lang_pred string, score double")


def label_languages(df: DataFrame, model: Model, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The rows of df whose text has a language, all columns; label_col, where null, gets the predicted language.

    Null, empty and letterless texts go. Where the model knows no language, every text with a letter stays and its null
    label does too. Rows are judged each by its own text, so ties and repeated rows are all kept or all dropped. Whole
    texts count. An empty table gives an empty result. Columns may have any names.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    docs, text, label = df.toDF(*names.values()), names[text_col], names[label_col]
    if model.languages:
        kind = dict(df.dtypes)[label_col]
        docs = _predicted(docs, text, model).filter("lang_pred <> 'und'").withColumn(label, F.coalesce(label, F.col("lang_pred").cast(kind)))
    else:
        docs = docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return docs.select(*[F.col(x).alias(c) for c, x in names.items()])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
