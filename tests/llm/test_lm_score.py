"""Language-model scores against counts and a step-by-step walk in plain Python."""

import math
import random
from collections import Counter

import pytest

from weftline.llm.lm_score import STRENGTH, op4_lm_score, score_texts


class Plain:
    """The automaton of texts, one step at a time; contexts are tuples."""

    def __init__(self, texts, order=3, strength=STRENGTH):
        self.n, self.order, self.strength, self.one = Counter(), order, strength, Counter()
        for t in texts:
            words = [None, *self.split(t)]
            self.one.update(words[1:])
            for k in range(1, order + 1):
                self.n.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        self.total, self.types = sum(self.one.values()), len(self.one)

    @staticmethod
    def split(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            lowered = lowered.replace(c, " ")
        return [w for w in lowered.split(" ") if w] + ["<end> "]

    def p(self, w):
        return (self.one[w] + 1) / (self.total + self.types + 1)

    def step(self, state, w):
        """The probability of w in a state: by its arc, whose weight holds that of the shorter contexts, or by failure."""
        if not state:
            return self.p(w)
        below = self.step(state[1:], w)
        if (*state, w) in self.n:
            return (self.n[(*state, w)] + self.strength * below) / (self.n[state] + self.strength)
        return self.strength / (self.n[state] + self.strength) * below

    def after(self, state, w):
        state = (*state, w)[-(self.order - 1) :] if self.order > 1 else ()
        while state and state not in self.n:
            state = state[1:]
        return state

    def score(self, text):
        state, log = self.after((), None), 0.0
        for w in self.split(text):
            log += math.log10(self.step(state, w))
            state = self.after(state, w)
        return log


def corpus(rng):
    texts = [" ".join(rng.choice(["The", "of", "é", "A|B", "x y", "lone%d" % rng.randint(0, 300)]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    return texts + [None, "", " \t\n", "the of the of " * 5000, "The\x0bof\x0cé"]


@pytest.mark.parametrize("order,sizes", [(3, {}), (3, {"block": 400, "shard": 9000, "lane": 7}), (1, {"block": 500}), (2, {"block": 300, "lane": 3}), (4, {"block": 2000, "shard": 30_000, "lane": 2})])
def test_scores(spark, order, sizes):
    rows = list(enumerate(corpus(random.Random(4)))) + [(7, "again"), (None, "of the"), (500, "the of the of")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    plain = Plain([t for i, t in rows if i is not None and i % 3], order)
    want = []
    for i, t in rows:
        words = plain.split(t)
        want.append((i, len(words), sum(plain.one[w] > 0 for w in words), plain.total, sum(math.log10(plain.p(w)) for w in words), plain.score(t)))
    want.sort(key=str)
    train = df["doc_id"] % 3 != 0
    for learn in (train, df.filter(train)):  # a null id meets no condition
        got = sorted(map(tuple, score_texts(df, learn, order=order, **sizes).collect()), key=str)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(corpus(random.Random(4)))
    for state in [(), (None,), (None, "the"), ("the",), ("the", "of"), ("x", "y")]:
        assert state == () or state in plain.n
        assert sum(plain.step(state, w) for w in plain.one) + plain.step(state, "never seen") == pytest.approx(1)


def test_no_training_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = score_texts(df, df.limit(0)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert score_texts(df.limit(0), df).count() == 0
    assert score_texts(df.limit(0), df["doc_id"] > 0).count() == 0


def test_query_has_an_arc_for_grams_seen_once(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "rare%d" % rng.randint(0, 500)]) for _ in range(20))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_lm_score(spark, str(tmp_path)).collect()}
    plain = Plain([t for i, t in rows if not got[i].held_out])
    assert 1 in plain.n.values() and any(r.held_out for r in got.values())
    for i, t in rows:
        assert got[i].score == pytest.approx(plain.score(t), rel=1e-9)


def test_texts_learned_twice_are_told_apart(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=60)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:40]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_texts(df, df["doc_id"] >= 0).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 200))


def test_grams_are_sent_in_rounds(spark, monkeypatch):
    from weftline.llm import lm_score

    sent, answer = [], lm_score._answer

    def count(asked):
        sent.append(sum(len(r["keys"]) for r in asked.collect()))
        return answer(asked)

    monkeypatch.setattr(lm_score, "_answer", count)
    texts = [" ".join(f"w{i * j % 97}" for j in range(60)) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Plain(texts)
    got = {r.doc_id: r.score for r in score_texts(df, df, block=2000, shard=500).collect()}
    assert all(got[i] == pytest.approx(plain.score(t), rel=1e-9) for i, t in enumerate(texts[:20]))
    assert max(sent) < 0.6 * sum(sent)  # the disk never holds all of them
