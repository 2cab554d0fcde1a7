"""Language identification and quality scores: held-out accuracy, edge cases, posteriors by hand."""

import math
import random
import unicodedata
from collections import Counter

import pytest
import xxhash

from weftline.llm import language_id, quality
from weftline.llm.language_id import Model, fit, identify, label_languages
from weftline.llm.quality import score_quality, site_posteriors


def corpus(n=300):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "uvwxyzé"}
    out = []
    for i in range(n):
        lang = ["aa", "bb"][i % 2]
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 7))) for _ in range(30)]
        out.append((i, " ".join(words), lang, "clash"))
    return out


def test_language(spark):
    schema = "doc_id long, text string, lang string, score string"
    df = spark.createDataFrame(corpus(), schema)
    model = fit(df.filter("doc_id < 200"), most_rows=150)
    odd = [(1000, None, None, ""), (1001, "", "aa", ""), (1002, "12 ... !!", "bb", ""), (None, "vwx " * 60_000, None, ""), (1003, "x" * 500, None, ""), (1003, "x" * 500, None, "")]
    both = df.unionAll(spark.createDataFrame(odd, schema))
    rows = identify(both, model).collect()
    assert all(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert all(0 <= r.score <= 1 for r in rows)
    assert {(r.doc_id, r.lang_pred) for r in rows if r.doc_id is None or r.doc_id >= 1000} == {(1000, "und"), (1001, "und"), (1002, "und"), (None, "bb"), (1003, "bb")}
    left = label_languages(both, model)
    assert left.columns == both.columns and left.count() == 303
    assert {r.lang for r in left.filter("doc_id = 1003 OR doc_id IS NULL").collect()} == {"bb"}
    assert label_languages(both.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify(df, fit(df.limit(0))).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0


def test_unlabelled_texts_are_kept(spark):
    rows = [(1, "some words", None), (2, "12 -- !", None), (3, None, None), (4, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in label_languages(df, fit(df)).collect()) == [1, 4]


def test_sample_goes_by_id_and_text(spark):
    for same in (None, 1):  # rows that share an id are neither all taken nor all left
        rows = [(same, f"word{i} " + "abc " * (i % 7), ["aa", "bb"][i % 2]) for i in range(400)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert fit(df, most_rows=100).languages == ["aa", "bb"]


def test_backoff_goes_to_the_longest_known_ngram():
    model = Model.of([(0, "abc", "x", 3), (3, "abd", "x", 2), (3, "abd", "y", 1), (1, "d", "y", 9), (1, "d", "x", 1), (1, "q", "x", 1)])
    abd, zd, none = model.words(["abd", "zd", "!!"])
    assert abd[0] > abd[1] and zd[1] > zd[0] and list(none) == [0.0, 0.0]
    tie = Model.of([(0, "a", "y", 1), (0, "a", "x", 1)])
    assert list(tie.predict(["a", "½ ² Ⅷ 12 _", "a½"])) == [("x", 0.5), ("und", 0.0), ("x", 0.5)]


def plain_predictions(train, texts):
    """Words first, then 5- to 1-grams, with dictionaries."""

    def words(text):
        found, now = [], ""
        for c in (text or "").lower() + " ":
            if unicodedata.category(c)[0] == "L" or now and unicodedata.category(c)[0] == "M":
                now += c
            elif now:
                found.append(now)
                now = ""
        return found

    def grams(w, n):
        return [w] if n == 0 else list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]

    languages = sorted({x for _, x in train})
    counts = {(n, x): Counter() for n in range(6) for x in languages}
    for text, x in train:
        for w in words(text):
            for n in range(6):
                counts[n, x].update(grams(w, n))
    kinds = [len(set().union(*(counts[n, x] for x in languages))) for n in range(6)]

    def log(n, g, x):
        return math.log((counts[n, x][g] + 0.5) / (sum(counts[n, x].values()) + 0.5 * (kinds[n] + 1)))

    def score(w, x):
        for n in (0, 5, 4, 3, 2, 1):
            known = [g for g in grams(w, n) if any(counts[n, y][g] for y in languages)]
            if known:
                return sum(log(n, g, x) for g in known) / max(n, 1)
        return 0.0

    for text in texts:
        found = words(text)
        if not found:
            yield "und", 0.0
            continue
        logs = [sum(score(w, x) for w in found) * min(1, 20 / len(found)) for x in languages]
        p = [math.exp(v - max(logs)) for v in logs]
        yield languages[p.index(max(p))], max(p) / sum(p)


@pytest.mark.parametrize("chunk", [200_000, 3])
def test_scores_equal_plain_ones(spark, monkeypatch, chunk):
    monkeypatch.setattr(language_id, "_CHUNK", chunk)
    monkeypatch.setattr(language_id, "_KEPT", chunk)
    rng = random.Random(5)
    letters = {"aa": "abcdé", "bb": "abxyz", "cc": "कखािी"}
    rows = []
    for i in range(90):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", "-1", "'s"]) for _ in range(rng.randint(1, 12))), lang))
    rows += [(900, "Abxé zzzz q! 9", None), (901, "y" * 300, "bb"), (902, "a" * 70 + " ½", None), (903, "", "aa"), (904, None, "aa"), (905, "一 Ⅷ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    train = df.filter("doc_id % 4 <> 2")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(df, fit(train)).collect()}
    want = plain_predictions([(t, x) for i, t, x in rows if i % 4 != 2 and x is not None], [t for _, t, _ in rows])
    for (i, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-4)


def test_quality_learns_and_keeps(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        docs.append((i, (" ||| " if bad else " ").join(rng.sample(words, 20)), f"h{i % 4}", "p", 1.0))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    docs += [(None, None, None, None, 1.0), (601, "", "new", None, 1.0), (602, "a " * 50_000, "h1", "p", 1.0), (602, "a " * 50_000, "h1", "p", 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, score double")
    lab = spark.createDataFrame(labels + [(3, 7), (None, 1), (4, None)], "doc_id long, quality int")
    rows = score_quality(df, lab).collect()
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None and r.doc_id < 600:
            assert r.keep == (r.doc_id % 5 != 0)
    assert {r.score for r in score_quality(df, lab.limit(0)).collect()} == {0.5}
    assert score_quality(df.limit(0), lab).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 1)] * 50 + [("big", "p", 0)] * 50 + [("big", "q", 0), ("small", "r", 1), ("bare", "s", None), (None, None, 1)]
    got = {(r.host, r.path): r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, y int")).collect()}
    prior = got["bare", "s"].prior
    assert abs(prior - 53 / 105) < 1e-12
    assert got["bare", "s"].host_rate == prior and abs(got["bare", "s"].path_rate - prior) < 1e-12
    assert prior < got["small", "r"].host_rate <= got["small", "r"].path_rate < 1
    assert got["big", "q"].path_rate < got["big", "p"].path_rate
    assert set(got) == {("big", "p"), ("big", "q"), ("small", "r"), ("bare", "s"), (None, None)}


def plain_quality(rows, labels, fold):
    """Scores of (id, text, host, path) with dictionaries; fold: of each labelled id."""

    def features(text):
        runs, kind = [], None
        for c in (text or "").lower():
            now = "l" if c.isalpha() else "d" if c.isdigit() else None if c.isspace() else "s"
            if now and now == kind:
                runs[-1] += c
            elif now:
                runs.append(c)
            kind = now
        return [xxhash.xxh32_intdigest(x) % quality.FEATURES for x in runs]

    def weights(without):
        n = [Counter(), Counter()]
        for i, t, _, _ in rows:
            if i in labels and fold[i] != without:
                n[labels[i]].update(features(t))
        total = [sum(c.values()) + 0.5 * quality.FEATURES for c in n]
        return lambda f: math.log((n[1][f] + 0.5) / total[1] / ((n[0][f] + 0.5) / total[0]))

    known = {f: weights(f) for f in [*range(quality.FOLDS), None]}
    evidence = []
    for i, t, _, _ in rows:
        found = [known[fold.get(i)](f) for f in features(t)]
        evidence.append(sum(found) / len(found) if found else 0.0)
    y = [labels.get(r[0]) for r in rows]
    of = [[e for e, v in zip(evidence, y, strict=True) if v == c] for c in (0, 1)]
    mean = [sum(x) / len(x) for x in of]
    var = sum((e - mean[c]) ** 2 for c in (0, 1) for e in of[c]) / sum(map(len, of))

    def sites(key):
        n, good = Counter(), Counter()
        for r, v in zip(rows, y, strict=True):
            n[key(r)] += v is not None
            good[key(r)] += v or 0
        return n, good

    def strength(n, good, centre):
        all_n = sum(n.values())
        spread = sum(n[s] * (good[s] / n[s] - centre(s)) ** 2 for s in n if n[s]) / all_n
        noise = sum(centre(s) * (1 - centre(s)) for s in n if n[s]) / all_n
        level = sum(n[s] * centre(s) * (1 - centre(s)) for s in n if n[s]) / all_n
        return min(max(level / max(spread - noise, 1e-9), 1), 1000)

    hosts, paths = sites(lambda r: r[2]), sites(lambda r: (r[2], r[3]))
    prior = (sum(hosts[1].values()) + 1) / (sum(hosts[0].values()) + 2)
    a = strength(*hosts, lambda s: prior)
    b = strength(*paths, lambda s: (hosts[1][s[0]] + a * prior) / (hosts[0][s[0]] + a))
    for r, e, v in zip(rows, evidence, y, strict=True):
        one, own, site = v is not None, v or 0, (r[2], r[3])
        host = (hosts[1][r[2]] - own + a * prior) / (hosts[0][r[2]] - one + a)
        p = (paths[1][site] - own + b * host) / (paths[0][site] - one + b)
        odds = (e - sum(mean) / 2) * (mean[1] - mean[0]) / var
        yield 1 / (1 + math.exp(-min(max(odds, -30), 30) - math.log(p / (1 - p))))


def test_quality_equals_plain_scores(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        good = rng.random() < (0.8 if i % 3 else 0.3)
        text = " ".join(rng.choice(["alpha", "beta", "Gamma2", "x-y", "!!!" if not good else "delta", "z%d" % rng.randint(0, 40)]) for _ in range(rng.randint(0, 12)))
        rows.append((i, text, [None, "h1", "h2"][i % 3], [None, "p", "q"][i % 4 % 3], int(good)))
    rows += [(500, None, "h1", "p", 0), (501, "tie", "h9", "p", 0), (501, "tie", "h9", "p", 0), (None, "alpha", "h1", "p", 0)]
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string").repartition(3)
    labels = {i: y for i, _, _, _, y in rows if i is not None and i < 150 and i % 2}
    lab = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    fold = {r.doc_id: r.fold for r in lab.selectExpr("doc_id", f"pmod(xxhash64(doc_id, 3), {quality.FOLDS}) AS fold").collect()}
    got = sorted(((r.doc_id, r.score) for r in score_quality(df, lab).collect()), key=str)
    want = sorted(((r[0], s) for r, s in zip(rows, plain_quality([r[:4] for r in rows], labels, fold), strict=True)), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-9)
    assert len({s for i, s in got if i == 501}) == 1
