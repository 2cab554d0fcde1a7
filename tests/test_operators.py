"""Operators that SQL can't say, and errors, on small tables."""

import hashlib
import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import ids, text
from weftline.operators import dataset, features, learn, matching, negatives, pool, profile, ranking, retrieval, value_summary
from weftline.plans import QUERIES
from weftline.sources import catalog_xml, tables
from weftline.streaming.match_stream import match_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_compatibility_form(spark):
    assert one(spark, text.normalize_query(F.lit(" Ｔhe “ﬁrst” — x ½ "))) == 'The "first" - x 1⁄2'
    assert one(spark, text.exact_key(F.lit(None))) == ""


def test_blocks(spark):
    b = one(spark, text.parse_block(F.lit(" PV_TYPE: enum (n=2); PV: Yes | yes. |  | No")))
    assert (b.kind, b.declared, b.raw, b.norm, b.well_formed) == ("ENUM", 2, ["Yes", "No"], ["yes", "no"], True)
    b = one(spark, text.parse_block(F.lit("a | B")))
    assert (b.norm, b.well_formed) == (["a", "b"], False)
    assert one(spark, text.parse_block(F.lit(None))).norm == []
    assert one(spark, text.value_kind(F.array(F.lit("Never"), F.lit("rarely"), F.lit("sometimes"), F.lit("often"), F.lit("always")))) == "LIKERT_5_FREQUENCY"
    assert one(spark, text.value_kind(F.array().cast("array<string>"))) == "EMPTY"


def test_recipes():
    assert text.parse_recipe("v1_v6_v2b") == ["short_name", "question", "concept_name"]
    for bad in ("v1_v1", "v1_v99"):
        with pytest.raises(ValueError):
            text.parse_recipe(bad)


def test_mask_is_nested_and_like_python(spark):
    rows = spark.range(300).select("id", ids.hash_share(F.col("id"), "s").alias("x"), ids.allowed(F.col("id"), 0.2, "s").alias("a"), ids.allowed(F.col("id"), 0.6, "s").alias("b")).collect()
    for r in rows:
        assert r.x == int(hashlib.sha1(f"s|{r.id}".encode()).hexdigest()[:12], 16) / 16**12
        assert r.b or not r.a
    assert one(spark, ids.allowed(F.lit("x"), 1, "s")) and not one(spark, ids.allowed(F.lit("x"), 0, "s"))


def test_canonical_rank(spark):
    df = spark.createDataFrame([("g", "10", 1.0), ("g", "2", 1.0), ("g", "X", 1.0), ("g", "7", 2.0)], "g string, i string, s double")
    for d in (df, df.repartition(3)):
        assert [r.i for r in ranking.canonical_rank(d, ["g"], "i", "s").orderBy("rank").collect()] == ["7", "2", "10", "X"]
    for bad in ([("g", "2", 1.0)] * 2, [("g", "2", float("nan"))], [("g", "2", None)]):
        with pytest.raises(ValueError):
            ranking.canonical_rank(spark.createDataFrame(bad, "g string, i string, s double"), ["g"], "i", "s")


def test_guards(spark):
    df = spark.createDataFrame([("a",)], "x string")
    with pytest.raises(ValueError):
        dataset.require_columns(df, ["y"])
    with pytest.raises(ValueError):
        dataset.forbid_columns(df, ["x"])
    with pytest.raises(ValueError):
        dataset.filter_eligible(df, "x", "x", "odd")
    with pytest.raises(ValueError):
        dataset.allow_list(df, spark.createDataFrame([("a",), ("a",)], "x string"), ["x"])
    with pytest.raises(ValueError):
        learn.ablation_features({"a": ["x"], "b": ["x"]}, None)


def test_leakage_takes_whole_queries(spark):
    schema = "q string, x string, g string"
    ev = spark.createDataFrame([("1", "Blood: type?", "5::1"), ("1", "Blood: type?", "6::1"), ("2", "age", "7::1"), ("3", "age", "8::2"), ("4", "new", "9::1")], schema)
    train = spark.createDataFrame([("9", "blood type", "6::3"), ("2", "other", "1::1"), ("8", "AGE", "7::2")], schema)
    assert {r.q for r in dataset.without_leakage(ev, train, "q", "x", "g").collect()} == {"3", "4"}


def test_containment_join_equals_brute_force(spark):
    long = ["the quick brown fox jumps", "quick brown", "a b c d", "", "fox", "xquick brown foxx"]
    short = ["quick brown fox", "brown", "b c", "fox", "zz", "he quick brown fo"]
    got = matching.contained_in(spark.createDataFrame(list(enumerate(short)), "i long, s string"), spark.createDataFrame(list(enumerate(long)), "j long, l string"), "i", "s", "j", "l")
    assert {tuple(r) for r in got.collect()} == {(i, j) for (i, s), (j, x) in itertools.product(enumerate(short), enumerate(long)) if s in x}


def test_longest_word_only_without_hits(spark):
    q = spark.createDataFrame([(1, "ABC", "ABC", True, ["v"]), (2, "QQ LONGESTW", "QQ LONGESTW", True, ["v"]), (3, "LONGESTW Q", "LONGESTW Q", False, ["v"])], "query_id long, source string, words string, is_enum boolean, values array<string>")
    schema = "cand_id long, field string, term string, is_enum_cand boolean, status int, cand_values array<string>"
    terms = spark.createDataFrame([(1, "P", "ABC", True, 2, ["v"]), (2, "P", "THE LONGESTW ONE", True, 1, ["v", "w"])], schema)
    joined = spark.createDataFrame([(1, "P", "ABC", True, 2, ["v"]), (2, "P", "THELONGESTWONE", True, 1, ["v", "w"])], schema)
    got = {(r.query_id, r.cand_id): (r.rule, r.score) for r in matching.match(q, terms, joined).collect()}
    assert got == {(1, 1): (1, 99.9), (2, 2): (16, 19.95)}


def test_value_summaries(spark):
    rows = [("a", "1", f"v{i}", f"Meaning {i}", str(9 - i)) for i in range(8)]
    rows += [("b", "1", "x", "Only", None), ("c", "1", "x", "One", None), ("c", "1", "y", "Two", None), ("d", "1", " ", None, None), ("e", "1", "1", "Yes", None), ("e", "1", "0", "No", None)]
    df = spark.createDataFrame(rows, "cde_publicid string, cde_version string, valid_value string, value_meaning string, meaning_concept_display_order string")
    got = {r.cde_publicid: r for r in value_summary.value_summaries(df).collect()}
    assert {k: (r.rule, r.omitted) for k, r in got.items()} == {"a": (None, False), "b": ("n1", True), "c": ("n2_telling", True), "e": ("n2_generic", False)}
    assert got["c"].query_summary == "" and got["c"].catalog_summary == "PV_TYPE: ENUM(n=2); PV: One | Two"
    assert got["e"].kind == "BINARY" and got["e"].n_generic == 2 and got["e"].query_summary != got["e"].catalog_summary
    assert [tuple(r) for r in value_summary.value_summaries(df.repartition(5)).orderBy("cde_publicid").collect()] == [tuple(got[k]) for k in sorted(got)]
    assert value_summary.summary_blocks(df).columns == ["cde_publicid", "cde_version", "PV_N", "PV_TYPE", "PV_BLOCK_CDE", "PV_BLOCK_SDE"]
    assert value_summary.summary_report(value_summary.value_summaries(df)).first().omission_rate == 0.5


def _pool(n, concepts=()):
    return [value_summary.Value(f"v{i}", f"Label {i}" if i >= len(concepts) else concepts[i], concepts[i] if i < len(concepts) else None, float("inf"), i) for i in range(n)]


def test_summary_sizes_and_strata():
    policy = value_summary.Policy()
    sizes = {n: {value_summary.side_size(n, 8, policy, f"s{i}") for i in range(50)} for n in (0, 1, 2, 3, 4, 5, 6, 40)}
    assert sizes == {0: {0}, 1: {1}, 2: {2}, 3: {2}, 4: {2, 3}, 5: {2, 3}, 6: {2, 3, 4}, 40: {7, 8}}
    assert value_summary.strata(4, 8, 0, 8, policy) == (0, 4)
    assert value_summary.strata(4, 8, 2, 6, policy) == (1, 3)  # 4 * (0.25 + 0.1), rounded
    assert value_summary.strata(4, 4, 4, 0, policy) == (4, 0)  # capped at 0.7, and others are lacking
    assert value_summary.strata(3, 6, 1, 1, policy) == (1, 1)


def test_small_rules():
    rule = value_summary.small_rule
    policy, strict = value_summary.Policy(), value_summary.Policy(strict=True)
    assert rule(1, 1, 0, (1, 1), policy) == ("n1", True)
    assert rule(2, 1, 1, (2, 2), policy) == ("n2_telling", True) and rule(2, 2, 0, (2, 2), policy) == ("n2_generic", False)
    assert rule(3, 2, 1, (2, 2), policy) == ("n3_generic", False) and rule(3, 1, 2, (2, 2), policy) == ("n3_telling", False)
    assert rule(3, 1, 2, (1, 2), policy) == ("n3_telling_too_few", True) and rule(4, 0, 4, (2, 2), policy) == (None, False)
    assert rule(3, 2, 1, (2, 2), strict) == ("strict_small", True) and rule(2, 2, 0, (2, 2), strict) == ("n2_generic", False)


def test_equal_sides_are_drawn_again_and_subsets_only_judged_where_small_or_strict():
    same = [value_summary.Value(f"t{i}", f"t{i}", None, float("inf"), i) for i in range(4)]  # value and meaning are equal
    fields = [f.split()[0] for f in value_summary.SCHEMA.split(", ")][2:]
    seen = {"redrawn": 0, "within": 0}
    for i in range(200):
        row = dict(zip(fields, value_summary.summarise(same, "ENUM", f"id{i}::1", value_summary.Policy()), strict=True))
        assert row["same_after"] == (row["same_before"] and row["n_query"] == 0) and row["omitted"] == (row["n_query"] == 0)
        assert row["query_summary"] != row["catalog_summary"] and not row["within_catalog"]
        seen["redrawn"] += row["redraws"] > 0 and not row["same_after"]
        q, c = (set(row[x].partition("PV: ")[2].split(" | ")) for x in ("query_summary", "catalog_summary"))
        seen["within"] += row["n_query"] > 0 and q < c  # kept, as there are more than three values
        strict = dict(zip(fields, value_summary.summarise(same, "ENUM", f"id{i}::1", value_summary.Policy(strict=True)), strict=True))
        assert strict["within_catalog"] == (row["n_query"] > 0 and q < c) and (not strict["within_catalog"] or strict["omitted"])
    assert seen["redrawn"] > 0 and seen["within"] > 0
    three = [value_summary.Value(x, x, None, float("inf"), i) for i, x in enumerate("abc")]
    for i in range(40):
        row = dict(zip(fields, value_summary.summarise(three, "ENUM", f"x{i}::1", value_summary.Policy(most_catalog=3, least=2)), strict=True))
        assert row["rule"] == "n3_telling" and row["query_summary"] != row["catalog_summary"]
    gone = value_summary.summarise(three, "ENUM", "x::1", value_summary.Policy(placeholder="<none>", strict=True))
    assert gone[3] == "<none>"


def test_generic_values_share_a_concept_and_may_be_shown_by_meaning():
    pool = [value_summary.Value("U", "Unknown", "UNKNOWN", 2.0, 0), value_summary.Value("UNK", "Not known", "UNKNOWN", 1.0, 1), *_pool(6)[2:]]
    chosen = value_summary.draw_side(pool, 5, value_summary.Policy(), "s")
    assert [v.value for v in chosen if v.concept] == ["UNK"] and len(chosen) == 5  # the concept's first in display order
    assert [v.value for v in value_summary.draw_side(pool, 6, value_summary.Policy(), "s")][:2] == ["UNK", "U"]  # filled up
    assert value_summary.query_items(pool[:1], value_summary.Policy(label_share=1.0), "s") == ["Unknown"]
    assert value_summary.query_items(pool[:1], value_summary.Policy(label_share=0.0), "s") == ["U"]
    shown = [value_summary.query_items(pool[:1], value_summary.Policy(), f"s{i}") == ["Unknown"] for i in range(400)]
    assert 0.2 < sum(shown) / 400 < 0.4


def test_draws_agree(spark):
    names = [f"n{i}" for i in range(30)]
    df = spark.createDataFrame([("g", x) for x in names], "g string, name string")
    rows = value_summary.draw_rows(df, ["g"], "name", 7, "k").collect()
    assert sorted(r.name for r in rows) == value_summary.draw(names, 7, "k")
    assert value_summary.draw(names, 0, "k") == [] and value_summary.draw(["b", "a"], 5, "k") == ["b", "a"]


def test_batches_repeat_no_text(spark):
    df = spark.range(300).selectExpr("id", "concat('t', id % 20) AS t", "concat('u', id % 7) AS u").coalesce(1)
    rows = retrieval.distinct_text_batches(df, ["t", "u"], 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.batch, []).append(r)
    assert len(rows) == 300
    for b in by.values():
        assert len(b) <= 5 and len({r.t for r in b}) == len(b) == len({r.u for r in b})


def test_vector_search_in_blocks(spark):
    df = spark.range(60).selectExpr("id AS k", "array(cast(id % 7 AS double), cast(id % 3 AS double)) AS v")
    asked = df.filter("k % 5 = 0").withColumnRenamed("k", "q")
    a = retrieval.vector_search(df, asked, "k", "q", "v", 4).collect()
    assert sorted(a) == sorted(retrieval.vector_search(df.repartition(5), asked, "k", "q", "v", 4, block=3).collect())
    assert len(a) == 48


def test_learned_ranker_and_grid(spark):
    df = spark.range(400).selectExpr("id % 20 AS q", "id AS c", "cast(hash(id) % 100 AS double) AS x", "if(id % 3 = 0, NULL, 1.0D) AS y").withColumn("is_label", F.col("x") > 60)
    best, _, results = learn.grid_search(df, df, ["x", "y"], "q", "c", "is_label", [{"trees": 2}, {"trees": 2, "depth": 1}])
    assert len(results) == 2 and best == {"trees": 2} and results[0]["recall_1"] == 1.0


XML = """<DataElementsList>
<DataElement num="1"><PUBLICID> 100 </PUBLICID><VERSION>1.0</VERSION><PREFERREDNAME> </PREFERREDNAME><SHORTNAME>AGE</SHORTNAME><LONGNAME>Age at visit</LONGNAME>
<DATAELEMENTCONCEPT><PublicId>7</PublicId><ConceptDetails><ConceptDetails_ITEM><PREFERRED_NAME>Age</PREFERRED_NAME></ConceptDetails_ITEM><ConceptDetails_ITEM/></ConceptDetails></DATAELEMENTCONCEPT>
<VALUEDOMAIN><PublicId>8</PublicId><PermissibleValues><PermissibleValues_ITEM><VALIDVALUE>1</VALIDVALUE><VALUEMEANING>One</VALUEMEANING></PermissibleValues_ITEM><PermissibleValues_ITEM><VALIDVALUE>2</VALIDVALUE></PermissibleValues_ITEM></PermissibleValues></VALUEDOMAIN>
<ALTERNATENAMELIST><ALTERNATENAMELIST_ITEM><AlternateName>ageAtVisit</AlternateName><AlternateNameType>Table</AlternateNameType></ALTERNATENAMELIST_ITEM></ALTERNATENAMELIST></DataElement>
<DataElement num="2"><PUBLICID>101</PUBLICID><LONGNAME>no version</LONGNAME></DataElement>
</DataElementsList>"""


def test_xml_catalog(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    t = catalog_xml.read_catalog(spark, f"{tmp_path}/*.xml")
    m = t["master"].collect()
    assert [(r.cde_publicid, r.cde_version, r.preferred_name, r.long_name) for r in m] == [("100", "1.0", "AGE", "Age at visit")]
    assert [(r.valid_value, r.value_meaning) for r in t["permissible_values"].collect()] == [("1", "One"), ("2", None)]
    assert t["concept"].first().concept_details == '[{"PREFERRED_NAME":"Age"}]'
    assert t["classifications"].count() == 0 and len(t) == 7
    assert [(r.token, r.n) for r in catalog_xml.name_tokens_by_type(t["alternate_names"], 2).orderBy("token").collect()] == [("age", 1), ("at", 1)]


def test_tables(spark, tmp_path):
    (tmp_path / "allow.csv").write_text("kind,context,enabled\nA ,x,yes\nB,y,no\n")
    assert [tuple(r) for r in tables.read_allow_list(spark, f"{tmp_path}/allow.csv", ["kind", "context"], {"most": "3"}).collect()] == [("A ", "x", "yes", "3")]
    (tmp_path / "bad.csv").write_text("kind\nA\nA\n")
    with pytest.raises(ValueError):
        tables.read_allow_list(spark, f"{tmp_path}/bad.csv", ["kind"])
    for run, metrics in (("r1", '{"dev": {"mrr": 0.5, "odd": "NaN"}, "test": {"mrr": 1}}'), ("r2", None)):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "run_config.json").write_text('{"lr": 0.1}')
        if metrics:
            (tmp_path / "runs" / run / "metrics.json").write_text(metrics)
    runs = tables.read_runs(spark, f"{tmp_path}/runs/*/{{file}}.json")
    assert sorted((r.split, r.metric, r.value) for r in tables.long_metrics(runs).collect()) == [("dev", "mrr", 0.5), ("test", "mrr", 1.0)]
    assert {(r.split, r.mrr) for r in tables.wide_metrics(runs, ["mrr"]).collect()} == {("dev", 0.5), ("test", 1.0)}
    df = spark.range(5).selectExpr("id", "'abc' AS print")
    df.write.parquet(f"{tmp_path}/cache")
    assert tables.cached_if_same(spark, f"{tmp_path}/cache", {"print": "abc"}).count() == 5
    assert tables.cached_if_same(spark, f"{tmp_path}/cache", {"print": "x"}) is None and tables.cached_if_same(spark, f"{tmp_path}/none", {}) is None
    assert tables.fingerprint(df, ["id"]) == tables.fingerprint(df.repartition(3), ["id"]) != tables.fingerprint(df.limit(4), ["id"])
    spark.range(2).selectExpr("cast(id AS int) AS id").write.parquet(f"{tmp_path}/other")
    merged = tables.merge_parquet(spark, [f"{tmp_path}/cache", f"{tmp_path}/other"])
    assert merged.dtypes == [("id", "bigint"), ("print", "string")] and merged.count() == 7
    sheet = spark.createDataFrame([(0, "Title", None), (1, "name", "id"), (2, "a", "1"), (3, None, None), (4, "b", "2 3")], "n int, c string, d string")
    assert [(r.c, r.id) for r in tables.ids_in_cell(tables.sheet_rows(sheet, "n", "c", "Name"), "d").orderBy("c", "at").collect()] == [("a", "1"), ("b", "2"), ("b", "3")]
    tables.write_csv(df, f"{tmp_path}/csv"), tables.write_json(df, f"{tmp_path}/json"), tables.write_rankings(df, f"{tmp_path}/zstd")
    assert tables.read_parquet(spark, f"{tmp_path}/zstd", ["id"], "id > 2").count() == 2
    assert tables.first_of_splits([df, df.selectExpr("id", "1 AS more")], "print", "id").count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "fox")], "query_id long, q string").write.json(f"{tmp_path}/in")
    catalog, seen = spark.createDataFrame([(7, "a fox"), (8, "dog")], "id long, t string"), {}
    stream = spark.readStream.schema("query_id long, q string").json(f"{tmp_path}/in")
    run = match_stream(stream, lambda b: retrieval.bm25_search(catalog, b, "id", "query_id", "t", "q", 3), lambda out, n: seen.update({n: out.collect()}), f"{tmp_path}/check")
    run.awaitTermination(120)
    assert [r.id for rows in seen.values() for r in rows] == [7]


def test_containments_of_any_ids(spark, tmp_path):
    names = ["red bolt", "red bolt m8", "Red Bolt", "ed", "", None, "x", "xy red", "steel nut"]
    rows = [(i * 7, n) for i, n in enumerate(names)]
    a, b = spark.createDataFrame(rows, "q long, a string"), spark.createDataFrame([(i + 1, n) for i, n in rows], "c long, b string")
    want = []
    for (q, x), (c, y) in itertools.product(rows, rows):
        x, y = (x or "").lower(), (y or "").lower()
        if x and y and x != y and (x in y or y in x):
            want.append((q, c + 1, len(x) / len(y) if x in y else None, len(y) / len(x) if y in x else None))
    got = retrieval.containments(a, b, "q", "c", "a", "b").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any((q - c) % 64 for q, c, *_ in want)
    spark.createDataFrame([(0, "red bolt", "Brand#1"), (1, "red bolt", "Brand#2")], "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {r.p_partkey for r in QUERIES["m8_whole_containment"](spark, str(tmp_path)).collect()} == {0, 1}


def test_split_routing_and_join_guards(spark):
    rows = spark.createDataFrame([("test",), ("cctg",), ("gdc_combined",), ("new",)], "split string")
    got = {r.split: (r.allowance, r.candidate_table, r.hydration) for r in dataset.route_splits(rows, "split").collect()}
    assert got == {"test": (0.7, "test_a070", "thinned"), "cctg": (0.7, "cctg_a070", "thinned"), "gdc_combined": (1.0, "gdc_combined_a10", "hydrated"), "new": (1.0, "new_a10", "thinned")}
    left = spark.createDataFrame([(1, False), (2, True)], "k int, injected boolean")
    scores = spark.createDataFrame([(1, 0.5)], "k int, score double")
    assert {r.k: r.score for r in dataset.merge_scores(left, scores, ["k"], "score", "injected").collect()} == {1: 0.5, 2: None}
    with pytest.raises(ValueError, match="repeat"):
        dataset.indicator_join(left, scores.unionAll(scores), ["k"])
    with pytest.raises(ValueError, match="injected"):
        dataset.merge_scores(left, scores.limit(0), ["k"], "score", "injected")
    counts, sample = dataset.overlap_audit(spark.createDataFrame([("A b",), ("a  B",), ("c",)], "t string"), spark.createDataFrame([("a b",)], "u string"), "t", "u")
    assert tuple(counts.first()) == (2, 2) and [r.t for r in sample.collect()] == ["A b", "a  B"]


def test_lists_in_text_and_recipes(spark):
    cases = {"['a', \"b c\", 'it\\'s']": ["a", "b c", "it's"], '["x", "y"]': ["x", "y"], "a | b": ["a", "b"], "[]": [], None: [], "[1, 2]": ["1", "2"], "['a, b', 'c']": ["a, b", "c"]}
    for value, want in cases.items():
        assert one(spark, text.listed_items(F.lit(value))) == want
    assert sorted(["v1_v7", "v1_v2", "v2", "v7"], key=text.recipe_complexity) == ["v2", "v7", "v1_v2", "v1_v7"]


def test_batch_matching_strips_blocks_and_withholds_exact_evidence(spark):
    catalog = spark.createDataFrame([("c1", "Tumor Size", "Size of the tumor", "TS", 1), ("c2", "Tumor Size Unit", "Unit", "TSU", 1)], "id string, long string, question string, alt string, status int")
    fields = {"P": F.col("long"), "Q": F.col("question"), "A": F.col("alt")}
    terms, joined = (matching.field_terms(catalog, "id", fields, F.lit(False), F.col("status"), [F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))], joined=j) for j in (False, True))
    assert terms.count() == 6 and terms.first().cand_values == ["x", "y"]
    asked = spark.createDataFrame([("q", "Tumor size | PV_TYPE: ENUM; PV: a | b", "PV_TYPE: ENUM; PV: a | b"), ("q", "Tumor size | PV_TYPE: ENUM; PV: a | b", None)], "qid string, t string, b string")
    ready = matching.prepare_queries(asked, "qid", "t", "b").collect()
    assert [(r.query_id, r.source, r.words) for r in ready] == [("q", "TUMOR SIZE", "TUMOR SIZE")]
    gold = spark.createDataFrame([("q", "c1")], "query_id string, cand_id string")
    full = matching.match_batch(asked, terms, joined, "qid", "t", gold=gold, rate=1.0).collect()
    held = matching.match_batch(asked, terms, joined, "qid", "t", gold=gold, rate=0.0).collect()
    assert [(r.cand_id, r.rule) for r in full][0] == ("c1", 1)
    assert all(not (r.cand_id == "c1" and r.rule <= 3) for r in held) and {r.cand_id for r in held} >= {"c2"}


def test_value_blocks_are_filled_only_where_asked(spark):
    pairs = spark.createDataFrame([("k", "PV_TYPE: E; PV: a | b")], "cde_id string, PV_BLOCK_SDE string")
    catalog = spark.createDataFrame([("k", "", "PV_TYPE: E; PV: A | c")], "cde_id string, PV_BLOCK_CDE string, PV_SUMMARY string")
    thin, full = (features.add_value_overlap(pairs, catalog, hydrate=h).first() for h in (False, True))
    assert (thin.pv_n_cde, thin.pv_exact_overlap_frac_cde, thin.pv_exact_overlap_jaccard) == (0, None, 0.0)
    assert (full.pv_n_cde, full.pv_exact_overlap_count, full.pv_type_match) == (2, 1, True)
    both = spark.createDataFrame([("PV_TYPE: E; PV: a", "PV_TYPE: E; PV: b"), ("PV_TYPE: E; PV: a", "a | a"), (None, "b | c")], "PV_BLOCK_CDE string, PV_SUMMARY string")
    assert tuple(features.block_disagreement(both).first()) == (2, 1)
    with pytest.raises(ValueError, match="already"):
        features.add_text_features(pairs.withColumn("text_family", F.lit("")).withColumn("query_text_q3", F.lit("")))


def test_short_texts_are_joined_without_a_nested_loop(spark):
    long = ["the quick brown fox", "ab", "a", "", None, "xyz zy", "b a", "élan vital"]
    short = ["a", "ab", "zy", "fox", "", None, "quick brown", "él", "q b", "the quick brown fox"]
    a, b = spark.createDataFrame(list(enumerate(short)), "i long, s string"), spark.createDataFrame(list(enumerate(long)), "j long, l string")
    want = {(i, j) for (i, s), (j, x) in itertools.product(enumerate(short), enumerate(long)) if s and x and s in x}
    got = matching.contained_in(a, b, "i", "s", "j", "l")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    terms = b.select(F.col("j").alias("cand_id"), F.lit("P").alias("field"), F.col("l").alias("term"))
    pairs = matching.term_pairs(a.select(F.col("i").alias("query_id"), F.col("s").alias("source")), terms)
    found = {(r.query_id, r.cand_id) for r in pairs.collect()}
    assert want <= found and not any(not short[i] for i, _ in found)
    for df in (got, pairs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vector_search_takes_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)] + [(9, None)], "k long, v array<double>")
    asked = df.filter("k IN (1, 9)").withColumnRenamed("k", "q")
    got = [(r.q, r.k, r.score, r["rank"]) for r in retrieval.vector_search(df, asked, "k", "q", "v", 5, block=1, chunk=2).collect()]
    assert sorted(got) == [(1, 0, 1.0, 5), (1, 1, 2.0, 1), (1, 3, 2.0, 2), (1, 5, 2.0, 3), (1, 7, 2.0, 4)]
    assert not retrieval.vector_search(df, asked.limit(0), "k", "q", "v", 5).collect() and not retrieval.vector_search(df.limit(0), asked, "k", "q", "v", 5).collect()


def test_negatives_are_unique_by_id_and_text_and_filled(spark):
    catalog = [(f"c{i}", f"text {i % 20}") for i in range(40)] + [("blank", " "), ("none", None)]
    texts = dict(catalog)
    ranked = [("q", f"c{i}", i + 1) for i in range(12)] + [("q", "blank", 13), ("q", "c20", 14)] + [("r", "c5", 1)]
    gold = [("q", "c0"), ("q", "c3"), ("r", "c5")]
    args = [spark.createDataFrame(ranked, "q string, c string, rank int"), spark.createDataFrame(gold, "q string, c string"), spark.createDataFrame([("q", "c0"), ("r", "c5"), ("lone", "c1")], "q string, c string"), spark.createDataFrame(catalog, "c string, t string")]
    positives = {"q": "c0", "r": "c5", "lone": "c1"}
    out = negatives.select_negatives(*args, "q", "c", "t", 2, 6, 15, "s")
    rows = out.collect()
    for q, p in positives.items():
        own = sorted((r for r in rows if r.q == q), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, 16)) and len({r.t for r in own}) == 15 and texts[p] not in {r.t for r in own}
        assert not {r.c for r in own} & {c for x, c in gold if x == q}
        assert [r.source for r in own] == sorted((r.source for r in own), key=["band", "top", "fill"].index)
    by = {r.q: tuple(r)[1:] for r in negatives.negative_counts(out, args[2], "q", 15).collect()}
    assert by == {"q": (4, 6, 5, True, False), "r": (0, 0, 15, True, False), "lone": (0, 0, 15, True, False)}
    all_of = negatives.select_negatives(*args, "q", "c", "t", 2, 6, 99, "s").groupBy("q").count()
    assert {r.q: r["count"] for r in all_of.collect()} == {"q": 19, "r": 19, "lone": 19}
    assert negatives.select_negatives(args[0], args[1], args[2], args[3].limit(0), "q", "c", "t", 2, 6, 3, "s").count() == 0
    assert [negatives.band_of_epoch(e, [(1, 5), (6, 9)], (2, 3)) for e in (-1, 0, 1, 7)] == [(1, 5), (1, 5), (6, 9), (6, 9)] and negatives.band_of_epoch(0, [], (2, 3)) == (2, 3)


def test_imported_lists_are_checked(spark):
    schema = "query_id string, is_evaluable string, data_element string, top20_public_ids string, top20_scores string"
    rows = spark.createDataFrame([("0", "True", "age", "7, 8,9", "0.9,0.8, 0.7"), ("1", "False", "sex", "7", "1"), ("2", "true", "site", None, None)], schema)
    split = spark.createDataFrame([("a", 0, "age"), ("c", 2, "site")], "query_id string, original_query_id int, data_element string")
    catalog = spark.createDataFrame([("7", "2.0"), ("7", "10.0"), ("9", "1")], "cde_publicid string, cde_version string")
    got = tables.listed_candidates(rows, split, catalog, 3).collect()
    assert sorted(map(tuple, got)) == [("a", "7::10.0", 1, 0.9), ("a", "9::1", 3, 0.7)]
    with pytest.raises(ValueError, match="no imported row"):
        tables.listed_candidates(rows, split.unionAll(spark.createDataFrame([("b", 1, "sex")], split.schema)), catalog, 3)
    for odd in [("0", "True", "age", "7,8", "1"), ("0", "True", "weight", "7", "1")]:
        with pytest.raises(ValueError, match="row 0"):
            tables.listed_candidates(spark.createDataFrame([odd], schema), split, catalog, 3, complete=False)


def test_pinned_copies_never_overwrite(tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.bin").write_bytes(b"one")
    pins = {"x": ("a.bin", hashlib.sha256(b"one").hexdigest())}
    assert tables.pinned_copies(source, target, pins, dry_run=True) == {"x": "copied"} and not target.exists()
    assert tables.pinned_copies(source, target, pins) == {"x": "copied"} and (target / "x.parquet").read_bytes() == b"one"
    assert tables.pinned_copies(source, target, pins) == {"x": "kept"}
    (target / "x.parquet").write_bytes(b"two")
    with pytest.raises(ValueError, match="another file"):
        tables.pinned_copies(source, target, pins)
    with pytest.raises(ValueError, match="differs"):
        tables.pinned_copies(source, target, {"x": ("a.bin", "0" * 64)})


def test_catalogs_come_from_archives(spark, tmp_path):
    record = "<L><DataElement><PUBLICID>{}</PUBLICID><VERSION>1</VERSION><LONGNAME>n</LONGNAME></DataElement></L>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.xml", record.format(1))
        z.writestr("two.XML", record.format(2))
        z.writestr("read.me", "no")
    found = catalog_xml.read_catalog(spark, catalog_xml.unpacked(str(tmp_path / "a.zip"), str(tmp_path / "out")))
    assert {r.cde_publicid for r in found["master"].collect()} == {"1", "2"}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/one.xml", "")
        z.writestr("y/one.xml", "")
    with pytest.raises(ValueError, match="twice"):
        catalog_xml.unpacked(str(tmp_path / "b.zip"), str(tmp_path / "out2"))


def test_checks_of_empty_exports(spark):
    none = spark.createDataFrame([], "a array<string>, b array<string>")
    row = profile.pair_overlap(none, "a", "b").first()
    assert row.n_pairs == 0 and row.strict_subset_rate is None
    pairs = spark.createDataFrame([(["A", "b"], ["a", "B", "c"]), (["x."], ["x"]), (None, ["x"]), (["x"], [])], none.schema)
    row = profile.pair_overlap(pairs, "a", "b").first()
    assert (row.both_present_n, row.query_absent_cde_present_n, row.exact_item_match_n, row.normalized_item_match_n, row.strict_subset_n, row.subset_or_equal_rate) == (2, 1, 0, 1, 1, 1.0)
    odd = spark.createDataFrame([(None, float("nan"))], "x string, y double")
    assert [tuple(r) for r in pool.missing_summary(odd, ["x", "y"]).collect()] == [("x", 1, 1.0), ("y", 1, 1.0)]
