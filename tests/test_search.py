"""The engine end to end: known scores, query languages, keys, order, mutation, indexes."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import errors
from lodestone.engine import SearchEngine, match
from lodestone.functions.text import field_norm, highlight, merge_ranges
from lodestone.operators.values import dense_index
from lodestone.options import FEATURES, SearchOptions, register_option
from lodestone.plans import matchers
from lodestone.plans.extended import parse_extended
from lodestone.plans.keys import KeySet
from lodestone.plans.logical import Branch, Leaf, parse_logical
from lodestone.sources.index import create_index, load_index, parse_index, save_index, wire_keys, wire_records
from lodestone.sources.records import infer_keys, label_of, load_records

LINES = ["hello word", "how are you", "indeed fine hello foo", "I am fine", "smithee", "smith"]
E1, E2, E3, E4 = 2.220446049250313e-16, 8.569061098350962e-12, 9.287439764962262e-10, 1.4901161193847656e-8


def frame(spark, rows, schema):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"ref_index long, {schema}")


def strings(spark, values):
    return frame(spark, [(v,) for v in values], "text string")


def found(df):
    return [r.ref_index for r in df.collect()]


def scored(df):
    return [(r.ref_index, r.score) for r in df.collect()]


@pytest.fixture(scope="module")
def lines(spark):
    return SearchEngine(strings(spark, LINES), threshold=0.5, minMatchCharLength=4, useExtendedSearch=True, includeScore=True, keys=["text"])


@pytest.mark.parametrize(
    "query, wanted",
    [
        ("=smith", [(5, E1)]),
        ("'hello", [(0, E2), (2, E4)]),
        ("^hello", [(0, E2)]),
        ("fine$", [(3, E3)]),
        ("!indeed", [(4, E1), (5, E1), (0, E2), (1, E3), (3, E3)]),
        ("!^hello", [(4, E1), (5, E1), (1, E3), (3, E3), (2, E4)]),
        ("!foo$", [(4, E1), (5, E1), (0, E2), (1, E3), (3, E3)]),
        ("!foo$ !^how", [(4, E1), (5, E1), (0, E2), (3, E3)]),
        ("'\"indeed fine\"", [(2, E4)]),
        ("'\"indeed fine\" foo$ | 'are", [(1, E3), (2, E4)]),
        ("'\"indeed fine\" foo$ | helol", [(2, E4), (0, 0.3205001277290518)]),
        ("a\nb", []),
    ],
)
def test_operator_queries(lines, query, wanted):
    got = scored(lines.search(query))
    assert [r for r, _ in got] == [r for r, _ in wanted]
    assert [s for _, s in got] == pytest.approx([s for _, s in wanted], rel=1e-12)


def test_operator_grammar():
    kinds = lambda q: [[(t.kind, t.text) for t in g] for g in parse_extended(q)]
    assert kinds("^core go$ | rb$") == [[("prefix", "core"), ("suffix", "go")], [("suffix", "rb")]]
    assert kinds('="said "test""') == [[("exact", 'said "test"')]]
    assert kinds("a\\|b | c") == [[("fuzzy", "a|b")], [("fuzzy", "c")]]
    assert kinds("'") == [[("fuzzy", "'")]]
    assert kinds('!"hello world"$ !^x') == [[("inverse-suffix", "hello world"), ("inverse-prefix", "x")]]
    assert kinds("") == [[]]


def test_inverse_needs_every_key(spark):
    rows = [("Orange Chef", "Pancakes"), ("Blue Chef", "Syrup"), ("Cook", "Pancakes"), ("Chef", "Pancakes Syrup")]
    engine = SearchEngine(frame(spark, rows, "title string, author string"), keys=["title", "author"], use_extended_search=True)
    assert found(engine.search("!Syrup")) == [2, 0] or set(found(engine.search("!Syrup"))) == {0, 2}
    assert set(found(engine.search("!^Chef"))) == {0, 1, 2}
    missing = SearchEngine(frame(spark, [("a", None)], "title string, author string"), keys=["title", "author"], use_extended_search=True)
    assert found(missing.search("!zzz")) == []  # a key without a value fails


def test_fuzzy_scores_and_order(spark):
    engine = SearchEngine(strings(spark, ["Apple", "Orange", "Banana"]), text="text", include_score=True)
    assert found(engine.search("ran")) == [1, 2]
    assert found(engine.search("nan")) == [2, 1]
    assert found(engine.search("nan", 1)) == [2]
    assert scored(engine.search("apple"))[0] == (0, 0.0)
    assert found(engine.search(" ")) == [0, 1, 2] and found(engine.search("", 2)) == [0, 1]
    assert found(engine.search("ran", 0)) == []


NAMES = [
    "beforeEach",
    "async beforeEach test",
    "assert.async in beforeEach",
    "Module with Promise-aware beforeEach",
    "Promise-aware return values without beforeEach/afterEach",
    "Module with Promise-aware afterEach",
    "before",
    "before (skip)",
]


def test_known_scores(spark):
    docs = strings(spark, NAMES)
    free = SearchEngine(docs, text="text", ignore_location=True, ignore_field_norm=True, include_score=True)
    wanted = [(3, 2 / 22), (5, 6 / 22), (4, 9 / 22), (1, 0.5), (2, 0.5), (0, 12 / 22)]
    got = scored(free.search("promiseawarebeforeEach"))
    assert [r for r, _ in got] == [r for r, _ in wanted] and [s for _, s in got] == pytest.approx([s for _, s in wanted])
    wanted = [
        (0, 0.0), (1, 0.1972392177586917), (6, 0.4), (2, 0.4493775633055149),
        (7, 0.5231863610884103), (3, 0.5916079783099616), (4, 0.699819425905295),
    ]
    got = scored(SearchEngine(docs, text="text", include_score=True).search("beforeEach"))
    assert [r for r, _ in got] == [r for r, _ in wanted] and [s for _, s in got] == pytest.approx([s for _, s in wanted], rel=1e-12)


def test_long_pattern_scores(spark):
    docs = strings(spark, ["promiseawarebeforeEach", "xx", "a promise aware beforeEach b"])
    engine = SearchEngine(docs, text="text", ignore_location=True, ignore_field_norm=True, include_score=True)
    assert scored(engine.search("promiseawarebeforeEach")) == [(0, 0.0), (2, pytest.approx(2 / 22))]


def test_norm_weights_and_location(spark):
    docs = strings(spark, ["Stove", "My good friend Steve from college"])
    search = lambda **o: found(SearchEngine(docs, text="text", **o).search("Steve"))
    assert search() == [0, 1]
    assert search(ignore_field_norm=True) == [1, 0]
    assert search(field_norm_weight=0.15) == [1, 0]
    norms = spark.createDataFrame([("a",), ("a b",), ("a b c d",), ("a b",), ("a　b",), ("a\tb",)], "v string")
    assert [r[0] for r in norms.select(field_norm(F.col("v"))).collect()] == [1.0, 0.707, 0.5, 0.707, 1.0, 0.707]


def test_weights_are_relative(spark):
    rows = [("old man", "smith"), ("new", "old man")]
    docs = frame(spark, rows, "a string, b string")
    one = scored(SearchEngine(docs, keys=[{"name": "a", "weight": 3}, {"name": "b", "weight": 1}], include_score=True).search("man"))
    ten = scored(SearchEngine(docs, keys=[{"name": "a", "weight": 30}, {"name": "b", "weight": 10}], include_score=True).search("man"))
    assert one == ten and [r for r, _ in one] == [0, 1]


def test_logical_trees():
    assert parse_logical({"$and": [{"a": "x"}, {"$or": [{"b": "y"}, "z"]}]}) == Branch("$and", [Leaf("a", "x"), Branch("$or", [Leaf("b", "y"), Leaf(None, "z")])])
    assert parse_logical({"a": "x", "b": "y"}) == Branch("$and", [Leaf("a", "x"), Leaf("b", "y")])
    assert parse_logical({"$or": []}) == Branch("$or", [])
    assert parse_logical({"$and": [{"$path": ["a", "b.c"], "$val": "x"}]}).children == [Leaf("a.b.c", "x")]
    assert parse_logical({"$or": [{"a": "x"}], "$and": [{"b": "y"}]}) == Branch("$or", [Leaf("a", "x"), Leaf("b", "y")])
    assert parse_logical("ab") == Branch("$and", [Leaf("0", "a"), Leaf("1", "b")])
    with pytest.raises(errors.QueryProblem):
        parse_logical({"a": 3})
    with pytest.raises(errors.QueryProblem):
        parse_logical({"$path": "a", "$val": "x"})


BOOKS = [("Old Man's War", ("John", "Scalzi"), ["sci", "war"]), ("The Lock Artist", ("Steve", "Hamilton"), ["thriller"]), ("HTML5", ("Remy", "Sharp"), []), (None, None, None)]
SCHEMA = "title string, author struct<first:string,last:string>, tags array<string>"


def test_logical_search(spark):
    engine = SearchEngine(frame(spark, BOOKS, SCHEMA), keys=["title", "author.first", "tags"], include_score=True, include_matches=True)
    assert found(engine.search({"$and": [{"title": "old"}, {"author.first": "jon"}]})) == [0]
    assert found(engine.search({"$or": [{"title": "lock"}, {"tags": "war"}]})) == [0, 1]
    assert found(engine.search({"$and": [{"title": "lock"}, {"tags": "war"}]})) == []
    assert found(engine.search({"$or": []})) == []
    assert found(engine.search({"nokey": "war"})) == []
    both = engine.search({"$and": ["war"]}).collect()
    assert both[0].ref_index == 0 and {m.key for m in both[0].matches} == {"title", "tags"}
    assert both[0].matches[1].ref_index == 1  # position in the array


def test_logical_or_multiplies_all_hits(spark):
    engine = SearchEngine(frame(spark, [("wood", "x"), ("wood", "wood")], "a string, b string"), keys=["a", "b"], include_score=True, use_extended_search=True)
    got = scored(engine.search({"$or": [{"a": "'wood"}, {"b": "'wood"}]}))
    assert [r for r, _ in got] == [1, 0]


def test_token_search(spark):
    shop = [("red shirt", "x"), ("red hat", "y"), ("blue shirt", "z"), ("green", "w")]
    docs = frame(spark, shop, "name string, extra string")
    assert set(found(SearchEngine(docs, keys=["name"], use_token_search=True, threshold=0.2).search("shirt red"))) == {0, 1, 2}
    assert found(SearchEngine(docs, keys=["name"], use_token_search=True, threshold=0.2, token_match="all").search("shirt red")) == [0]
    assert found(SearchEngine(docs, keys=["name"], use_token_search=True).search("!!!")) == []
    engine = SearchEngine(docs, keys=["name"], use_token_search=True)
    assert engine.statistics(["red", "shirt", "nope"]) == (4, {"nope": 0, "red": 2, "shirt": 2})
    many = [f"t{k}" for k in range(60)] + ["red"]
    assert engine.statistics(many)[1].get("red") == 2
    upper = SearchEngine(docs, keys=["name"], use_token_search=True, tokenize=lambda t: t.split("-"))
    assert found(upper.search("red hat"))[0] == 1
    with pytest.raises(errors.FeatureUnavailable):
        match("a", "a", {"use_token_search": True})


def test_token_all_covers_terms_over_array_elements(spark):
    docs = frame(spark, [("shirt", ["red", "new"]), ("shirt", ["blue"])], "title string, tags array<string>")
    assert found(SearchEngine(docs, keys=["title", "tags"], use_token_search=True, token_match="all", threshold=0.2).search("red shirt")) == [0]


def test_paths(spark):
    schema = "a struct<`first.name`:string>, m map<string,string>, blocks array<struct<content:array<struct<text:string>>>>, n array<int>, b boolean, d double"
    rows = [(("Ann",), {"k": "mapped"}, [([("deep",), (None,), ("down",)],), ([],)], [7, None, 42], True, 3.0), (None, None, None, None, None, None)]
    docs = frame(spark, rows, schema)
    keys = [["a", "first.name"], "m.k", "blocks.content.text", "n", "b", "d", "n.2", "missing.x"]
    fields = SearchEngine(docs, keys=keys).get_index().fields().orderBy("key_idx", "arr_idx").collect()
    assert [(f.key_id, f.arr_idx, f.v) for f in fields] == [
        ("a.first.name", None, "Ann"),
        ("m.k", None, "mapped"),
        ("blocks.content.text", 0, "deep"),
        ("blocks.content.text", 2, "down"),
        ("n", 0, "7"),
        ("n", 2, "42"),
        ("b", None, "true"),
        ("d", None, "3"),
    ]  # a list fans out before its steps apply, so n.2 leads nowhere


def test_numbers_as_text(spark):
    values = [3.0, 0.5, 1e-7, 1e-6, 123456789.25, 1e21, 1.5e25, -0.0, float("nan"), float("-inf"), 1e20, -2.5e-9]
    docs = frame(spark, [(v,) for v in values], "x double")
    got = {r.ref_index: r.v for r in SearchEngine(docs, keys=["x"]).get_index().fields().collect()}
    assert [got[n] for n in range(len(values))] == [
        "3", "0.5", "1e-7", "0.000001", "123456789.25", "1e+21", "1.5e+25", "0", "NaN", "-Infinity", "100000000000000000000", "-2.5e-9",
    ]


def test_getters(spark):
    docs = frame(spark, [("a b", "c"), ("d", None)], "x string, y string")
    keys = [{"name": "words", "get_fn": lambda: F.split("x", " ")}, {"name": "y", "getFn": lambda: F.upper("y")}]
    got = SearchEngine(docs, keys=keys).get_index().fields().orderBy("ref_index", "key_idx", "arr_idx").collect()
    assert [(f.key_id, f.arr_idx, f.v) for f in got] == [("words", 0, "a"), ("words", 1, "b"), ("y", None, "C"), ("words", 0, "d")]


def test_blank_values_keep_their_place(spark):
    engine = SearchEngine(strings(spark, ["", "apple", "banana", "﻿ ", None]), text="text")
    assert found(engine.search("apple")) == [1] and found(engine.search("banana"))[0] == 2
    assert engine.get_index().fields().count() == 2


def test_mutation(spark):
    engine = SearchEngine(strings(spark, ["a", "b", "c", "d"]), text="text", order_by=["text"])
    engine.add(spark.createDataFrame([("e",), (None,)], "text string"))
    contents = lambda: [(r.ref_index, r.text) for r in engine.docs.orderBy("ref_index").collect()]
    assert contents() == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert [r.text for r in engine.remove_at(1).collect()] == ["b"]
    assert contents() == [(0, "a"), (1, "c"), (2, "d"), (3, "e")]
    assert [r.text for r in engine.remove(F.col("text") == "d").collect()] == ["d"]
    assert contents() == [(0, "a"), (1, "c"), (2, "e")]
    assert engine.remove().count() == 0
    engine.remove_all([0, 2, 99])
    assert contents() == [(0, "c")]
    for bad in (-1, 1, True, 1.0):
        with pytest.raises(errors.PositionProblem):
            engine.remove_at(bad)
    engine.set_collection(strings(spark, ["zz"]))
    assert found(engine.search("zz")) == [0]


def test_row_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    for n in (1, 5):
        assert [(r.ref_index, r.k) for r in dense_index(df.repartition(n), "k").orderBy("k").collect()] == [(k, k) for k in range(100)]


def test_partitions_do_not_change_results(spark):
    docs = frame(spark, [(f"red item {n % 7}", f"x{n}") for n in range(60)], "a string, b string")
    results = [scored(SearchEngine(docs.repartition(n), ref_index="ref_index", keys=["a", "b"], include_score=True).search("rde itm")) for n in (1, 6)]
    assert results[0] == results[1] and results[0]


def test_limit_is_a_prefix(spark):
    docs = frame(spark, [(f"red item {n % 5}",) for n in range(30)], "a string")
    for options in ({}, {"should_sort": False}, {"sort_fn": [F.length("a") * 0]}):
        engine = SearchEngine(docs, keys=["a"], **options)
        assert found(engine.search("red item 3", 7)) == found(engine.search("red item 3"))[:7]


def test_indexes(spark, tmp_path):
    docs = frame(spark, BOOKS, SCHEMA)
    keys = ["title", {"name": "author.first", "weight": 2}, "tags"]
    wanted = scored(SearchEngine(docs, keys=keys, include_score=True).search("war"))
    index = create_index(docs, keys)
    save_index(index, str(tmp_path / "index"))
    loaded = load_index(spark, str(tmp_path / "index"))
    wire = parse_index(wire_records(index), json.loads(wire_keys(index)))
    for held in (index, loaded, wire):
        assert scored(SearchEngine(docs, keys=keys, include_score=True, index=held).search("war")) == wanted
        assert held.size() == 4
    record = json.loads(wire_records(index).orderBy("record").first().record)
    assert record == {"i": 0, "$": {"0": {"v": "Old Man's War", "n": 0.577}, "1": {"v": "John", "n": 1.0}, "2": [{"v": "sci", "n": 1.0, "i": 0}, {"v": "war", "n": 1.0, "i": 1}]}}
    texts = lambda ix: [(f.ref_index, f.v) for f in ix.fields().filter("key_id = 'title'").orderBy("ref_index").collect()]
    assert texts(index.remove_at(0)) == [(0, "The Lock Artist"), (1, "HTML5")]
    assert texts(index.remove_all([2, 0, -5, True])) == [(0, "The Lock Artist")]
    more = docs.filter("ref_index = 1").withColumn("ref_index", F.lit(9).cast("long"))
    assert texts(index.add(more))[-1] == (9, "The Lock Artist")
    assert [r.v for r in index.values_at(0, "tags").collect()] == ["sci", "war"]
    plain = create_index(strings(spark, ["", "a b"]), text="text")
    assert [json.loads(r.record) for r in wire_records(plain).collect()] == [{"v": "a b", "i": 1, "n": 0.707}]
    with pytest.raises(errors.IndexProblem):
        SearchEngine(docs, keys=keys, index={"keys": []})


def test_case_and_accents(spark):
    docs = strings(spark, ["Déjà vu", "cafe", "Łódź straße"])
    assert found(SearchEngine(docs, text="text", threshold=0.0).search("deja")) == []
    plain = SearchEngine(docs, text="text", ignore_diacritics=True, threshold=0.0, ignore_location=True)
    assert found(plain.search("deja")) == [0] and found(plain.search("café")) == [1] and found(plain.search("lodz strasse")) == [2]
    assert found(SearchEngine(docs, text="text", is_case_sensitive=True, threshold=0.0).search("CAFE")) == []


def test_ranges_and_highlights(spark):
    engine = SearchEngine(strings(spark, ["Hello World"]), text="text", include_matches=True)
    row = engine.search("wor").select("matches", highlight(F.col("text"), F.get("matches", F.lit(0))["indices"]).alias("h")).first()
    assert [tuple(r) for r in row.matches[0].indices] == [(6, 8)] and row.h == "Hello <b>Wor</b>ld"
    ranges = spark.sql("select array(struct(4 as start, 6 as end), struct(0 as start, 1 as end), struct(2 as start, 3 as end), struct(9 as start, 9 as end)) r")
    assert [tuple(r) for r in ranges.select(merge_ranges(F.col("r"))).first()[0]] == [(0, 6), (9, 9)]


def test_options():
    assert SearchOptions.coerce({"ignoreLocation": True}).ignore_location
    with pytest.raises(TypeError, match="Unknown search option: nope"):
        SearchOptions.coerce({"nope": 1})
    with pytest.raises(TypeError):
        SearchOptions.coerce([1])
    with pytest.raises(ValueError):
        SearchOptions(token_match="most")
    with pytest.raises(errors.KeyProblem):
        KeySet([{"weight": 1}])
    with pytest.raises(errors.KeyProblem, match="'a.b'"):
        KeySet([{"name": ["a", "b"], "weight": 0}])
    assert [k.weight for k in KeySet(["a", {"name": "b", "weight": 3}]).keys] == [0.25, 0.75]


def test_features(spark):
    FEATURES["logical"] = False
    try:
        with pytest.raises(errors.FeatureUnavailable):
            SearchEngine(strings(spark, ["a"]), keys=["text"]).search({"text": "a"})
    finally:
        FEATURES["logical"] = True


def test_plugins(spark):
    class Suffix:
        @staticmethod
        def accepts(query, options):
            return bool((options.extra or {}).get("bySuffix"))

        @staticmethod
        def compile(query, options, probes):
            return matchers.Matcher(lambda s, i, p: matchers.result(s["u"].endswith(query), F.lit(0.5)))

    register_option("bySuffix")
    matchers.register(Suffix)
    try:
        assert matchers.registered() == (Suffix,)
        assert found(SearchEngine(strings(spark, ["ab", "ba"]), text="text", bySuffix=True).search("b")) == [0]
    finally:
        matchers.clear_registry()


def test_one_off_match(spark):
    assert match("wor", "Hello World", {"include_matches": True}).ranges == [(6, 8)]
    assert match("^hel", "Hello", {"use_extended_search": True, "include_matches": True}).ranges == [(0, 2)]
    assert not match("^xyz", "Hello", {"use_extended_search": True}).is_match


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "x", "n": 1, "tags": ["a"], "by": {"name": "z", "age": 3}}]))
    (tmp_path / "a.jsonl").write_text('{"title": "x"}\n{"title": "y"}\n')
    (tmp_path / "bad.json").write_text("[]")
    df = load_records(spark, str(tmp_path / "a.json"))
    assert sorted(infer_keys(df.schema)) == ["by.name", "tags", "title"]
    assert [r[0] for r in df.select(label_of(df)).collect()] == ["x"]
    assert load_records(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(ValueError):
        load_records(spark, str(tmp_path / "bad.json"))


def test_empty_collection(spark):
    engine = SearchEngine(spark.createDataFrame([], "ref_index long, text string"), text="text", include_score=True)
    assert found(engine.search("a")) == [] and engine.size() == 0
    engine = SearchEngine(spark.createDataFrame([], "ref_index long, text string"), keys=["text"], use_token_search=True)
    assert found(engine.search("a")) == []


def test_sql_functions(spark):
    from lodestone.functions.sql import register_functions
    from lodestone.functions.text import normalised_words

    register_functions(spark, threshold=0.4)
    df = spark.createDataFrame([("hello", "helo wrld"), ("hello", "xyz"), (None, "a"), ("a", None), ("", "a")], "p string, t string")
    df.createOrReplaceTempView("pairs")
    got = spark.sql("SELECT fuzzy_match(p, t) AS m, fuzzy_score(p, t) AS s FROM pairs").collect()
    assert [r.m for r in got] == [True, False, False, False, False]
    assert got[0].s == pytest.approx(match("hello", "helo wrld", {"threshold": 0.4}).score) and got[1].s is None
    one = spark.sql("SELECT 'The disk v1.2 is FULL!' AS t").select(normalised_words(F.col("t"), ["the", "is"])).first()[0]
    assert one == "disk v1.2 full"


def test_functional_forms(spark):
    from lodestone import fuzzy_search, ordered_on_driver

    docs = strings(spark, ["apple", "apply", "ape"])
    assert found(fuzzy_search(docs, "apple", 1, text="text")) == [0]
    rows = ordered_on_driver(fuzzy_search(docs, "appl", text="text", include_score=True), lambda a, b: len(a.text) - len(b.text))
    assert [r.ref_index for r in rows][0] == 2
    with pytest.raises(ValueError):
        ordered_on_driver(fuzzy_search(docs, "appl", text="text"), lambda a, b: 0, most=1)


@pytest.mark.parametrize("options", [{}, {"use_token_search": True}, {"use_extended_search": True}])
def test_standing_queries_are_searches(spark, options):
    from lodestone.streaming.search import standing_queries

    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red apple", "green aple", "old man", "apple pie", None, ""])], "ref_index long, a string")
    asked = [(7, "apple"), (8, " "), (9, "old mna"), (10, "apple red")]
    found = standing_queries(docs, asked, {"keys": ["a"], **options}, frequencies=(4, SearchEngine(docs, ref_index="ref_index", keys=["a"], use_token_search=True).document_frequencies()))
    engine = SearchEngine(docs, ref_index="ref_index", keys=["a"], include_score=True, **options)
    wanted = {(q, r.ref_index, round(r.score, 9)) for q, text in asked if text.strip() for r in engine.search(text).collect()}
    assert {(r.qid, r.ref_index, round(r.score, 9)) for r in found.collect()} == wanted and wanted
    if not options.get("use_extended_search"):  # one pass, however many queries
        assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_indexed_search_joins_the_best_rows_only(spark):
    docs = spark.createDataFrame([(k, f"item {k % 7}", 1.5, "x") for k in range(40)], "ref_index long, a string, score double, subs string")
    index = create_index(docs.select("ref_index", "a"), ["a"])
    whole = SearchEngine(docs.drop("score", "subs"), ref_index="ref_index", keys=["a"], include_score=True)
    for query in ("itm 3", {"$and": [{"a": "item"}, {"a": "5"}]}):
        engine = SearchEngine(docs, ref_index="ref_index", keys=["a"], include_score=True, index=index)
        best = engine.search(query, 4)
        assert [(r.ref_index, r.a) for r in best.collect()] == [(r.ref_index, r.a) for r in whole.search(query, 4).collect()]
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("GlobalLimit") and plan.count("Join") == 1  # the limit lies below the join
    assert engine.search("itm 3").count() == whole.search("itm 3").count()
