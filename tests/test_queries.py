"""Every catalogue query against its SQL, batches and streams."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.engine import SearchEngine
from lodestone.operators.batch import bands, search_many
from lodestone.operators.tokens import merged_frequencies
from lodestone.streaming.search import fold_frequencies, search_stream, without_tombstones

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return repr(v) if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in queries.ORACLES:
        said = duck.execute(queries.ORACLES[name])
        names = [d[0] for d in said.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall())


def test_accents_over_all_documents(spark, tmp_path):
    """Letters without a decomposition are mapped in the query and in its SQL, in either case."""
    texts = ["ßøłđħŧı Straße", "ØŁĐĦŦ ẞ", "Ångström é", "plain", "", None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    name = "without_accents_all"
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select("doc_id", "n", "text_md5").collect())
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        assert got == sorted(c.execute(queries.ORACLES[name]).fetchall())
    plain = ["ssoldhti strasse", "oldht ss", "angstrom e", "plain", "", None]
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert got == [(n, None if t is None else len(t), digest(t)) for n, t in enumerate(plain)]


def test_batch_equals_single_queries(spark):
    parts = spark.read.parquet(f"{DATA}/part.parquet")
    asked = ["red plat", "gizno", "small rod"]
    for options in ({}, {"use_token_search": True, "threshold": 0.4}, {"use_token_search": True, "token_match": "all"}, {"use_extended_search": True}):
        engine = SearchEngine(parts, ref_index="p_partkey", keys=["p_name", "p_type"], include_score=True, **options)
        many = search_many(engine, spark.createDataFrame(list(enumerate(asked)), "qid int, query string"), 5)
        for n, q in enumerate(asked):
            one = [(r.ref_index, r.score) for r in engine.search(q, 5).collect()]
            batch = [(r.ref_index, r.score) for r in many.filter(F.col("qid") == n).orderBy("rank").collect()]
            assert [r for r, _ in one] == [r for r, _ in batch]
            assert [s for _, s in one] == pytest.approx([s for _, s in batch], rel=1e-9)


def test_blank_and_no_queries(spark):
    engine = SearchEngine(spark.read.parquet(f"{DATA}/part.parquet"), ref_index="p_partkey", keys=["p_name"])
    assert search_many(engine, spark.createDataFrame([(1, " ")], "qid int, query string")).count() == 0


def test_bands(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.9,), (None,), (0.55,), (0.8,)], "s double")
    assert [r[0] for r in df.select(bands(F.col("s"), ("a", "b", "c"), (0.55, 0.8))).collect()] == ["a", "b", "c", "c", "b", "c"]


def test_stream_statistics(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, "red hat"), (1, "red")], "ref_index long, t string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ref_index long, t string").parquet(source)
    fold = fold_frequencies(str(tmp_path / "df"), {"keys": ["t"]})
    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    table = spark.read.parquet(str(tmp_path / "df/version=0"))
    assert {r.term: r.df for r in table.collect()} == {"red": 2, "hat": 1}
    gone = spark.createDataFrame([("hat", 1)], "term string, df long")
    assert {r.term: r.df for r in merged_frequencies(table, gone, -1).collect()} == {"red": 2}
    found = search_stream(stream, "hat", {"keys": ["t"], "use_token_search": True, "threshold": 0.1}, frequencies=(2, table))
    q = found.writeStream.format("memory").queryName("token_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("token_stream")
    assert [r.ref_index for r in out.collect()] == [0]
    assert without_tombstones(out, spark.createDataFrame([(0,)], "ref_index long")).count() == 0
    with pytest.raises(ValueError):
        search_stream(stream, "hat", {"keys": ["t"], "use_token_search": True})


def test_plans_stay_narrow(spark):
    """Operator queries: no Python, no shuffle, pruned columns; fuzzy ones: one Arrow call."""
    parts = spark.read.parquet(f"{DATA}/part.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    native = plan(SearchEngine(parts, ref_index="p_partkey", keys=["p_name"], use_extended_search=True).search("'red", 5).select("ref_index"))
    assert "ArrowEvalPython" not in native and "Exchange" not in native and "TakeOrderedAndProject" in native and "p_brand" not in native
    fuzzy = plan(SearchEngine(parts, ref_index="p_partkey", keys=["p_name", "p_type"], include_score=True).search("rde", 5))
    assert fuzzy.count("ArrowEvalPython") == 1


def test_engines_that_share_an_index_keep_their_weights(spark):
    rows = spark.createDataFrame([(0, "red", "x red y z"), (1, "x red y z", "red")], "ref_index long, a string, b string")
    from lodestone.sources.index import create_index

    index = create_index(rows, ["a", "b"])
    weigh = lambda a, b: SearchEngine(rows, keys=[{"name": "a", "weight": a}, {"name": "b", "weight": b}], include_score=True, index=index)
    first = weigh(9, 1)
    before = first.search("red").select("ref_index", "score").collect()
    other = weigh(1, 9).search("red").select("ref_index", "score").collect()
    assert first.search("red").select("ref_index", "score").collect() == before
    assert [r.ref_index for r in other] == [r.ref_index for r in before][::-1]
