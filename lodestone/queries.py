"""Queries over the driver's tables, one or more per operator, with the SQL that must give the same rows.

Scores span 1e-16 to 1, so queries return ``round(ln(score), 5)``; the scores themselves differ in
the last bit between implementations of ``pow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import SearchEngine
from .functions.text import highlight, merge_ranges, without_accents
from .operators.batch import fuzzy_join, search_many, triage, without_partner
from .operators.values import dense_index
from .functions.sql import register_functions
from .plans.keys import KeySet
from .shared import scratch
from .sources.index import create_index, load_index, parse_index, save_index, wire_records
from .sources.records import infer_keys, load_records
from .streaming.search import search_stream, standing_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(spark, sf_dir, keys=("p_name",), **options) -> SearchEngine:
    return SearchEngine(_table(spark, sf_dir, "part"), ref_index="p_partkey", keys=list(keys), include_score=True, **options)


def _scores(df: DataFrame) -> DataFrame:
    return df.select("ref_index", F.round(F.ln("score"), 5).alias("ln_score"))


# SQL pieces

_WORDS = r"greatest(1, len(regexp_extract_all({v}, '[^\x09-\x0D\x20\x{{00A0}}]+')))"
_NORM = "(floor(1000 / pow(" + _WORDS + ", 0.5) + 0.5) / 1000)"
_LN_EPS = "(-52 * ln(2.0))"


def _norm(v: str) -> str:
    return _NORM.format(v=v)


def _extended_sql(condition: str) -> str:
    return f"SELECT p_partkey AS ref_index, round({_norm('p_name')} * {_LN_EPS}, 5) AS ln_score FROM part WHERE {condition}"


def _edits(pattern: str, most: int) -> str:
    """Least edits between the pattern and any substring of p_name, by brute force."""
    return f"""(SELECT min(levenshtein('{pattern}', substr(lower(p_name), s, l))) FROM range(1, 40) a(s), range(0, {len(pattern) + most + 1}) b(l)
      WHERE s <= length(p_name) AND s + l - 1 <= length(p_name))"""


def _levenshtein_sql(pattern: str, most: int) -> str:
    m = len(pattern)
    return f"""
WITH d AS (SELECT DISTINCT p_name FROM part),
k AS (SELECT p_name, {_edits(pattern, most)} AS edits FROM d)
SELECT p_partkey AS ref_index,
       round({_norm('p_name')} * CASE WHEN lower(p_name) = '{pattern}' THEN {_LN_EPS} ELSE ln(greatest(0.001, edits / {m}.0)) END, 5) AS ln_score
FROM part JOIN k USING (p_name) WHERE edits <= {most}
"""


# Operator language


@query(_extended_sql("lower(p_name) = 'red plate'"))
def ext_exact(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search('="red plate"'))


@query(_extended_sql("contains(lower(p_name), 'plate')"))
def ext_include(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("'plate"))


@query(_extended_sql("starts_with(lower(p_name), 'red')"))
def ext_prefix(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("^red"))


@query(_extended_sql("ends_with(lower(p_name), 'gizmo')"))
def ext_suffix(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("gizmo$"))


@query(_extended_sql("NOT contains(lower(p_name), 'plate')"))
def ext_inverse(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("!plate"))


@query(_extended_sql("NOT starts_with(lower(p_name), 'red')"))
def ext_inverse_prefix(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("!^red"))


@query(_extended_sql("NOT ends_with(lower(p_name), 'gizmo')"))
def ext_inverse_suffix(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("!gizmo$"))


@query(_extended_sql("starts_with(lower(p_name), 'red') AND ends_with(lower(p_name), 'plate') OR contains(lower(p_name), 'gizmo')"))
def ext_and_or(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("^red plate$ | 'gizmo"))


@query(_extended_sql("lower(p_name) = 'cold ring' OR contains(lower(p_name), 'ue pl')"))
def ext_quoted(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("=\"cold ring\" | '\"ue pl\""))


@query(f"""
SELECT p_partkey AS ref_index, round(0.5 * {_norm('p_name')} * {_LN_EPS} + 0.5 * {_norm('p_type')} * {_LN_EPS}, 5) AS ln_score
FROM part WHERE NOT contains(lower(p_name), 'sm') AND NOT contains(lower(p_type), 'sm')
""")
def ext_multi_key_inverse_gate(spark, sf_dir):
    return _scores(_part(spark, sf_dir, ("p_name", "p_type"), use_extended_search=True).search("!sm"))


@query(f"""
WITH k AS (SELECT p_name, {_edits('wdget', 2)} AS edits FROM (SELECT DISTINCT p_name FROM part))
SELECT p_partkey AS ref_index, round({_norm('p_name')} * ln(greatest(0.001, edits / 5.0) / 2), 5) AS ln_score
FROM part JOIN k USING (p_name) WHERE starts_with(lower(p_name), 'bl') AND edits <= 2
""")
def ext_fuzzy_term(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True, threshold=0.4, ignore_location=True).search("^bl wdget"))


# Approximate matching


@query(f"""
SELECT doc_id AS ref_index, round({_norm('text')} * CASE WHEN lower(text) = 'the ' THEN {_LN_EPS} ELSE ln(0.001) END, 5) AS ln_score
FROM documents WHERE contains(lower(text), 'the ')
""")
def fuzzy_contains(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _scores(SearchEngine(docs, ref_index="doc_id", keys=["text"], threshold=0.0, ignore_location=True, include_score=True).search("the "))


@query(f"""
SELECT c_custkey AS ref_index, round({_norm('c_name')} * CASE WHEN lower(c_name) = 'customer#00000001' THEN {_LN_EPS} ELSE ln(0.001) END, 5) AS ln_score
FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')
""")
def fuzzy_prefix_dist0(spark, sf_dir):
    people = _table(spark, sf_dir, "customer")
    return _scores(SearchEngine(people, ref_index="c_custkey", keys=["c_name"], threshold=0.05, distance=0, include_score=True).search("Customer#00000001"))


@query(f"""
SELECT doc_id AS ref_index, round({_norm('text')} * ln(greatest(0.001, (instr(lower(text), 'the ') - 1) / 100.0)), 5) AS ln_score
FROM documents WHERE instr(lower(text), 'the ') > 0 AND (instr(lower(text), 'the ') - 1) / 100.0 <= 0.2 AND lower(text) <> 'the '
""")
def fuzzy_exact_location(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _scores(SearchEngine(docs, ref_index="doc_id", keys=["text"], threshold=0.2, include_score=True).search("the "))


@query(_levenshtein_sql("red plat", 3))
def fuzzy_ignore_location(spark, sf_dir):
    return _scores(_part(spark, sf_dir, threshold=0.4, ignore_location=True).search("red plat"))


@query(_levenshtein_sql("gren gizmp", 3))
def fuzzy_typo(spark, sf_dir):
    return _scores(_part(spark, sf_dir, threshold=0.3, ignore_location=True).search("gren gizmp"))


@query()
def fuzzy_default(spark, sf_dir):
    return _scores(_part(spark, sf_dir).search("smal wigdet"))


@query()
def fuzzy_long_pattern(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    engine = SearchEngine(docs, ref_index="doc_id", keys=["text"], threshold=0.5, include_score=True)
    return _scores(engine.search("the attion to thanedble the anea eriner thanea and more"))


@query(f"""
SELECT p_partkey AS ref_index, round({_norm('p_name')} * ln(0.001), 5) AS ln_score FROM part WHERE contains(p_name, 'Red') OR contains(p_name, 'ring')
""")
def case_sensitive(spark, sf_dir):
    engine = _part(spark, sf_dir, is_case_sensitive=True, threshold=0.0, ignore_location=True)
    return _scores(engine.search("Red").unionByName(engine.search("ring")))


# Logical queries (threshold 0 anywhere in the text: contains)

_LOGICAL = {"threshold": 0.0, "ignore_location": True}


def _leaf(column: str, text: str, weight: float) -> str:
    """ln of a leaf's contribution, 0 where it does not match."""
    return f"CASE WHEN contains(lower({column}), '{text}') THEN {weight} * {_norm(column)} * CASE WHEN lower({column}) = '{text}' THEN {_LN_EPS} ELSE ln(0.001) END ELSE 0 END"


def _logical_sql(condition: str, *leaves: str) -> str:
    return f"SELECT p_partkey AS ref_index, round({' + '.join(leaves)}, 5) AS ln_score FROM part WHERE {condition}"


@query(_logical_sql("contains(lower(p_name), 'red') AND contains(lower(p_type), 'promo')", _leaf("p_name", "red", 0.5), _leaf("p_type", "promo", 0.5)))
def logical_and(spark, sf_dir):
    return _scores(_part(spark, sf_dir, ("p_name", "p_type"), **_LOGICAL).search({"$and": [{"p_name": "red"}, {"p_type": "promo"}]}))


@query(_logical_sql("contains(lower(p_name), 'red') OR contains(lower(p_type), 'promo')", _leaf("p_name", "red", 0.5), _leaf("p_type", "promo", 0.5)))
def logical_or(spark, sf_dir):
    return _scores(_part(spark, sf_dir, ("p_name", "p_type"), **_LOGICAL).search({"$or": [{"p_name": "red"}, {"p_type": "promo"}]}))


@query(
    _logical_sql(
        "contains(lower(p_name), 'ring') AND (contains(lower(p_type), 'small') OR contains(lower(p_brand), '#1'))",
        _leaf("p_name", "ring", 0.5),
        _leaf("p_type", "small", 0.25),
        _leaf("p_brand", "#1", 0.25),
    )
)
def logical_nested(spark, sf_dir):
    keys = [{"name": "p_name", "weight": 2}, "p_type", "p_brand"]
    expression = {"$and": [{"p_name": "ring"}, {"$or": [{"$path": ["p_type"], "$val": "small"}, {"p_brand": "#1"}]}]}
    return _scores(_part(spark, sf_dir, keys, **_LOGICAL).search(expression))


@query(
    _logical_sql(
        "(contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')) AND contains(lower(p_name), 'rod')",
        _leaf("p_name", "small", 0.5),
        _leaf("p_type", "small", 0.5),
        _leaf("p_name", "rod", 0.5),
    )
)
def logical_keyless(spark, sf_dir):
    return _scores(_part(spark, sf_dir, ("p_name", "p_type"), **_LOGICAL).search({"$and": ["small", {"p_name": "rod"}]}))


@query(_logical_sql("contains(lower(p_name), 'blue') AND contains(lower(p_type), 'large')", _leaf("p_name", "blue", 0.5), _leaf("p_type", "large", 0.5)))
def logical_implicit_and(spark, sf_dir):
    return _scores(_part(spark, sf_dir, ("p_name", "p_type"), **_LOGICAL).search({"p_name": "blue", "p_type": "large"}))


# Token search

_TERMS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))"


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest({_TERMS}) AS term FROM documents) GROUP BY term")
def token_stats(spark, sf_dir):
    return SearchEngine(_table(spark, sf_dir, "documents"), ref_index="doc_id", keys=["text"], use_token_search=True).document_frequencies()


def _idf_sql(term: str, column: str = "p_name", table: str = "part") -> str:
    held = rf"count(*) FILTER (WHERE list_contains(regexp_extract_all(lower({column}), '[\p{{L}}\p{{M}}\p{{N}}_]+'), '{term}'))"
    return f"(SELECT ln(1 + (count(*) - {held} + 0.5) / ({held} + 0.5)) FROM {table})"


@query(f"SELECT 'red' AS term, round({_idf_sql('red')}, 6) AS idf UNION ALL SELECT 'rid', round({_idf_sql('rid')}, 6)")
def token_idf(spark, sf_dir):
    from .plans.matchers import idf_of

    fields, holding = _part(spark, sf_dir, use_token_search=True).statistics(["red", "rid"])
    return spark.createDataFrame([(t, idf_of(fields, holding[t])) for t in ("red", "rid")], "term string, idf double").select("term", F.round("idf", 6).alias("idf"))


def _token_sql(both: bool) -> str:
    red, plate = "contains(lower(p_name), 'red')", "contains(lower(p_name), 'plate')"
    part = lambda c, w: f"CASE WHEN {c} THEN {w} * 0.999 ELSE 0 END"
    return f"""
SELECT ref_index, ln_score FROM (SELECT p_partkey AS ref_index, round({_norm('p_name')} * ln(greatest(0.001,
  1 - ({part(red, 'a')} + {part(plate, 'b')}) / (a + b))), 5) AS ln_score
FROM part, (SELECT {_idf_sql('red')} AS a, {_idf_sql('plate')} AS b) WHERE {red} {'AND' if both else 'OR'} {plate})
"""


@query(_token_sql(False))
def token_any(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_token_search=True, threshold=0.1).search("Red, plate!"))


@query(_token_sql(True))
def token_all(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_token_search=True, threshold=0.1, token_match="all").search("plate red"))


@query(f"""
WITH k AS (SELECT p_name, {_edits('gizno', 2)} AS g, {_edits('smal', 1)} AS s FROM (SELECT DISTINCT p_name FROM part)),
w AS (SELECT {_idf_sql('gizno')} AS a, {_idf_sql('smal')} AS b)
SELECT p_partkey AS ref_index, round({_norm('p_name')} * ln(greatest(0.001, 1 - (
  CASE WHEN g <= 2 THEN a * (1 - greatest(0.001, g / 5.0)) ELSE 0 END + CASE WHEN s <= 1 THEN b * (1 - greatest(0.001, s / 4.0)) ELSE 0 END) / (a + b))), 5) AS ln_score
FROM part JOIN k USING (p_name), w WHERE g <= 2 OR s <= 1
""")
def token_typo(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_token_search=True, threshold=0.4).search("gizno smal"))


# Projection and scoring


@query(f"SELECT doc_id AS ref_index, {_norm('text')} AS norm FROM documents WHERE length(trim(text)) > 0")
def field_norm(spark, sf_dir):
    fields = SearchEngine(_table(spark, sf_dir, "documents"), ref_index="doc_id", keys=["text"]).get_index().fields()
    return fields.select("ref_index", "norm")


@query(f"""
SELECT p_partkey AS ref_index, round(CASE WHEN contains(lower(p_name), 'small') THEN 0.75 * {_norm('p_name')} * {_LN_EPS} ELSE 0 END
  + CASE WHEN contains(lower(p_type), 'small') THEN 0.25 * {_norm('p_type')} * {_LN_EPS} ELSE 0 END, 5) AS ln_score
FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small')
""")
def weighted_score(spark, sf_dir):
    keys = [{"name": "p_name", "weight": 3}, "p_type"]
    return _scores(_part(spark, sf_dir, keys, use_extended_search=True).search("'small"))


@query(f"SELECT p_partkey AS ref_index, round({_LN_EPS}, 5) AS ln_score FROM part WHERE contains(lower(p_name), 'rod')")
def ignore_field_norm(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True, ignore_field_norm=True).search("'rod"))


@query("SELECT p_partkey AS ref_index, cast(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN cast(cast(p_retailprice AS BIGINT) AS VARCHAR) ELSE cast(p_retailprice AS VARCHAR) END FROM part")
def stringified_numbers(spark, sf_dir):
    return _part(spark, sf_dir, ("p_size", "p_retailprice")).get_index().fields().select("ref_index", "v")


@query("SELECT doc_id AS ref_index FROM documents WHERE contains(strip_accents(lower(text)), 'ete') ")
def diacritics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return SearchEngine(docs, ref_index="doc_id", keys=["text"], ignore_diacritics=True, threshold=0.0, ignore_location=True).search("été").select("ref_index")


@query("SELECT event_id AS ref_index FROM events WHERE json_extract_string(props, '$.k') = '69'")
def nested_path(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k int"))
    return SearchEngine(events, ref_index="event_id", keys=["props.k"], use_extended_search=True).search("=69").select("ref_index")


@query("SELECT event_id AS ref_index FROM events WHERE json_extract_string(props, '$.k') = '42'")
def nested_path_variant(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumn("props", F.parse_json("props"))
    return SearchEngine(events, ref_index="event_id", keys=[["props", "k"]], use_extended_search=True).search("=42").select("ref_index")


@query(f"""
SELECT conv_id AS ref_index, round(sum({_norm('text')} * {_LN_EPS}), 4) AS ln_score
FROM conversations WHERE contains(lower(text), 'the ') GROUP BY conv_id
""")
def array_path(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    found = SearchEngine(talks, ref_index="conv_id", keys=["turns.text"], use_extended_search=True, include_score=True, include_matches=True).search("'\"the \"")
    # The product underflows for long talks, so the sum of logarithms is taken from the matches.
    words = F.regexp_count(F.col("m.value"), F.lit("[^\\x09-\\x0D\\x20\\u00A0]+"))
    norm = F.floor(1000 / F.sqrt(F.greatest(words, F.lit(1))) + 0.5) / 1000
    each = found.select("ref_index", F.explode("matches").alias("m"))
    return each.groupBy("ref_index").agg(F.round(F.sum(norm * (-52 * F.ln(F.lit(2.0)))), 4).alias("ln_score"))


# Order and limit


@query(f"SELECT p_partkey AS ref_index, round({_norm('p_name')} * {_LN_EPS}, 5) AS ln_score FROM part WHERE contains(lower(p_name), 'red') ORDER BY 2, 1 LIMIT 25")
def topk_ties(spark, sf_dir):
    return _scores(_part(spark, sf_dir, use_extended_search=True).search("'red", 25))


@query("SELECT p_partkey AS ref_index FROM part WHERE contains(lower(p_name), 'red') ORDER BY 1 LIMIT 25")
def unsorted_limit(spark, sf_dir):
    return _part(spark, sf_dir, use_extended_search=True, should_sort=False).search("'red", 25).select("ref_index")


@query("SELECT p_partkey AS ref_index, p_retailprice FROM part WHERE contains(lower(p_name), 'red') ORDER BY p_retailprice DESC, 1 LIMIT 25")
def custom_order(spark, sf_dir):
    engine = _part(spark, sf_dir, use_extended_search=True, sort_fn=[F.col("p_retailprice").desc()])
    return engine.search("'red", 25).select("ref_index", "p_retailprice")


@query("SELECT p_partkey AS ref_index FROM part ORDER BY 1 LIMIT 10")
def blank_query(spark, sf_dir):
    return _part(spark, sf_dir).search("  ", 10).select("ref_index")


@query("SELECT row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS ref_index, c_custkey FROM customer")
def row_numbers(spark, sf_dir):
    return dense_index(_table(spark, sf_dir, "customer"), "c_name", "c_custkey").select("ref_index", "c_custkey")


# Highlights


@query("SELECT p_partkey AS ref_index, replace(p_name, 'la', '<b>la</b>') AS marked FROM part WHERE contains(p_name, 'la')")
def highlight_ranges(spark, sf_dir):
    found = _part(spark, sf_dir, use_extended_search=True, include_matches=True).search("'la")
    first = F.get("matches", F.lit(0))
    return found.select("ref_index", highlight(first["value"], first["indices"]).alias("marked"))


@query("""
WITH r AS (SELECT p_partkey AS ref_index, p_size % 5 AS a, p_size % 5 + 2 AS b, p_size % 7 + 1 AS c, p_size % 7 + 2 AS d FROM part)
SELECT ref_index, CASE WHEN c <= b + 1 AND a <= d + 1 THEN least(a, c) || '-' || greatest(b, d)
  WHEN a < c THEN a || '-' || b || ',' || c || '-' || d ELSE c || '-' || d || ',' || a || '-' || b END AS merged FROM r
""")
def merged_ranges(spark, sf_dir):
    size = F.col("p_size")
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    ranges = merge_ranges(F.array(pair(size % 5, size % 5 + 2), pair(size % 7 + 1, size % 7 + 2)))
    shown = F.array_join(F.transform(ranges, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_index"), shown.alias("merged"))


# Mutation


@query("""
SELECT p_partkey AS ref_index, p_name AS name FROM part
UNION ALL SELECT (SELECT max(p_partkey) + 1 FROM part) + row_number() OVER (ORDER BY s_suppkey) - 1, s_name FROM supplier
""")
def collection_add(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_index"), F.col("p_name").alias("name"))
    engine = SearchEngine(parts, text="name", order_by=["name"])
    engine.add(_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    return engine.docs.select("ref_index", "name")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ref_index, p_name FROM part WHERE NOT contains(p_name, 'red')")
def collection_remove(spark, sf_dir):
    engine = _part(spark, sf_dir)
    engine.remove(F.col("p_name").contains("red"))
    return engine.docs.select("ref_index", "p_name")


@query("SELECT CASE WHEN p_partkey > 7 THEN p_partkey - 1 ELSE p_partkey END AS ref_index, p_name FROM part WHERE p_partkey <> 7")
def collection_remove_at(spark, sf_dir):
    engine = _part(spark, sf_dir)
    engine.remove_at(7)
    return engine.docs.select("ref_index", "p_name")


@query("SELECT p_partkey - (p_partkey > 3)::INT - (p_partkey > 9)::INT AS ref_index, p_name FROM part WHERE p_partkey NOT IN (3, 9)")
def collection_remove_all(spark, sf_dir):
    engine = _part(spark, sf_dir)
    engine.remove_all([9, 3, 3, -1])
    return engine.docs.select("ref_index", "p_name")


@query(_extended_sql("starts_with(lower(p_name), 'hot')"))
def index_roundtrip(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").withColumn("ref_index", F.col("p_partkey"))
    index = create_index(parts, ["p_name"])
    back = parse_index(wire_records(index), [k.as_dict() for k in KeySet(["p_name"]).keys])
    return _scores(SearchEngine(parts, keys=["p_name"], use_extended_search=True, include_score=True, index=back).search("^hot"))


@query("SELECT p_partkey - (p_partkey > 3)::INT - (p_partkey > 9)::INT AS ref_index, p_name AS v FROM part WHERE p_partkey NOT IN (3, 9) UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier")
def index_mutation(spark, sf_dir):
    """Rows of an index taken out by position, others put in."""
    index = create_index(_table(spark, sf_dir, "part").withColumn("ref_index", F.col("p_partkey")), ["p_name"])
    more = _table(spark, sf_dir, "supplier").select((1_000_000 + F.col("s_suppkey")).alias("ref_index"), F.col("s_name").alias("p_name"))
    return index.remove_at(9).remove_all([3, 3, -1]).add(more).fields().select("ref_index", "v")


@query(_extended_sql("ends_with(lower(p_name), 'gizmo')"))
def saved_index(spark, sf_dir):
    """An index saved as Parquet, loaded and searched."""
    parts = _table(spark, sf_dir, "part").withColumn("ref_index", F.col("p_partkey"))
    path = scratch(spark, "saved-index")
    save_index(create_index(parts, ["p_name"]), path)
    return _scores(SearchEngine(parts, keys=["p_name"], use_extended_search=True, include_score=True, index=load_index(spark, path)).search("gizmo$"))


# Sources


@query("SELECT p_partkey AS ref_index FROM part WHERE starts_with(lower(p_name), 'red') AND NOT contains(lower(p_name), 'plate')")
def strings_search(spark, sf_dir):
    """A collection of strings."""
    engine = SearchEngine(_table(spark, sf_dir, "part"), ref_index="p_partkey", text="p_name", use_extended_search=True)
    return engine.search("^red !plate").select("ref_index")


def _as_json(spark, sf_dir, suffix: str) -> str:
    """Parts as one JSON file, an object a line or an array."""
    path = f"{scratch(spark, 'records')}{suffix}"
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.struct("p_type", "p_size").alias("more"))
    lines = parts.select(F.to_json(F.struct("*")).alias("value"))
    if suffix == ".json":
        lines = lines.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ",\n"), F.lit("]")).alias("value"))
    lines.write.text(path)
    return path


_RECORDS_SQL = """
SELECT p_partkey AS ref_index, 'p_name,more.p_type' AS keys FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_type), 'green')
"""


@query(_RECORDS_SQL)
def json_records(spark, sf_dir):
    """An array of objects, its keys inferred."""
    return _inferred(load_records(spark, _as_json(spark, sf_dir, ".json")))


@query(_RECORDS_SQL)
def json_lines_records(spark, sf_dir):
    """An object a line, its keys inferred."""
    return _inferred(load_records(spark, _as_json(spark, sf_dir, ".jsonl")))


def _inferred(records: DataFrame) -> DataFrame:
    keys = sorted(infer_keys(records.schema), reverse=True)
    found = SearchEngine(records, ref_index="p_partkey", keys=keys, use_extended_search=True).search("'green")
    return found.select("ref_index", F.lit(",".join(keys)).alias("keys"))


# Functions for SQL, tokenizers


@query(f"""
WITH d AS (SELECT DISTINCT p_name FROM part), k AS (SELECT p_name, {_edits('gren gizmp', 3)} AS edits FROM d)
SELECT p_partkey AS ref_index, edits <= 3 AS found,
  round(CASE WHEN edits > 3 THEN NULL WHEN lower(p_name) = 'gren gizmp' THEN 0 ELSE greatest(0.001, edits / 10.0) END, 6) AS score
FROM part JOIN k USING (p_name)
""")
def sql_functions(spark, sf_dir):
    register_functions(spark, threshold=0.3, ignore_location=True)
    _table(spark, sf_dir, "part").createOrReplaceTempView("lodestone_parts")
    return spark.sql(
        "SELECT p_partkey AS ref_index, fuzzy_match('gren gizmp', p_name) AS found, round(fuzzy_score('gren gizmp', p_name), 6) AS score FROM lodestone_parts"
    )


@query("SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(p_type), '[a-z]{2}'))) AS term FROM part) GROUP BY term")
def token_pattern(spark, sf_dir):
    """Terms by a regular expression."""
    return _part(spark, sf_dir, ("p_type",), use_token_search=True, tokenize="[a-z]{2}").document_frequencies()


@query("SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(string_split(lower(p_type), ' '))) AS term FROM part) GROUP BY term")
def token_function(spark, sf_dir):
    """Terms by a Python function."""
    return _part(spark, sf_dir, ("p_type",), use_token_search=True, tokenize=lambda text: text.split(" ")).document_frequencies()


# Batches and joins


@query(f"""
WITH q AS (SELECT DISTINCT p_name AS qid FROM part),
s AS (SELECT qid, p_partkey AS ref_index, {_norm('p_name')} * CASE WHEN p_name = qid THEN {_LN_EPS} ELSE ln(0.001) END AS s FROM part, q WHERE contains(lower(p_name), qid)),
r AS (SELECT qid, ref_index, round(s, 5) AS ln_score, row_number() OVER (PARTITION BY qid ORDER BY s, ref_index) AS rank FROM s)
SELECT qid, ref_index, ln_score, rank::INTEGER AS rank FROM r WHERE rank <= 3
""")
def batch_topk(spark, sf_dir):
    asked = _table(spark, sf_dir, "part").select(F.col("p_name").alias("qid"), F.col("p_name").alias("query")).distinct()
    found = search_many(_part(spark, sf_dir, threshold=0.0, ignore_location=True), asked, 3)
    return found.select("qid", "ref_index", F.round(F.ln("score"), 5).alias("ln_score"), "rank")


def _customers_to_suppliers(spark, sf_dir):
    suppliers = _table(spark, sf_dir, "supplier")
    engine = SearchEngine(suppliers, ref_index="s_suppkey", keys=["s_name"], use_token_search=True, threshold=0.0)
    customers = _table(spark, sf_dir, "customer").withColumn("number", F.regexp_extract("c_name", "#(.*)", 1))
    return customers, engine


_JOIN_SQL = """
WITH n AS (SELECT c_custkey, regexp_extract(c_name, '#(.*)', 1) AS number FROM customer),
j AS (SELECT c_custkey AS qid, min(s_suppkey) AS ref_index FROM n JOIN supplier ON contains(s_name, number) GROUP BY 1)
"""


@query(_JOIN_SQL + "SELECT n.c_custkey AS qid, ref_index, CASE WHEN ref_index IS NULL THEN 'missing' ELSE 'matched' END AS band FROM n LEFT JOIN j ON n.c_custkey = j.qid")
def fuzzy_best_match(spark, sf_dir):
    customers, engine = _customers_to_suppliers(spark, sf_dir)
    return fuzzy_join(customers, engine, ["number"], "c_custkey").select("qid", "ref_index", "band")


@query(
    _JOIN_SQL
    + "SELECT 'supplier' AS side, s_suppkey AS id FROM supplier WHERE s_suppkey NOT IN (SELECT ref_index FROM j)"
    + " UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT qid FROM j)"
)
def reconcile_missing(spark, sf_dir):
    """Rows of either side without a partner on the other."""
    customers, engine = _customers_to_suppliers(spark, sf_dir)
    joined = fuzzy_join(customers, engine, ["number"], "c_custkey")
    left = without_partner(_table(spark, sf_dir, "supplier"), "s_suppkey", joined, "ref_index")
    right = without_partner(customers, "c_custkey", joined, "qid")
    sides = left.select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("id"))
    return sides.unionByName(right.select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id")))


@query(_JOIN_SQL + "SELECT n.c_custkey AS qid, CASE WHEN ref_index IS NULL THEN 'escalate' ELSE 'auto' END AS band FROM n LEFT JOIN j ON n.c_custkey = j.qid")
def triage_bands(spark, sf_dir):
    customers, engine = _customers_to_suppliers(spark, sf_dir)
    return triage(customers, engine, ["number"], "c_custkey").select("qid", "band")


# Streams


def _drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into a written table."""
    path = scratch(stream.sparkSession, name)
    query_ = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query_.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _streamed(spark, sf_dir, name: str) -> DataFrame:
    return spark.readStream.schema(_table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query(_extended_sql("starts_with(lower(p_name), 'cold')"))
def stream_search(spark, sf_dir):
    found = search_stream(_streamed(spark, sf_dir, "part"), "^cold", {"keys": ["p_name"], "use_extended_search": True}, ref_index="p_partkey")
    return _scores(_drained(found.select("ref_index", "score"), "stream-search"))


@query("SELECT 1 AS qid, event_id AS ref_index FROM events WHERE event_type = 'error' UNION ALL SELECT 2, event_id FROM events WHERE starts_with(event_type, 'p')")
def stream_standing_queries(spark, sf_dir):
    found = standing_queries(_streamed(spark, sf_dir, "events"), [(1, "=error"), (2, "^p")], {"keys": ["event_type"], "use_extended_search": True}, ref_index="event_id")
    return _drained(found.select("qid", "ref_index"), "standing")


# Text functions


@query("""WITH t AS (SELECT doc_id, strip_accents(replace(translate(lower(text), 'łđøħŧı', 'ldohti'), 'ß', 'ss')) AS t FROM documents)
SELECT doc_id, length(t) AS n, md5(t) AS text_md5 FROM t""")
def without_accents_all(spark, sf_dir):
    """All documents, those with letters that have no decomposition too."""
    plain = _table(spark, sf_dir, "documents").select("doc_id", without_accents(F.lower("text")).alias("t"))
    return plain.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.encode("t", "UTF-8")).alias("text_md5"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator query on part names: native predicates, one scan, top ten without a full sort."""
    return _part(spark, sf_dir, use_extended_search=True).search("^red plate$ | 'gizmo", 10)
