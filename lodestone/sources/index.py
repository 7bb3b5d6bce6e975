"""Saved indexes: Parquet for use, JSON for exchange."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Index
from ..operators.values import fold_subs, short_form, with_subs
from ..options import SearchOptions
from ..plans.keys import Key, KeySet


def create_index(df: DataFrame, keys: Sequence[Any] = (), text: str | None = None, options=None, **more: Any) -> Index:
    """Values of ``df`` (with ``ref_index``) once, for several engines.  No rows give an empty index."""
    o = SearchOptions.coerce(options, **more)
    found = KeySet(keys)
    return Index(with_subs(df, found, text, o).select("ref_index", "subs"), found, text is not None)


def save_index(index: Index, path: str) -> None:
    """``fields`` (one row per value, by key, so that a search on some keys reads those) and ``rows``, ``keys``."""
    index.fields().write.partitionBy("key_idx").mode("overwrite").parquet(f"{path}/fields")
    index.rows.select("ref_index").write.mode("overwrite").parquet(f"{path}/rows")
    spark = index.rows.sparkSession
    keys = [(n, k.id, list(k.path), float(r.weight), json.dumps(k.src)) for n, (k, r) in enumerate(zip(index.keys.keys, index.keys.raw))]
    spark.createDataFrame([(index.strings, keys)], "strings boolean, keys array<struct<n:int,id:string,path:array<string>,weight:double,src:string>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/keys")


def load_index(spark: SparkSession, path: str) -> Index:
    head = spark.read.parquet(f"{path}/keys").first()
    keys = KeySet([Key(tuple(k.path), k.id, k.weight, json.loads(k.src)) for k in head["keys"]])
    fields = spark.read.parquet(f"{path}/fields").withColumn("key_idx", F.col("key_idx").cast("int"))
    held = short_form(fields)
    none = F.array().cast(held.schema["subs"].dataType)
    rows = spark.read.parquet(f"{path}/rows").join(held, "ref_index", "left")
    return Index(rows.select("ref_index", F.coalesce("subs", none).alias("subs")), keys, head.strings)


def wire_keys(index: Index) -> str:
    """The keys as JSON."""
    return json.dumps([{**k.as_dict(), "weight": r.weight} for k, r in zip(index.keys.keys, index.keys.raw)])


def wire_records(index: Index) -> DataFrame:
    """``record``: a JSON object per row, ``{i, v, n}`` or ``{i, $: {key: {v, n} or [{v, n, i}, ...]}}``.

    Array values carry their position; rows of a collection of strings without a value are left out.
    """
    rows = index.rows
    if index.strings:
        one = rows.filter(F.size("subs") > 0).select(F.get("subs", F.lit(0)).alias("s"), F.col("ref_index").alias("i"))
        return one.select(F.to_json(F.struct(F.col("s.v").alias("v"), "i", F.col("s.norm").alias("n"))).alias("record"))
    entries = []
    for k in range(len(index.keys)):
        own = _of_key(k)
        listed = F.to_json(F.transform(own, lambda s: F.struct(s["v"].alias("v"), s["norm"].alias("n"), s["arr_idx"].alias("i"))))
        single = F.to_json(F.transform(own, lambda s: F.struct(s["v"].alias("v"), s["norm"].alias("n"))))
        text = F.when(F.get(own, F.lit(0))["arr_idx"].isNotNull(), listed).otherwise(F.substring(single, F.lit(2), F.length(single) - 2))
        entries.append(F.when(F.size(own) > 0, F.concat(F.lit(f'"{k}":'), text)))
    body = F.array_join(F.array_compact(F.array(*entries)), ",") if entries else F.lit("")
    return rows.select(F.concat(F.lit('{"i":'), F.col("ref_index").cast("string"), F.lit(',"$":{'), body, F.lit("}}")).alias("record"))


def _of_key(k: int):
    return F.filter("subs", lambda s: s["key_idx"] == k)


def parse_index(records: DataFrame, keys: Sequence[dict], options=None, column: str = "record", **more: Any) -> Index:
    """An index from wire records (a string column) and wire keys, ``[{path, id, weight, src}, ...]``."""
    o = SearchOptions.coerce(options, **more)
    found = KeySet([Key(tuple(k["path"]), k["id"], float(k["weight"]), k.get("src")) for k in keys])
    raw = records.select(F.from_json(column, "i long, v string, n double, `$` string").alias("r")).select("r.*")
    one = "struct<v:string,n:double,i:int>"
    value = "struct<key_idx:int,arr_idx:int,v:string,norm:double>"
    flat = F.filter(
        F.array(F.struct(F.lit(None).cast("int").alias("key_idx"), F.lit(None).cast("int").alias("arr_idx"), F.col("v"), F.col("n").alias("norm"))).cast(f"array<{value}>"),
        lambda x: x["v"].isNotNull(),
    )
    parts = [flat]
    for k in range(len(found)):
        text = F.get_json_object(F.col("`$`"), f"$.{k}")
        listed = F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{one}>")
        parts.append(_entries(listed, k, value))
    rows = raw.select(F.col("i").alias("ref_index"), F.concat(*(F.coalesce(p, F.array().cast(f"array<{value}>")) for p in parts)).alias("__raw"))
    return Index(fold_subs(rows, o, norm=lambda x: x["norm"]), found, len(found) == 0)


def _entries(listed, k: int, value: str):
    one = F.transform(listed, lambda x: F.struct(F.lit(k).alias("key_idx"), x["i"].alias("arr_idx"), x["v"].alias("v"), x["n"].alias("norm")))
    return F.filter(one.cast(f"array<{value}>"), lambda x: x["v"].isNotNull())
