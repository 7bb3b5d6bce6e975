"""From rows to searchable values, and dense row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import field_norm, is_blank, without_accents_list
from ..options import SearchOptions
from ..plans.keys import KeySet, texts_of
from ..shared import written

#: A row's searchable values: position of the key (null in a collection of strings), of the innermost
#: array element, the text, its folded form, its norm.
SUBS = "array<struct<key_idx:int,arr_idx:int,v:string,u:string,norm:double>>"


def dense_index(df: DataFrame, *order: Column | str, name: str = "ref_index") -> DataFrame:
    """Number rows 0.. in the given order: sorted by ranges, each partition offset by the rows before it.

    The sorted rows are written: counting and numbering must see the same partitions, also if an
    executor is lost in between.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    marked = spread.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    marked = written(marked, "numbered")
    counts = marked.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select("__p", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = marked.join(F.broadcast(offsets), "__p")
    return numbered.withColumn(name, F.col("__before") + F.col("__m") - F.col("__first")).drop("__p", "__m", "__first", "__before")


def folded(values: Column, options: SearchOptions) -> Column:
    """An array of texts as they are compared."""
    lower = values if options.is_case_sensitive else F.transform(values, F.lower)
    return without_accents_list(lower) if options.ignore_diacritics else lower


def _of_key(values: Column, k: int) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(k).alias("key_idx"), x["arr_idx"].alias("arr_idx"), x["v"].alias("v")))


def with_subs(df: DataFrame, keys: KeySet, text: str | None, options: SearchOptions) -> DataFrame:
    """Add ``subs``: the values of all keys in their order, without blank ones."""
    if text is not None:
        kept = F.when(F.col(text).isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("key_idx"), F.lit(None).cast("int").alias("arr_idx"), F.col(text).alias("v"))))
        raw = F.coalesce(kept, F.array().cast("array<struct<key_idx:int,arr_idx:int,v:string>>"))
    else:
        parts = []
        for k, key in enumerate(keys.keys):
            own = texts_of(key, df.schema, options.get_fn)
            parts.append(_of_key(own, k))
        raw = F.concat(*parts) if parts else F.array().cast("array<struct<key_idx:int,arr_idx:int,v:string>>")
    df = df.withColumn("__raw", F.filter(raw, lambda x: ~is_blank(x["v"])))
    return fold_subs(df, options, norm=lambda x: field_norm(x["v"], options.field_norm_weight))


def fold_subs(df: DataFrame, options: SearchOptions, norm) -> DataFrame:
    """``subs`` of ``__raw``: the texts with their folded forms and norms."""
    by_udf = options.ignore_diacritics  # one Arrow call for the row's texts; else folding stays in the lambda
    if by_udf:
        df = df.withColumn("__u", folded(F.transform("__raw", lambda x: x["v"]), options))

    def one(x: Column, i: Column) -> Column:
        u = F.get("__u", i) if by_udf else x["v"] if options.is_case_sensitive else F.lower(x["v"])
        fields = {"key_idx": x["key_idx"], "arr_idx": x["arr_idx"], "v": x["v"], "u": u, "norm": norm(x)}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    return df.withColumn("subs", F.transform("__raw", one).cast(SUBS)).drop("__raw", "__u")


def long_form(df: DataFrame, keys: KeySet) -> DataFrame:
    """One row per value: ``ref_index, key_idx, key_id, weight, arr_idx, v, v_norm, norm``."""
    ids = F.array(*(F.lit(k.id) for k in keys.keys)) if len(keys) else F.array().cast("array<string>")
    weights = F.array(*(F.lit(float(k.weight)) for k in keys.keys)) if len(keys) else F.array().cast("array<double>")
    each = df.select("ref_index", F.explode("subs").alias("s"))
    return each.select(
        "ref_index",
        "s.key_idx",
        F.get(ids, F.col("s.key_idx")).alias("key_id"),
        F.get(weights, F.col("s.key_idx")).alias("weight"),
        "s.arr_idx",
        "s.v",
        F.col("s.u").alias("v_norm"),
        "s.norm",
    )


def short_form(fields: DataFrame) -> DataFrame:
    """Back from one row per value to ``ref_index, subs``."""
    packed = F.struct("key_idx", F.col("arr_idx"), "v", F.col("v_norm").alias("u"), "norm")
    return fields.groupBy("ref_index").agg(F.array_sort(F.collect_list(packed)).cast(SUBS).alias("subs"))
