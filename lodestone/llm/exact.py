"""Exact deduplication on streaming state.

Rows' digests flow through a Structured Streaming aggregation whose RocksDB state is keyed
by digest and never expires.  A key retains the stable identifier (the smallest id), a
content locator (file and row of the text that holds the key) and a count.  Spark combines
equal digests before they reach the state, so a digest with a third of all rows costs one
state update a task.

A ``state`` folder serves any number of calls.  It holds ``prints``, where every call adds a
folder of its own rows' digests and locators, and ``log``, the checkpoint of the stream that
reads them; a call folds in what is new.  Rows that come from Parquet files are located in
these; the texts of others are written to the state's ``texts`` first, so a locator
leads to a text as long as the files stand.

Hits are checked on their full bytes: the texts of a digest with several rows, and the held
text, read by locator even if an earlier call brought it, must all be the same.  Should digests of
different texts ever be equal, all rows of that digest, those of earlier calls too, are read by
their locators and grouped by their whole texts.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, scratch, settle

#: Where a text is: a Parquet file, the row in it, and the file's column.
PLACE = ("file", "row", "text_col")
PRINTS = "id long, file string, row long, text_col string, digest binary, sha binary, call string"

#: Places are sent to every executor only if they were counted and are at most so many (some 60 MB).
MOST_BROADCAST_PLACES = 300_000

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: without this each one reserves megabytes of disk ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # A task closes its store: else an executor goes on holding those of all its partitions, outside its heap, after the call.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def fold_into_state(spark: SparkSession, state: str, files_per_batch: int = 1000) -> DataFrame:
    """Run what is new in the state's ``prints`` through the stream, in batches of files; returns the whole state.

    Columns: ``digest, keep_id, keep_file, keep_row, keep_text_col, keep_call, group_size``.
    """
    with _settings(spark, _ROCKS):
        stream = spark.readStream.schema(PRINTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{state}/prints")
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "row", "text_col", "call")).alias("least")
        held = stream.groupBy("digest").agg(least, F.count("*").alias("n"))
        query = held.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.format("statestore").load(f"{state}/log")
        least, n = (f.name for f in rows.schema["value"].dataType.fields)
        return settle(
            rows.select(
                F.col("key.digest").alias("digest"),
                *(F.col(f"value.`{least}`.{c}").alias(f"keep_{c}") for c in ("id", *PLACE, "call")),
                F.col(f"value.`{n}`").alias("group_size"),
            ),
            "state",
        )


def _file_column(docs: DataFrame, text_col: str) -> str | None:
    """The column of the Parquet files that ``text_col`` is, unchanged; None if the rows come from anything
    but such files by selections, projections and the like."""
    plan, names = docs._jdf.queryExecution().analyzed(), docs.select(F.col(f"`{text_col}`"))._jdf.queryExecution().analyzed().output()
    while plan.children().size() == 1:
        plan = plan.children().head()
    if plan.children().size() or plan.nodeName().split()[0] != "LogicalRelation" and "parquet" not in plan.toString():
        return None
    same = [plan.output().apply(k) for k in range(plan.output().size())]
    found = [a.name() for a in same if a.exprId().equals(names.head().exprId())]
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return found[0] if found else None


def _located(docs: DataFrame, id_col: str, text_col: str, copy: str) -> tuple[DataFrame, str]:
    """``id, text, file, row``, and the files' column of texts: from the Parquet files that the rows come
    from, else from a copy written to ``copy``."""
    own = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if column := _file_column(docs, text_col):
        return docs.select(*own, *place), column
    docs = docs.select(*own)
    docs.write.parquet(copy)
    return docs.sparkSession.read.schema(docs.schema).parquet(copy).select("id", "text", *place), "text"


def _at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` at the written table ``places`` (file, row and what else it has)."""
    small = places.count() <= MOST_BROADCAST_PLACES
    return rows.join(F.broadcast(places) if small else places, ["file", "row"])


def _read_places(spark: SparkSession, places: DataFrame) -> DataFrame:
    """``places`` (file, row, text_col and more; written) with ``full``, read from the files named and no others."""
    found = places.limit(0).withColumn("full", F.lit("")).drop("text_col")
    for (column,) in places.select("text_col").distinct().collect():
        own = places.filter(F.col("text_col") == column).drop("text_col")
        files = [unquote(r.file) for r in own.select("file").distinct().toLocalIterator()]
        rows = spark.read.schema(f"`{column}` string").parquet(*files)
        rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.col(f"`{column}`")).alias("full"))
        found = found.unionByName(_at(rows, own))
    return found


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest=sha256_of,
    state: str | None = None,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Per row ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are after each run of ``[\\x20\\x09-\\x0D]`` is replaced by one space;
    null counts as empty.  Of equal texts the row with the smallest id stays.  Repeated rows
    with one id are one document said twice: each is counted and marked alike.  Null ids come
    last; a group of nulls only has a null keep_id and all its rows are kept.  Other columns are
    ignored.  ``digest`` maps the normalised text to a binary key.  ``state`` is the folder of
    earlier calls' state to fold these rows into (a new one if None): keep_id and group_size then
    count the rows of all calls; rows of this call only are returned.
    """
    spark = docs.sparkSession
    state, call = state or scratch(spark, "dedup-state"), "c" + uuid.uuid4().hex
    located, column = _located(docs, id_col, text_col, f"{state}/texts/{call}")
    text = normalised(F.col("text"))
    own = located.select("id", "file", "row", F.lit(column).alias("text_col"), digest(text).alias("digest"), sha256_of(text).alias("sha"))
    own.write.parquet(f"{state}/prints/call={call}")
    held = fold_into_state(spark, state, files_per_batch)
    prints = spark.read.schema(PRINTS).parquet(f"{state}/prints")
    told = settle(prints.filter(F.col("call") == call).withColumnRenamed("id", "doc_id").join(held, "digest"), "told")
    texts = located.select("file", "row", text.alias("full"))
    different = _unequal_hits(told, texts, call)
    if not different.isEmpty():
        told = _by_whole_text(told, texts, prints, different, call)
    return told.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _unequal_hits(told: DataFrame, texts: DataFrame, call: str) -> DataFrame:
    """Digests whose rows, the held one included, have different full texts.

    The least and the greatest text of a digest are found before the shuffle, so copies
    of one text within a task are sent once.
    """
    hits = settle(told.filter("group_size > 1").select("file", "row", "digest"), "hits")
    full = _at(texts, hits).select("digest", "full")
    place = [F.col(f"keep_{c}").alias(c) for c in PLACE]
    held = told.filter((F.col("group_size") > 1) & (F.col("keep_call") != call)).select("digest", *place).distinct()
    held = settle(held, "held")
    if not held.isEmpty():
        full = full.unionByName(_read_places(told.sparkSession, held).select("digest", "full"))
    ends = full.groupBy("digest").agg(F.min("full").alias("least"), F.max("full").alias("most"))
    return settle(ends.filter("least <> most").select("digest"), "unequal")


def _by_whole_text(told: DataFrame, texts: DataFrame, prints: DataFrame, different: DataFrame, call: str) -> DataFrame:
    """Digests that different texts share: the rows of all calls are grouped by the texts themselves."""
    rows = settle(prints.join(different, "digest", "left_semi").drop("digest"), "collided")
    own = _at(texts, settle(rows.filter(F.col("call") == call).drop("text_col"), "collided-now"))
    older = settle(rows.filter(F.col("call") != call), "collided-before")
    whole = settle(own.unionByName(_read_places(told.sparkSession, older)), "whole")
    least = F.min(F.struct(F.col("id").isNull(), "id")).alias("least")
    groups = whole.groupBy("full").agg(least, F.count("*").alias("group_size")).select("full", F.col("least.id").alias("keep_id"), "group_size")
    redone = whole.filter(F.col("call") == call).join(groups, "full").select(F.col("id").alias("doc_id"), "sha", "keep_id", "group_size")
    return told.join(different, "digest", "left_anti").select(*redone.columns).unionByName(redone)
