"""Collections of records from JSON and JSON Lines, and keys inferred from a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that name a record, best first.
LABELS = ("title", "name", "label", "id")


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """A ``.json`` file with an array of objects, or ``.jsonl`` / ``.ndjson`` with one a line.

    A file without objects, or with anything else, is refused.
    """
    lines = path.endswith((".jsonl", ".ndjson"))
    try:
        df = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
        usable = bool(df.columns) and not df.isEmpty()
    except Exception as error:
        raise ValueError(f"{path} is not a list of objects") from error
    if not usable:
        raise ValueError(f"{path} holds no objects")
    return df


def infer_keys(schema: T.StructType) -> list[str]:
    """Searchable keys: strings and lists of strings, at the top and one level down; numbers are skipped."""
    text = lambda kind: isinstance(kind, T.StringType) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)
    keys = []
    for field in schema:
        if text(field.dataType):
            keys.append(field.name)
        elif isinstance(field.dataType, T.StructType):
            keys += [f"{field.name}.{inner.name}" for inner in field.dataType if isinstance(inner.dataType, T.StringType)]
    return keys


def label_of(df: DataFrame) -> Column:
    """What a record is called: the first of the usual columns that is not null, else its first column."""
    own = [F.col(c).cast("string") for c in LABELS if c in df.columns] or [F.col(df.columns[0]).cast("string")]
    return F.coalesce(*own)
