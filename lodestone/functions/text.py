"""Text columns: stringifying, trimming, folding, norms, ranges and highlights."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that ECMAScript's trim removes.
TRIMMED = "\t\n\v\f\r                  　﻿"

#: Letters without a decomposition, and what stands for them.
PLAIN_LETTERS = {"ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ø": "o", "Ø": "O", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i", "ß": "ss"}

RANGE = "struct<start:int,end:int>"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def strip_accents(text: str) -> str:
    """Decompose, drop combining marks of the basic plane, replace letters that do not decompose."""
    parts = []
    for c in unicodedata.normalize("NFD", text):
        if ord(c) < 0x300 and c not in PLAIN_LETTERS:
            parts.append(c)
        elif not (ord(c) <= 0xFFFF and unicodedata.category(c)[0] == "M"):
            parts.append(PLAIN_LETTERS.get(c, c))
    return "".join(parts)


@F.arrow_udf(T.StringType())
def _strip_accents_udf(values: pa.Array) -> pa.Array:
    known: dict = {None: None}
    return pa.array([known[v] if v in known else known.setdefault(v, strip_accents(v)) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _strip_accents_list_udf(values: pa.Array) -> pa.Array:
    known: dict = {None: None}
    strip = lambda v: known[v] if v in known else known.setdefault(v, strip_accents(v))
    return pa.array([None if row is None else [strip(v) for v in row] for row in values.to_pylist()], pa.list_(pa.string()))


def without_accents(text: Column) -> Column:
    """One Arrow batch call; Spark has no Unicode normalisation of its own."""
    return _strip_accents_udf(text)


def without_accents_list(texts: Column) -> Column:
    return _strip_accents_list_udf(texts)


def fold_literal(text: str, options) -> str:
    """A pattern as the values are folded."""
    text = text if options.is_case_sensitive else text.lower()
    return strip_accents(text) if options.ignore_diacritics else text


def _number_text(value: Column) -> Column:
    """Doubles in ECMAScript's shortest form, from Spark's (mantissa, E, exponent)."""
    raw = value.cast("string")
    parts = F.split(raw, "E")
    mantissa, exponent = parts[0], F.get(parts, F.lit(1)).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"^-|\.", ""), r"(?<=.)0+$", "")
    sign = F.when(mantissa.startswith("-"), "-").otherwise("")
    whole = F.when(
        F.length(digits) > exponent + 1, F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400)))
    ).otherwise(F.rpad(digits, exponent + 1, "0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    tail = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.lit(400)))).otherwise(digits)
    far = F.concat(tail, F.lit("e"), F.when(exponent > 0, "+").otherwise(""), exponent.cast("string"))
    with_exponent = F.when(exponent >= 21, far).when(exponent >= 0, whole).when(exponent >= -6, small).otherwise(far)
    return (
        F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), raw)
        .when(value == 0, "0")
        .when(exponent.isNotNull(), F.concat(sign, with_exponent))
        .otherwise(F.regexp_replace(raw, r"\.0$", ""))
    )


def is_text_type(kind: T.DataType) -> bool:
    """Whether a leaf of this type is searchable."""
    return isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType))


def stringify(value: Column, kind: T.DataType) -> Column:
    """A scalar leaf as text; null stays null."""
    if isinstance(kind, T.FloatType):
        return _number_text(value.cast("string").cast("double"))
    return _number_text(value) if isinstance(kind, T.DoubleType) else value.cast("string")


def word_starts(text: Column) -> Column:
    """Words between tabs to carriage returns, spaces and no-break spaces; at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[^\\x09-\\x0D\\x20\\u00A0]+")))


def field_norm(text: Column, weight: float = 1.0) -> Column:
    """n to the power -weight/2, rounded half up to three digits."""
    return F.floor(F.lit(1000.0) / F.pow(word_starts(text).cast("double"), F.lit(0.5 * weight)) + 0.5) / F.lit(1000.0)


def merge_ranges(ranges: Column) -> Column:
    """Inclusive ranges in order; overlapping and adjoining ones become one."""
    last = lambda acc: F.element_at(acc, -1)

    def add(acc, r):
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], r["end"]).alias("end"))),
        )
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] + 1 >= r["start"])
        return F.when(touches, joined).otherwise(F.concat(acc, F.array(r)))

    typed = F.coalesce(ranges, F.array()).cast(f"array<{RANGE}>")
    return F.aggregate(F.array_sort(typed), F.array().cast(f"array<{RANGE}>"), add)


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping places of ``part`` from the left, as inclusive ranges."""
    if not part:
        return F.array().cast(f"array<{RANGE}>")
    pieces = F.split(text, "\\Q" + part.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    starts = F.aggregate(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{RANGE}>").alias("found")),
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece) + len(part)).cast("int").alias("at"),
            F.concat(
                acc["found"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(piece)).cast("int").alias("start"),
                        (acc["at"] + F.length(piece) + len(part) - 1).cast("int").alias("end"),
                    )
                ),
            ).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return starts


def highlight(text: Column, ranges: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """The text with marks around its ranges; ranges may come in any order or overlap."""
    marked = F.aggregate(
        merge_ranges(ranges),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, r: F.struct(
            (r["end"] + 1).cast("int").alias("at"),
            F.concat(
                acc["out"],
                F.substring(text, acc["at"] + 1, r["start"] - acc["at"]),
                F.lit(before),
                F.substring(text, r["start"] + 1, r["end"] - r["start"] + 1),
                F.lit(after),
            ).alias("out"),
        ),
    )
    return F.concat(marked["out"], F.substring(text, marked["at"] + 1, F.length(text)))


def normalised_words(text: Column, stopwords: list[str] = ()) -> Column:
    """Words of letters, digits, ``_`` and dots, lower-cased, without stop words, joined by spaces."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*stopwords)) if stopwords else words
    return F.array_join(kept, " ")
