"""Search keys: spellings, weights, and nested paths compiled over a schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KeyProblem
from ..functions.text import is_text_type, stringify

#: One searchable text of a row before folding: the innermost array position (null outside arrays).
VALUE = "array<struct<arr_idx:int,v:string>>"


@dataclass(frozen=True)
class Key:
    """path: property steps; get_fn: DataFrame-independent builder of a string or string-array Column."""

    path: tuple[str, ...]
    id: str
    weight: float = 1.0
    src: Any = None
    get_fn: Callable[[], Column] | None = None

    def as_dict(self) -> dict[str, Any]:
        return {"path": list(self.path), "id": self.id, "weight": self.weight, "src": self.src}


def key_path(name: str | Sequence[str]) -> tuple[str, ...]:
    return tuple(name.split(".")) if isinstance(name, str) else tuple(name)


def key_id(name: str | Sequence[str]) -> str:
    return name if isinstance(name, str) else ".".join(name)


def make_key(spec: Any) -> Key:
    """From a dotted string, a list of steps, a mapping with ``name``, or a Key."""
    if isinstance(spec, Key):
        return spec
    if isinstance(spec, (str, list, tuple)):
        return Key(key_path(spec), key_id(spec), 1.0, spec if isinstance(spec, str) else list(spec))
    if not isinstance(spec, Mapping) or "name" not in spec:
        raise KeyProblem.nameless()
    name, weight = spec["name"], spec.get("weight")
    if weight is not None and weight <= 0:
        raise KeyProblem.weightless(key_id(name), weight)
    getter = spec.get("get_fn", spec.get("getFn"))
    return Key(key_path(name), key_id(name), 1.0 if weight is None else float(weight), name if isinstance(name, str) else list(name), getter)


class KeySet:
    """Keys in declaration order with weights that sum to 1; of equal ids the last one is found by id."""

    def __init__(self, specs: Sequence[Any]):
        self.raw = [make_key(s) for s in specs]
        total = sum(k.weight for k in self.raw)
        self.keys = [replace(k, weight=k.weight / total) for k in self.raw]
        self.by_id = {k.id: n for n, k in enumerate(self.keys)}

    def __len__(self) -> int:
        return len(self.keys)

    def index_of(self, id_: str) -> int | None:
        """Position of the first key with this id, as values are stored by position."""
        return next((n for n, k in enumerate(self.keys) if k.id == id_), None)

    def weight_of(self, id_: str) -> float:
        return self.keys[self.by_id[id_]].weight

    def reweighted(self, own: KeySet) -> KeySet:
        """These keys, in a set of its own, with the weights that ``own`` has for their ids."""
        new = KeySet(self.raw)
        new.keys = [own.keys[own.by_id[k.id]] if k.id in own.by_id else k for k in self.raw]
        return new

    def to_list(self) -> list[dict[str, Any]]:
        return [k.as_dict() for k in self.keys]


def _one(value: Column, arr_idx: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.struct(arr_idx.cast("int").alias("arr_idx"), value.alias("v")))).otherwise(F.array().cast(VALUE))


def _none() -> Column:
    return F.array().cast(VALUE)


def _walk(value: Column, kind: T.DataType, steps: tuple[str, ...], arr_idx: Column, depth: int) -> Column:
    """All texts below ``value``: structs by field, maps by key, arrays by position or all elements."""
    if not steps or not steps[0]:
        if isinstance(kind, T.ArrayType) and depth == 0:
            return _fan(value, kind, (), depth)
        return _one(stringify(value, kind), arr_idx) if is_text_type(kind) else _none()
    step, rest = steps[0], steps[1:]
    if isinstance(kind, T.StructType):
        if step not in kind.names:
            return _none()
        inner, inner_kind = value.getField(step), kind[step].dataType
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        inner, inner_kind = F.try_element_at(value, F.lit(step)), kind.valueType
    elif isinstance(kind, T.ArrayType) and step.isdigit():
        inner, inner_kind = F.get(value, F.lit(int(step))), kind.elementType
    elif isinstance(kind, T.VariantType):
        inner, inner_kind = F.try_variant_get(value, f"$['{step}']", "variant"), kind
    else:
        return _none()
    return _below(inner, inner_kind, rest, arr_idx, depth + 1)


def _below(value: Column, kind: T.DataType, rest: tuple[str, ...], arr_idx: Column, depth: int) -> Column:
    if isinstance(kind, T.ArrayType):
        return _fan(value, kind, rest, depth)
    if isinstance(kind, T.VariantType):
        items = F.try_variant_get(value, "$", "array<variant>")
        fanned = _fan(items, T.ArrayType(T.VariantType()), rest, depth)
        if rest and rest[0]:
            alone = _walk(value, kind, rest, arr_idx, depth)
        else:
            text = F.when(F.schema_of_variant(value).rlike("^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), _variant_text(value))
            alone = _one(text, arr_idx)
        return F.when(items.isNotNull() & F.schema_of_variant(value).startswith("ARRAY"), fanned).otherwise(alone)
    return _walk(value, kind, rest, arr_idx, depth)


def _variant_text(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    number = stringify(F.try_variant_get(value, "$", "double"), T.DoubleType())
    return F.when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), number).otherwise(F.try_variant_get(value, "$", "string"))


def _fan(items: Column, kind: T.ArrayType, rest: tuple[str, ...], depth: int) -> Column:
    """Every element, with its own position as the innermost one."""
    element = kind.elementType
    if not rest or not rest[0]:
        if not is_text_type(element) and not isinstance(element, T.VariantType):
            return _none()
        text = _variant_text if isinstance(element, T.VariantType) else (lambda x: stringify(x, element))
        found = F.transform(items, lambda x, i: F.struct(i.alias("arr_idx"), text(x).alias("v")))
        return F.coalesce(F.filter(found.cast(VALUE), lambda x: x["v"].isNotNull()), _none())
    return F.coalesce(F.flatten(F.transform(items, lambda x, i: _below_or_walk(x, element, rest, i, depth))), _none())


def _below_or_walk(value: Column, kind: T.DataType, rest: tuple[str, ...], arr_idx: Column, depth: int) -> Column:
    return F.coalesce(_walk(value, kind, rest, arr_idx, depth + 1), _none())


def texts_of(key: Key, schema: T.StructType, get_fn: Callable | None = None) -> Column:
    """The texts of a key as ``VALUE``; a missing path or null gives none."""
    getter = key.get_fn or (None if get_fn is None else lambda: get_fn(list(key.path)))
    if getter is not None:
        own = getter()
        array = F.array(own) if not _is_array(own, schema) else own
        alone = not _is_array(own, schema)
        listed = F.transform(array, lambda x, i: F.struct((F.lit(None) if alone else i).cast("int").alias("arr_idx"), x.cast("string").alias("v")))
        return F.coalesce(F.filter(listed.cast(VALUE), lambda x: x["v"].isNotNull()), _none())
    name = key.path[0]
    if name not in schema.names:
        return _none()
    top = F.col("`" + name.replace("`", "``") + "`")
    return F.coalesce(_below(top, schema[name].dataType, key.path[1:], F.lit(None), 1), _none())


def _is_array(column: Column, schema: T.StructType) -> bool:
    from pyspark.sql import SparkSession

    probe = SparkSession.active().createDataFrame([], schema).select(column.alias("x"))
    return isinstance(probe.schema["x"].dataType, T.ArrayType)
