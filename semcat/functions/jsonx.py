"""First-scalar lookup in the loosely typed JSON of the search API.

Plain values - texts, whole numbers, lists of them, objects of them, lists of such
objects - are looked up in the JVM, as variants.  Only what has another shape (mixed or
deeper lists, fractions, booleans, repeated keys) goes to the Python walk.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semcat.functions.text import normalise_string

# The keys tried inside an object, in this order.
VALUE_KEYS = ("code", "id", "value", "label", "text", "name", "content")


def first_scalar(value) -> str | None:
    """Depth-first first non-blank scalar; objects are searched by VALUE_KEYS."""
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            todo.extend(reversed(item))
        elif isinstance(item, dict):
            todo.extend(item.get(key) for key in reversed(VALUE_KEYS))
        elif item is not None:
            text = str(item).strip()
            if text:
                return text
    return None


def scalar_list(value) -> list[str]:
    """First scalar of every entry, nulls dropped, order and duplicates kept."""
    entries = value if isinstance(value, list) else [value]
    return [s for s in map(first_scalar, entries) if s is not None]


def _parsed(batch: pa.Array) -> Iterator:
    return (None if text is None else json.loads(text) for text in batch.to_pylist())


# Shapes, as schema_of_variant names them, that need no Python.
_ONES = ("STRING", "BIGINT", "VOID")
_OBJECT = rf"OBJECT<(\w+: ({'|'.join(_ONES)})(, )?)*>"
_VALUES = "struct<" + ",".join(f"{key}:string" for key in VALUE_KEYS) + ">"
_ODD, _SCALAR, _LIST, _FIELDS, _ROWS = range(5)


def _kind(value: Column) -> Column:
    """Which plain shape a variant has; none at all counts as a scalar."""
    shape = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | shape.isin(*_ONES), _SCALAR)
        .when(shape.isin(*[f"ARRAY<{one}>" for one in _ONES]), _LIST)
        .when(shape.rlike(f"^{_OBJECT}$"), _FIELDS)
        .when(shape.rlike(f"^ARRAY<{_OBJECT}>$"), _ROWS)
        .otherwise(_ODD)
    )


def _plain_list(value: Column, kind: Column) -> Column:
    """First scalars of the entries of a variant of plain shape; nothing and null are the empty list."""

    def as_type(name: str) -> Column:
        return F.try_variant_get(value, "$", name)

    def of_object(fields: Column) -> Column:
        return F.coalesce(*[normalise_string(fields[key]) for key in VALUE_KEYS])

    found = (
        F.when(kind == _SCALAR, F.array(normalise_string(as_type("string"))))
        .when(kind == _LIST, F.transform(as_type("array<string>"), normalise_string))
        .when(kind == _FIELDS, F.array(of_object(as_type(_VALUES))))
        .when(kind == _ROWS, F.transform(as_type(f"array<{_VALUES}>"), of_object))
    )
    return F.array_compact(F.coalesce(found, F.array().cast("array<string>")))


def _single(c: Column, native: Callable[[Column], Column], walk: Callable, kind: str) -> Column:
    @F.arrow_udf(kind)
    def walked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if v is None else walk(json.loads(v)) for v in batch.to_pylist()], arrow)

    arrow = pa.string() if kind == "string" else pa.list_(pa.string())
    parsed = F.try_parse_json(c)
    kind_of = _kind(parsed)
    # A text that is no variant, broken ones too, is left to the walk; a null argument costs the worker nothing.
    odd = c.isNotNull() & (parsed.isNull() | (kind_of == _ODD))
    return F.when(odd, walked.asNondeterministic()(F.when(odd, c))).otherwise(native(_plain_list(parsed, kind_of)))


def json_first(c: Column) -> Column:
    """First scalar of a JSON text."""
    return _single(c, lambda found: F.get(found, F.lit(0)), first_scalar, "string")


def json_scalars(c: Column) -> Column:
    """List form of :func:`json_first`; null gives the empty list."""
    return _single(c, lambda found: found, scalar_list, "array<string>")


def json_fields(c: Column, scalars: dict[str, str], lists: dict[str, str]) -> Column:
    """Several lookups into one JSON object by the Python walk, as a struct.

    ``scalars`` and ``lists`` map an output field to a dotted path.
    """
    arrow = pa.struct(
        [(name, pa.string()) for name in scalars]
        + [(name, pa.list_(pa.string())) for name in lists]
    )
    spark = ", ".join(
        [f"{name}: string" for name in scalars] + [f"{name}: array<string>" for name in lists]
    )

    def at(value, path: str):
        for key in path.split("."):
            value = value.get(key) if isinstance(value, dict) else None
        return value

    @F.arrow_udf(f"struct<{spark}>")
    def fields(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [
                None
                if value is None
                else {n: first_scalar(at(value, p)) for n, p in scalars.items()}
                | {n: scalar_list(at(value, p)) for n, p in lists.items()}
                for value in _parsed(batch)
            ]
            yield pa.array(rows, arrow)

    # Else a filter on a field would be pushed below the lookup, which then runs twice.
    return fields.asNondeterministic()(c)


def with_json_fields(df: DataFrame, column: str, scalars: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """``df`` with a column per lookup into the JSON object of ``column``, read once.

    Equal to :func:`json_fields`, whose walk sees only the objects that hold a value of
    another than plain shape in one of the paths.  Null objects give nulls.
    """
    parsed, walked, c = "json__parsed", "json__walked", F.col
    paths = sorted({*scalars.values(), *lists.values()})
    at = {path: f"json__{i}" for i, path in enumerate(paths)}
    steps = df.select("*", F.try_parse_json(column).alias(parsed))
    # Separate steps keep each from being computed once per reference.
    values = [F.try_variant_get(parsed, f"$.{path}", "variant").alias(name) for path, name in at.items()]
    steps = steps.select("*", *values)
    steps = steps.select("*", *[_kind(c(name)).alias(f"{name}k") for name in at.values()])
    odd = c(column).isNotNull() & (c(parsed).isNull() | (F.least(*[c(f"{name}k") for name in at.values()], F.lit(_ROWS)) == _ODD))
    steps = steps.select(
        "*",
        *[_plain_list(c(name), c(f"{name}k")).alias(f"{name}l") for name in at.values()],
        json_fields(F.when(odd, c(column)), scalars, lists).alias(walked),
    )

    given = c(column).isNotNull() & ~F.is_variant_null(c(parsed))

    def field(name: str, native: Column) -> Column:
        return F.when(c(walked).isNotNull(), c(walked)[name]).when(given, native).alias(name)

    found = [field(n, F.get(c(f"{at[p]}l"), F.lit(0))) for n, p in scalars.items()]
    found += [field(n, c(f"{at[p]}l")) for n, p in lists.items()]
    return steps.select(*df.columns, *found)
