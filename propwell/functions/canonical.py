"""Canonical names, canonical JSON text and content hashes, as column expressions.

Canonical JSON: keys sorted, ``", "`` and ``": "`` as separators, nulls written, absent
keys left out, text outside ASCII kept. Values nested inside a VARIANT are written
compactly, in Spark's own VARIANT form; numbers there are normalised (``1.0`` -> ``1``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propwell.fixed import FIELD_ALIASES

_TEXT_FORM = (T.DateType, T.TimestampType, T.TimestampNTZType)
_BARE_FORM = (T.NumericType, T.BooleanType)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once per row, also where `body` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_string(value: Column) -> Column:
    """A string column as a JSON literal; NULL becomes ``null``."""
    # the literal ends in a quote, so only the brackets of the array around it are cut
    return F.btrim(F.to_json(F.array(value)), F.lit("[]"))


def _object(parts: Iterable[tuple[str, Column]]) -> Column:
    pieces, lead = [], "{"
    for key, text in sorted(parts, key=lambda part: part[0]):
        pieces += [F.lit(f'{lead}"{key}": '), text]
        lead = ", "
    return F.concat(*pieces, F.lit("}")) if pieces else F.lit("{}")


def json_value(value: Column, dtype: T.DataType) -> Column:
    """The canonical JSON text of a column of the given type."""
    null = F.lit("null")
    if isinstance(dtype, T.StringType):
        return json_string(value)
    if isinstance(dtype, _TEXT_FORM):
        return json_string(value.cast("string"))
    if isinstance(dtype, _BARE_FORM):
        return F.coalesce(value.cast("string"), null)
    if isinstance(dtype, T.VariantType):
        return F.coalesce(F.to_json(value), null)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: json_value(item, dtype.elementType))
        return F.coalesce(F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")), null)
    if isinstance(dtype, T.StructType):
        fields = [(f.name, json_value(value.getField(f.name), f.dataType)) for f in dtype.fields]
        return F.when(value.isNull(), null).otherwise(_object(fields))
    if isinstance(dtype, T.MapType):
        return json_map(value, dtype.valueType)
    return json_string(value.cast("string"))


def json_map(value: Column, value_type: T.DataType) -> Column:
    """The canonical JSON text of an open payload held as a map."""

    def member(entry: Column) -> Column:
        text = F.concat(json_string(entry.key), F.lit(": "), json_value(entry.value, value_type))
        return F.struct(entry.key.alias("key"), text.alias("text"))

    members = F.array_sort(F.transform(F.map_entries(value), member))
    texts = F.transform(members, lambda one: one.text)
    return F.coalesce(F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}")), F.lit("null"))


def canonical_json(df: DataFrame, fields: Iterable[str] | Mapping[str, str] | None = None) -> Column:
    """Canonical JSON of the given columns of `df` (all of them by default).

    `fields` may map JSON key -> column name.
    """
    if fields is None:
        fields = df.columns
    pairs = fields.items() if isinstance(fields, Mapping) else [(name, name) for name in fields]
    return _object((key, json_value(F.col(name), df.schema[name].dataType)) for key, name in pairs)


def content_hash(json_text: Column) -> Column:
    """SHA-256 hex of canonical JSON text."""
    return F.sha2(json_text, 256)


def listing_key_hash(df: DataFrame) -> Column:
    """Identity of a listing version: id, price and address only.

    A new price is a new version; new pictures are not.
    """
    return content_hash(canonical_json(df, ["listing_id", "price", "address"]))


def canonical_name(name: Column) -> Column:
    """Alias -> canonical column name; unknown names pass through."""
    aliases = F.create_map(*[F.lit(part) for pair in FIELD_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(aliases, name), name)


def canonical_rename(payload: Column) -> Column:
    """Rename the keys of an open payload (a map in landed order).

    When several keys get the same name the last one wins, also with a null value.
    """

    def latest_first(members: Column) -> Column:
        names = F.transform(F.map_keys(members), canonical_name)
        return F.struct(
            F.reverse(names).alias("names"), F.reverse(F.map_values(members)).alias("values")
        )

    def of(pairs: Column) -> Column:
        def value(name: Column) -> Column:
            return F.get(pairs.values, F.array_position(pairs.names, name) - 1)

        return let(
            F.array_distinct(pairs.names),
            lambda kept: F.map_from_arrays(kept, F.transform(kept, value)),
        )

    return let(let(payload, latest_first), of)


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename the columns of a typed scan by the same rule, without touching the rows."""
    last = {}
    for place, name in enumerate(df.columns):
        last[FIELD_ALIASES.get(name, name)] = f"_{place}"
    # by place: landed names may differ in case only
    placed = df.toDF(*[f"_{place}" for place in range(len(df.columns))])
    return placed.select(*[F.col(source).alias(target) for target, source in last.items()])


def open_payload(json_text: Column) -> Column:
    """JSON object text -> map in landed key order, values kept as VARIANT."""
    return F.from_json(json_text, "map<string,variant>")


def with_entries(payload: Column, entries: Mapping[str, Column]) -> Column:
    """`payload` with entries set."""
    others = F.map_filter(payload, lambda name, _: ~name.isin(*entries))
    pairs = [part for name, value in entries.items() for part in (F.lit(name), value)]
    return F.map_concat(others, F.create_map(*pairs))
