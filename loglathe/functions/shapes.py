"""Shapes of JSON values: what a VARIANT breaks of one, as a single expression.

A shape takes a VARIANT column and the name of the place, and gives the name of
the first thing that is wrong there, or null.  Shapes are put together from
types, bounds, lists, maps and records; nothing is parsed or looked up twice and
no Python runs on rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Shape = Callable[[Column, str], Column]

#: Fixed value: the largest whole number that a double tells from its neighbours.
LARGEST = (1 << 53) - 1
DIGEST = "^[a-f0-9]{64}$"


def field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use).getItem(0)


def kind(value: Column) -> Column:
    """STRING, BIGINT, DOUBLE or another scalar, a decimal with its digits, or the shape of what is nested; null for what is missing."""
    return F.schema_of_variant(value)


def _string(value: Column) -> Column:
    return bound(value, lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _number(value: Column) -> Column:
    return bound(value, lambda x: F.when(bound(kind(x), lambda k: k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL")), F.try_variant_get(x, "$", "double")))


def _members(value: Column) -> Column:
    """A record's fields, null for what is no record."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _unless(fits: Column, at: str) -> Column:
    return F.when(~F.coalesce(fits, F.lit(False)), F.lit(at))


def keys(value: Column) -> Column:
    return F.map_keys(_members(value))


def text(pattern: str | None = None, least: int = 1, most: int | None = None) -> Shape:
    def fits(own: Column) -> Column:
        fits = F.length(own) >= least
        fits = fits & own.rlike(pattern) if pattern else fits
        return fits & (F.length(own) <= most) if most is not None else fits

    return lambda value, at: bound(_string(value), lambda own: _unless(fits(own), at))


def whole(least: int = 0, most: int = LARGEST) -> Shape:
    return lambda value, at: bound(_number(value), lambda own: _unless((own == F.floor(own)) & own.between(least, most), at))


def one_of(*values: str | int) -> Shape:
    read = _string if isinstance(values[0], str) else _number
    return lambda value, at: _unless(read(value).isin(*values), at)


def nothing(value: Column, at: str) -> Column:
    """A JSON null."""
    return _unless(F.is_variant_null(value), at)


def either(*shapes: Shape) -> Shape:
    """One of the shapes at least fits."""

    def check(value: Column, at: str) -> Column:
        def wrong(x: Column) -> Column:
            out = F.lit(True)
            for shape in shapes:
                out = out & shape(x, at).isNotNull()
            return F.when(out, F.lit(at))

        return bound(value, wrong)

    return check


def items(shape: Shape, most: int, least: int = 0, unique: Callable[[Column], Column] | None = None) -> Shape:
    """A list of so many values, each of the shape, with different ``unique`` values."""

    def check(value: Column, at: str) -> Column:
        def wrong(own: Column) -> Column:
            fits = own.isNotNull() & F.size(own).between(least, most) & ~F.exists(own, lambda x: shape(x, at).isNotNull())
            if unique:
                fits = fits & (F.size(F.array_distinct(F.transform(own, unique))) == F.size(own))
            return _unless(fits, at)

        return bound(F.try_variant_get(value, "$", "array<variant>"), wrong)

    return check


def entries(shape: Shape, most: int) -> Shape:
    """A record of any names that are not empty, so many at most, each value of the shape."""

    def check(value: Column, at: str) -> Column:
        def wrong(own: Column) -> Column:
            broken = F.exists(F.map_values(own), lambda x: shape(x, at).isNotNull()) | F.exists(F.map_keys(own), lambda k: k == "")
            return _unless(own.isNotNull() & (F.size(own) <= most) & ~broken, at)

        return bound(_members(value), wrong)

    return check


def record(required: dict[str, Shape], optional: dict[str, Shape] | None = None, exact: bool = True) -> Shape:
    """A record with exactly these fields, or with others as well; the first wrong field names the breach.

    ``at`` names a breach of the keys; fields are named after themselves.
    """
    optional = optional or {}

    def check(value: Column, at: str) -> Column:
        def wrong(own: Column) -> Column:
            names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
            fits = own.isNotNull() & (F.size(F.array_except(names(required), F.map_keys(own))) == 0)
            if exact:
                fits = fits & (F.size(F.array_except(F.map_keys(own), names([*required, *optional]))) == 0)
            found = [_unless(fits, at)]
            found += [shape(F.try_element_at(own, F.lit(name)), name) for name, shape in required.items()]
            found += [F.when(F.map_contains_key(own, name), shape(F.try_element_at(own, F.lit(name)), name)) for name, shape in optional.items()]
            return F.coalesce(*found)

        return bound(_members(value), wrong)

    return check


def has(value: Column, *names: str) -> Column:
    """Whether a record has any of the fields."""
    return F.coalesce(F.arrays_overlap(keys(value), F.array(*map(F.lit, names))), F.lit(False))
