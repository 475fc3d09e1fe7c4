"""Fields of drifting JSON records, read through VARIANT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import lenient_double


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a computed column is pushed below its projection by writing the
    expression out again; with parsed JSON that means parsing every line many times.
    A one-element explode stops that.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    kept = [c for c in df.columns if c not in columns]
    return df.select("*", made).select(*kept, *[F.col(f"__once.{n}").alias(n) for n in columns])


def json_path(dotted: str) -> str:
    """``a[].b`` (first element) to ``$.a[0].b``."""
    return "$." + dotted.replace("[]", "[0]")


def field(variant: str | Column, dotted: str, kind: str = "string") -> Column:
    """One field by dotted path; null when absent, null or of another type."""
    return F.try_variant_get(_col(variant), json_path(dotted), kind)


def first_field(variant: str | Column, candidates: Sequence[str], kind: str = "string") -> Column:
    """First non-null field among candidate paths."""
    return F.coalesce(*[field(variant, c, kind) for c in candidates])


def lowered_fields(variant: str | Column) -> Column:
    """The members of an object as entries with lower-case keys, in their order."""
    members = F.map_entries(F.try_variant_get(_col(variant), "$", "map<string,variant>"))
    return F.transform(members, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))


def any_case(lowered: Column, candidates: Sequence[str], kind: str = "string") -> Column:
    """First non-null member among the candidate names, whatever their spelling."""

    def one(name: str) -> Column:
        hits = F.filter(lowered, lambda e: (e["key"] == name.lower()) & ~F.coalesce(F.is_variant_null(e["value"]), F.lit(True)))
        return F.try_variant_get(F.element_at(F.when(F.size(hits) > 0, hits), -1)["value"], "$", kind)

    return F.coalesce(*[one(n) for n in candidates])


def is_array(variant: str | Column) -> Column:
    return F.schema_of_variant(_col(variant)).startswith("ARRAY")


def is_object(variant: str | Column) -> Column:
    return F.schema_of_variant(_col(variant)).startswith("OBJECT")


def elements(variant: str | Column) -> Column:
    """A JSON array as an array of variants (null when it is not an array)."""
    return F.try_variant_get(_col(variant), "$", "array<variant>")


def elements_or_self(variant: str | Column) -> Column:
    v = _col(variant)
    return F.coalesce(elements(v), F.array(v))


def first_array(variant: str | Column, candidates: Sequence[str]) -> Column:
    return F.coalesce(*[field(variant, c, "array<variant>") for c in candidates])


def text_array(value: str | Column) -> Column:
    """JSON array text (or nothing) to an array of strings; empty when it cannot be read."""
    parsed = F.try_variant_get(F.try_parse_json(_col(value)), "$", "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def price_levels(
    levels: str | Column,
    *,
    price: Sequence[str] = ("price", "p"),
    size: Sequence[str] = ("size", "quantity", "q"),
    first: int | None = None,
) -> Column:
    """Levels given as objects or ``[price, size]`` pairs to ARRAY<STRUCT<price, size>>."""
    raw = _col(levels)
    source = F.slice(raw, 1, first) if first else raw

    def one(x: Column) -> Column:
        px = F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in price], F.try_variant_get(x, "$[0]", "string"))
        sz = F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in size], F.try_variant_get(x, "$[1]", "string"))
        return F.struct(lenient_double(px).alias("price"), lenient_double(sz).alias("size"))

    return F.transform(source, one)
