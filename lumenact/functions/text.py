"""Unicode-aware text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Unicode-aware split() treats as white space.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_space(text: Column) -> Column:
    """Single spaces between words and none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def collect_text(column: Column, dtype: T.DataType) -> Column:
    """All non-empty strings inside a nested value, depth first.

    The schema is walked while the plan is built, so the result is one plain
    expression. Values that are neither text nor containers are left out.
    """
    nothing = F.array().cast("array<string>")
    if isinstance(dtype, T.StringType):
        found = F.filter(F.array(normalize_space(column)), lambda t: t != "")
    elif isinstance(dtype, T.ArrayType):
        found = F.flatten(F.transform(column, lambda x: collect_text(x, dtype.elementType)))
    elif isinstance(dtype, T.MapType):
        found = F.flatten(F.transform(F.map_values(column), lambda x: collect_text(x, dtype.valueType)))
    elif isinstance(dtype, T.StructType):
        parts = [collect_text(column[f.name], f.dataType) for f in dtype.fields]
        found = F.concat(*parts) if parts else nothing
    else:
        found = nothing
    return F.coalesce(found, nothing)
