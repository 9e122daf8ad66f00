"""Column types by their SQL names, and value rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted type names and what they are stored as.
TYPE_NAMES = {
    "int": "bigint", "integer": "bigint", "bigint": "bigint", "smallint": "bigint", "serial": "bigint", "bigserial": "bigint",
    "text": "string", "varchar": "string", "char": "string", "character": "string", "name": "string", "timestamp": "string", "date": "string", "time": "string",
    "double": "double", "float": "double", "real": "double", "numeric": "double", "decimal": "double",
    "bool": "boolean", "boolean": "boolean", "json": "string", "jsonb": "string",
}


def spark_type(name: str) -> str:
    """The Spark type of a declared type; a length such as VARCHAR(32) is ignored."""
    base = name.strip().lower().split("(")[0].split()[0]
    if base not in TYPE_NAMES:
        raise ValueError(f"unknown type: {name}")
    return TYPE_NAMES[base]


def total(c: Column) -> Column:
    """SUM as a double, whatever the argument; null for no rows."""
    return F.sum(c.cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """Double division; null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ascending(name: str | Column) -> Column:
    """Ascending, nulls last."""
    return (F.col(name) if isinstance(name, str) else name).asc_nulls_last()


def descending(name: str | Column) -> Column:
    """Descending, nulls first."""
    return (F.col(name) if isinstance(name, str) else name).desc_nulls_first()


def date_number(c: Column) -> Column:
    """A date as the integer yyyymmdd."""
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)
