"""When two values count as equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(c: Column) -> Column:
    """The JSON object or array in a canonical form (keys in order, no blanks); null for other texts."""
    inner = F.trim(c, F.lit(" \t\r\n"))
    shaped = (inner.startswith("{") & inner.endswith("}")) | (inner.startswith("[") & inner.endswith("]"))
    return F.when(shaped, F.to_json(F.try_parse_json(inner)))


def equivalent(a: Column, b: Column, is_text: bool) -> Column:
    """a and b are equal or both null or, as texts, hold equal JSON objects or arrays."""
    same = a.eqNullSafe(b)
    if not is_text:
        return same
    return F.when(same, F.lit(True)).otherwise(F.coalesce(canonical_json(a) == canonical_json(b), F.lit(False)))


def key_text(columns: list[str]) -> Column:
    """The key as text: of one column its value, of several their values in parentheses."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.concat(F.lit("("), F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns)), F.lit(")"))
