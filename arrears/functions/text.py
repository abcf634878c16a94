"""String helpers built from Spark's native functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(c: Column | str) -> Column:
    """Login / name normalisation: trim, then lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))


def contains_ci(c: Column | str, word: str) -> Column:
    """Case-insensitive ``LIKE '%word%'`` (null input -> null)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.ilike(f"%{word}%")


def concat_text(prefix: str, c: Column) -> Column:
    """``CONCAT(text, value)`` where a null value reads as the empty string."""
    return F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("")))


def try_number(c: Column | str) -> Column:
    """Guarded text -> number of any form ('199.5', '2e2'); unparsable becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string")).try_cast("double")


def try_int(c: Column | str) -> Column:
    """Guarded text -> whole number (the sip join key): anything else becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c.cast("string")).try_cast("int")


def money_sum(c: Column | str) -> Column:
    """Exact money total: amounts are DECIMAL(19,4) (money semantics), so the
    sum does not depend on row order; reported as double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(19,4)")).cast("double")
