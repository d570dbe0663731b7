"""Scalar conformance: codes, numbers, names, rounding, flags. Built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FROM = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
_TO = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code(c: Column | str, width: int = 5) -> Column:
    """Trimmed, zero-padded code; a longer one stays whole (lpad alone would cut it)."""
    t = F.trim(_col(c).cast("string"))
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def whole_code(c: Column | str, width: int = 5) -> Column:
    """Code of a number that lost its zeros or gained decimals: ``5001.0`` -> ``05001``."""
    t = F.regexp_replace(F.trim(_col(c).cast("string")), r"\.0*$", "")
    return code(t.try_cast("bigint").cast("string"), width)


def number(c: Column | str, default: float | None = None) -> Column:
    """Number with a decimal comma or point; null, text and NaN give the default."""
    v = F.replace(F.trim(_col(c).cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    v = F.when(~F.isnan(v), v)
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def name_key(c: Column | str) -> Column:
    """Name without accents, upper case, single spaces."""
    plain = F.translate(_col(c), _FROM, _TO)
    plain = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.upper(plain), r"\s+", " "))


def present(*cols: Column | str) -> Column:
    """Coordinates that count: not null, not NaN and not zero."""
    out = F.lit(True)
    for c in map(_col, cols):
        out = out & c.isNotNull() & ~F.isnan(c) & (c != 0)
    return out


def half_up(c: Column | str, digits: int) -> Column:
    """Rounding that every engine repeats: floor(x * 10**d + 0.5) / 10**d."""
    k = float(10**digits)
    return F.floor(_col(c) * k + 0.5) / k


def clamp(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def flag(condition: Column) -> Column:
    """1 if the condition holds, else 0; unknown counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def decimal_sum(c: Column | str) -> Column:
    """Sum that does not depend on the order of the rows."""
    return F.sum(_col(c).cast("decimal(18,4)")).cast("double")


def label_of(ordinal: Column | str, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), _col(ordinal).cast("int") + 1)


def ordinal_of(label: Column | str, names: tuple[str, ...]) -> Column:
    """Place of a label in the list, from 0; null for an unknown one."""
    at = F.array_position(F.array(*map(F.lit, names)), _col(label))
    return F.when(at > 0, (at - 1).cast("int"))


def argmax(values: Column | str) -> Column:
    """Place of the largest element, from 0; the first of equal ones."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def dominant(cols: tuple[str, ...]) -> Column:
    """Name of the largest of several columns; of equal ones the first listed."""
    top = F.greatest(*cols)
    out = F.lit(None).cast("string")
    for c in reversed(cols):
        out = F.when(F.col(c) == top, F.lit(c)).otherwise(out)
    return out


def missing_columns(df, expected) -> list[str]:
    """Expected columns that a table lacks, in their order."""
    have = set(df.columns)
    return [c for c in expected if c not in have]
