"""Row predicates (F1-F3, F7, F8, F10, F11, X5, X12, X13) as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrun.functions.time import _c, ts_lit
from millrun.sources import registry as R


def good_status(bad: Sequence[str] = ("E",), status="Status") -> Column:
    """keep readings whose status is not bad. NULL status is dropped, as
    ``Status <> 'E'`` drops it under three-valued logic."""
    s = _c(status)
    return s.isNotNull() & ~s.isin(list(bad))


def good_status_by_config(bad_array="bad_status", status="Status") -> Column:
    """F1 when the bad codes come per row from a joined plant configuration."""
    s = _c(status)
    return s.isNotNull() & ~F.array_contains(_c(bad_array), s)


def in_window(tbf, taf, ts="DateAndTime") -> Column:
    """``ts BETWEEN tbf AND taf``, both ends inclusive, plant-local."""
    return _c(ts).between(ts_lit(tbf), ts_lit(taf))


def not_fault_noise(message="Message") -> Column:
    """drop 'Alarm fault...' rows; NULL messages are kept."""
    m = _c(message)
    return m.isNull() | ~m.startswith(R.FAULT_PREFIX)


def is_fault_prefix(message="Message") -> Column:
    """X12 prefix test. NULL message -> NULL (counts as 'real' in A9)."""
    return _c(message).startswith(R.FAULT_PREFIX)


def is_quality_fault(message="Message") -> Column:
    """F8: ``Message LIKE '%quality is bad%'`` -- contains, not prefix."""
    return _c(message).contains(R.FAULT_CONTAINS)


def condition_family(name: str, condition="ConditionName") -> Column:
    """the name itself or any ``name_...`` variant; no wildcards exist, so
    ``%`` or ``[`` in the name match literally."""
    c = _c(condition)
    return (c == F.lit(name)) | c.startswith(name + "_")


# the comparison operators of the threshold counters. '===' and '!==' are
# the same as '==' and '!=' on typed columns.
_OPS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "===": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "!==": lambda a, b: a != b,
}
OPERATORS = tuple(_OPS)


def compare(value, op: str, threshold) -> Column:
    """``value <op> threshold``; an unknown operator raises. A NULL value
    never satisfies the predicate (documented deviation Q9)."""
    try:
        fn = _OPS[op]
    except KeyError:
        raise ValueError(f"Unknown operator: {op}") from None
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(fn(_c(value), t), F.lit(False))


def values_agree(a, b, tolerance) -> Column:
    """``|a-b| / max(|a|, |b|, 1e-6) <= tolerance``."""
    a, b = _c(a), _c(b)
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(R.GAP_SCALE_FLOOR))
    return F.abs(a - b) / scale <= tol
