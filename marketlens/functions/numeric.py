"""Numeric helpers shared by every report.

Two roundings, both half away from zero and returned as DOUBLE:

* ``qround(num, den, k)`` — exact: ``num / den`` where both are exact sums or
  counts (integers or DECIMAL).  The quotient is never formed in floating
  point; the rounded value is an integer floor division of scaled integers,
  so a true tie (9888426.09 / 6 = 1648071.015) rounds up in every engine.
* ``rnd(x, k)`` — for values that are already floating point: goes through
  ``DECIMAL(38,6)`` so that a double whose decimal form ends in 5 rounds the
  same way in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(x) -> Column:
    return _c(x).cast("double")


def rnd(x, places: int) -> Column:
    """Half-up rounding to ``places`` decimals, as DOUBLE."""
    return F.round(_c(x).cast("decimal(38,6)"), places).cast("double")


def qround(num, den, places: int, mult: int = 1, num_scale: int = 0, den_scale: int = 0) -> Column:
    """Exact half-up rounding of ``num * mult / den`` to ``places`` decimals.

    ``num`` / ``den`` are integers or DECIMALs with at most ``num_scale`` /
    ``den_scale`` decimals; NULL when ``den`` is 0 / NULL or ``num`` is NULL.
    """
    ni = (_c(num) * F.lit(10 ** num_scale)).cast("decimal(38,0)")
    di = (_c(den) * F.lit(10 ** den_scale)).cast("decimal(38,0)")
    a = F.abs(ni) * F.lit(mult * 10 ** (places + den_scale))
    d = di * F.lit(10 ** num_scale)
    q = F.call_function("div", (F.lit(2) * a + d).cast("decimal(38,0)"), (F.lit(2) * d).cast("decimal(38,0)"))
    return F.when(d != 0, F.signum(ni) * q / F.lit(10 ** places)).cast("double")


def decq(num, den, precision: int, scale: int, **kw) -> Column:
    """``qround`` stored as DECIMAL(precision, scale)."""
    return qround(num, den, scale, **kw).cast(f"decimal({precision},{scale})")


def fdiv(num, den) -> Column:
    """Float division; NULL when the denominator is 0 or NULL (``NULLIF``)."""
    return F.try_divide(as_double(num), as_double(den))


def ratio(num, den, scale: float = 1.0) -> Column:
    """``num / den * scale`` in double precision, NULL-safe."""
    r = fdiv(num, den)
    return r if scale == 1.0 else r * F.lit(float(scale))


def dec(x, precision: int, scale: int) -> Column:
    """Store ``x`` as DECIMAL(precision, scale), rounding half-up (mart write casts)."""
    return F.round(_c(x).cast("decimal(38,6)"), scale).cast(f"decimal({precision},{scale})")


def decimals_to_double(df):
    """Cast every DECIMAL column to DOUBLE (report boundary: one numeric type)."""
    from pyspark.sql.types import DecimalType
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])
