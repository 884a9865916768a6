"""Column functions that normalise ids and times; all stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hex_id(c: Column | str) -> Column:
    """The 32 lower-case hex digits of an id, ignoring case, hyphens, braces and blanks.

    Null, empty and anything that isn't 32 hex digits (such as 'None') give null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.translate(c, " \t\n\r\f\v\u00a0\u200b\ufeff{}-", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def epoch_ms(c: Column | str) -> Column:
    """Epoch milliseconds of a DOUBLE in seconds, milli-, micro- or nanoseconds.

    The unit follows from the magnitude (seconds stay below 1e11 until the year
    5138). Null, NaN, infinite and non-positive times give null.
    """
    c = F.col(c) if isinstance(c, str) else c
    scaled = (
        F.when(c < 1e11, c * 1000.0)
        .when(c < 1e14, c)
        .when(c < 1e17, c / 1e3)
        .otherwise(c / 1e6)
    )
    return F.when((c > 0) & ~F.isnan(c) & (c < 9e18), F.round(scaled).cast("long"))
