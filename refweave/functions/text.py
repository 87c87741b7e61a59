"""Column expressions shared by the operators; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode code points with the White_Space property, and the four information separators.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(col: Column | str) -> Column:
    """Without surrounding white space of any kind (Spark's plain trim knows only the blank)."""
    return F.trim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE_SPACE))


def clean_sha(col: Column | str) -> Column:
    """A sha as it is compared: stripped, lower case; blank becomes null."""
    out = F.lower(strip(col))
    return F.when(out != "", out)


def micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without a zone, read as UTC whatever the session's zone is."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone()))


def filled(col: Column | str) -> Column:
    """Whether a field says something: not null, not blank, not ``unknown``."""
    out = strip((F.col(col) if isinstance(col, str) else col).cast("string"))
    return F.coalesce((out != "") & (F.lower(out) != "unknown"), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """SHA-1 of the parts joined by ``::``; a missing part counts as empty."""
    return F.sha1(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
