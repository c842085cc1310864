"""Text in its normal form, and points in time written in many ways."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space below U+0080.
ASCII_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


@F.pandas_udf(T.StringType())
def _fold_unicode(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).strip().lower())


def normal_form(c: Column) -> Column:
    """NFC, trimmed of all white space, lower case; null for null, empty and blank text.

    ASCII text (as many characters as bytes) stays in the JVM; only the other values, which NFC can
    change, cross to Python in Arrow batches.
    """
    plain = F.length(c) == F.octet_length(c)
    folded = F.when(plain, F.lower(F.btrim(c, F.lit(ASCII_SPACE)))).otherwise(_fold_unicode(F.when(~plain, c)))
    return F.nullif(folded, F.lit(""))


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_RFC = r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\.?,?\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(gmt|utc|z|[+-]\d{2}:?\d{2})?$"
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt\s]\s*(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)\s*([Zz]|(?i:utc|gmt)|[+-]\d{2}(?::?\d{2})?)?)?$"
#: What the engine's own cast reads as it stands, but for a missing zone.
_PLAIN = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:\d\d)?$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})([Zz]|[+-]\d{2}:?\d{2})?$"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once for each row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _moment(date: Column, rest: Column) -> Column:
    """The instant of a date yyyy-[m]m-[d]d and `clock|zone`; a missing clock is midnight, a missing zone UTC."""
    clock = F.replace(F.split_part(rest, F.lit("|"), F.lit(1)), F.lit(","), F.lit("."))
    digits = F.upper(F.replace(F.split_part(rest, F.lit("|"), F.lit(2)), F.lit(":"), F.lit("")))
    zone = F.when(digits.isin("", "Z", "UTC", "GMT"), F.lit("Z")).otherwise(F.concat(F.substring(digits, 1, 3), F.lit(":"), F.when(F.length(digits) > 3, F.substring(digits, 4, 2)).otherwise(F.lit("00"))))
    return F.unix_micros(F.concat(date, F.lit("T"), F.when(clock == "", F.lit("00:00:00")).otherwise(clock), zone).try_cast("timestamp"))


def instant_us(text: Column) -> Column:
    """Microseconds since 1970 UTC of a point in time given as text, or null when the text is none.

    Understood: ISO dates with `-`, `/` or `.`, with or without time, fraction and zone; the compact ISO
    form; RFC 1123 dates; epoch numbers, whose length tells seconds, milli-, micro- or nanoseconds. Text
    without a zone is UTC; a date alone is its midnight. Impossible dates are null.
    """
    def read(t: Column) -> Column:
        # One pass of a pattern gives all its parts, apart by bars; what does not match has no bar.
        iso = _once(F.regexp_replace(t, _ISO, "$1-$2-$3|$4|$5"), lambda c: F.when(c.contains("|"), _moment(F.split_part(c, F.lit("|"), F.lit(1)), F.substring(c, F.instr(c, F.lit("|")) + 1, F.length(c)))))
        compact = _once(F.regexp_replace(t, _COMPACT, "$1-$2-$3|$4:$5:$6|$7"), lambda c: F.when(c.contains("|"), _moment(F.substring(c, 1, 10), F.substring(c, F.lit(12), F.length(c)))))

        def named(c: Column) -> Column:
            month = (F.instr(F.lit(_MONTHS), F.lower(F.split_part(c, F.lit("|"), F.lit(2)))) + 2) / 3
            date = F.concat(F.split_part(c, F.lit("|"), F.lit(3)), F.lit("-"), month.cast("int").cast("string"), F.lit("-"), F.split_part(c, F.lit("|"), F.lit(1)))
            return F.when(c.contains("|") & (month == F.floor(month)), _moment(date, F.concat_ws("|", F.split_part(c, F.lit("|"), F.lit(4)), F.split_part(c, F.lit("|"), F.lit(5)))))

        rfc = _once(F.regexp_replace(t, _RFC, "$1|$2|$3|$4|$5"), named)
        number = t.try_cast("decimal(30,9)")
        scale = F.when(F.abs(number) < 100_000_000_000, F.lit(1_000_000)).when(F.abs(number) < 100_000_000_000_000, F.lit(1_000)).when(F.abs(number) < 100_000_000_000_000_000, F.lit(1))
        epoch = F.when(scale.isNull(), (number / 1000).try_cast("long")).otherwise((number * scale).try_cast("long"))
        return F.when(t.rlike(r"^\d{4}[-/.]"), iso).when(t.rlike(r"^-?\d{9,19}(?:\.\d+)?$"), epoch).when(t.rlike(r"^\d{8}[Tt]"), compact).otherwise(rfc)

    trimmed = F.btrim(text, F.lit(ASCII_SPACE + "\u00a0\u3000"))
    zoned = F.when(F.substring(trimmed, -1, 1) == "Z", trimmed).when(F.substring(trimmed, -6, 1).isin("+", "-"), trimmed).otherwise(F.concat(trimmed, F.lit("Z")))
    return F.when(trimmed.rlike(_PLAIN), F.unix_micros(zoned.try_cast("timestamp"))).otherwise(_once(trimmed, read))
