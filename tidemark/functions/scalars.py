"""Scalar expressions: null-safe arithmetic, dates, codes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sdiv(a: Column, b: Column) -> Column:
    """a / b, null where b is null or zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, by Dekker's product and Knuth's sum; the plain sum where these overflow."""
    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    lost = al * bl - (((p - ah * bh) - al * bh) - ah * bl)
    s = p + c
    t = s - p
    out = s + (((p - (s - t)) + (c - t)) + lost)
    return F.when(F.isnan(out), s).otherwise(out)


def parsed_date(text: Column) -> Column:
    """A date from compact or ISO text; null where neither fits."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(text, "yyyy-MM-dd"))


def percent_change(now: Column, before: Column) -> Column:
    return sdiv((now - before) * 100, F.abs(before))


def limit_status(close: Column, up: Column, down: Column, tolerance: float = 0.005) -> Column:
    """-1 at or below the lower limit, 1 at or above the upper one, else 0; null if any input is. The lower test wins."""
    known = close.isNotNull() & up.isNotNull() & down.isNotNull()
    return F.when(known, F.when(close <= down + tolerance, -1).when(close >= up - tolerance, 1).otherwise(0))


def element_max(a: Column, b: Column) -> Column:
    """The larger of two values, null if either is (greatest() alone skips nulls)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def element_min(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def quarter_end(date: Column) -> Column:
    return F.last_day(F.add_months(F.date_trunc("quarter", date), 2)).cast("date")


def previous_quarter_end(date: Column) -> Column:
    """The quarter end before a quarter end; null for any other date."""
    return F.when(date == quarter_end(date), F.date_sub(F.date_trunc("quarter", date), 1).cast("date"))


def same_quarter_last_year(date: Column) -> Column:
    return F.when(date == quarter_end(date), F.last_day(F.add_months(date, -12)))


def round_half_up(x: Column, places: int = 2) -> Column:
    """Decimal rounding, halves away from zero, as ticks are rounded."""
    return F.round(x.cast("decimal(18,6)"), places).cast("double")


def organisation_id(name: Column) -> Column:
    """An organisation's name folded for matching: trimmed, one kind of blank, lower case, one legal suffix cut."""
    folded = F.lower(F.trim(F.regexp_replace(name, r"[\s　]+", " ")))
    return F.regexp_replace(folded, r",? (co\.?,? ltd\.?|ltd\.?|inc\.?|plc|llc|ag|gmbh)$", "")


def analyst_id(organisation: Column, authors: Column) -> Column:
    """Organisation and its authors in one order, however they were listed."""
    tokens = F.array_sort(F.filter(F.transform(F.split(authors, r"[,;/]"), lambda t: F.trim(t)), lambda t: t != ""))
    return F.concat_ws("|", organisation_id(organisation), F.array_join(tokens, ","))
