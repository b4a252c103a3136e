"""Dates as people write them. A column's day/month order is voted on first; parsing then follows it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}"
SLASHED = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})\s*$"
#: Slashed dates whose first number, whose second number is over 12; and those of a day and a month, in either order. As patterns
#: alone, which tell most cells at their first characters and extract nothing.
_MONTH, _DAY, _REST = "(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])", r"[/.-](\d{4}|\d{2})\s*$"
DAY_FIRST = r"^\s*(1[3-9]|[2-9]\d)[/.-]\d{1,2}" + _REST
MONTH_FIRST = r"^\s*\d{1,2}[/.-](1[3-9]|[2-9]\d)" + _REST
DAY_AND_MONTH = rf"^\s*({_MONTH}[/.-]{_DAY}|{_DAY}[/.-]{_MONTH}){_REST}"
#: Formats with named months or the year first; commas are taken out before.
NAMED = ("d-MMM-yyyy", "d MMM yyyy", "MMM d yyyy", "d MMMM yyyy", "MMMM d yyyy", "d-MMM-yy", "yyyy/M/d")
_LOOKS = r"(?i)^\s*(\d{1,2}[ -][a-z]{3,9}[ -](\d{4}|\d{2})|[a-z]{3,9} \d{1,2} \d{4}|\d{4}/\d{1,2}/\d{1,2})\s*$"


def order_votes(c: Column) -> dict[str, Column]:
    """Aggregates from which ``voted_order`` tells a column's order."""
    return {
        "filled": F.count(c),
        "iso": F.count_if(c.rlike(ISO)),
        "slashed": F.count_if(c.rlike(SLASHED)),
        "day_first": F.count_if(c.rlike(DAY_FIRST)),
        "month_first": F.count_if(c.rlike(MONTH_FIRST)),
    }


def voted_order(votes: dict[str, int]) -> str | None:
    """``iso``, ``dmy``, ``mdy``, or None: slashed dates without evidence."""
    if votes["filled"] and votes["iso"] > 0.5 * votes["filled"]:
        return "iso"
    if votes["day_first"] or votes["month_first"]:
        return "dmy" if votes["day_first"] >= votes["month_first"] else "mdy"
    return None


def named_date(t: Column) -> Column:
    """A date of text with a named month or the year first."""
    return F.when(t.rlike(_LOOKS), F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(t), F.lit(f)) for f in NAMED]), "yyyy-MM-dd"))


def looks_dated(c: Column) -> Column:
    """True for text that some reading makes a date."""
    t = F.translate(c, ",", "")
    return F.coalesce(c.rlike(ISO) | c.rlike(DAY_AND_MONTH) | named_date(t).isNotNull(), F.lit(False))


def parsed_date(c: Column, order: str | None = None) -> Column:
    """An ISO date string, NULL if the text is no date. Times of day go. Without an order, slashed dates are month first."""
    t = F.trim(F.translate(c, ",", ""))
    a, b, y = (F.regexp_extract(t, SLASHED, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    day, month = (a, b) if order == "dmy" else (b, a)
    slashed = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    valid = lambda s: F.date_format(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
    return F.when(t.rlike(ISO), valid(F.substring(t, 1, 10))).when(t.rlike(SLASHED), valid(slashed)).otherwise(named_date(t))
