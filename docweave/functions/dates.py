"""Dates written as spreadsheet serials, dd/mm/yyyy or ISO text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import text

BR = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:\s.*)?$"
BR_PADDED = r"^\d{2}/\d{2}/\d{4}$"
ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ].*)?$"
SERIAL = r"^\d{5,6}(\.\d+)?$"


def date_style(c: Column | str) -> Column:
    """serial, br, iso, other or empty, from the way a value is written."""
    v = text(c)
    return (
        F.when(v == "", "empty")
        .when(v.rlike(BR), "br")
        .when(v.rlike(ISO), "iso")
        .when(v.rlike(SERIAL) & (v.try_cast("double") > 20000), "serial")
        .otherwise("other")
    )


def parse_date(c: Column | str) -> Column:
    """DATE of a mixed value, null when it is no calendar date. Two-digit years are 20xx."""
    v = text(c)
    year = F.regexp_extract(v, BR, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    br = F.concat_ws(
        "-", year, F.lpad(F.regexp_extract(v, BR, 2), 2, "0"), F.lpad(F.regexp_extract(v, BR, 1), 2, "0")
    )
    padded = F.concat(F.substring(v, 7, 4), F.lit("-"), F.substring(v, 4, 2), F.lit("-"), F.substring(v, 1, 2))
    # the styles of date_style in its order, each pattern tried once, and only where its sign is; most are written in full
    slashed = F.contains(v, F.lit("/"))
    return (
        F.when(slashed & v.rlike(BR_PADDED), padded.try_cast("date")).when(slashed & v.rlike(BR), br.try_cast("date"))
        .when(F.contains(v, F.lit("-")) & v.rlike(ISO), F.substring(v, 1, 10).try_cast("date"))
        .when(v.rlike(SERIAL) & (v.try_cast("double") > 20000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(v.try_cast("double")).cast("int")))
    )


def date_text(c: Column | str) -> Column:
    return F.coalesce(parse_date(c).cast("string"), F.lit(""))


def is_recent(c: Column | str, days: int, now: str) -> Column:
    """True when the date is at most one day ahead of ``now`` and at most ``days`` old."""
    age = F.datediff(F.lit(now).cast("date"), parse_date(c))
    return F.coalesce((age >= -1) & (age <= max(1, days)), F.lit(False))


def day_number(c: Column | str) -> Column:
    """Days since 1970-01-01, 0 when there is no date; orders rows by date."""
    return F.coalesce(F.datediff(parse_date(c), F.lit("1970-01-01").cast("date")), F.lit(0)).cast("bigint")
