"""Dates as the catalog's pages write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from showloom.functions.text import let

#: Month names of four letters or less, with one misspelling that pages have.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "mat": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12}
#: Infobox keys that may hold the first year, in order.
YEAR_KEYS = ["original_release", "first_aired", "released", "broadcast", "air_date", "release_date"]


def month_number(name: Column) -> Column:
    # As it is mostly written, and only else in lower case, which costs more than the rest of a date.
    table = F.create_map(*[F.lit(x) for m, n in MONTHS.items() for x in (m, n, m.capitalize(), n)])
    return F.coalesce(F.element_at(table, name), F.element_at(table, F.lower(name)))


def full_year(digits: Column) -> Column:
    year = digits.try_cast("int")
    return F.when(year < 30, year + 2000).when(year < 100, year + 1900).otherwise(year)


#: How pages write a date, from its start: day, month and year; month and year; year. One text fits one at most.
DATE = r"(?s)^(?:(\d{1,2})\s+([A-Za-z]{3,4})\s+(\d{2,4})|([A-Za-z]{3,4})\s+(\d{2,4})|(\d{4})).*"


def date_to_iso(c: Column) -> Column:
    """"d Mon yy[yy]", else "Mon yy[yy]" (day 01), else "yyyy" (01-01), at the text's start; days aren't validated.

    The pattern is tried once: its groups are put into one text between marks, and a text that it doesn't fit has none.
    """
    mark = "\x01"
    text = F.trim(F.translate(c, f"{mark}?_", "\x02"))

    def written(p: Column) -> Column:
        day, month, year, alone = [F.get(p, F.lit(i)) for i in range(4)]
        two = lambda x: F.lpad(x, 2, "0")
        dated = F.concat(F.lpad(full_year(year).cast("string"), 4, "0"), F.lit("-"), two(month_number(month).cast("string")), F.lit("-"), F.when(day == "", "01").otherwise(two(day)))
        return F.when(F.size(p) == 4, F.when(alone != "", F.concat(alone, F.lit("-01-01"))).otherwise(dated))

    return let(F.split(F.regexp_replace(text, DATE, mark.join(["$1", "$2$4", "$3$5", "$6"])), mark), written)


def year_of_iso(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def start_year(info: Column) -> Column:
    """The first year from 1900 to 2099 in an infobox map's year keys, in their order."""
    found = [F.nullif(F.regexp_extract(F.element_at(info, F.lit(k)), r"\b((?:19|20)\d{2})\b", 1), F.lit("")) for k in YEAR_KEYS]
    return F.coalesce(*found).try_cast("int")
