"""Column expressions for names, ids and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def capitalize(s: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def normalize_id(s: Column) -> Column:
    """First run of letters and first run of digits as a number; unchanged without digits."""
    digits = F.regexp_extract(s, "[0-9]+", 0)
    return F.when(digits != "", F.concat(F.regexp_extract(s, "[A-Za-z]+", 0), digits.cast("bigint").cast("string"))).otherwise(s)


def year_of(s: Column) -> Column:
    """The first four characters as a year, NULL where they are no number."""
    return F.substring(s, 1, 4).try_cast("int")


def parts_of(name: Column) -> Column:
    return F.split(name, "[.]")


def level_of(name: Column) -> Column:
    """Number of dot-separated parts."""
    return F.size(parts_of(name))


def ordered_unique(*names: Column, sep: str = ".") -> Column:
    """Distinct non-empty parts in their order, joined."""
    parts = F.filter(F.array(*names), lambda p: p.isNotNull() & (p != "") & (F.lower(p) != "nan"))
    return F.array_join(F.array_distinct(parts), sep)


def count_tokens(s: Column, sep: str = ",") -> Column:
    return F.when(F.length(s) > 0, F.size(F.split(s, sep))).otherwise(0)


def repair_date(s: Column) -> Column:
    """YYYY-MM-DD or DD-MM-YYYY as a date."""
    p = F.split(s, "-")
    return F.try_to_date(F.when(F.contains(F.substring(s, 1, 4), F.lit("-")), F.concat_ws("-", p[2], p[1], p[0])).otherwise(s), "yyyy-MM-dd")


def dates_in_name(s: Column) -> tuple[Column, Column]:
    """Begin and end date of a file name that holds _YYYYMMDD_YYYYMMDD_."""
    pattern = "_([0-9]{8})_([0-9]{8})_"
    return tuple(F.try_to_date(F.regexp_extract(s, pattern, k), "yyyyMMdd") for k in (1, 2))


def bimonth(d: Column) -> Column:
    """Two-month period 1 to 6 of a date."""
    return F.ceil(F.month(d) / 2).cast("int")


def tile_alias(tile: Column) -> Column:
    """The scan name of a tile: the zero meridian is 000E; else the zero parallel is 00N."""
    return F.when(F.contains(tile, F.lit("000W")), F.replace(tile, F.lit("000W"), F.lit("000E"))).otherwise(F.replace(tile, F.lit("00S"), F.lit("00N")))


def template(path: Column, year: Column) -> Column:
    """{year} in a path replaced."""
    return F.replace(path, F.lit("{year}"), year.cast("string"))
