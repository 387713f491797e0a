"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def missing(x: Column) -> Column:
    """Null or empty: an empty identifier counts as none."""
    return x.isNull() | (x == "")


def iso_local(ts: Column) -> Column:
    """ISO date-time without zone; the fraction is left out when it is zero."""
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def version(x: Column) -> Column:
    """A dotted version as an array of numbers, which compares as versions do; other characters are ignored."""
    return F.transform(F.split(F.regexp_replace(x, r"[^0-9.]", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def requirement_name(x: Column) -> Column:
    """The package of a line like ``name>=1.2``."""
    return F.trim(F.split(x, ">=")[0])


def percent(part: Column, whole: Column) -> Column:
    """part of whole times 100; 0 of nothing."""
    return F.coalesce(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def described(prefix: str, day: str) -> Column:
    return F.concat(F.lit(prefix), F.lit(" - "), F.lit(day))


def fields(x: Column, sign: str, first: int, last: int) -> Column:
    """Fields first to last (from 1) between a sign, as ``cut -d -f`` gives them; fewer fields: those there are."""
    return F.array_join(F.slice(F.split(x, "\\Q" + sign + "\\E"), first, last - first + 1), sign)


def holds(x: Column, part: str) -> Column:
    """Whether a text contains a part; null: no."""
    return F.coalesce(F.contains(x, F.lit(part)), F.lit(False))


def rule_line(sign: str, n: int) -> Column:
    return F.repeat(F.lit(sign), n)


def stamped(ts: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time as text; other forms in use: yyyyMMdd, yyyy-MM-dd."""
    return F.date_format(ts, form)


def looked_up(map_: Column, key: Column, default: Column) -> Column:
    """A map's value, or the default where the key is missing."""
    return F.coalesce(F.try_element_at(map_, key), default)


def child_path(parent: Column, name: Column) -> Column:
    """parent/name, or the name alone below no parent."""
    return F.when(missing(parent), name).otherwise(F.concat_ws("/", parent, name))


def alike(x: Column, y: Column) -> Column:
    """1 for equal texts down to 0 for those that share nothing: 1 - edit distance / longer length."""
    return F.lit(1.0) - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
