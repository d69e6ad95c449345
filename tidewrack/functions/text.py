"""Text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark.errors import utils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.regex import to_java

_Made = TypeVar("_Made")


def untraced(make: Callable[..., _Made]) -> Callable[..., _Made]:
    """``make`` without a note of the Python line for each Column: with thousands of them the notes take most of the driver's time."""

    @wraps(make)
    def run(*args, **kwargs):
        was = getattr(utils, "_enable_debugging_cache", None)
        utils._enable_debugging_cache = False
        try:
            return make(*args, **kwargs)
        finally:
            utils._enable_debugging_cache = was

    return run


BLANK = "[\\s\\u0085\\u00a0]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def aside(value: Column) -> Column:
    """The value computed outside of generated code: large expressions don't fit into one method."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: value), F.lit(0))


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with columns that no optimizer rule copies into the expressions that use them."""
    at = "__once"
    rows = rows.select("*", F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias(at))
    return rows.withColumns({n: F.col(f"{at}.{n}") for n in values}).drop(at)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(c, "^" + BLANK, ""), BLANK + "$", "")


def norm(c: Column) -> Column:
    """Lower case without white space at both ends; the form that keys compare in."""
    return F.lower(strip(c))


def limit(c: Column, most: int) -> Column:
    """At most ``most`` characters, with dots where more were cut off."""
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("...")))


def bounded(c: Column, most: int = 80) -> Column:
    """At most ``most`` bytes of ASCII text, the last three of them dots where it was longer."""
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def flatten(c: Column, most: int) -> Column:
    """One line: line ends are written out."""
    return limit(F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("")), most)


def slashes(path: Column) -> Column:
    """A clean path with forward slashes: no doubled ones and no single dots."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, "/+", "/")
    p = F.regexp_replace(p, "(^|/)(?:\\./)+", "$1")
    p = F.regexp_replace(p, "/\\.$", "")
    return F.when(p == "", ".").when(p == "/", "/").otherwise(F.regexp_replace(p, "/$", ""))


def bare(path: Column) -> Column:
    """Without slashes at both ends."""
    return F.trim(path, F.lit("/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def directory(path: Column) -> Column:
    """Path without its last segment; empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty where there is none."""
    return F.lower(F.regexp_extract(name, "(\\.[^./]*)$", 1))


def contains_any(c: Column, parts: list[str]) -> Column:
    """Whether any of the parts is in ``c``; false without parts."""
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def first_match(c: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """First match of a pattern of the linear dialect, empty where there is none."""
    return F.regexp_extract(c, to_java(pattern, ignore_case), group)


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(to_java(pattern)), F.lit(group))


def severity_rank(c: Column) -> Column:
    s = norm(c)
    return F.when(s == "critical", 4).when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def confidence_rank(c: Column) -> Column:
    s = norm(c)
    return F.when(s == "high", 3).when(s == "medium", 2).when(s == "low", 1).otherwise(0)


def unique_sorted(values: Column) -> Column:
    """Trimmed values, one spelling of each (the first) regardless of case, in byte order."""
    clean = F.filter(F.transform(values, strip), lambda v: v != "")
    first = F.filter(clean, lambda v, i: F.array_position(F.transform(clean, F.lower), F.lower(v)) == i + 1)
    return F.array_sort(first)


def parse_pairs(lines: Column, separator: str = "[=:]") -> Column:
    """Map of ``key = value`` lines, keys in lower case; a later key overwrites an earlier one.

    Lines without a key or a value are left out.
    """
    pair = F.transform(lines, lambda x: F.struct(norm(F.regexp_extract(x, f"^([^=:]*){separator}", 1)).alias("k"), strip(F.regexp_extract(x, f"^[^=:]*{separator}(?s:(.*))$", 1)).alias("v")))
    good = F.filter(pair, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)
