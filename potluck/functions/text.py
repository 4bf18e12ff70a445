"""Column helpers with the semantics of Python's string methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: What (?U)\\s stands for.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.length(c), F.lit(0)) > 0


def lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[.!?]+"), strip), lambda x: x != "")


def search(c: Column, pattern: str) -> Column:
    return c.rlike("(?iU)" + pattern)


def matches(c: Column, pattern: str) -> Column:
    """How many times a pattern occurs."""
    return F.regexp_count(c, F.lit("(?iU)" + pattern))


def literals(entries: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in entries])


def hits(c: Column, entries: list[str]) -> Column:
    """How many of the entries occur in c; c should be a plain column or bound by let."""
    return F.size(F.filter(literals(entries), lambda w: F.contains(c, w)))


def any_of(c: Column, entries: list[str]) -> Column:
    """Does one of the entries occur? Plain substring tests, which are far cheaper than an alternation."""
    return let(c, lambda t: F.exists(literals(entries), lambda w: F.contains(t, w)))


def whole_words(c: Column, entries: list[str]) -> Column:
    """How many words of c (runs of word characters) are in the entries."""
    return F.size(F.filter(F.split(c, r"(?U)\W+"), lambda w: w.isin(entries)))


def trailing_share(ws: Column, entries: list[str], marks: str) -> Column:
    """Share of the words that are in the entries once trailing marks are cut off."""
    return share(F.size(F.filter(ws, lambda w: F.rtrim(w, F.lit(marks)).isin(entries))), F.size(ws))


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def steps(x: Column, cuts: list[tuple[float, float]], otherwise: Column | float) -> Column:
    """The value of the first cut that x reaches; x is computed once, not once per cut."""

    def choose(y: Column) -> Column:
        out = F.when(y >= cuts[0][0], F.lit(cuts[0][1]))
        for cut, value in cuts[1:]:
            out = out.when(y >= cut, F.lit(value))
        return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))

    return let(x, choose)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def count_if(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(xs, test))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(search(c, pattern), F.regexp_extract(c, "(?iU)" + pattern, group))


def six(c: Column) -> Column:
    """A score to six places, rounded in floating point as SQL does; F.round goes by its decimal digits."""
    return F.floor(c * 1e6 + 0.5) / 1e6
