"""Column-level functions: addresses, spelling, truthiness, token estimates.

All of them are built from Spark's own expressions, so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def outer_trim(c: Column) -> Column:
    """Text without outer blanks; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def plain(c: Column) -> Column:
    """Lower case without outer blanks."""
    return F.lower(outer_trim(c))


def source_key(c: Column) -> Column:
    """A source name up to case, outer blanks and ``_`` for ``-``; blank is null."""
    s = F.replace(plain(c), F.lit("_"), F.lit("-"))
    return F.when(s != "", s)


def unsigned32(c: Column) -> Column:
    """An address modulo 2^32, so that sign-extended spellings agree."""
    return c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def hex8(text: Column) -> Column:
    """Eight lower-case hex digits of an address text, null where unreadable.

    Readable: eight hex digits, bare or after ``0x`` or ``sub_``, in either
    case, with or without outer blanks.
    """
    s = plain(text)
    digits = F.when(s.startswith("0x"), F.substr(s, F.lit(3))).when(s.startswith("sub_"), F.substr(s, F.lit(5))).otherwise(s)
    return F.when((F.char_length(digits) == 8) & digits.rlike("^[0-9a-f]{8}$"), digits)


def address_of(text: Column) -> Column:
    """The address of a text as an unsigned number in a long, null where unreadable."""
    return F.conv(hex8(text), 16, 10).cast("long")


def address_text(addr: Column) -> Column:
    """``sub_`` and eight upper-case hex digits."""
    return F.format_string("sub_%08X", addr)


def truthy(c: Column) -> Column:
    """Null for the values that count as missing: null, zero and the empty text."""
    return F.when(c.cast("string").isin("0", "0.0", ""), None).otherwise(c)


def truthy_coalesce(*cols: Column) -> Column:
    """The first value that is neither null, zero nor empty; the last one otherwise."""
    return F.coalesce(*[truthy(c) for c in cols[:-1]], cols[-1])


def token_estimate(text: Column, ratio: float = 3.1) -> Column:
    """0 for an empty or null text, else its code points over ``ratio``, rounded, at least 1."""
    n = F.char_length(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.round(n / F.lit(ratio)).cast("int")))


def split_lines(text: Column) -> Column:
    """Lines of a text; a final line end adds no empty line."""
    def without_last(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    return let(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), without_last)


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole rounded, 0 where the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))
