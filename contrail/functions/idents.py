"""Aircraft, airport and runway identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

# Address blocks of the two registries.
US_FIRST = 0xA00001
US_LAST = 0xADF7C7
CANADA_F_FIRST = 0xC00001
CANADA_F_SPAN = 0x44A9
CANADA_G_FIRST = 0xC044A9
CANADA_G_SPAN = 0xFBB56
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# N-numbers never use I and O.
US_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
# One optional letter, or two: 1 + 24 + 24 * 24.
US_SUFFIXES = 601
# Addresses below one digit at the 4th, 3rd, 2nd and 1st place.
US_STEP_4 = 1 + 24 + 10
US_STEP_3 = US_SUFFIXES + 10 * US_STEP_4
US_STEP_2 = US_SUFFIXES + 10 * US_STEP_3
US_STEP_1 = US_SUFFIXES + 10 * US_STEP_2


def _letter(index: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), index.cast("int") + 1, F.lit(1))


def _canadian(value: Column) -> Column:
    def tail(prefix: str, first: int) -> Column:
        off = value - first
        head = F.floor(off / 676)
        return F.when(
            (off >= 0) & (head < 26),
            F.concat(F.lit(prefix), _letter(head, LETTERS),
                     _letter(F.floor(off % 676 / 26), LETTERS), _letter(off % 26, LETTERS)))

    return F.coalesce(
        F.when(value - CANADA_F_FIRST <= CANADA_F_SPAN, tail("C-F", CANADA_F_FIRST)),
        F.when(value - CANADA_G_FIRST <= CANADA_G_SPAN, tail("C-G", CANADA_G_FIRST)),
    )


def _us_suffix(rest: Column) -> Column:
    """Zero, one or two letters for an offset of 0..600."""
    k = rest - 1
    first = _letter(F.floor(k / 25), US_LETTERS)
    second = F.when(k % 25 == 0, F.lit("")).otherwise(_letter(k % 25 - 1, US_LETTERS))
    return F.when(rest == 0, F.lit("")).otherwise(F.concat(first, second))


def _us(value: Column) -> Column:
    """Digits by mixed-radix division of the address offset, then the suffix.

    After each digit the offset either falls into the letter suffixes that may
    follow it, or selects the next digit.  The fourth digit is followed by one
    letter or a fifth digit.
    """
    off = value - US_FIRST

    def digits(rest: Column, steps: list[int]) -> Column:
        step, following = steps[0], steps[1:]
        digit = F.floor((rest - US_SUFFIXES) / step)
        below = (rest - US_SUFFIXES) % step
        tail = digits(below, following) if following else _fifth(below)
        return F.when(rest < US_SUFFIXES, _us_suffix(rest)).otherwise(
            F.concat(digit.cast("bigint").cast("string"), tail))

    def _fifth(rest: Column) -> Column:
        return (
            F.when(rest == 0, F.lit(""))
            .when(rest <= 24, _letter(rest - 1, US_LETTERS))
            .otherwise((rest - 25).cast("bigint").cast("string"))
        )

    first = F.floor(off / US_STEP_1) + 1
    return F.concat(
        F.lit("N"), first.cast("bigint").cast("string"),
        digits(off % US_STEP_1, [US_STEP_2, US_STEP_3, US_STEP_4]))


def icao_to_tail(hex_id) -> Column:
    """Registration decoded from a 24-bit address; null outside both blocks."""
    h = F.upper(_c(hex_id))
    value = F.conv(h, 16, 10).cast("bigint")
    return (
        F.when(h.startswith("C"), _canadian(value))
        .when(h.startswith("A") & value.between(US_FIRST, US_LAST), _us(value))
    )


def faa_to_icao(code) -> Column:
    """A bare three-letter US code gains a K; anything else is kept."""
    c = F.upper(F.trim(_c(code)))
    return F.when(c.rlike("^[A-Z]{3}$"), F.concat(F.lit("K"), c)).otherwise(c)


def icao_to_faa(code) -> Column:
    c = F.upper(F.trim(_c(code)))
    return F.when(c.rlike("^K.{3}$"), F.substring(c, 2, 3)).otherwise(c)


def runway_number(ident) -> Column:
    """Two-digit runway number without its side letter, or '' if not 01-36."""
    digits = F.regexp_extract(F.upper(F.trim(_c(ident))), r"^(\d+)[LRC]?$", 1)
    number = F.when(digits != "", digits.cast("int"))
    return F.when(number.between(1, 36), F.lpad(number.cast("string"), 2, "0")).otherwise("")
