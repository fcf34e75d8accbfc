"""Check digits as columns: true, false, or null where the value hasn't the form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.arrays import let
from inkveil.functions.text import digits, like

# Fixed values of GB 11643 and GB 32100.
ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID_DIGITS = "10X98765432"
USCC_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]


def _at(value: Column, k: int) -> Column:
    return F.substring(value, k, 1)


def id_card_digit(first17: Column) -> Column:
    """The check digit of the first 17 digits."""
    total = sum((_at(first17, k).try_cast("int") * w for k, w in enumerate(ID_WEIGHTS, 1)), F.lit(0))
    return F.substring(F.lit(ID_DIGITS), total % 11 + 1, F.lit(1))


def id_card(value: Column) -> Column:
    return let(F.upper(F.trim(value)), lambda v: F.when(like(v, r"^\d{17}[\dX]$"), id_card_digit(v) == _at(v, 18)))


def uscc_digit(first17: Column) -> Column:
    total = sum(((F.instr(F.lit(USCC_CHARS), _at(first17, k)) - 1) * w for k, w in enumerate(USCC_WEIGHTS, 1)), F.lit(0))
    return F.substring(F.lit(USCC_CHARS), (31 - total % 31) % 31 + 1, F.lit(1))


def uscc(value: Column) -> Column:
    return let(F.upper(F.trim(value)), lambda v: F.when(like(v, f"^[{USCC_CHARS}]{{18}}$"), uscc_digit(v) == _at(v, 18)))


def luhn(value: Column) -> Column:
    """12 to 19 digits, others than digits left out, that pass Luhn's check; false otherwise."""
    d = digits(value)
    return F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))


def hk_paren(value: Column) -> Column:
    return F.when(like(value, r"[（(]\d[)）]$"), F.lit(True))


VALIDATORS: dict[str, Callable[[Column], Column]] = {"id_card": id_card, "uscc": uscc, "luhn": luhn, "hk_paren": hk_paren}


# Forms of made-up values and of service lines.
PLACEHOLDER_FORMS = [r"^(\d)\1{5,}$", r"^(?:1234567890|0123456789)", r"^[Xx×＊*·．.]{3,}$", r"^[某甲乙丙丁]{1,3}(?:某|方|公司)*$", r"^[*xX×#]{4,}$"]
SERIES = ["1234567890", "0123456789", "123456789", "012345678"]
HOTLINE = r"^(?:400|800)[\s\-—–－]?\d{3}[\s\-—–－]?\d{4}$"


def is_placeholder(value: Column) -> Column:
    """Whether a value is empty or stands for another: six digits or more of at most two kinds, a series, or a known form."""
    few = lambda d: (F.length(d) >= 6) & ((F.size(F.array_distinct(F.split(d, ""))) <= 2) | d.isin(SERIES))
    return let(F.btrim(value, F.lit(" \t\n\r")), lambda v: (v == "") | let(digits(v), few) | like(v, "|".join(PLACEHOLDER_FORMS)))


def is_hotline(value: Column) -> Column:
    return like(F.btrim(value, F.lit(" \t\n\r")), HOTLINE)
