"""Masks as columns, by name, and the mask of a type."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.text import digits, like
from inkveil.registry import COMPOUND_SURNAMES, TypeMeta


def stars(n: Column | int) -> Column:
    return F.repeat(F.lit("*"), n if isinstance(n, Column) else F.lit(n))


def _head(v: Column, n: Column | int) -> Column:
    return F.substring(v, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def keep(v: Column, head: int | Column, tail: int | Column) -> Column:
    """Head and tail as they are, stars between; stars alone (4 to 8) if nothing would lie between or there are 2 characters."""
    n, head, tail = F.length(v), *(x if isinstance(x, Column) else F.lit(x) for x in (head, tail))
    all_stars = stars(F.greatest(F.least(n, F.lit(8)), F.lit(4)))
    return F.when((n <= head + tail) | (n <= 2), all_stars).otherwise(F.concat(_head(v, head), stars(n - head - tail), F.right(v, tail)))


def first_only(v: Column) -> Column:
    return F.concat(_head(v, 1), stars(F.greatest(F.length(v) - 1, F.lit(1))))


def email(v: Column) -> Column:
    """The first letter, three stars or more, and the domain after the last @."""
    domain = F.substring_index(v, "@", -1)
    local = _head(v, F.length(v) - F.length(domain) - 1)
    masked = F.concat(_head(local, 1), stars(F.greatest(F.length(local) - 1, F.lit(3))), F.lit("@"), domain)
    return F.when(F.contains(v, F.lit("@")), masked).otherwise(first_only(v))


def person(v: Column) -> Column:
    head = F.when(like(_head(v, 2), f"^(?:{'|'.join(COMPOUND_SURNAMES)})$"), 2).otherwise(1)
    return F.concat(_head(v, head), stars(F.greatest(F.length(v) - head, F.lit(1))))


def amount(v: Column) -> Column:
    return F.lit("¥******.**元")


def hk_id(v: Column) -> Column:
    form = r"^([A-Z]{1,2})(\d{6})(?:[(（](\d)[)）])?$"
    up = F.upper(F.trim(v))
    last = F.regexp_extract(up, form, 3)
    tail = F.when(last != "", F.concat(F.lit("("), last, F.lit(")"))).otherwise("")
    return F.when(like(up, form), F.concat(F.regexp_extract(up, form, 1), stars(6), tail)).otherwise(first_only(v))


def _behind(code: Column, rest: Column) -> Column:
    n = F.length(rest)
    return F.concat(code, F.lit("-"), F.when(n <= 4, stars(n)).otherwise(F.concat(stars(n - 4), F.right(rest, F.lit(4)))))


def landline(v: Column) -> Column:
    """The area or service code and the last four digits; without a code the first digit and the last four."""
    s = F.trim(v)
    hot, area = r"^(400|800)\s*[-—–]?\s*(.*)$", r"^\(?\s*(0\d{2,3})\s*\)?\s*[-—–]?\s*(.*)$"
    d = digits(s)
    plain = F.when(F.length(d) <= 4, stars(F.length(d))).otherwise(F.concat(_head(d, 1), stars(F.greatest(F.length(d) - 5, F.lit(1))), F.right(d, F.lit(4))))
    is_hot = like(s, hot) & (F.length(d) >= 7)
    by_hot = _behind(F.regexp_extract(s, hot, 1), digits(F.regexp_extract(s, hot, 2)))
    by_area = _behind(F.regexp_extract(s, area, 1), digits(F.regexp_extract(s, area, 2)))
    return F.when(is_hot, by_hot).when(like(s, area), by_area).otherwise(plain)


# Fixed value: province, city and district at the start of an address.
ADMIN = (
    r"^\s*[一-鿿]{1,8}?(?:省|自治区)?[一-鿿]{1,10}?(?:市|自治州|地区|盟)[一-鿿]{1,15}?(?:区|县|旗|市)"
)


def address(v: Column) -> Column:
    """Province, city and district, or six characters, and stars for the rest."""
    found = F.regexp_extract(v, ADMIN, 0)
    head = F.when(found != "", found).otherwise(_head(v, 6))
    return F.concat(head, stars(F.greatest(F.length(v) - F.length(head), F.lit(0))))


def ipv4(v: Column) -> Column:
    four = F.size(F.split(v, r"\.")) == 4
    return F.when(four, F.concat(F.substring_index(v, ".", 1), F.lit(".*.*.*"))).otherwise(stars(F.length(v)))


def mac(v: Column) -> Column:
    sep = F.when(F.contains(v, F.lit(":")), F.lit(":")).otherwise(F.lit("-"))
    parts = F.split(v, "[:-]")
    return F.when(F.size(parts) == 6, F.concat(F.get(parts, F.lit(0)), F.repeat(F.concat(sep, F.lit("**")), F.lit(5)))).otherwise(stars(F.length(v)))


def secret(v: Column) -> Column:
    return F.lit("[已脱敏]")


#: Names that rules can refer to.
MASKS: dict[str, Callable[[Column], Column]] = {
    "person": person, "passport": first_only, "hk_id": hk_id, "landline": landline, "address": address,
    "ipv4": ipv4, "mac": mac, "secret": secret, "amount": amount, "email": email,
}


def mask(value: Column, type_id: Column, types: Iterable[TypeMeta]) -> Column:
    """The mask of each type; six stars for an unknown one."""
    types = list(types)
    sizes = {t.type_id: [t.keep_head, t.keep_tail] for t in types if not t.mask and not t.replacement}
    fixed = {t.type_id: t.replacement for t in types if t.replacement and not t.mask}
    pick = lambda values, kind: F.element_at(F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"map<string,{kind}>"), type_id)
    size = pick(sizes, "array<int>")
    out = F.when(size.isNotNull(), keep(value, F.get(size, F.lit(0)), F.get(size, F.lit(1)))).when(pick(fixed, "string").isNotNull(), pick(fixed, "string"))
    for name in sorted({t.mask for t in types if t.mask}):
        out = out.when(type_id.isin([t.type_id for t in types if t.mask == name]), MASKS[name](value))
    return out.otherwise(F.lit("******"))
