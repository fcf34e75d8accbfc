"""Spans of pattern matches as arrays of structs, built without leaving the row.

A text is searched once per pattern: matches are put between marks, and the lengths of what stands between marks give the positions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import checks
from inkveil.functions.arrays import PIECE, at, cut, let, none_of, prefix
from inkveil.functions.text import like
from inkveil.registry import Rule

#: Type of a span in the normalised text. det_ord: the place of the rule that found it.
SPAN = "struct<det_ord:int,type_id:string,start:int,end:int,confidence:double,reasons:array<string>,value:string>"
NO_SPANS = f"array<{SPAN}>"

#: Stands around matches; a code point that isn't a character, so that texts don't have it (those that do are searched twice).
MARK = "\ufdd0"

#: Characters around a match in which a word takes confidence off, and how much.
ANTI_WINDOW, ANTI_PENALTY = 12, 0.25


def bound(rows: DataFrame) -> DataFrame:
    """The same rows, with each column computed here once.

    The optimiser merges projections and would copy a long expression to every place that names its column; it doesn't merge
    across a generator, which costs a row's copy and no shuffle.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(c) for c in rows.columns]))))


def none() -> Column:
    return F.array().cast(NO_SPANS)


def span(det_ord: int, type_id: str, start: Column, end: Column, confidence: Column, reasons: Column, value: Column) -> Column:
    fields = [F.lit(det_ord).alias("det_ord"), F.lit(type_id).alias("type_id"), start.cast("int").alias("start"), end.cast("int").alias("end")]
    return F.struct(*fields, confidence.alias("confidence"), reasons.alias("reasons"), value.alias("value"))


def _apart(marked: Column) -> Column:
    """pieces() of a text whose matches stand between marks."""
    odd = lambda parts, k: F.filter(parts, lambda _, i: i % 2 == k)
    return let(F.split(marked, MARK, -1), lambda parts: F.struct(odd(parts, 1).alias("ms"), odd(parts, 0).alias("gs")))


def pieces(text: Column, pattern: str | Column) -> Column:
    """What a pattern matches (ms), and what stands before, between and after (gs). Matches aren't empty."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    once = _apart(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")))
    twice = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("ms"), F.split(text, pattern, -1).alias("gs"))
    return F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)


def placed(x: Column) -> Column:
    """pieces() as array<struct<start, m>>."""
    ms, gs = x["ms"], x["gs"]
    ends = prefix(F.transform(ms, lambda m, i: F.length(m) + F.length(F.get(gs, i))))
    zipped = let(ends, lambda e: F.transform(ms, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), m.alias("m"))))
    return F.coalesce(F.when(F.size(ms) > 0, zipped), none_of("struct<start:int,m:string>"))


def matches(text: Column, pattern: str | Column, guard: Column | None = None) -> Column:
    """All matches from left to right as array<struct<start, m>>; empty where the guard is false or the text null."""
    found = let(pieces(text, pattern), placed)
    return F.coalesce(F.when(guard, found) if guard is not None else found, none_of("struct<start:int,m:string>"))


def made_of(found: Column, text: Column, make: Callable[[Column, Column], Column]) -> Column:
    """make(match, pieces of the text) of each match, without nulls; the text is cut only where something was found."""
    each = lambda f, parts: F.filter(F.transform(f, lambda x: make(x, parts)), lambda s: s.isNotNull())
    return let(found, lambda f: let(F.when(F.size(f) > 0, cut(text)), lambda parts: each(f, parts)))


def keyword_context(parts: Column, start: Column, end: Column, n: int | Column) -> Column:
    """n characters before and after a range of a text in pieces."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(at(parts, start - n, n), F.lit("|"), at(parts, end, n))


def rule_guard(text: Column, rule: Rule) -> Column:
    """A cheap condition that holds for any text with a span of the rule."""
    out = like(text, rule.guard) if rule.guard else text.isNotNull()
    if rule.require_keyword:
        out = out & like(text, any_word(rule.keywords))
    return out


_PARAMETERS = (
    "array<struct<det_ord:int,type_id:string,label:string,ok:double,weak:double,keywords:array<string>,boost:double,required:boolean,anti:array<string>,"
    "validator:string,ok_reason:string,weak_reason:string,strip:string,window:int,most:int>>"
)


def constant(value: object, kind: str) -> Column:
    """A constant of any type, in one expression that the optimiser folds."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def quote(word: str) -> str:
    """The word as a pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", word)


def any_word(words: Iterable[str]) -> str:
    """A pattern of any of the words, longer ones first; places at which none begins are left after a look at one character."""
    words = sorted(words, key=lambda w: (-len(w), w))
    firsts = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", c) for c in sorted({w[0] for w in words if w}))
    each = f"(?:{'|'.join(map(quote, words))})"
    return f"(?=[{firsts}]){each}" if firsts and "" not in words else each


def one_of(value: Column, words: Iterable[str]) -> Column:
    """Whether the value is one of many words, which the optimiser makes one set of: a look-up whatever their number."""
    return value.isin(sorted(set(words)))


def _parameters(rules: list[tuple[int, Rule]], labels: dict[str, str]) -> Column:
    rows = [
        {
            "det_ord": k, "type_id": r.type_id, "label": labels[r.type_id], "ok": float(r.conf_ok), "weak": float(r.conf_weak), "keywords": r.keywords, "boost": float(r.boost),
            "required": r.require_keyword, "anti": r.anti, "validator": r.validator or "", "ok_reason": r.ok_reason, "weak_reason": r.weak_reason, "strip": r.strip,
            "window": r.window, "most": r.max_per_doc or 0,
        }
        for k, r in rules
    ]
    return constant(rows, _PARAMETERS)


def rule_spans(text: Column, rules: list[tuple[int, Rule]], labels: dict[str, str]) -> Column:
    """Spans of rules in normalised text, in the order of the rules.

    Blanks around a match are cut off and the start moves along; characters of a rule's strip are cut too, but the start moves
    for blanks only. Confidence is kept within 0 and 0.99. The patterns are literals, so each is compiled once; what follows
    a match is one expression for all rules, with the rule's values from a constant array.
    """
    if not rules:
        return none()
    if long := [r.type_id for _, r in rules if r.window > PIECE]:
        raise ValueError(f"window of more than {PIECE} characters: {long[0]}")
    known, around = _parameters(rules, labels), F.lit(f"{MARK}$0{MARK}")
    free = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\ufdd1")).otherwise(text)
    marked = lambda t: F.array(*[F.when(rule_guard(t, r), F.struct(F.lit(i).alias("i"), F.regexp_replace(t, r.tried(), around).alias("x"))) for i, (_, r) in enumerate(rules)])  # noqa: E501, E731
    hits = F.filter(let(free, marked), lambda h: F.contains(h["x"], F.lit(MARK)))

    def of_rule(h: Column, parts: Column) -> Column:
        def scored_all(p: Column) -> Column:
            out = F.filter(F.transform(let(_apart(h["x"]), placed), lambda m: make(p, m, parts)), lambda s: s.isNotNull())
            return F.when(p["most"] > 0, F.slice(out, F.lit(1), p["most"])).otherwise(out)

        return let(F.get(known, h["i"]), scored_all)

    def make(p: Column, x: Column, parts: Column) -> Column:
        whole = F.ltrim(x["m"], F.lit(" \n"))
        value = F.rtrim(whole, F.lit(" \n"))
        value = F.when(p["strip"] != "", F.btrim(value, p["strip"])).otherwise(value)
        place = F.struct((x["start"] + F.length(x["m"]) - F.length(whole)).alias("start"), value.alias("value"))
        return let(place, lambda q: scored(p, q["start"], q["value"], parts))

    def scored(p: Column, start: Column, value: Column, parts: Column) -> Column:
        end = start + F.length(value)

        def first(words: Column, n: Column | int) -> Column:
            return F.when(F.size(words) > 0, let(keyword_context(parts, start, end, n), lambda c: F.get(F.filter(words, lambda w: F.contains(c, w)), F.lit(0))))

        ok = F.when(p["validator"] == "", F.lit(True))
        for name, check in checks.VALIDATORS.items():
            ok = ok.when(p["validator"] == name, check(value))
        seen = F.struct(first(p["keywords"], p["window"]).alias("kw"), first(p["anti"], ANTI_WINDOW).alias("bad"), ok.alias("ok"))
        return let(seen, lambda c: finished(p, start, end, value, c))

    def finished(p: Column, start: Column, end: Column, value: Column, c: Column) -> Column:
        conf = F.when(c["ok"], p["ok"]).otherwise(p["weak"]) + F.when(c["kw"].isNotNull(), p["boost"]).otherwise(F.lit(0.0))
        conf = conf - F.when(c["bad"].isNotNull(), F.lit(ANTI_PENALTY)).otherwise(F.lit(0.0))
        form = F.when(p["validator"] == "", F.lit("格式匹配")).when(c["ok"].isNull(), F.lit("格式不完整")).when(c["ok"], p["ok_reason"]).otherwise(p["weak_reason"])
        reasons = F.array_compact(
            F.array(
                F.concat(F.lit("匹配 "), p["label"], F.lit(" 模式")),
                form,
                F.concat(F.lit("上下文含关键词「"), c["kw"], F.lit("」")),
                F.concat(F.lit("疑似非敏感上下文「"), c["bad"], F.lit("」")),
            )
        )
        fields = F.struct(
            p["det_ord"].alias("det_ord"), p["type_id"].alias("type_id"), start.alias("start"), end.alias("end"),
            F.greatest(F.lit(0.0), F.least(conf, F.lit(0.99))).alias("confidence"), reasons.alias("reasons"), value.alias("value"),
        )
        return F.when((value != "") & (c["kw"].isNotNull() | ~p["required"]), fields)

    # the text is cut only where something was found
    each = lambda found: let(F.when(F.size(found) > 0, cut(text)), lambda parts: F.flatten(F.transform(found, lambda h: of_rule(h, parts))))
    return let(hits, each)


def overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (a["start"] < b["end"])
