"""From spans to candidates: filters, overlaps, grouping by value, evidence, order. All within a document's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.checks import is_hotline, is_placeholder
from inkveil.functions.masks import mask
from inkveil.functions.arrays import before, between, cut, let, near, none_of, places, runs, slices_at
from inkveil.functions.spans import NO_SPANS, bound, constant, one_of
from inkveil.functions.text import key_of, norm_key, raw_end, raw_start
from inkveil.operators.entities import entity_numbers, placeholder
from inkveil.registry import SEVERITIES, Settings

#: Characters between a name and an identity number that support each other, and what that adds.
NEAR, NEAR_BOOST = 60, 0.08


def _lookup(type_id: Column, values: dict[str, object], default: object) -> Column:
    kind = "int" if isinstance(default, int) else "string"
    return F.coalesce(F.element_at(constant(values, f"map<string,{kind}>"), type_id), F.lit(default))


def priority(type_id: Column, settings: Settings) -> Column:
    return _lookup(type_id, {t: m.priority for t, m in settings.type_map().items()}, 10)


def severity_rank(type_id: Column, settings: Settings) -> Column:
    return _lookup(type_id, {t: SEVERITIES[m.severity] for t, m in settings.type_map().items()}, 1)


def with_raw_places(spans: Column, raw: Column, index: Column) -> Column:
    """Spans with raw_start, raw_end, and value as it stands in the raw text."""

    def move(s: Column, parts: Column) -> Column:
        a, b = raw_start(index, s["start"], raw), raw_end(index, s["end"], raw)
        names = ("det_ord", "type_id", "start", "end", "confidence", "reasons")
        return F.struct(*[s[c].alias(c) for c in names], between(parts, raw, a, b).alias("value"), a.alias("raw_start"), b.alias("raw_end"))

    return let(F.when(F.size(spans) > 0, cut(raw)), lambda parts: F.transform(spans, lambda s: move(s, parts)))


def wanted(s: Column, settings: Settings) -> Column:
    """Whether a span stands the filters before overlaps: active type, no made-up value, not allowed, sure enough."""
    made_up = (s["type_id"] != "AMOUNT") & is_placeholder(s["value"]) & ~((s["type_id"] == "PHONE_LANDLINE") & is_hotline(s["value"]))
    allowed = F.array_contains(constant(sorted(map(key_of, settings.allowlist)), "array<string>"), norm_key(s["value"])) if settings.allowlist else F.lit(False)
    return one_of(s["type_id"], settings.active()) & ~made_up & ~allowed & (s["confidence"] >= settings.min_confidence)


def in_order(spans: Column, settings: Settings) -> Column:
    """Spans by priority, confidence and length, all from high to low; equal ones as they were."""
    keyed = F.transform(
        spans, lambda s, i: F.struct((-priority(s["type_id"], settings)).alias("p"), (-s["confidence"]).alias("c"), (s["start"] - s["end"]).alias("l"), i.alias("i"), s.alias("s"))
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def without_overlaps(ordered: Column, kind: str) -> Column:
    """Of spans in order those that overlap none taken before, in order. kind: the type of the array; spans aren't empty.

    By start the spans fall into clusters: one ends where as many spans have ended as have started. Spans of different clusters don't
    overlap. In a cluster of two the first in order stays; in a larger one those taken are kept sorted, and a search by halves finds the only one
    that can overlap the next. The time grows with n log n, and within a cluster with the size of what it keeps.
    """
    item = f"struct<i:int,s:{kind.removeprefix('array<').removesuffix('>')}>"

    def greedy(cluster: Column) -> Column:
        start = F.struct(none_of(item).alias("kept"), none_of("int").alias("starts"), none_of("int").alias("ends"))

        def step(acc: Column, x: Column) -> Column:
            a, b = x["s"]["start"], x["s"]["end"]

            def put(n: Column) -> Column:
                insert = lambda v, one: F.concat(F.slice(v, F.lit(1), n), F.array(one), F.slice(v, n + 1, F.size(v)))
                taken = F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), insert(acc["starts"], a).alias("starts"), insert(acc["ends"], b).alias("ends"))
                return F.when(F.coalesce(F.get(acc["ends"], n - 1) > a, F.lit(False)), acc).otherwise(taken)

            return let(before(acc["starts"], b), put)

        return F.aggregate(F.array_sort(cluster), start, step, lambda acc: acc["kept"])

    def in_clusters(by_start: Column) -> Column:
        def cut_at(ends: Column) -> Column:
            heads = F.filter(places(F.size(ends)), lambda i: (i == 0) | (F.get(ends, i - 1) <= F.get(by_start, i)["start"]))
            of_two = lambda c: F.array(F.when(F.get(c, F.lit(0))["i"] < F.get(c, F.lit(1))["i"], F.get(c, F.lit(0))).otherwise(F.get(c, F.lit(1))))
            ordered_ = F.transform(by_start, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))
            taken = F.transform(slices_at(ordered_, heads), lambda c: F.when(F.size(c) == 1, c).when(F.size(c) == 2, of_two(c)).otherwise(greedy(c)))
            return F.transform(F.array_sort(F.flatten(taken)), lambda x: x["s"])

        return let(F.array_sort(F.transform(by_start, lambda x: x["s"]["end"])), cut_at)

    keyed = F.transform(ordered, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")))
    return F.when(F.size(ordered) < 2, ordered).otherwise(let(F.array_sort(keyed), in_clusters))


RAW_SPANS = NO_SPANS.replace("value:string>", "value:string,raw_start:int,raw_end:int>")


def resolve(detected: DataFrame, settings: Settings) -> DataFrame:
    """detect()'s rows with kept: the spans that remain, disjoint, in the order in which they were taken."""
    placed = bound(detected.withColumn("placed", with_raw_places(F.col("spans"), F.col("raw"), F.col("index"))))
    placed = bound(placed.withColumn("placed", in_order(F.filter("placed", lambda s: wanted(s, settings)), settings)))
    least = SEVERITIES[settings.min_severity]
    kept = F.filter(without_overlaps(F.col("placed"), RAW_SPANS), lambda s: severity_rank(s["type_id"], settings) >= least)
    return bound(placed.withColumn("kept", kept).drop("placed"))


def candidates(resolved: DataFrame, settings: Settings) -> DataFrame:
    """resolve()'s rows with candidates: for each type and value of a document one struct.

    Fields: cid (rank by severity, confidence, count, order), type_id, key, value (of the first span taken), masked, severity,
    confidence, reasons, number and placeholder of the entity, occurrences (raw_start, raw_end, text), count.
    """
    meta = settings.type_map()
    keyed = F.transform("kept", lambda s, i: F.struct(s["type_id"].alias("type_id"), norm_key(s["value"]).alias("key"), i.alias("i"), s.alias("s")))
    ids = F.transform(F.filter("kept", lambda s: s["type_id"].isin("ID_CARD", "ID_CARD_15")), lambda s: s["raw_start"])
    rows = bound(resolved.withColumns({"keyed": F.array_sort(keyed), "id_places": F.array_sort(ids)}))

    def group(m: Column) -> Column:
        first = F.get(m, F.lit(0))
        starts = F.transform(m, lambda k: k["s"]["raw_start"])
        beside = (first["type_id"] == "PERSON_NAME") & F.exists(starts, lambda a: near(F.col("id_places"), a, NEAR))
        top = F.round(F.array_max(F.transform(m, lambda k: k["s"]["confidence"])), 3)
        reasons = F.array_distinct(F.flatten(F.transform(m, lambda k: k["s"]["reasons"])))
        return F.struct(
            first["i"].alias("at"), first["type_id"].alias("type_id"), first["key"].alias("key"), first["s"]["value"].alias("value"),
            F.when(beside, F.round(F.least(top + F.lit(NEAR_BOOST), F.lit(0.99)), 3)).otherwise(top).alias("confidence"),
            F.when(beside, F.concat(reasons, F.array(F.lit("邻近身份证号，佐证为自然人")))).otherwise(reasons).alias("reasons"),
            F.transform(m, lambda k: F.struct(k["s"]["raw_start"].alias("raw_start"), k["s"]["raw_end"].alias("raw_end"), k["s"]["value"].alias("text"))).alias("occurrences"),
            F.array_min(starts).alias("first"),
        )

    alike = runs(F.col("keyed"), lambda a, b: (a["type_id"] != b["type_id"]) | (a["key"] != b["key"]))
    # groups in the order of their first spans
    rows = bound(rows.withColumn("groups", F.array_sort(F.transform(alike, group))).drop("keyed", "id_places"))
    numbers = entity_numbers(F.transform("groups", lambda g: F.struct(g["type_id"].alias("type_id"), g["key"].alias("key"), g["first"].alias("first"))))
    keyed = bound(rows.withColumn("numbers", numbers))
    label = lambda t: _lookup(t, {k: m.label for k, m in meta.items()}, "")
    severity = lambda t: _lookup(t, {k: m.severity for k, m in meta.items()}, "low")

    def ranked(g: Column, i: Column) -> Column:
        return F.struct((-severity_rank(g["type_id"], settings)).alias("a"), (-g["confidence"]).alias("b"), (-F.size(g["occurrences"])).alias("c"), i.alias("d"), g.alias("g"))

    def whole(k: Column, i: Column) -> Column:
        g = k["g"]
        number = F.get("numbers", k["d"])["number"]
        fields = ("type_id", "key", "value", "confidence", "reasons", "occurrences")
        return F.struct(
            (i + 1).alias("cid"), *[g[c].alias(c) for c in fields], label(g["type_id"]).alias("label"), severity(g["type_id"]).alias("severity"),
            _lookup(g["type_id"], {k: m.category for k, m in meta.items()}, "自定义").alias("category"), mask(g["value"], g["type_id"], meta.values()).alias("masked"),
            number.alias("number"), placeholder(label(g["type_id"]), number).alias("placeholder"), F.size(g["occurrences"]).alias("count"),
        )

    out = F.transform(F.array_sort(F.transform("groups", ranked)), whole)
    return bound(keyed.withColumn("candidates", out).drop("groups", "numbers"))


def exclude_allowed(spans: DataFrame, allowed: DataFrame) -> DataFrame:
    """Spans (with value) whose key isn't that of a row of allowed (value); for lists too long for Settings."""
    keys = allowed.select(norm_key(F.col("value")).alias("_key")).distinct()
    return spans.withColumn("_key", norm_key(F.col("value"))).join(keys, "_key", "left_anti").drop("_key")
