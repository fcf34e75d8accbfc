"""Detection: all spans of a text in one pass over its row, and copies of names that it has confirmed."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from py4j.java_gateway import JavaObject
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.arrays import at, before, cover, covered, cut, let, none_of, prefix, runs
from inkveil.functions.spans import MARK, bound, none, rule_spans, span
from inkveil.functions.text import like, norm_index, norm_key, normalize
from inkveil.operators.context import context_spans
from inkveil.operators.entities import org_core
from inkveil.operators.plugins import with_plugins
from inkveil.registry import ALIAS_ORD, NAME_COPY_ORD, Settings


@cache
def _of_norm(what: Callable[..., Column], *of: Settings) -> Column:
    """An expression over the columns norm and spans, built once for each Settings: building it takes longer than planning it."""
    return what(F.col("norm"), *of) if of else what(F.col("norm"), F.col("spans"))


def found_spans(text: Column, settings: Settings) -> Column:
    """Spans of rules and context detectors of active types, in the order of the detectors."""
    labels = {t: m.label for t, m in settings.type_map().items()}
    rules = F.coalesce(rule_spans(text, settings.rules(), labels), none())
    return F.concat(rules, *context_spans(text, settings))


def confirmed_names(spans: Column) -> Column:
    """Names of 2 to 4 characters that are sure enough to be looked for elsewhere, each once."""
    sure = F.filter(spans, lambda s: (s["type_id"] == "PERSON_NAME") & (s["confidence"] >= 0.7) & F.length(s["value"]).between(2, 4))
    return F.array_distinct(F.transform(sure, lambda s: s["value"]))


def dictionary(text: Column, words: Column) -> Column:
    """All places of words in the text, overlapping ones too, as array<struct<start, m>>, by place; words: array, not empty ones.

    One alternation finds the places at which any word starts in one pass; which words start there is looked up by their lengths.
    """

    def search(ws: Column) -> Column:
        first = F.array_join(F.array_distinct(F.transform(ws, lambda w: F.substring(w, 1, 1))), "")
        each = F.array_join(F.transform(ws, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")
        pattern = F.concat(F.lit("(?=[\\Q"), first, F.lit("\\E])(?=(?:"), each, F.lit("))"))
        free = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\ufdd1")).otherwise(text)
        marked = F.split(F.regexp_replace(free, pattern, F.lit(MARK)), MARK, -1)
        starts = let(marked, lambda parts: prefix(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p))))
        known = F.struct(F.array_distinct(F.transform(ws, lambda w: F.length(w))).alias("sizes"), F.array_sort(ws).alias("words"), starts.alias("starts"))
        return let(known, lambda k: let(F.when(F.size(k["starts"]) > 0, cut(text)), lambda parts: F.flatten(F.transform(k["starts"], lambda at_: here(k, parts, at_)))))

    def here(k: Column, parts: Column, start: Column) -> Column:
        tried = F.array_distinct(F.transform(k["sizes"], lambda n: at(parts, start, n)))
        real = F.filter(tried, lambda w: F.coalesce(F.get(k["words"], before(k["words"], w)) == w, F.lit(False)))
        return F.transform(real, lambda w: F.struct(start.alias("start"), w.alias("m")))

    return F.coalesce(let(F.array_distinct(words), lambda ws: F.when(F.size(ws) > 0, search(ws))), none_of("struct<start:int,m:string>"))


def name_copies(text: Column, spans: Column) -> Column:
    """Further places of confirmed names, other than within a span; unsure names don't stand in the way. In the order of the text."""
    blockers = F.filter(spans, lambda s: ~((s["type_id"] == "PERSON_NAME") & (s["confidence"] < 0.6)))

    def free(found: Column) -> Column:
        apart = lambda by: F.filter(found, lambda m: ~covered(m["start"], m["start"] + F.length(m["m"]), by))
        return F.when(F.size(found) > 0, let(cover(blockers), apart)).otherwise(found)

    def copy(m: Column) -> Column:
        reason = F.array(F.concat(F.lit("与已确认人名「"), m["m"], F.lit("」一致的另一处出现")))
        return span(NAME_COPY_ORD, "PERSON_NAME", m["start"], m["start"] + F.length(m["m"]), F.lit(0.72), reason, m["m"])

    return F.transform(let(dictionary(text, confirmed_names(spans)), free), copy)


# Fixed value: how a contract defines a short name.
_SHORT = r"[（(]\s*(?:以下|下)?\s*(?:简称|称)\s*[:：]?\s*[「“\"'‘]?([一-鿿A-Za-z0-9]{2,20})\s*[」”\"'’]?\s*[)）]"


def org_aliases(text: Column, spans: Column) -> Column:
    """Short names of found organisations: defined within 40 characters after one, or its core, with 公司 too if that is long.

    Of several reasons for a name the first counts. Spans come in the order of the names, then of the text.
    """
    orgs = F.filter(spans, lambda s: (s["type_id"] == "ORG_NAME") & (F.length(s["value"]) >= 5))

    def names(o: Column, parts: Column) -> Column:
        tail = at(parts, o["end"], 40)
        return let(norm_key(o["value"]), lambda key: of_key(o, tail, key))

    def of_key(o: Column, tail: Column, key: Column) -> Column:
        alt = lambda name, conf, why: F.struct(name.alias("name"), F.lit(conf).alias("conf"), F.lit(why).alias("why"), o["value"].alias("of"))
        defined = F.transform(F.regexp_extract_all(tail, F.lit(_SHORT), F.lit(1)), lambda n: alt(n, 0.9, "显式简称定义"))

        def cores(core: Column) -> Column:
            long = F.array(alt(core, 0.72, "字号"), alt(F.concat(core, F.lit("公司")), 0.7, "字号+公司"))
            return F.when(F.length(core) >= 4, long).when(F.length(core) >= 2, F.array(alt(core, 0.66, "字号"))).otherwise(F.slice(long, 1, 0))

        return F.filter(F.concat(defined, let(org_core(key), cores)), lambda a: (a["name"] != "") & (norm_key(a["name"]) != key))

    def once(every: Column) -> Column:
        keyed = F.transform(every, lambda a, i: F.struct(a["name"].alias("name"), i.alias("i"), a.alias("a")))
        return F.transform(runs(F.array_sort(keyed), lambda a, b: a["name"] != b["name"]), lambda r: F.get(r, F.lit(0)))

    def search(alts: Column, parts: Column) -> Column:
        known = F.struct(alts.alias("alts"), F.transform(alts, lambda a: a["name"]).alias("names"), cover(spans).alias("by"))
        return let(known, lambda k: found(k, parts))

    def found(k: Column, parts: Column) -> Column:
        word = "^[A-Za-z0-9]"

        def free(m: Column) -> Column:
            end = m["start"] + F.length(m["m"])
            return ~like(at(parts, m["start"] - 1, 1), word) & ~like(at(parts, end, 1), word) & ~covered(m["start"], end, k["by"])

        def alias(x: Column) -> Column:
            a, m = x["a"], x["m"]
            reason = F.array(F.concat(F.lit("与「"), a["of"], F.lit("」同指的"), a["why"]))
            return span(ALIAS_ORD, "ORG_NAME", m["start"], m["start"] + F.length(m["m"]), a["conf"], reason, m["m"])

        # the names are sorted, so each hit's reason is found by halves
        hits = F.filter(dictionary(text, k["names"]), free)
        of = F.transform(hits, lambda m: let(F.get(k["alts"], before(k["names"], m["m"])), lambda a: F.struct(a["i"].alias("i"), m["start"].alias("start"), a["a"].alias("a"), m.alias("m"))))
        return F.transform(F.array_sort(of), alias)

    each = lambda o: let(F.when(F.size(o) > 0, cut(text)), lambda parts: let(once(F.flatten(F.transform(o, lambda x: names(x, parts)))), lambda alts: F.when(F.size(alts) > 0, search(alts, parts))))  # noqa: E501, E731
    return F.coalesce(let(orgs, each), none())


def _is_spread(plan: JavaObject) -> bool:
    """Whether the rows of a plan with one source have been dealt out already and not shuffled since."""
    while (inputs := plan.children()).size() == 1:
        if plan.nodeName() == "Repartition":
            return True
        if plan.nodeName() not in ("Project", "Filter", "Generate"):
            return False
        plan = inputs.apply(0)
    return False


def spread(docs: DataFrame) -> DataFrame:
    """docs in at least a few partitions for each core, if a scan of their size has fewer: patterns cost far more than moving a small text.

    Nothing moves once the input has as many full-sized splits as there are cores, nor where it has been spread before, nor in a stream.
    """
    if docs.isStreaming:
        return docs
    spark = docs.sparkSession
    try:
        split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        plan = docs._jdf.queryExecution().optimizedPlan()
        if _is_spread(plan):
            return docs
        size = int(plan.stats().sizeInBytes())
        cores = spark.sparkContext.defaultParallelism
    except (AttributeError, PySparkException):  # a remote session has no plan statistics: the scan's own splits stay
        return docs
    return docs if size >= cores * split else docs.repartition(4 * cores)


def detect(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, raw, norm, index (null where raw and norm have the same positions), spans in norm.

    A null text has no spans. With detectors of users also failures (operators.plugins). Other columns are dropped. No shuffle but of small inputs (spread).
    """
    rows = bound(spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw"))))
    rows = bound(rows.withColumns({"norm": normalize(F.col("raw")), "index": norm_index(F.col("raw"))}))
    rows = bound(rows.withColumn("spans", _of_norm(found_spans, settings)))
    if settings.detectors:
        rows = bound(with_plugins(rows, settings))
    active = set(settings.active())
    if settings.propagate and "PERSON_NAME" in active:
        rows = bound(rows.withColumn("spans", F.concat("spans", _of_norm(name_copies))))
    if settings.propagate and "ORG_NAME" in active:
        rows = bound(rows.withColumn("spans", F.concat("spans", _of_norm(org_aliases))))
    return rows


def span_table(detected: DataFrame) -> DataFrame:
    """One row per span: doc_id, det_ord, type_id, start, end, confidence, reasons, value."""
    return detected.select("doc_id", F.inline("spans"))
