"""Detectors of users: their spans join the others, their failures stay theirs."""

import re
import sys
from dataclasses import dataclass

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from inkveil.operators import plugins
from inkveil.plans import report
from inkveil.plans.analysis import analyse
from inkveil.registry import Rule, Settings
from inkveil.sources.rules import settings_from_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


@dataclass(frozen=True)
class Tickets:
    type_id: str = "TICKET"
    label: str = "工单"
    severity: str = "high"

    def run(self, text):
        for m in re.finditer(r"T-\d+", text):
            yield plugins.Found(m.start(), m.end(), 0.9, ("工单格式",))


class Failing:
    type_id, name = "BAD", "failing"

    def run(self, text):
        yield (0, 1)
        if "boom" in text:
            raise RuntimeError("boom " + "x" * 1000)


class Outside:
    type_id = "OUTSIDE"

    def run(self, text):
        return [(0, len(text) + 1, 0.9)]


class Gone:
    """Can't be loaded where it is sent."""

    type_id = "GONE"

    def __reduce__(self):
        return (int, ("not a number",))


class Names:
    """A detector of a type that is known: its sure names are copied as other names are."""

    type_id = "PERSON_NAME"

    def run(self, text):
        at = text.find("阿福")
        return [(at, at + 2, 0.9, ["名单"])] if at >= 0 else None


ROWS = [(1, "请看 T-123 和 T-123@mail.org 谢谢"), (2, "boom T-9"), (3, None), (4, ""), (4, "T-1"), (5, "阿福来了。后来阿福走了")]


@pytest.fixture(scope="module")
def found(spark):
    st = Settings(detectors=(Tickets(), Failing(), Outside(), Names()))
    return analyse(spark.createDataFrame(ROWS, "doc_id long, text string"), st).cache()


def test_spans_join_the_others(found):
    got = [(r.doc_id, r.type_id, r.value, r.masked, r.severity, r["count"]) for r in report.candidate_table(found).filter("type_id in ('TICKET', 'EMAIL', 'PERSON_NAME')").collect()]
    assert (1, "TICKET", "T-123", "T-*23", "high", 1) in got  # the second stands in the address, whose priority is higher
    assert {(d, v) for d, t, v, *_ in got if t == "EMAIL"} == {(1, "T-123@mail.org")}
    assert {(d, v, n) for d, t, v, _, _, n in got if t == "PERSON_NAME"} == {(5, "阿福", 2)}
    assert {d for d, t, *_ in got if t == "TICKET"} == {1, 2, 4}


def test_failures_stay_apart(found):
    got = {(r.doc_id, r.detector): r.error for r in plugins.failures(found).collect()}
    # one of the texts of 4 is empty, so that not even the first character is there
    assert set(got) == {(2, "failing"), (4, "failing"), *((d, "Outside(OUTSIDE)") for d in (1, 2, 4, 5))}
    assert got[2, "failing"].startswith("RuntimeError: boom") and len(got[2, "failing"]) == plugins.ERROR_CHARS
    assert "no such place" in got[1, "Outside(OUTSIDE)"]


def test_empty_table_and_none_active(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    broken = analyse(docs, Settings(detectors=(Gone(), Tickets())))
    assert {r.detector for r in plugins.failures(broken).collect()} == {"Gone(GONE)"} and report.candidate_table(broken).filter("type_id = 'TICKET'").count() == 3
    st = Settings(detectors=(Tickets(), Failing()), only=frozenset({"EMAIL"}))
    out = analyse(docs, st)
    assert plugins.failures(out).count() == 0 and out.count() == len(ROWS)
    assert analyse(docs.limit(0), Settings(detectors=(Tickets(),))).count() == 0


def test_bad_patterns(spark):
    """A custom rule that doesn't compile costs its own rows; the others score as they do as rules."""
    st = settings_from_json('{"custom_rules": [{"type_id": "A", "pattern": "A\\\\d+", "keywords": ["编号"]}, {"type_id": "B", "pattern": "(["}]}')
    rows = spark.createDataFrame([(1, "编号 A12，其他A7"), (2, "A9" + "x" * 50)], "doc_id long, text string")
    out = analyse(rows, plugins.isolated(st)).cache()
    assert {(r.doc_id, r.detector) for r in plugins.failures(out).collect()} == {(1, "PatternDetector(B)"), (2, "PatternDetector(B)")}
    good = settings_from_json('{"custom_rules": [{"type_id": "A", "pattern": "A\\\\d+", "keywords": ["编号"]}]}')
    columns = ["doc_id", "type_id", "value", F.round("confidence", 3).alias("c"), "count"]
    want = report.candidate_table(analyse(rows, good)).filter("type_id = 'A'").select(*columns).collect()
    assert sorted(want) == sorted(report.candidate_table(out).filter("type_id = 'A'").select(*columns).collect()) and len(want) == 3


def test_rule_detector_equals_rule(spark):
    rule = Rule("X", r"[a-z]+\d+\.?", 0.6, 0.6, ("key",), 0.2, anti=("not",), strip=".", max_per_doc=3)
    text = "key ab1. not cd2 \n ef3 gh4 key"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    only = frozenset({"X"})
    spans = [analyse(rows, st).select(F.inline("spans")).select("start", "end", F.round("confidence", 3), "value").collect()
             for st in (Settings(extra_rules=(rule,), only=only), plugins.isolated(Settings(extra_rules=(rule,), only=only)))]
    assert spans[0] == spans[1] and len(spans[0]) == 3
