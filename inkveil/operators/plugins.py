"""Detectors of users: Python objects that look at a text, each on its own. A failure costs a detector its spans in one document only.

A detector has a type_id and run(text), which yields Found or tuples (start, end, confidence, reasons); places count in the normalised text. All
detectors of a job run in one Arrow UDTF that a lateral join gives the text of a row: the row comes back once, with the spans and the failures of
all detectors as arrays, so nothing is shuffled and the spans join those of rules before names are copied and overlaps resolved.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple, Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.spans import ANTI_PENALTY, ANTI_WINDOW, SPAN
from inkveil.registry import PLUGIN_ORD, Rule, Settings

#: Characters of an error that are kept.
ERROR_CHARS = 500

FAILURE = "struct<detector:string,error:string>"
FOUND = f"spans array<{SPAN}>, failures array<{FAILURE}>"


class Found(NamedTuple):
    """A span in the normalised text; confidence from 0 to 1."""

    start: int
    end: int
    confidence: float = 0.7
    reasons: tuple[str, ...] = ()


class Detector(Protocol):
    """What a detector has. A type that isn't known yet gets label (or the id), severity "medium" and two characters kept at each end.

    Detectors are sent to the executors by pickle and must not rely on what a former text left in them.
    """

    type_id: str

    def run(self, text: str) -> Iterable[Found | tuple]: ...


@dataclass(frozen=True)
class PatternDetector:
    """A rule's search in Python: a pattern that doesn't compile, or fails, is this detector's failure and no one else's."""

    rule: Rule

    @property
    def type_id(self) -> str:
        return self.rule.type_id

    def run(self, text: str) -> Iterator[Found]:
        r = self.rule
        for n, m in enumerate(re.finditer(r.pattern, text)):
            if r.max_per_doc and n >= r.max_per_doc:
                return
            value = m[0].lstrip(" \n")
            start = m.end() - len(value)
            value = value.rstrip(" \n").strip(r.strip) if r.strip else value.rstrip(" \n")
            end = start + len(value)
            around = lambda w: text[max(0, start - w) : start] + "|" + text[end : end + w]  # noqa: B023, E731
            word = next((k for k in r.keywords if k in around(r.window)), None)
            bad = next((k for k in r.anti if k in around(ANTI_WINDOW)), None)
            if value and (word or not r.require_keyword):
                confidence = r.conf_ok + (r.boost if word else 0) - (ANTI_PENALTY if bad else 0)
                reasons = ["格式匹配", *([f"上下文含关键词「{word}」"] if word else []), *([f"疑似非敏感上下文「{bad}」"] if bad else [])]
                yield Found(start, end, max(0.0, min(confidence, 0.99)), tuple(reasons))


def isolated(settings: Settings) -> Settings:
    """settings with extra rules as detectors of their own, so that a bad pattern of one doesn't end the job. Rules with a validator stay."""
    own = [r for r in settings.extra_rules if not r.validator]
    return replace(settings, extra_rules=tuple(r for r in settings.extra_rules if r.validator), detectors=settings.detectors + tuple(map(PatternDetector, own)))


def name_of(detector: Detector) -> str:
    return getattr(detector, "name", None) or f"{type(detector).__name__}({detector.type_id})"


def _checked(found: Iterable, text: str, det_ord: int, type_id: str) -> list[tuple]:
    spans = []
    for x in found:
        start, end, confidence, reasons = Found(*x)
        if not 0 <= start < end <= len(text):
            raise ValueError(f"no such place: {start} to {end} of {len(text)}")
        spans.append((det_ord, type_id, int(start), int(end), max(0.0, min(float(confidence), 0.99)), [str(r) for r in reasons], text[start:end]))
    return spans


@dataclass(frozen=True)
class Sent:
    """A detector as executors get it: pickled on its own, so that one that can't be loaded there is a failure as well."""

    det_ord: int
    name: str
    type_id: str
    pickled: bytes


def run_all(detectors: list[Sent], loaded: dict[int, Detector], text: str | None) -> tuple[list[tuple], list[tuple[str, str]]]:
    """Spans and failures of all detectors over a text. A detector that fails in between yields nothing for this text."""
    spans, failures = [], []
    for d in detectors if text is not None else []:
        try:
            if d.det_ord not in loaded:
                loaded[d.det_ord] = pickle.loads(d.pickled)
            spans += _checked(loaded[d.det_ord].run(text) or (), text, d.det_ord, d.type_id)
        except Exception as e:  # noqa: BLE001  whatever a detector raises is its own failure
            failures.append((d.name, f"{type(e).__name__}: {e}"[:ERROR_CHARS]))
    return spans, failures


def with_plugins(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows (norm, spans) with the spans of active detectors after those there, and failures: array<struct<detector, error>>."""
    active = set(settings.active())
    detectors = [Sent(PLUGIN_ORD + k, name_of(d), d.type_id, cloudpickle.dumps(d)) for k, d in enumerate(settings.detectors) if d.type_id in active]

    class Run:
        def __init__(self):
            self.loaded: dict[int, Detector] = {}

        def eval(self, text: str):
            yield run_all(detectors, self.loaded, text)

    found = F.udtf(Run, returnType=FOUND, useArrow=True)
    joined = rows.withColumnRenamed("spans", "_spans").lateralJoin(found(F.col("norm").outer()))
    return joined.withColumn("spans", F.concat("_spans", "spans")).drop("_spans")


def failures(found: DataFrame) -> DataFrame:
    """One row for each detector and document that it failed in: doc_id, detector, error. found: analyse() with detectors."""
    return found.select("doc_id", F.inline("failures"))

