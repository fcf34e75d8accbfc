"""Names of outputs, embedded mappings, blocks of pages, against plain Python."""

import io
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from inkveil.functions import boxes
from inkveil.plans import report, review
from inkveil.plans.analysis import analyse
from inkveil.registry import Settings
from inkveil.sources import docx, layout


def serial_names(paths):
    used, out = set(), {}
    for path in sorted(set(paths)):
        stem, kind = re.fullmatch(r"(.+?)(?:\.([^.]*))?", path.rsplit("/", 1)[1]).groups()
        kind = (kind or "").lower()
        base, n = stem, 2
        if base in used:
            base = f"{stem}_{kind}"
        while base in used:
            base, n = f"{stem}_{kind}{n}", n + 1
        used.add(base)
        out[path] = f"/out/{base}_脱敏{'.' + kind if kind else ''}"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_output_names(spark, seed):
    rng = random.Random(seed)
    paths = ["/in/a.docx", "/in/a.txt", "/in/a_txt.txt", "/in/a_txt.docx", "/in/none", "/x/none", "/in/b.md"]
    paths += [f"/{rng.choice('pqrstu')}{rng.randrange(9)}/{rng.choice(['a', 'a_txt', 'a_txt2', 'a_txt_txt', 'c_md', 'c', 'a_docx', 'a_docx3'])}.{rng.choice(['txt', 'docx', 'md', 'TXT'])}" for _ in range(120)]
    paths += [f"/many/{k:03}/a.txt" for k in range(60)]
    rows = spark.createDataFrame([(p, k) for k, p in enumerate([*paths, paths[0]])], "path string, stem int")
    got = review.output_paths(rows, "/out")
    assert got.columns == ["path", "stem", "output"]
    got = got.collect()
    want = serial_names(paths)
    assert len(got) == len(paths) + 1 and {r.path: r.output for r in got} == want
    assert len(set(want.values())) >= len({re.sub(r"\.[^.]*$", "", v) for v in want.values()}) == len(want)


def test_inputs_are_not_overwritten(spark, tmp_path):
    os.makedirs(f"{tmp_path}/real")
    os.symlink(f"{tmp_path}/real", f"{tmp_path}/link")
    (tmp_path / "real" / "a.txt").write_text("x")
    for path, folder in ((f"{tmp_path}/link/a.txt", f"{tmp_path}/real"), (f"file://{tmp_path}/real/./x/../a.txt", f"{tmp_path}/real"), ("s3://b/x//a.txt", "s3://b/x")):
        with pytest.raises(Exception, match="overwrite"):
            review.output_paths(spark.createDataFrame([(path,)], "path string"), folder, suffix="").collect()
    assert review.output_paths(spark.createDataFrame([], "path string"), "/out").count() == 0


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def word(text, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{docx.CONTENT_TYPES}"/>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{docx.RELATIONS}"/>')
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_embedded_mappings(spark):
    files = spark.createDataFrame([(1, word("一")), (2, word("二", **{"customXml/mapping.json": "old"})), (3, b"PK bad"), (4, word("四"))], "doc_id long, content binary")
    mappings = spark.createDataFrame([(1, '{"version": 1}'), (2, '{"version": 2}'), (3, "{}")], "doc_id long, mapping string")
    out = {r.doc_id: r for r in docx.embed_mappings(files, mappings).collect()}
    assert out[3].error and out[3].content is None and not out[4].error
    with zipfile.ZipFile(io.BytesIO(out[1].content)) as z:
        assert b"application/json" in z.read("[Content_Types].xml") and b"mapping.json" in z.read("word/_rels/document.xml.rels")
    again = docx.embed_mappings(spark.createDataFrame([(1, out[1].content)], "doc_id long, content binary"), mappings.limit(1)).first().content
    with zipfile.ZipFile(io.BytesIO(again)) as z:
        assert z.read("[Content_Types].xml").count(b"mapping.json") == 1

    rows = [("/r/a.docx", out[1].content), ("/r/b.docx", out[4].content), ("/r/c.docx", word("丙")), ("/r/d.txt", b"text"), ("/r/e.docx", b"PK")]
    beside = [(f"/r/{n}", b'{"beside": 1}') for n in ("a.mapping.json", "b.docx.mapping.json", "b_mapping.json", "d_mapping.json")]
    got = review.mapping_texts(spark.createDataFrame(rows, "path string, content binary"), spark.createDataFrame(beside, "path string, content binary"))
    assert {r.path[3]: (r.mapping, r.mapping_path) for r in got.collect()} == {
        "a": ('{"version": 1}', None), "b": ('{"beside": 1}', "/r/b.docx.mapping.json"), "c": (None, None), "d": ('{"beside": 1}', "/r/d_mapping.json"), "e": (None, None),
    }
    outside = docx.rewrite_word_files(spark.createDataFrame([(1, out[1].content)], "doc_id long, content binary"), spark.createDataFrame([], "doc_id long, start int, end int, original string, placeholder string"),
                                      report.block_offsets(docx.word_blocks(files.filter("doc_id = 1"))))
    with zipfile.ZipFile(io.BytesIO(outside.first().content)) as z:
        assert not [n for n in z.namelist() if "mapping" in n]


def brute_page(words):
    """Lines by the first word's top, words joined as the scripts ask."""
    ordered = sorted((w for w in words if w[0]), key=lambda w: (round(w[2], 1), w[1], w[2:]))
    lines, anchor = [], None
    for w in ordered:
        if anchor is None or abs(w[2] - anchor) > 3.0:
            lines.append([])
            anchor = w[2]
        lines[-1].append(w)
    cjk = lambda c: 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0x3000 <= ord(c) <= 0x303F
    text, found = "", []
    for line in lines:
        text += "\n" if text else ""
        for k, w in enumerate(line):
            text += " " if k and not cjk(line[k - 1][0][-1]) and not cjk(w[0][0]) else ""
            found.append((len(text), len(text) + len(w[0]), *w[1:]))
            text += w[0]
    return text, found


def test_pages(spark):
    rng = random.Random(3)
    words = []
    for doc, page, n in ((1, 1, 200), (1, 3, 90), (2, 1, 1), (3, 2, 40)):
        for _ in range(n):
            top = rng.randrange(600) / 8
            words.append((doc, page, rng.choice(["word", "合同", "a甲", "（一）", "x", "㐀b", "mail@host.org", "", None]), float(rng.randrange(50)), top, float(rng.randrange(50, 60)), top + 5.5))
    words.append((4, 1, "", 0.0, 0.0, 1.0, 1.0))
    table = spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, top double, x1 double, bottom double")
    blocks = layout.page_blocks(table).cache()
    got = {(r.doc_id, r.page): r for r in blocks.collect()}
    by_page = {}
    for d, p, *w in words:
        by_page.setdefault((d, p), []).append(w)
    want = {k: brute_page(v) for k, v in by_page.items()}
    assert got.keys() == {k for k, v in want.items() if v[0].strip()}
    for k, r in got.items():
        assert (r.text, [tuple(b) for b in r.word_boxes]) == want[k]
    assert {(r.doc_id, r.page): r.block_index for r in blocks.filter("doc_id = 1").collect()} == {(1, 1): 0, (1, 3): 1}
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (4, 1)], "doc_id long, page int")
    warned = {r.doc_id: r.warnings for r in layout.page_warnings(pages, blocks).collect()}
    assert warned[1] == ["第 2 页无可提取文字，需先检查图片或OCR", "第 5 页无可提取文字，需先检查图片或OCR"] and warned[4] == ["第 1 页无可提取文字，需先检查图片或OCR", review.NO_TEXT]

    offsets = report.block_offsets(blocks)
    found = analyse(docx.documents_of(offsets), Settings(only=frozenset({"EMAIL"}), propagate=False))
    occurrences = review.read_reports(report.report_json(found, offsets)).collect()
    assert len(occurrences) == sum(1 for w in words if w[2] == "mail@host.org")
    starts = {r.doc_id: {} for r in offsets.collect()}
    for r in offsets.collect():
        starts[r.doc_id][r.page] = r.start
    for o in occurrences:
        a, b = o.start - starts[o.doc_id][o.page], o.end - starts[o.doc_id][o.page]
        hit = [w for w in want[o.doc_id, o.page][1] if w[1] > a and w[0] < b]
        assert o.bbox == [min(w[2] for w in hit), min(w[3] for w in hit), max(w[4] for w in hit), max(w[5] for w in hit)]


def test_boxes(spark):
    rng = random.Random(4)
    at, words = 0, []
    for _ in range(80):
        at += rng.randrange(3)
        words.append((at, at := at + rng.randrange(1, 6), *(float(rng.randrange(99)) for _ in range(4))))
    asked = [(rng.randrange(-3, at + 3), rng.randrange(-3, at + 9)) for _ in range(300)]
    kind = f"w array<{boxes.WORD_BOX}>, q array<struct<a:int,b:int>>"
    for given in (words, [], None):
        row = spark.createDataFrame([(given, asked)], kind).select(F.transform("q", lambda q: boxes.box_of(F.col("w"), q["a"], q["b"])).alias("b")).first()
        for (a, b), box in zip(asked, row.b, strict=True):
            hit = [w for w in given or [] if a < b and w[1] > a and w[0] < b]
            assert box == ([min(w[2] for w in hit), min(w[3] for w in hit), max(w[4] for w in hit), max(w[5] for w in hit)] if hit else None)
