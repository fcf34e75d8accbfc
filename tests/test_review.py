"""Positions by line, full reports, selections, logs, names of outputs, Word files restored, bad files."""

import io
import json
import zipfile

import pytest

from inkveil.operators import rewrite
from inkveil.plans import report, review
from inkveil.plans.analysis import analyse
from inkveil.registry import Settings
from inkveil.sources import docx
from inkveil.sources.text import as_read, blocks_from_documents, list_files

ST = Settings(only=frozenset({"EMAIL", "PHONE_MOBILE"}), propagate=False)
TEXTS = [
    (1, "\n\n联系电话：13800138001\r\n\r\n邮箱 a.b@corp.cn\n\n\n13800138001 ​13900139002\n"),
    (2, "x" + "\n" * 81 + "m@firm.com"),
    (3, "没有"),
    (4, None),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = analyse(as_read(docs), ST)
    return docs, rows, report.block_offsets(blocks_from_documents(docs))


def test_every_place_has_its_line(found):
    """Lines by searching the raw text: blank lines, CRLF and zero-width characters between."""
    docs, rows, blocks = found
    got = {(r["doc_id"], r["位置"], r["原文值"]) for r in report.csv_report(rows, blocks).collect()}
    want = set()
    for doc, text in TEXTS:
        for n, line in enumerate((text or "").splitlines(), 1):
            for value in ("13800138001", "13900139002", "a.b@corp.cn", "m@firm.com"):
                if value in line:
                    want.add((doc, f"第 {n} 行", value))
    assert got == want and len(want) == 5
    # a place in no block stays
    assert report.csv_report(rows, blocks.filter("doc_id = 99")).count() == 5


def test_report_and_mapping(found):
    docs, rows, blocks = found
    reports = report.report_json(rows, blocks, ST, review.warnings_of(docs), "2024-01-01T00:00:00+00:00")
    whole = {r.doc_id: json.loads(r.report) for r in reports.collect()}
    one = whole[1]
    assert one["summary"]["by_type"] == {"PHONE_MOBILE": 3, "EMAIL": 1} and list(one["summary"]["by_type"]) == ["PHONE_MOBILE", "EMAIL"]
    assert one["source"]["blocks"] == 3 and one["warnings"] == [] and whole[3]["warnings"] == [review.NO_TEXT] and whole[3]["items"] == []
    assert one["settings"]["min_severity"] == ST.min_severity and one["generated_at"].startswith("2024") and "ID_CARD" in one["settings"]["disabled_types"]
    for doc in (1, 2):
        lines = [t for t in TEXTS[doc - 1][1].splitlines() if t.strip()]
        for item in whole[doc]["items"]:
            for o in item["occurrences"]:
                a, b = o["local_offset"]
                assert lines[o["block_index"]][a:b] == o["text"] and o["offset"][1] - o["offset"][0] == b - a and o["block_type"] == "line" and o["page"] is None
    back = review.read_reports(reports)
    items = rewrite.mapping_items(rows)
    places = ["doc_id", "type_id", "start", "end", "text"]
    assert sorted(map(tuple, back.select(*places).collect())) == sorted(map(tuple, items.withColumnRenamed("original", "text").select(*places).collect()))
    mapping = {r.doc_id: json.loads(r.mapping) for r in report.mapping_json(items, blocks).collect()}
    assert [e["occurrences"] for e in mapping[1]["entities"]] == [1, 2, 1] and {i["block_location"] for i in mapping[2]["items"]} == {"第 82 行"}
    assert report.read_mapping(report.mapping_json(items, blocks)).count() == items.count()


def test_selection_files(spark, found):
    _, rows, _ = found
    items = rewrite.mapping_items(rows)
    chosen = items.filter("doc_id = 1 and start > 20")
    files = review.selection_json(chosen, 0.5, "low")
    got = review.selected(items, review.read_selections(files))
    assert sorted(map(tuple, got.select("doc_id", "start").collect())) == sorted(map(tuple, chosen.select("doc_id", "start").collect()))
    types_only = spark.createDataFrame([(1, '{"source": "x", "enabled_types": ["EMAIL"]}')], "doc_id long, selection string")
    assert [r.type_id for r in review.selected(items, review.read_selections(types_only)).collect()] == ["EMAIL"]
    bogus = spark.createDataFrame([(1, '{"enabled_types": ["EMAIL"], "enabled_items": [{"type": "EMAIL", "offset": [999, 1010]}]}')], "doc_id long, selection string")
    with pytest.raises(rewrite.SelectionError):
        review.selected(items, review.read_selections(bogus))
    assert review.selected(items, review.read_selections(bogus), strict=False).count() == 0
    allowed = spark.createDataFrame([("13800138001",)], "value string")
    assert review.without_values(items, allowed).count() == items.count() - 2


def test_export_logs_and_numbers(spark, found):
    docs, rows, _ = found
    redacted, items = rewrite.redact(rows), rewrite.mapping_items(rows)
    warned = review.warnings_of(docs)
    with pytest.raises(review.ExportError):
        review.exportable(redacted, warned)
    assert {r.doc_id for r in review.exportable(redacted, warned, strict=False).collect()} == {1, 2}
    log = {r.doc_id: json.loads(r.log) for r in review.redaction_log(redacted, items).collect()}
    assert log[1]["applied"] == 4 and log[1]["enabled_types"] == ["EMAIL", "PHONE_MOBILE"] and len(log[1]["items"]) == 4 and log[3]["applied"] == 0
    cut = redacted.withColumn("text", redacted["text"].substr(1, 12))
    back = rewrite.restore(cut, items)
    log = {r.doc_id: json.loads(r.log) for r in review.restore_log(back, items, rewrite.missing_placeholders(cut, items)).collect()}
    assert log[2]["applied"] == 1 and log[1]["missing_placeholders"] and log[1]["items"]
    numbers = spark.createDataFrame([(1, "T", "A", 1), (1, "T", "B", 2)], "doc_id long, type_id string, key string, number int")
    unseen = spark.createDataFrame([(1, "T", "C", 9), (1, "T", "D", 4), (1, "T", "A", 1), (1, "U", "E", 2), (1, "T", "D", 30)], "doc_id long, type_id string, key string, first int")
    got = {(r.type_id, r.key): r.number for r in review.number_unseen(numbers, unseen).collect()}
    assert got == {("T", "A"): 1, ("T", "B"): 2, ("T", "D"): 3, ("T", "C"): 4, ("U", "E"): 1}


def test_output_names_and_mappings(spark):
    files = spark.createDataFrame([("/a/x.docx",), ("/a/x.txt",), ("/b/x.docx",), ("/b/x.txt",), ("/b/x.md",), ("/a/y",)], "path string")
    got = {r.path: r.output for r in review.output_paths(files, "/out").collect()}
    assert len(set(got.values())) == 6 and got["/a/x.docx"] == "/out/x_脱敏.docx" and got["/a/x.txt"] == "/out/x_txt_脱敏.txt" and got["/a/y"] == "/out/y_脱敏"
    with pytest.raises(Exception, match="overwrite"):
        review.output_paths(files, "/a", suffix="").collect()
    mappings = spark.createDataFrame([("/o/x.docx.mapping.json",), ("/o/x.mapping.json",), ("/o/z_mapping.json",)], "path string")
    redacted = spark.createDataFrame([("/o/x.docx",), ("/o/x.txt",), ("/o/z.txt",), ("/o/w.txt",)], "path string")
    got = {r.path: r.mapping_path for r in review.mapping_of(redacted, mappings).collect()}
    assert got == {"/o/x.docx": "/o/x.docx.mapping.json", "/o/x.txt": "/o/x.mapping.json", "/o/z.txt": "/o/z_mapping.json", "/o/w.txt": None}


def word(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{run}</w:t></w:r>' for run in p)}</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_files_there_and_back(spark):
    files = spark.createDataFrame([(1, word(["联系电话：138", "00138001"], ["再打 13800138001", " 或 13900139002"])), (2, word(["无"]))], "doc_id long, content binary")
    blocks = docx.word_blocks(files)
    placed = report.block_offsets(blocks.filter("error is null"))
    items = rewrite.mapping_items(analyse(docx.documents_of(blocks), ST))
    redacted = docx.rewrite_word_files(files, items, placed)
    texts = {r.doc_id: r.text for r in docx.documents_of(docx.word_blocks(redacted)).collect()}
    assert "138" not in texts[1] and texts[1].count("#1]") == 2 and texts[1].count("#2]") == 1
    back = docx.restore_word_files(redacted, rewrite.mapping_sequences(items))
    got = {r.doc_id: r for r in back.collect()}
    assert got[1].restored == 3 and got[1].error is None and got[1].missing == [] and got[2].restored == 0
    assert {r.doc_id: r.text for r in docx.documents_of(docx.word_blocks(back)).collect()} == {1: "联系电话：13800138001\n再打 13800138001 或 13900139002", 2: "无"}
    short = rewrite.mapping_sequences(items.filter("start < 10"))
    assert "more places" in docx.restore_word_files(redacted, short).filter("doc_id = 1").first().error
    outside = items.selectExpr("doc_id", "start + 500 as start", "end + 500 as end", "original", "placeholder")
    assert "no paragraph" in docx.rewrite_word_files(files, outside, placed).filter("doc_id = 1").first().error


def test_bad_files_cost_their_row_only(spark, tmp_path):
    good = word(["好"])
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"<a/>" * 400)
    raw = bytearray(packed.getvalue())
    raw[60:70] = b"\xff" * 10  # the packed data
    locked = bytearray(good)
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1  # said to be encrypted
    odd = bytearray(good)
    odd[odd.index(b"PK\x01\x02") + 10] = 77  # an unknown way of packing
    rows = [(1, good), (2, bytes(raw)), (3, bytes(locked)), (4, bytes(odd)), (5, good[:50]), (6, None), (7, b"")]
    got = docx.word_blocks(spark.createDataFrame(rows, "doc_id long, content binary")).collect()
    assert {r.doc_id: r.error is None for r in got} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}
    (tmp_path / "a.txt").write_text("text")
    (tmp_path / "b.doc").write_bytes(b"old")
    listed = {r.path.rsplit("/", 1)[-1]: (r.kind, r.error is None) for r in list_files(spark, str(tmp_path), strict=False).collect()}
    assert listed == {"a.txt": ("text", True), "b.doc": (None, False)}
    with pytest.raises(Exception, match="docx first"):
        list_files(spark, str(tmp_path)).select("error").collect()


def _broadcasts(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_blocks_and_mappings_are_not_broadcast(spark):
    """The optimiser takes both for small: at 0.1 GB the driver had no room for them."""
    docs = spark.createDataFrame([(1, "电话：13800138001\n\n邮箱 a.b@mail.org"), (2, None)], "doc_id long, text string")
    settings = Settings(only=frozenset({"PHONE_MOBILE", "EMAIL"}), propagate=False)
    blocks = report.block_offsets(blocks_from_documents(docs))
    found = analyse(as_read(docs), settings)
    lines = report.csv_report(found, blocks)
    assert sorted((r["类型"], r["位置"]) for r in lines.collect()) == [("EMAIL", "第 3 行"), ("PHONE_MOBILE", "第 1 行")] and not _broadcasts(lines)
    items = rewrite.mapping_items(found)
    lost = rewrite.unmapped_placeholders(rewrite.redact(found), items.filter("type_id = 'EMAIL'"))
    assert [r.placeholder for r in lost.collect()] == ["[手机号码#1]"] and not _broadcasts(lost)
    assert not _broadcasts(rewrite.restore(rewrite.redact(found), items)) and not _broadcasts(rewrite.apply_items(docs, items))
