import io
import zipfile

import pytest

from inkveil.operators import rewrite
from inkveil.plans import report
from inkveil.plans.analysis import analyse
from inkveil.registry import Settings
from inkveil.sources import docx
from inkveil.sources.text import blocks_from_documents, full_text, output_name, read_allowlist, read_text_files
from inkveil.streaming import jobs

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:w14" mc:Ignorable="w14"'


def word_file(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


BODY = (
    "<w:p><w:r><w:t>联系电话：138</w:t></w:r><w:r><w:t>0013</w:t></w:r><w:r><w:t>8001</w:t><w:tab/><w:t>完</w:t></w:r></w:p>"
    "<w:p><w:r><w:t xml:space='preserve'>  </w:t></w:r></w:p><w:p><w:del><w:r><w:delText>日期 2024-03-15</w:delText></w:r></w:del></w:p>"
)


def test_word(spark):
    header = f"<w:hdr {NS}><w:p><w:r><w:t>邮箱 a.b@mail.org</w:t></w:r></w:p></w:hdr>"
    good = word_file(BODY, **{"word/header1.xml": header, "customXml/item1.xml": "<x/>", "docProps/core.xml": "<c><creator>me</creator></c>"})
    rows = [(1, good), (2, b"no zip"), (3, None), (5, word_file("", **{"word/x.xml": "<!DOCTYPE a><a/>"}))]
    files = spark.createDataFrame(rows, "doc_id long, content binary")
    blocks = docx.word_blocks(files)
    got = {r.doc_id: r for r in blocks.filter("error is not null").collect()}
    assert set(got) == {2, 3, 5}
    texts = [r.text for r in blocks.filter("doc_id = 1").orderBy("block_index").collect()]
    assert texts == ["联系电话：13800138001 完", "日期 2024-03-15", "邮箱 a.b@mail.org"]
    assert docx.word_blocks(files.filter("doc_id = 1"), headers=False).count() == 2
    docs = docx.documents_of(blocks)
    items = rewrite.mapping_items(analyse(docs, Settings(propagate=False)))
    out = docx.rewrite_word_files(files.filter("doc_id = 1"), items, report.block_offsets(blocks.filter("block_index is not null"))).first()
    assert out.error is None and out.applied == 3
    word = docx.WordFile(bytes(out.content))
    assert [word.text(p) for _, p in word.paragraphs] == ["联系电话：[手机号码#1] 完", "日期 [日期#1]", "邮箱 [电子邮箱#1]"]
    assert "customXml/item1.xml" not in word.data and b"creator" not in word.data["docProps/core.xml"]
    assert b'xmlns:w14="urn:w14"' in word.data["word/document.xml"]
    word = docx.WordFile(word_file(BODY, **{"word/embeddings/a.bin": b"x"}))
    with pytest.raises(docx.WordError):
        word.for_outside()
    with pytest.raises(docx.WordError):
        word.replace(0, [(0, 2, "别的", "x")])


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  \ntwo\r\nthree", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "allow.lst").write_text("# note\n\n 张三 \n")
    docs = read_text_files(spark, str(tmp_path))
    row = docs.select("file_type", full_text(docs.text).alias("t"), output_name(docs.path).alias("name")).first()
    assert docs.count() == 1 and (row.file_type, row.t, row.name) == ("txt", "one\ntwo\nthree", "a_脱敏.txt")
    assert [(r.block_index, r.text, r.location) for r in blocks_from_documents(docs).orderBy("block_index").collect()] == [(0, "one", "第 1 行"), (1, "two", "第 4 行"), (2, "three", "第 5 行")]
    assert [r.value for r in read_allowlist(spark, str(tmp_path / "allow.lst")).collect()] == ["张三"]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a.b@mail.org"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    items = jobs.stream_items(jobs.stream_documents(spark, f"{tmp_path}/in", docs.schema), Settings(only=frozenset({"EMAIL"}), propagate=False))
    for _ in range(2):  # what has been read once isn't read again
        jobs.write_items(items.select("doc_id", "value"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "a.b@mail.org")]


def test_views_cover_every_order(spark):
    from inkveil.fixtures import CONTRACTS, VALUES

    orders = spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, id + 0.5D AS o_totalprice, DATE '1995-03-15' AS o_orderdate FROM range(1, 43)")
    for view in (CONTRACTS, VALUES):
        got = spark.sql(view.replace("FROM orders", "FROM {orders}"), orders=orders).select("doc_id").collect()
        assert sorted(r.doc_id for r in got) == list(range(1, 43))


def test_rule_tables():
    from inkveil.sources import rules

    table = """
| # | id | c | s | label | m | p | on | re |
|---|:--|--|--|--|--|--|--|--|
| 1 | NEW | 其他 | 高 | 一二三四五六七八九十一二三四五六 | x | keep_head=1；keep_tail=0; mask=none; other; =3 | 是 | a\\|b\\d |
|2|URL||medium|u|x|replacement=[x]|否|
| 3 | LEFT | x | 低 | no pattern | x | | 是 |
| 4 | short | x |
|  | EMPTY | x | 低 | l | m | | 是 | z |
```
| 5 | DATE | x | 高 | fenced | m | | 否 |
```
| 6 | DATE | x | ? | d | m | keep_tail=4;mask=passport | ✓ |
"""
    rows = {r.type_id: r for r in rules.table_rows(table)}
    assert rows.keys() == {"NEW", "URL", "LEFT", "DATE"}
    assert rows["NEW"] == rules.RuleRow("1", "NEW", "其他", "high", "一二三四五六七八九十一二三四", {"keep_head": 1, "keep_tail": 0}, True, "a|b\\d")
    st = rules.with_rule_table(Settings(), table)
    types, before = st.type_map(), Settings().type_map()
    assert [(r.type_id, r.pattern, r.conf_ok, r.boost) for r in st.extra_rules] == [("NEW", "a|b\\d", 0.7, 0.1)] and "LEFT" not in types
    assert (types["URL"].severity, types["URL"].enabled, types["URL"].replacement, types["URL"].mask) == ("medium", False, "[x]", None)
    assert (types["DATE"].severity, types["DATE"].keep_tail, types["DATE"].mask, types["DATE"].enabled) == (before["DATE"].severity, 4, "passport", True)
    assert rules.cells_of("|a|b \\| c||") == ["a", "b | c"] and rules.cells_of("| a || b |") == ["a", "", "b"]


def test_settings_in_json():
    from inkveil.sources.rules import settings_from_json

    base = Settings(min_confidence=0.3, only=frozenset({"URL"}), allowlist=frozenset({"x"}))
    same = settings_from_json("{}", base)
    assert (same.min_confidence, same.only, same.allowlist) == (0.3, {"URL"}, {"x"})
    st = settings_from_json('{"min_confidence": 1, "only": [], "disabled": ["DATE"], "custom_rules": [{"type_id": "A", "pattern": "a", "priority": 7, "keep_head": "1", "keywords": ["k"]}, {"type_id": "URL", "pattern": "u"}]}')
    assert st.min_confidence == 1.0 and st.only is None and st.disabled == {"DATE"} and len(st.extra_rules) == 2
    meta, rule = st.type_map()["A"], st.extra_rules[0]
    assert (meta.label, meta.category, meta.severity, meta.keep_head, meta.keep_tail, meta.priority) == ("A", "自定义", "medium", 1, 2, 7)
    assert (rule.conf_ok, rule.conf_weak, rule.keywords, rule.boost, rule.require_keyword) == (0.7, 0.4, ("k",), 0.15, False)


def test_page_texts_are_computed_once(spark):
    from inkveil.sources import layout

    words = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 9.0, 6.0), (1, 1, " ", 10.0, 0.0, 19.0, 6.0), (1, 2, " ", 0.0, 0.0, 9.0, 6.0)], "doc_id long, page int, text string, x0 double, top double, x1 double, bottom double")
    blocks = layout.page_blocks(words)
    assert [(r.page, r.text, [(b.start, b.end) for b in r.word_boxes]) for r in blocks.collect()] == [(1, "a  ", [(0, 1), (2, 3)])]
    # the filter on the text has no copy of it, and boxes that nobody asks for aren't made
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(blocks).count("array_join(") == 1
    assert plan(blocks.select("text")).count("x0") < plan(blocks).count("x0")
