import pytest
from pyspark.sql import functions as F

from inkveil.operators import rewrite
from inkveil.plans import report
from inkveil.plans.analysis import analyse
from inkveil.registry import Settings
from inkveil.sources.rules import settings_from_json, with_rule_table

CONTRACT = """合同编号：HT-2024-0088-A
签署日期：2024-03-15
甲方：北京星海智能科技有限公司（以下简称“星海智能”）
统一社会信用代码：91110108MA01ABCD2X
法定代表人：张三
身份证号：110105194912310020
联系电话：13800138001，座机 010-8666 2188
电子邮箱：zhang.san@example.com
合同金额：人民币 1,280,000.00 元
星海智能 委托乙方提供服务。张三向李四支付款项。token = sk-abcdefghijklmnop1234
卡号：６２２５​８８０１３７７０６８６８"""

SCHEMA = "doc_id long, text string, extra string, spans int"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, CONTRACT, "x", 1), (2, None, None, None), (3, "", None, 1), (4, "nothing to see", "y", 2), (4, "nothing to see", "y", 2), (None, "mail a.b@mail.org", None, 0)]
    return analyse(spark.createDataFrame(rows, SCHEMA)).cache()


def test_candidates(found):
    got = {(r.type_id, r.value): r for r in report.candidate_table(found.filter("doc_id = 1")).collect()}
    assert got["PERSON_NAME", "张三"]["count"] == 2 and got["PERSON_NAME", "张三"].number == 1
    assert got["PERSON_NAME", "李四"].number == 2
    assert got["ORG_NAME", "星海智能"].number == got["ORG_NAME", "北京星海智能科技有限公司"].number == 1
    assert got["USCC", "91110108MA01ABCD2X"].confidence == 0.77 and got["ID_CARD", "110105194912310020"].confidence == 0.54
    assert got["PHONE_LANDLINE", "010-8666 2188"].masked == "010-****2188"
    assert {"EMAIL", "AMOUNT", "DATE", "CONTRACT_NO", "SECRET", "PHONE_MOBILE"} <= {t for t, _ in got}
    assert ("BANK_CARD", "６２２５​８８０１３７７０６８６８") in got  # as it stands in the raw text


def test_edges(found):
    rows = {r.doc_id: r for r in found.filter("doc_id is null or doc_id in (2, 3)").select("doc_id", "candidates").collect()}
    assert not rows[2].candidates and not rows[3].candidates
    assert rows[None].candidates[0].value == "a.b@mail.org"
    assert found.filter("doc_id = 4").count() == 2
    assert analyse(found.sparkSession.createDataFrame([], SCHEMA)).count() == 0


def test_disjoint_and_literal(found):
    for row in found.filter("kept is not null").select("raw", "kept").collect():
        spans = sorted(row.kept, key=lambda s: s.start)
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:], strict=False))
        assert all(row.raw[s.raw_start : s.raw_end] == s.value for s in spans)


def test_round_trip(found):
    items = rewrite.mapping_items(found)
    redacted = rewrite.redact(found)
    text = redacted.filter("doc_id = 1").first().text
    assert "张三" not in text and "[自然人姓名#1]" in text and "13800138001" not in text
    back = rewrite.restore(redacted.filter("doc_id = 1"), items).first()
    assert back.text == CONTRACT and back.excess == 0
    more = redacted.filter("doc_id = 1").withColumn("text", F.concat("text", F.lit("[日期#1]")))
    assert rewrite.restore(more, items).first().excess == 1
    again = report.read_mapping(report.mapping_json(items.filter("doc_id = 1")))
    assert rewrite.restore(redacted.filter("doc_id = 1"), again).first().text == CONTRACT


def test_selection(found):
    spark, items = found.sparkSession, rewrite.mapping_items(found)
    bogus = spark.createDataFrame([(1, "PHONE_MOBILE", 999, 1010)], "doc_id long, type_id string, start int, end int")
    with pytest.raises(rewrite.SelectionError):
        rewrite.select_items(items, bogus)
    one = items.filter("type_id = 'DATE'")
    assert rewrite.select_items(items, one).count() == 1


def test_settings(spark):
    table = "| # | id | 归类 | 级别 | 名称 | 方法 | 参数 | 启用 | 正则 |\n|--|--|--|--|--|--|--|--|--|\n| 1 | ZQC | 其他 | 高 | 证书号 | 正则 | keep_head=2; keep_tail=3 | 是 | ZQC[0-9]{8} |\n| 2 | DATE | x | 低 | 日期 | - | keep_head=4 | 否 |\n```\n| 3 | URL | x | 低 | u | - | - | 否 |\n```\n"
    st = with_rule_table(Settings(), table)
    docs = spark.createDataFrame([(1, "证书 ZQC12345678 于 2024-03-15 见 http://example.com/ab")], "doc_id long, text string")
    got = {r.type_id: r.masked for r in report.candidate_table(analyse(docs, st)).collect()}
    assert got["ZQC"] == "ZQ******678" and "DATE" not in got and "URL" in got
    st = settings_from_json('{"min_confidence": 0.6, "only": ["DATE"], "allowlist": ["2024-03-15"]}')
    assert report.candidate_table(analyse(docs, st)).count() == 0


def test_negatives(spark):
    docs = spark.createDataFrame([(1, "商务合作及违约责任由双方承担。患者住院治疗。"), (2, "甲方应于收到通知后付款")], "doc_id long, text string")
    assert report.candidate_table(analyse(docs)).filter(F.col("type_id").isin("PERSON_NAME", "ADDRESS", "ORG_NAME")).count() == 0


def test_all_surnames_of_the_reference(spark):
    rare = "卫褚屈丰卓单宁甘骆"
    docs = spark.createDataFrame([(k, f"法定代表人：{x}启明\n身份证号：110105194912310020\n{x}启明向李四支付款项。", "x", 1) for k, x in enumerate(rare)], SCHEMA)
    got = {(r.doc_id, r.value) for r in report.candidate_table(analyse(docs)).filter("type_id = 'PERSON_NAME'").collect()}
    assert {(k, f"{x}启明") for k, x in enumerate(rare)} <= got
    assert len(set(Settings().surnames)) == len(Settings().surnames) == 434


def _times(column, word):
    return str(column).lower().count(word)


def test_names_of_organisations_are_stripped_once(spark):
    """Within lambdas Spark computes an expression at each place where it stands: long ones stand at one."""
    from inkveil.operators import entities

    x = F.col("x")
    assert _times(entities.org_core(x), "regexp_extract(") <= 2 * entities.ROUNDS
    assert _times(entities.same_org(F.upper(x), F.lower(x)), "lower(") == 1


def test_values_and_names_before_endings_are_taken_once(spark):
    from inkveil.functions import checks
    from inkveil.operators import context

    x = F.col("x")
    assert _times(checks.id_card(x), "upper(") == 1 and _times(checks.uscc(x), "upper(") == 1
    assert _times(context.organisations(x), "reverse(") <= 4
