"""The analysis row by row beside that by columns, on texts put together at random."""

import random

import pytest

from inkveil.operators import context as c
from inkveil.operators import rowwise
from inkveil.operators.detect import detect
from inkveil.operators.resolve import candidates, resolve
from inkveil.plans.analysis import COLUMNS, analyse
from inkveil.registry import Rule, Settings

WORDS = [
    *c.PARTIES, *c.ROLES, *c.NAME_STOPWORDS[:20], *c.ROLE_WORDS, *c.NAME_TAILS, *c.NAME_CUES, *c.ACTIONS, *c.LEADS, *c.ORG_STOPWORDS, *c.ADDRESS_LABELS, *c.ADDRESS_FIELDS,
    *c.ADDRESS_PARTS, *c.ORG_STRONG, *c.ORG_WEAK, *c.ORG_LEADS, *c.ORG_PARTIES, "北京", "上海", "浙江省", "杭州市", "海淀区", "内蒙古自治区", "星海智能", "云启", "科技", "李博文",
    "周宁", "欧阳子涵", "王", "张三", *"：:，。\n\n\t 　（）()“”、·-&", "\r\n", " ", "\x85", "简称", "以下简称", "下称", "住", "3号", "12 号楼", "110105198003157806",
    "11010519800315780X", "1101010119900101123", "13812345678", "13133133111", "１３８１２３４５６７８", "138​12345678", "010-86661234", "400-800-8888", "（010）86661234",
    "a.b@corp.cn", "4111111111111111", "4111 1111 1111 1111", "91110105MA0000001X", "E12345678", "H1234567890", "人民币 1,234.50 元", "100万元", "壹佰万元整", "12,345.67",
    "2024-05-06", "1999 年 12 月", "(2024)京民初12号", "京民〔2024]号", "合同编号：HT-0001-A", "车牌京A1234学", "邮编：100081", "微信号：wx_12345678", "QQ 123456", "192.168.1.1",
    "https://example.com/a.b", "A123456(3)", "税号：AB1234567890123", "注册号：123456789012345", "token=abcd1234efgh", "sk-abcdefghijklmnop1234", "AA:BB:CC:DD:EE:01",
    "账号 6222021234567", "​", "﻿", "ﬁ", "Ａ", "㈱", "\U0001f600", "𠮷", "﷐", "XXX", "某某公司", "1234567890",
]
EVERY = frozenset(t.type_id for t in Settings().types)


@pytest.fixture(scope="module")
def docs(spark):
    chance = random.Random(7)
    texts = ["".join(chance.choice(WORDS) for _ in range(chance.choice([3, 8, 20, 60, 150]))) for _ in range(1500)]
    names = ["李博文", "周宁", "王晓宁", "赵子涵", "孙晓", "吴博文", "郑嘉怡", "冯丽娟", "卫星辰", "韩启明"]
    texts += [None, "", " ", "\n", "周宁", "周宁\n", "周宁 ", "a" * 3000 + "有限公司", "北京" + "大" * 300 + "有限公司", "".join(f"姓名：{n}，电话。{n}说" for n in names)]
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(8).localCheckpoint()


@pytest.mark.parametrize(
    "settings",
    [
        Settings(),
        Settings(forced=EVERY, propagate=False, min_confidence=0.0),
        Settings(allowlist=frozenset({"李博文", "星海智能", "13812345678"}), min_severity="medium", disabled=frozenset({"DATE"}), fix_case_no=True),
    ],
)
def test_rows_equal_columns(docs, settings):
    by_columns = candidates(resolve(detect(docs, settings), settings), settings).select("doc_id", *COLUMNS)
    by_rows = analyse(docs, settings)
    assert by_rows.schema.simpleString() == by_columns.schema.simpleString()
    want, got = ({r["doc_id"]: r for r in rows.collect()} for rows in (by_columns, by_rows))
    assert sum(len(r["candidates"]) for r in want.values()) > 5000
    assert [k for k in want if want[k] != got[k]] == [] and len(want) == len(got) == docs.count()


def test_columns_asked_for(docs):
    few = analyse(docs, columns=("kept",))
    assert few.columns == ["doc_id", "kept"]
    assert {tuple(r) for r in few.selectExpr("doc_id", "size(kept)").collect()} == {tuple(r) for r in analyse(docs).selectExpr("doc_id", "size(kept)").collect()}


def test_rules_of_users_stay_with_columns():
    assert rowwise.supported(Settings())
    assert not rowwise.supported(Settings(extra_rules=(Rule("T", r"\p{IsHan}++", 0.9, 0.9),)))
