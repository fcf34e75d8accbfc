import pytest
from pyspark.sql import functions as F

from inkveil.functions import checks, masks, text
from inkveil.operators import entities


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(("value", "f", "want"), [
    ("440305199001012347", lambda v: masks.keep(v, 6, 4), "440305********2347"),
    ("13800005678", lambda v: masks.keep(v, 3, 4), "138****5678"),
    ("赵启明", masks.person, "赵**"), ("欧阳晓宁", masks.person, "欧阳**"), ("010-8666 2188", masks.landline, "010-****2188"),
    ("0755-86329871", masks.landline, "0755-****9871"), ("400-800-8888", masks.landline, "400-***8888"), ("a@b.cn", masks.email, "a***@b.cn"),
    ("A123456(7)", masks.hk_id, "A******(7)"), ("10.1.2.3", masks.ipv4, "10.*.*.*"), ("ab", lambda v: masks.keep(v, 1, 1), "****"), ("", masks.first_only, "*"),
])
def test_masks(spark, value, f, want):
    assert one(spark, value, f) == want


def test_checks(spark):
    body = "11010519491231002"
    weights, digits = checks.ID_WEIGHTS, checks.ID_DIGITS
    good = body + digits[sum(int(c) * w for c, w in zip(body, weights, strict=True)) % 11]
    assert one(spark, good, checks.id_card) is True
    assert one(spark, body + ("0" if good[-1] != "0" else "1"), checks.id_card) is False
    assert one(spark, "123", checks.id_card) is None
    assert one(spark, "I" * 18, checks.uscc) is None
    assert one(spark, "6225 8801 3770 6868", checks.luhn) is True
    assert one(spark, "42", checks.luhn) is False


@pytest.mark.parametrize(("value", "want"), [("000000", True), ("12345678", False), ("1234567890123", True), ("XXX", True), ("", True), ("甲方", True), ("13800138001", False), ("112211", True)])
def test_placeholder(spark, value, want):
    assert one(spark, value, checks.is_placeholder) is want


def test_normalise_and_places(spark):
    raw = "Ａ​１－2\t。"
    assert one(spark, raw, text.normalize) == "A1-2 。"
    assert one(spark, raw, text.norm_index) == [0, 2, 3, 4, 5, 6]
    assert one(spark, "plain", text.norm_index) is None
    assert one(spark, None, text.normalize) is None


def test_org_names(spark):
    assert one(spark, "北京星海智能科技有限公司", entities.org_core) == "星海智能科技"
    assert one(spark, "中国工商银行股份有限公司", entities.org_core) == "工商银行"
    assert one(spark, "中国银行", entities.org_core) == "中国银行"
    assert one(spark, "上海分公司", entities.org_core) == "上海分公司"


def test_placeholder_text(spark):
    row = spark.createDataFrame([(" [a#12] ",), ("x[a#1]",), (None,)], "v string").select(*entities.parse_placeholder(F.col("v"))).collect()
    assert [tuple(r) for r in row] == [("a", 12), (None, None), (None, None)]


def test_nfkc_and_keys(spark):
    import unicodedata

    known = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    more = ["ｶﾞ", "ẹ́", "가", "ﬁ①㈱", "Ｐａｒｔｙ　（Ａ）—１_x", "ß", "áb̀"]
    values = ["".join(known[k : k + 1]) for k in range(len(known))] + more
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    got = {r.k: r for r in rows.select("k", text.nfkc(F.col("v")).alias("n"), text.norm_key(F.col("v")).alias("key")).collect()}
    assert not [hex(ord(v[0])) for k, v in enumerate(values) if got[k].n != unicodedata.normalize("NFKC", v)]
    gone = set("-—_()（）")
    want = lambda v: "".join(c for c in unicodedata.normalize("NFKC", v) if not c.isspace() and c not in gone).upper()
    assert {v for k, v in enumerate(values) if got[k].key != want(v)} <= {chr(0x19B), chr(0x264), chr(0x10791)}  # upper cases of Unicode 16
    assert all(text.key_of(v) == want(v) for v in more)
    assert one(spark, None, text.norm_key) is None


def test_words_as_one_pattern(spark):
    """A look at the first character spares places the alternation and changes no match; before, each rlike() in a lambda decoded its words anew."""
    import re

    from inkveil.functions.spans import any_word, one_of
    from inkveil.functions.text import like
    from inkveil.registry import RULES

    words, texts = ["账号", "@", "a-b", "^x", "]y", "[z", "(有", "&&q", "\\w", "账"], ["开账号", "aa-b", "^x", "x]y[z", "(有", "&q &&q", "\\w", "w", "", "-", None]
    plain = "|".join(map(re.escape, words))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", like(F.col("t"), any_word(words)).alias("any"), one_of(F.col("t"), words).alias("one"))
    for r in rows.collect():
        assert r["any"] == (None if r.t is None else bool(re.search(plain, r.t))), r.t
        assert r["one"] == (None if r.t is None else r.t in words), r.t
    assert sum(bool(r.first) for r in RULES) >= 15 and all(r.tried().startswith("(?=[") for r in RULES if r.first)


def test_spread_once(spark, tmp_path):
    """Views of orders are computed in many partitions, and what was dealt out isn't dealt out again. Before, texts were made in one task and then moved."""
    from inkveil import queries
    from inkveil.operators.detect import spread

    rows = spark.createDataFrame([(k, k, 1.5, "2024-01-02") for k in range(40)], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    docs = queries.contracts(spark, str(tmp_path)).select("doc_id", "text")
    assert docs.rdd.getNumPartitions() > 1 and docs.count() == 40
    assert spread(docs) is docs and spread(docs.filter("doc_id > 3")).count() == 36
    few = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    assert spread(few) is not few and spread(few).count() == 40
