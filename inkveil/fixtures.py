"""Views of contract text and of single values, computed from orders by SQL that Spark and DuckDB both run."""

_ID_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
_USCC_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]
_USCC = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def _pick(words: str, index: str) -> str:
    return f"split_part('{words}', ',', CAST({index} AS INT) + 1)"


def _given(x: str) -> str:
    return _pick("启明,星辰,丽娟,博文,嘉怡,晓,宁,子涵,思远", f"{x} % 9")


def _person(x: str) -> str:
    return f"(substr('赵钱孙李周吴郑王', CAST({x} % 8 AS INT) + 1, 1) || {_given(x)})"


_ID17 = "'110105' || CAST(1950 + k % 50 AS STRING) || '0315' || lpad(CAST(k % 1000 AS STRING), 3, '0')"
_ID_SUM = " + ".join(f"CAST(substr(id17, {i}, 1) AS INT) * {w}" for i, w in enumerate(_ID_WEIGHTS, 1))
_ID18 = f"id17 || CASE WHEN k % 5 = 0 THEN 'X' ELSE substr('10X98765432', ({_ID_SUM}) % 11 + 1, 1) END"
_MOBILE = "'13' || lpad(CAST((k * 7919) % 1000000000 AS STRING), 9, '0')"
_BASE = f"SELECT o_orderkey AS doc_id, o_custkey AS k, o_orderkey AS o, {_ID17.replace('k %', 'o_custkey %')} AS id17, o_totalprice, o_orderdate FROM orders"

#: doc_id, text, and what the text is made of: fullname, shortname, othername, a, b, id18, mobile, amount, date_text, address.
CONTRACTS = f"""
WITH base AS ({_BASE}),
parts AS (
    SELECT doc_id, k, o,
        {_pick('北京,上海,深圳,杭州', 'k % 4')} || {_pick('星海智能,云启数联,蓝桥信息,启明数据,远山网络', 'floor(k / 4) % 5')} || '科技有限公司' AS fullname,
        {_pick('星海智能,云启数联,蓝桥信息,启明数据,远山网络', 'floor(k / 4) % 5')} AS shortname,
        {_pick('北京,上海,深圳,杭州', 'o % 4')} || '瀚海数据服务有限公司' AS othername,
        {_person('k')} AS a, {_person('o')} AS b, {_ID18} AS id18, {_MOBILE} AS mobile,
        '人民币 ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) || ' 元' AS amount,
        CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text,
        '北京市海淀区中关村南大街 ' || CAST(k % 90 + 1 AS STRING) || ' 号院 3 号楼' AS address
    FROM base)
SELECT *, '甲方：' || fullname || '（以下简称“' || shortname || '”）' || chr(10) || '法定代表人：' || a || chr(10) || '身份证号：' || id18 || chr(10)
    || '联系电话：' || mobile || chr(10) || '乙方：' || othername || chr(10) || '授权代表：' || b || chr(10) || '合同金额：' || amount || chr(10)
    || '签署日期：' || date_text || chr(10) || '第一条 ' || shortname || ' 委托乙方提供服务。' || a || '向' || b || '支付款项。' || chr(10)
    || '通讯地址：' || address AS text
FROM parts"""

_USCC_SUM = " + ".join(f"(instr('{_USCC}', substr(uscc17, {i}, 1)) - 1) * {w}" for i, w in enumerate(_USCC_WEIGHTS, 1))
_N4, _N6 = "lpad(CAST(k % 10000 AS STRING), 4, '0')", "lpad(CAST(k % 1000000 AS STRING), 6, '0')"

#: Forms of the column `form` by `j`: the type, what stands before the value, the value, what follows.
FORMS = [
    ("PHONE_LANDLINE", "'座机：'", f"'010-8666 ' || {_N4}", "'。'"),
    ("USCC", "'统一社会信用代码：'", "uscc", "'。'"),
    ("BANK_ACCOUNT", "'开户账号：'", "'6' || lpad(CAST(k AS STRING), 11, '0')", "CASE WHEN k % 2 = 0 THEN '，金额' ELSE '。' END"),
    ("TAX_ID", "'税号：'", "'AB' || lpad(CAST(k AS STRING), 13, '0')", "'。'"),
    ("LICENSE_NO", "'注册号：'", "'6' || lpad(CAST(k AS STRING), 14, '0')", "'。'"),
    ("CASE_NO", "'见 '", "'(2024)京民初' || CAST(k % 10000 + 1 AS STRING) || '号'", "'。'"),
    ("CONTRACT_NO", "'合同编号：'", "'HT-' || lpad(CAST(k AS STRING), 8, '0') || '-A'", "'。'"),
    ("PLATE", "CASE WHEN k % 2 = 0 THEN '车牌：' ELSE '停在门口：' END", "'京A' || lpad(CAST(k % 100000 AS STRING), 5, '0')", "'。'"),
    ("POSTCODE", "'邮编：'", "'1' || lpad(CAST(k % 100000 AS STRING), 5, '0')", "'。'"),
    ("SOCIAL_ACCOUNT", "'微信号：'", "'wx_' || lpad(CAST(k AS STRING), 8, '0')", "'。'"),
    ("HK_ID_CARD", "'香港身份证：'", f"'A' || {_N6} || '(3)'", "'。'"),
    ("HK_MO_TW_PERMIT", "'通行证：'", "'H' || lpad(CAST(k AS STRING), 10, '0')", "'。'"),
    ("MAC_ADDRESS", "'设备 '", "'AA:BB:CC:DD:EE:' || lpad(CAST(k % 100 AS STRING), 2, '0')", "' 在线'"),
    ("ID_CARD_15", "'号 '", "'11010101' || '19900101' || lpad(CAST(k % 1000 AS STRING), 3, '0')", "'。'"),
]

_CASES = {part: "CASE j " + " ".join(f"WHEN {j} THEN {f[i]}" for j, f in enumerate(FORMS)) + " END" for part, i in (("lead", 1), ("val", 2), ("tail", 3))}

#: doc_id and a column for each kind of value; form: a line with one value of the type that j names.
VALUES = f"""
WITH base AS (SELECT *, '91110105MA' || lpad(CAST(k % 10000000 AS STRING), 7, '0') AS uscc17, CAST(floor(doc_id / 20) % {len(FORMS)} AS INT) AS j FROM ({_BASE}) AS s),
more AS (SELECT *, uscc17 || CASE WHEN k % 4 = 0 THEN '0' ELSE substr('{_USCC}', CAST((31 - ({_USCC_SUM}) % 31) % 31 AS INT) + 1, 1) END AS uscc FROM base),
form AS (SELECT *, {_CASES['lead']} AS lead_text, {_CASES['val']} AS val_text, {_CASES['tail']} AS tail_text FROM more)
SELECT doc_id, k, j, lead_text, val_text, lead_text || val_text || tail_text AS form, uscc, {_ID18} AS id18, {_MOBILE} AS mobile,
    '6225' || lpad(CAST((k * 7919) % 100000000 AS STRING), 8, '0') || {_N4} AS card,
    CASE WHEN k % 7 = 0 THEN 'user' || CAST(k AS STRING) ELSE 'user' || CAST(k AS STRING) || '@mail' || CAST(k % 5 AS STRING) || '.example.com' END AS email,
    CASE WHEN k % 3 = 0 THEN '欧阳' || {_given('k')} ELSE {_person('k')} END AS person,
    '人民币 ' || CAST(k AS STRING) || ' 元' AS amount,
    'A' || {_N6} || CASE WHEN k % 2 = 0 THEN '(' || CAST(k % 10 AS STRING) || ')' ELSE '' END AS hk_id,
    CASE k % 4 WHEN 0 THEN '010-8666 ' || {_N4} WHEN 1 THEN '0755-86' || {_N6} WHEN 2 THEN '400-800-' || {_N4} ELSE '86' || {_N6} END AS landline,
    CASE WHEN k % 3 = 1 THEN '某某南大街路 ' || CAST(k AS STRING) || ' 号' ELSE '北京市海淀区中关村南大街 ' || CAST(k % 90 + 1 AS STRING) || ' 号院 3 号楼' END AS address,
    CASE WHEN k % 9 = 0 THEN 'localhost' ELSE '10.0.' || CAST(k % 256 AS STRING) || '.7' END AS ip,
    CASE WHEN k % 2 = 0 THEN 'AA:BB:CC:DD:EE:' || lpad(CAST(k % 100 AS STRING), 2, '0') ELSE 'AA-BB-CC-DD-EE-' || lpad(CAST(k % 100 AS STRING), 2, '0') END AS mac,
    'E' || lpad(CAST(k AS STRING), 8, '0') AS passport,
    CASE k % 8 WHEN 0 THEN '000000' WHEN 1 THEN '1234567890' WHEN 2 THEN 'XXXX' WHEN 3 THEN '某某公司' WHEN 4 THEN '****' WHEN 5 THEN '' WHEN 6 THEN {_MOBILE} ELSE '甲方' END AS made_up,
    CASE k % 3 WHEN 0 THEN '400-800-8888' WHEN 1 THEN '800 800 8888' ELSE {_MOBILE} END AS hotline,
    'ＡＢ－' || CAST(k AS STRING) || ' c_(d)（e）—f' AS wide
FROM form"""


_WIDE = "translate({}, '0123456789', '０１２３４５６７８９')"
_ADDRESS_OF = "CASE WHEN {0} % 5 = 0 THEN 'u' || date_text || '@host' || CAST({0} % 7 AS STRING) || '.example.com' ELSE 'User.' || CAST({0} AS STRING) || '@mail.example.org' END"

#: doc_id, k and text: values in full-width digits, with characters of no width inside, within longer numbers and within addresses; blank lines and
#: several kinds of line ends. Neither this view nor its SQL says where they stand: both search.
MESSY = f"""
WITH c AS ({CONTRACTS})
SELECT doc_id, k, '联系人：' || a || '\u3000' || '电话：' || CASE WHEN k % 2 = 0 THEN {_WIDE.format("mobile")} ELSE mobile END || chr(13) || chr(10) || chr(13) || chr(10)
    || '备用 ' || mobile || CASE WHEN k % 3 = 0 THEN '7' WHEN k % 3 = 1 THEN '、13912345678' ELSE '' END || chr(10) || '   ' || chr(10)
    || '证件 ' || CASE WHEN k % 4 = 0 THEN substr(id18, 1, 7) || '\u200b' || substr(id18, 8) WHEN k % 4 = 1 THEN {_WIDE.format("id18")} WHEN k % 4 = 2 THEN id18 || '0' ELSE id18 END || chr(13)
    || '签于' || date_text || '，自 ' || CAST(1990 + k % 40 AS STRING) || ' 年 ' || CAST(k % 12 + 1 AS STRING) || ' 月 ' || CAST(k % 28 + 1 AS STRING) || ' 日起' || chr(10) || chr(10)
    || '邮箱 ' || {_ADDRESS_OF.format("k")} || '，另 ' || {_ADDRESS_OF.format("o")} || '。' || CASE WHEN k % 6 = 0 THEN '\ufeff' || mobile ELSE '' END AS text
FROM c"""
