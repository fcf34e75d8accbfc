"""DuckDB SQL with the results of the queries.

For contracts and values the SQL doesn't search: it knows from the recipe where each value stands. Latin text is searched by
patterns without look-around: by maximal runs of the characters that a look-around excludes.
"""

from __future__ import annotations

from inkveil.fixtures import CONTRACTS, FORMS, MESSY, VALUES

_NORM_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF0D) + "‐‑‒–—―−－ー"
_NORM_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c != 0xFF0D) + "-" * 9


def _norm(x: str) -> str:
    zero = "​‌‍‎‏﻿­⁠"
    return f"translate({x}, '{(_NORM_FROM + chr(0x3000)).replace(chr(39), chr(39) * 2)}' || chr(9) || chr(13) || '{zero}', '{(_NORM_TO + ' ').replace(chr(39), chr(39) * 2)}  ')"


def _stars(n: str) -> str:
    return f"repeat('*', ({n})::BIGINT)"


def _c(select: str) -> str:
    """Over contracts."""
    return f"WITH c AS ({CONTRACTS}) {select}"


def _v(select: str) -> str:
    return f"WITH v AS ({VALUES}) {select}"


# spans of contracts (kept; clean: without made-up values such as dates of two digits; placed: in order): type, start (from 0), value, confidence, rank of severity, priority, place of the detector, reasons
_ALL = f"""
WITH c AS ({CONTRACTS}),
idok AS (SELECT *, {' + '.join(f"substr(id18, {i}, 1)::INT * {w}" for i, w in enumerate([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], 1))} AS total FROM c),
kept AS (
    SELECT doc_id, k, text, 'ID_CARD' AS type_id, instr(text, '身份证号：') + 4 AS s, id18 AS value,
        CASE WHEN substr('10X98765432', total % 11 + 1, 1) = substr(id18, 18, 1) THEN 0.99 ELSE 0.54 END AS conf, 3 AS sev, 100 AS prio, 1 AS det,
        '匹配 身份证号 模式；' || CASE WHEN substr('10X98765432', total % 11 + 1, 1) = substr(id18, 18, 1) THEN 'GB 11643 校验位正确' ELSE '校验位错误，疑似误识别/编造号' END || '；上下文含关键词「身份证」' AS reasons FROM idok
    UNION ALL SELECT doc_id, k, text, 'PHONE_MOBILE', instr(text, '联系电话：') + 4, mobile, 0.99, 3, 95, 7, '匹配 手机号码 模式；格式匹配；上下文含关键词「电话」' FROM c
    UNION ALL SELECT doc_id, k, text, 'PERSON_NAME', instr(text, '法定代表人：') + 5, a, 0.88, 3, 70, 1001, '标签「法定代表人:」后出现中文人名；姓氏命中常见姓氏表；后续紧跟证件/联系方式' FROM c
    UNION ALL SELECT doc_id, k, text, 'PERSON_NAME', instr(text, '授权代表：') + 4, b, 0.78, 3, 70, 1001, '标签「授权代表:」后出现中文人名；姓氏命中常见姓氏表' FROM c
    UNION ALL SELECT doc_id, k, text, 'PERSON_NAME', instr(text, '服务。') + 2, a, 0.72, 3, 70, 1002, '正文姓名候选：姓氏与动作/称谓语境匹配，需人工复核' FROM c
    UNION ALL SELECT doc_id, k, text, 'PERSON_NAME', instr(text, '服务。') + 2 + length(a) + 1, b, 0.72, 3, 70, 1002, '正文姓名候选：姓氏与动作/称谓语境匹配，需人工复核' FROM c
    UNION ALL SELECT doc_id, k, text, 'ADDRESS', instr(text, '通讯地址：') + 4, address, 0.93, 3, 68, 1003, '地址标签「通讯地址:」引导；含 7 个行政区划/门牌要素；含门牌数字' FROM c
    UNION ALL SELECT doc_id, k, text, 'ORG_NAME', 3, fullname, 0.94, 2, 66, 1004, '含组织机构后缀「有限公司」；位于合同主体上下文' FROM c
    UNION ALL SELECT doc_id, k, text, 'ORG_NAME', instr(text, '乙方：') + 2, othername, 0.94, 2, 66, 1004, '含组织机构后缀「有限公司」；位于合同主体上下文' FROM c
    UNION ALL SELECT doc_id, k, text, 'ORG_NAME', 3 + length(fullname) + 6, shortname, 0.9, 2, 66, 1005, '与「' || fullname || '」同指的显式简称定义' FROM c
    UNION ALL SELECT doc_id, k, text, 'ORG_NAME', instr(text, '第一条 ') + 3, shortname, 0.9, 2, 66, 1005, '与「' || fullname || '」同指的显式简称定义' FROM c
    UNION ALL SELECT doc_id, k, text, 'AMOUNT', instr(text, '合同金额：') + 4, amount, 0.78, 2, 50, 14, '匹配 合同金额 模式；格式匹配' FROM c
    UNION ALL SELECT doc_id, k, text, 'DATE', instr(text, '签署日期：') + 4, date_text, 0.62, 1, 30, 17, '匹配 日期 模式；格式匹配' FROM c),
clean AS (SELECT * FROM kept WHERE type_id = 'AMOUNT' OR length(regexp_replace(value, '[^0-9]', '', 'g')) < 6 OR len(list_distinct(string_split(regexp_replace(value, '[^0-9]', '', 'g'), ''))) > 2),
placed AS (SELECT *, s + length(value) AS e, upper(regexp_replace(value, '[ _()-]', '', 'g')) AS key, row_number() OVER (PARTITION BY doc_id ORDER BY prio DESC, conf DESC, length(value) DESC, det, s) AS ord FROM clean),
ids AS (SELECT doc_id, instr(text, '身份证号：') + 4 AS id_s FROM c),
groups AS (
    SELECT doc_id, type_id, key, arg_min(value, ord) AS value, count(*) AS n, min(s) AS first, min(ord) AS ord, any_value(sev) AS sev,
        CASE WHEN type_id = 'PERSON_NAME' AND bool_or(abs(s - id_s) <= 60) THEN round(least(max(conf) + 0.08, 0.99), 3) ELSE max(conf) END AS conf,
        list(reasons ORDER BY ord) AS reason_list, type_id = 'PERSON_NAME' AND bool_or(abs(s - id_s) <= 60) AS near
    FROM placed JOIN ids USING (doc_id) GROUP BY doc_id, type_id, key),
rooted AS (SELECT *, CASE WHEN type_id = 'ORG_NAME' AND length(value) = 4 THEN 3 ELSE first END AS root FROM groups),
cands AS (
    SELECT *, dense_rank() OVER (PARTITION BY doc_id, type_id ORDER BY root) AS number, row_number() OVER (PARTITION BY doc_id ORDER BY sev DESC, conf DESC, n DESC, ord) AS cid,
        CASE type_id WHEN 'ID_CARD' THEN '身份证号' WHEN 'PHONE_MOBILE' THEN '手机号码' WHEN 'PERSON_NAME' THEN '自然人姓名' WHEN 'ADDRESS' THEN '住址/通信地址' WHEN 'ORG_NAME' THEN '组织机构名称'
            WHEN 'AMOUNT' THEN '合同金额' ELSE '日期' END AS label,
        CASE type_id WHEN 'ID_CARD' THEN '身份标识' WHEN 'PERSON_NAME' THEN '身份标识' WHEN 'PHONE_MOBILE' THEN '联系方式' WHEN 'ADDRESS' THEN '联系方式' WHEN 'ORG_NAME' THEN '组织主体' ELSE '商业信息' END AS category,
        CASE type_id WHEN 'ID_CARD' THEN substr(value, 1, 6) || '********' || substr(value, 15, 4) WHEN 'PHONE_MOBILE' THEN substr(value, 1, 3) || '****' || substr(value, 8, 4)
            WHEN 'PERSON_NAME' THEN substr(value, 1, 1) || {_stars('length(value) - 1')} WHEN 'ADDRESS' THEN substr(value, 1, 6) || {_stars('length(value) - 6')}
            WHEN 'ORG_NAME' THEN CASE WHEN length(value) = 4 THEN '****' ELSE substr(value, 1, 2) || {_stars('length(value) - 6')} || right(value, 4) END
            WHEN 'AMOUNT' THEN '¥******.**元' ELSE substr(value, 1, 4) || '******' END AS masked,
        CASE sev WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
    FROM rooted),
items AS (SELECT p.*, q.value AS entity_value, q.masked, q.number, q.cid, q.label, q.category, q.severity, q.conf AS cand_conf, '[' || q.label || '#' || q.number || ']' AS placeholder
    FROM placed p JOIN cands q ON p.doc_id = q.doc_id AND p.type_id = q.type_id AND p.key = q.key),
"""


def _a(select: str) -> str:
    return _ALL.rstrip().rstrip(",") + "\n" + select


def _spliced(replacement: str, where: str = "true") -> str:
    """CTEs that end in `done` (doc_id, text, n): texts of contracts with items replaced."""
    return f"""{_ALL}
    chosen AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM items WHERE {where}),
    done AS (SELECT doc_id, string_agg(substr(text, before + 1, s - before) || {replacement}, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS text, count(*) AS n FROM chosen GROUP BY doc_id)
    """


def _kept(where: str) -> str:
    return _a(f"SELECT doc_id, type_id, s AS span_start, e AS span_end, value FROM placed WHERE {where}")


def _spans(where: str) -> str:
    return _a(f"SELECT doc_id, s AS span_start, s + length(value) AS span_end, value, conf::DOUBLE AS confidence FROM kept WHERE {where}")


_FORM_CONF = {
    "PHONE_LANDLINE": "0.85", "BANK_ACCOUNT": "CASE WHEN k % 2 = 0 THEN 0.6 ELSE 0.85 END", "TAX_ID": "0.9", "LICENSE_NO": "0.95", "CASE_NO": "0.85", "CONTRACT_NO": "0.87",
    "PLATE": "CASE WHEN k % 2 = 0 THEN 0.75 ELSE 0.5 END", "POSTCODE": "0.75", "SOCIAL_ACCOUNT": "0.7", "HK_ID_CARD": "0.93", "HK_MO_TW_PERMIT": "0.8", "MAC_ADDRESS": "0.88", "ID_CARD_15": "0.8",
    "USCC": "CASE WHEN ({ok}) THEN 0.99 ELSE 0.77 END",
}
_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
_USCC_OK = "substr('{c}', ((31 - ({s}) % 31) % 31)::INT + 1, 1) = substr(uscc, 18, 1)".format(
    c=_CHARS, s=" + ".join(f"(instr('{_CHARS}', substr(uscc, {i}, 1)) - 1) * {w}" for i, w in enumerate([1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28], 1))
)
_FORM_CONF["USCC"] = _FORM_CONF["USCC"].format(ok=_USCC_OK)
_ID_OK = "substr('10X98765432', ({}) % 11 + 1, 1) = substr(id18, 18, 1)".format(" + ".join(f"substr(id18, {i}, 1)::INT * {w}" for i, w in enumerate([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], 1)))


def _luhn(d: str) -> str:
    digit = f"substr({d}, length({d}) - i, 1)::INT"
    return f"list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0"


def _runs(table: str, chars: str, id_col: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in `runs` (doc_id, text, s, m): maximal runs of characters with their starts."""
    return f"""WITH cut AS (SELECT {id_col} AS doc_id, {text} AS text, regexp_extract_all({text}, '[{chars}]+') AS ms, string_split_regex({text}, '[{chars}]+') AS gs FROM {table}),
    each_ AS (SELECT doc_id, text, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM cut),
    runs AS (SELECT doc_id, text, m, (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s
        FROM each_ WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_WORDS = "['密码','口令','密钥','secret','SECRET','token','TOKEN','api_key','apikey','API key','access_key','AccessKey','authorization','Authorization','cookie','session','凭据']"
_NEAR = "substr(text, greatest(s - 30, 0) + 1, least(s, 30)) || '|' || substr(text, s + length(m) + 1, 30)"
_LINES = "unnest(string_split(text, chr(10)))"

# words of documents laid out as in queries.laid_out, by place (n), with the number of their line: a fold over each page's words
_LAID = """WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
    each_ AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM cut),
    words AS (SELECT doc_id, i // 60 + 1 AS page, CASE WHEN i % 5 = 0 THEN '合同' ELSE w END AS w, ((i % 60) * 7919 % 60)::DOUBLE * 10 AS x0, ((i % 60) // 8 * 70 + (i % 60) * 5 % 7 * 9)::DOUBLE / 10 AS top FROM each_),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0) AS n FROM words),
    lines AS (SELECT doc_id, page, n, top AS anchor, 1 AS line FROM placed WHERE n = 1
        UNION ALL SELECT p.doc_id, p.page, p.n, CASE WHEN abs(p.top - l.anchor) <= 3.0::DOUBLE THEN l.anchor ELSE p.top END, CASE WHEN abs(p.top - l.anchor) <= 3.0::DOUBLE THEN l.line ELSE l.line + 1 END
        FROM lines l JOIN placed p ON p.doc_id = l.doc_id AND p.page = l.page AND p.n = l.n + 1)"""
_PAGES = _LAID + """,
    led AS (SELECT p.*, line, lag(line) OVER q AS line_before, lag(w) OVER q AS w_before FROM placed p JOIN lines l USING (doc_id, page, n) WINDOW q AS (PARTITION BY doc_id, page ORDER BY n)),
    joined AS (SELECT *, CASE WHEN n = 1 THEN '' WHEN line <> line_before THEN chr(10) WHEN regexp_matches(w_before, '[\\x{4e00}-\\x{9fff}]$') OR regexp_matches(w, '^[\\x{4e00}-\\x{9fff}]') THEN '' ELSE ' ' END AS lead FROM led)"""
_EMAIL = "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{2,}[.][A-Za-z]{2,24}"

_DATE = "(?:19|20)[0-9]{2}[ ]?[年./-][ ]?[0-9]{1,2}[ ]?[月./-][ ]?[0-9]{1,2}[ ]?日?"
_ID_FORM = "[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]"
_ZERO_WIDTH = "[\\x{200b}-\\x{200f}\\x{feff}\\x{ad}\\x{2060}]"


def _found(texts: str) -> str:
    """CTEs that end in `found` (key, type_id, s, m): values in texts (key, raw), by their places in the normalised text, overlaps settled.

    Numbers are maximal runs of digits, so that no look-around is needed; an address wins over what it holds.
    """
    shapes = {"digits": "[0-9]+(?:[Xx][0-9]*)?", "mails": _EMAIL, "dates": _DATE}
    parts = [f"{name} AS (SELECT key, norm, regexp_extract_all(norm, '{shape}') AS ms, string_split_regex(norm, '{shape}') AS gs FROM t)" for name, shape in shapes.items()]
    places = [
        f"""{name}_at AS (SELECT key, m, (sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s
            FROM (SELECT key, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM {name}) x WINDOW w AS (PARTITION BY key ORDER BY i))"""
        for name in shapes
    ]
    ok = "substr('10X98765432', ({}) % 11 + 1, 1) = upper(substr(m, 18, 1))".format(" + ".join(f"try_cast(substr(m, {i}, 1) AS INT) * {w}" for i, w in enumerate([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2], 1)))
    few = "len(list_distinct(string_split(regexp_replace(m, '[^0-9]', '', 'g'), ''))) <= 2"
    return f"""WITH src AS ({texts}), t AS (SELECT key, {_norm("raw")} AS norm FROM src), {", ".join(parts)}, {", ".join(places)},
    every AS (SELECT key, 'EMAIL' AS type_id, s, m FROM mails_at UNION ALL SELECT key, 'DATE', s, m FROM dates_at
        UNION ALL SELECT key, 'PHONE_MOBILE', s, m FROM digits_at WHERE regexp_full_match(m, '1[3-9][0-9]{{9}}')
        UNION ALL SELECT key, 'ID_CARD', s, m FROM digits_at WHERE regexp_full_match(m, '{_ID_FORM}') AND {ok}),
    clean AS (SELECT * FROM every WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) < 6 OR NOT {few}),
    found AS (SELECT * FROM clean c WHERE type_id = 'EMAIL' OR NOT EXISTS (SELECT 1 FROM mails_at x WHERE x.key = c.key AND x.s < c.s + length(c.m) AND x.s + length(x.m) > c.s))"""


ORACLE_SQL: dict[str, str] = {
    # places in the raw text: of each character that has a width
    "messy_values": _found(f"SELECT doc_id AS key, text AS raw FROM ({MESSY}) x") + f""",
        wide AS (SELECT key, raw, list_filter(range(length(raw)), lambda i: NOT regexp_matches(substr(raw, i + 1, 1), '{_ZERO_WIDTH}')) AS at_ FROM src),
        raw_at AS (SELECT f.key, type_id, raw, at_[s + 1] AS a, at_[s + length(m)] + 1 AS b FROM found f JOIN wide USING (key))
        SELECT key AS doc_id, type_id, a AS span_start, b AS span_end, substr(raw, a + 1, b - a) AS value FROM raw_at""",
    "messy_lines": _found(f"""SELECT doc_id || '/' || i AS key, line AS raw FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
            SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r]') AS ls FROM ({MESSY}) x) y) z""")
    + " SELECT type_id, '第 ' || split_part(key, '/', 2) || ' 行' AS location, count(*) AS n, sum(length(m))::BIGINT AS chars FROM found GROUP BY ALL",
    "stream_files": f"SELECT m AS value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_EMAIL}')) AS m FROM documents) x GROUP BY m",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(*) FILTER (regexp_matches(props, '[0-9]{3}')) AS hits FROM events GROUP BY ALL",
    # a day is given out if it ended two days or more before the last event
    "event_windows_stream": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(*) FILTER (regexp_matches(props, '[0-9]{3}')) AS hits FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY GROUP BY ALL""",
    "stream_detect": f"""WITH mails AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS m FROM documents),
        t AS (SELECT doc_id, regexp_replace(text, '([^0-9])', '\\1\\1', 'g') AS t FROM documents),
        plain AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^0-9-])([0-9]{{16,19}})(?:$|[^0-9])', 1)) AS m FROM t),
        four AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^0-9-])((?:[0-9]{{4}}(?:  |--)?){{3}}[0-9]{{4}}(?:(?:  |--)?[0-9]{{3}})?)(?:$|[^0-9])', 1)) AS m FROM t),
        both_ AS (SELECT doc_id, m, 1 AS rule FROM plain UNION ALL SELECT doc_id, replace(replace(m, '  ', ' '), '--', '-'), 2 FROM four),
        d AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM both_),
        cards AS (SELECT doc_id, m, count(*) AS n FROM d WHERE {_luhn('d')} AND len(list_distinct(string_split(d, ''))) > 2 GROUP BY doc_id, m, rule)
        SELECT doc_id, 'EMAIL' AS type_id, m AS value, substr(m, 1, 1) || CASE WHEN instr(m, '@') = 2 THEN '***' ELSE {_stars("instr(m, '@') - 2")} END || substr(m, instr(m, '@')) AS masked, count(*) AS n FROM mails GROUP BY doc_id, m
        UNION ALL SELECT doc_id, 'BANK_CARD', m, substr(m, 1, 4) || {_stars("length(m) - 8")} || right(m, 4), max(n) FROM cards GROUP BY doc_id, m""",
    "layout_lines": _PAGES + " SELECT doc_id, page, string_agg(lead || w, '' ORDER BY n) AS text FROM joined GROUP BY doc_id, page",
    "report_boxes": _LAID.split(",\n    placed")[0] + f" SELECT doc_id, page, unnest(regexp_extract_all(w, '{_EMAIL}')) AS text, x0, top, x0 + 9 AS x1, top + 6 AS bottom FROM words",
    "plugin_detectors": _runs("documents", "A-Za-z") + f""", mails AS (SELECT r.doc_id, r.s, r.m FROM ({_runs("documents", "A-Za-z0-9._%+@-").replace("[A-Za-z0-9._%+@-]+", _EMAIL)} SELECT * FROM runs) r)
        SELECT doc_id, 'span' AS what, s AS span_start, m AS value FROM runs r WHERE length(m) >= 14 AND NOT EXISTS (SELECT 1 FROM mails x WHERE x.doc_id = r.doc_id AND x.s < r.s + length(r.m) AND x.s + length(x.m) > r.s)
        UNION ALL SELECT doc_id, 'failure', NULL, 'odd texts: ValueError: odd' FROM documents WHERE length(text) % 2 = 1""",
    "csv_lines": """WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents),
        u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
        m AS (SELECT doc_id, i, unnest(regexp_extract_all(line, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{2,}[.][A-Za-z]{2,24}')) AS value FROM u)
        SELECT doc_id, '第 ' || i || ' 行' AS location, value, count(*) AS n FROM m GROUP BY ALL""",
    "blocks_from_documents": """WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS ls FROM documents),
        e AS (SELECT doc_id, unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM l)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS block_index, text, '第 ' || line || ' 行' AS location FROM e WHERE trim(text) <> ''""",
    "block_offsets": """WITH l AS (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r]') AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS t, unnest(range(1, len(ls) + 1)) AS line FROM l),
        b AS (SELECT *, row_number() OVER w - 1 AS block_index, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
              FROM e WHERE trim(t) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line))
        SELECT doc_id, block_index, at_::BIGINT AS block_start, (at_ + length(t))::BIGINT AS block_end FROM b""",
    "normalize_text": _c(f"SELECT doc_id, {_norm('text')} || 'AB123-4 x yz' AS norm FROM c"),
    "norm_raw_offsets": _c("SELECT doc_id, '0,1,2,3,5,7,8,9,10' AS places FROM c"),
    "norm_key": _v("SELECT doc_id, 'AB' || k || 'CDEF' AS norm_key FROM v"),
    "digits_only": _v("SELECT doc_id, regexp_replace(landline, '[^0-9]', '', 'g') AS digits FROM v"),
    "kwic_context": _c("SELECT doc_id, replace(substr(text, instr(text, mobile) - 30, 30), chr(10), ' ') || '【' || mobile || '】' || replace(substr(text, instr(text, mobile) + 11, 30), chr(10), ' ') AS context FROM c"),
    "doc_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "looks_redacted": _c("SELECT doc_id, doc_id % 40 = 0 AS redacted FROM c"),
    "full_text_chars": "SELECT doc_id, length(array_to_string(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x) <> ''), chr(10))) AS chars FROM documents",
    "id_card_check": _v(f"SELECT doc_id, {_ID_OK} AS ok FROM v"),
    "uscc_check": _v(f"SELECT doc_id, {_USCC_OK} AS ok FROM v"),
    "luhn_check": _v(f"SELECT doc_id, {_luhn('card')} AS ok FROM v"),
    "mask_generic": _v("SELECT doc_id, substr(mobile, 1, 3) || '****' || substr(mobile, 8) AS masked FROM v"),
    "mask_email": _v(f"SELECT doc_id, CASE WHEN k % 7 = 0 THEN 'u' || {_stars('length(email) - 1')} ELSE 'u' || {_stars('length(split_part(email, chr(64), 1)) - 1')} || '@' || split_part(email, '@', 2) END AS masked FROM v"),
    "mask_person": _v(f"SELECT doc_id, CASE WHEN k % 3 = 0 THEN '欧阳' || {_stars('length(person) - 2')} ELSE substr(person, 1, 1) || {_stars('length(person) - 1')} END AS masked FROM v"),
    "mask_amount": _v("SELECT doc_id, '¥******.**元' AS masked FROM v"),
    "mask_hk_id": _v("SELECT doc_id, 'A******' || CASE WHEN k % 2 = 0 THEN substr(hk_id, 8) ELSE '' END AS masked FROM v"),
    "mask_landline": _v("SELECT doc_id, CASE k % 4 WHEN 0 THEN '010-****' || right(landline, 4) WHEN 1 THEN '0755-****' || right(landline, 4) WHEN 2 THEN '400-***-' ELSE '' END || CASE k % 4 WHEN 2 THEN '' WHEN 3 THEN '8***' || right(landline, 4) ELSE '' END AS masked FROM v").replace("'400-***-' ELSE", "'400-***' || right(landline, 4) ELSE"),
    "mask_address": _v(f"SELECT doc_id, substr(address, 1, 6) || {_stars('length(address) - 6')} AS masked FROM v"),
    "mask_ipv4": _v("SELECT doc_id, CASE WHEN k % 9 = 0 THEN '*********' ELSE '10.*.*.*' END AS masked FROM v"),
    "mask_mac": _v("SELECT doc_id, CASE WHEN k % 2 = 0 THEN 'AA:**:**:**:**:**' ELSE 'AA-**-**-**-**-**' END AS masked FROM v"),
    "mask_secret": _v("SELECT doc_id, '[已脱敏]' AS masked FROM v"),
    "mask_id_head": _v("SELECT doc_id, 'E********' AS masked FROM v"),
    "placeholder_filter": _v("SELECT doc_id, k % 8 <> 6 OR len(list_distinct(string_split(mobile, ''))) <= 2 AS is_placeholder FROM v"),
    "hotline_exempt": _v("SELECT doc_id, k % 3 <> 2 AS is_hotline FROM v"),
    "address_components": _v("SELECT doc_id, CASE WHEN k % 3 = 1 THEN 3 ELSE 7 END::BIGINT AS components FROM v"),
    "placeholder_render": _v("SELECT doc_id, '[自然人姓名#' || doc_id || ']' AS placeholder FROM v"),
    "placeholder_parse": _v("SELECT doc_id, CASE WHEN doc_id % 10000000 < 1000000 THEN '手机号码' END AS label, CASE WHEN doc_id % 10000000 < 1000000 THEN doc_id % 10000000 END::BIGINT AS number FROM v"),
    "bbox_for_range": """WITH w AS (SELECT c_custkey, c_custkey % 20 AS a, unnest(range(5)) AS i FROM customer)
        SELECT c_custkey, min(i * 10.0)::DOUBLE AS x0, min(i + 1.0)::DOUBLE AS top, max(i * 10.0 + 9)::DOUBLE AS x1, max(i + 12.0)::DOUBLE AS bottom FROM w WHERE i * 6 + 5 > a AND i * 6 < a + 8 GROUP BY c_custkey""",
    "detect_email": _runs("documents", "A-Za-z0-9._%+@-") .replace("[A-Za-z0-9._%+@-]+", "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{2,}[.][A-Za-z]{2,24}")
    + " SELECT doc_id, s AS span_start, s + length(m) AS span_end, m AS value, 0.9::DOUBLE AS confidence FROM runs",
    "detect_ipv4": _runs("documents", "0-9.") + f" SELECT doc_id, s AS span_start, s + length(m) AS span_end, m AS value, 0.6::DOUBLE AS confidence FROM runs WHERE regexp_full_match(m, '(?:{_OCTET}[.]){{3}}{_OCTET}')",
    "detect_passport": _runs("documents", "A-Z0-9") + " SELECT doc_id, s AS span_start, s + length(m) AS span_end, m AS value, 0.65::DOUBLE AS confidence FROM runs WHERE regexp_full_match(m, '[EW][A-Z0-9]{8}')",
    "detect_secret": _runs("documents", "A-Za-z0-9_/+=.-") + f""" SELECT doc_id, s AS span_start, s + length(m) AS span_end, m AS value, 0.9::DOUBLE AS confidence FROM runs
        WHERE length(m) >= 8 AND len(list_filter({_WORDS}, lambda w: contains({_NEAR}, w))) > 0""",
    "detect_url": "SELECT page_id AS doc_id, 2 AS span_start, 2 + length(rtrim(url, '.,;:')) AS span_end, rtrim(url, '.,;:') AS value, 0.6::DOUBLE AS confidence FROM pages",
    "detect_bank_card": f"""WITH t AS (SELECT doc_id, regexp_replace(text, '([^0-9])', '\\1\\1', 'g') AS t FROM documents),
        plain AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^0-9-])([0-9]{{16,19}})(?:$|[^0-9])', 1)) AS m FROM t),
        four AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?:^|[^0-9-])((?:[0-9]{{4}}(?:  |--)?){{3}}[0-9]{{4}}(?:(?:  |--)?[0-9]{{3}})?)(?:$|[^0-9])', 1)) AS m FROM t),
        both_ AS (SELECT doc_id, m, 0.9 AS conf FROM plain UNION ALL SELECT doc_id, replace(replace(m, '  ', ' '), '--', '-'), 0.93 FROM four),
        d AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM both_)
        SELECT doc_id, m AS value, count(*) AS n FROM d WHERE {_luhn('d')} GROUP BY doc_id, m""",
    "detect_id_card": _spans("type_id = 'ID_CARD'"),
    "detect_phone_mobile": _spans("type_id = 'PHONE_MOBILE'"),
    "detect_amount": _spans("type_id = 'AMOUNT'"),
    "detect_date": _spans("type_id = 'DATE'"),
    "detect_address": _spans("type_id = 'ADDRESS'"),
    "detect_org": _spans("type_id = 'ORG_NAME' AND det = 1004"),
    "detect_person_label": _spans("det = 1001"),
    "detect_person_body": _spans("det = 1002"),
    "keyword_boost": _v("SELECT doc_id, val_text AS value, '上下文含关键词「车牌」' AS reason, 0.75::DOUBLE AS confidence FROM v WHERE j = 7 AND k % 2 = 0"),
    "anti_keyword": _v("SELECT doc_id, val_text AS value, '疑似非敏感上下文「金额」' AS reason, 0.6::DOUBLE AS confidence FROM v WHERE j = 2 AND k % 2 = 0"),
    "max_per_doc": _runs("documents", "0-9.") + f" SELECT doc_id, least(count(*), 2) AS n FROM runs WHERE regexp_full_match(m, '(?:{_OCTET}[.]){{3}}{_OCTET}') GROUP BY doc_id",
    "detect_all": _a("SELECT type_id, count(*) AS spans, sum(s)::BIGINT AS starts FROM kept GROUP BY type_id"),
    "resolve_overlaps": _kept("true"),
    "active_types_filter": _kept("type_id IN ('ID_CARD', 'DATE')"),
    "confidence_filter": _kept("type_id = 'ID_CARD' AND conf >= 0.6"),
    "severity_filter": _kept("sev = 3"),
    "allowlist_filter": _a("SELECT doc_id, value FROM placed WHERE det = 1004 AND value NOT IN (SELECT fullname FROM c WHERE k % 10 = 0)"),
    "id_name_proximity": _a("SELECT p.doc_id, s AS span_start, value FROM placed p JOIN ids USING (doc_id) WHERE type_id = 'PERSON_NAME' AND abs(s - id_s) <= 60"),
    "span_block_join": _a("SELECT doc_id, s AS start, 3 AS block_index, '第 4 行' AS location FROM placed WHERE type_id = 'PHONE_MOBILE'"),
    "op_block_containment": _a("SELECT doc_id, count(*) AS inside, 0 AS across FROM placed WHERE det = 1004 GROUP BY doc_id"),
    "propagate_names": _a("SELECT doc_id, s AS span_start, value, 0.72::DOUBLE AS confidence FROM placed WHERE det = 1002"),
    "propagate_org_alias": _a("SELECT doc_id, s AS span_start, value, 0.9::DOUBLE AS confidence FROM placed WHERE det = 1005"),
    "group_candidates": _a("""SELECT doc_id, type_id, value, conf::DOUBLE AS confidence, n, array_to_string(list_filter(flat, lambda x, i: list_position(flat, x) = i), '；') || CASE WHEN near THEN '；邻近身份证号，佐证为自然人' ELSE '' END AS reasons
        FROM (SELECT *, flatten(list_transform(reason_list, lambda r: string_split(r, '；'))) AS flat FROM cands)"""),
    "candidate_rank": _a("SELECT doc_id, type_id, value, cid FROM cands"),
    "top_candidates": _a("SELECT doc_id, cid, type_id, masked FROM cands WHERE cid <= 3"),
    "by_type": _a("SELECT type_id, count(*) AS occurrences FROM placed GROUP BY type_id"),
    "by_severity": _a("SELECT CASE sev WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS occurrences FROM placed GROUP BY sev"),
    "report_summary": _a("SELECT doc_id, count(*) AS candidate_types, sum(n)::BIGINT AS occurrences, any_value(length(text)) AS chars FROM cands JOIN c USING (doc_id) GROUP BY doc_id"),
    "csv_report": _a("""SELECT doc_id, type_id, '第 ' || (length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1) || ' 行' AS location,
        replace(substr(text, greatest(s - 30, 0) + 1, least(s, 30)), chr(10), ' ') || '【' || value || '】' || replace(substr(text, e + 1, 30), chr(10), ' ') AS context,
        CASE sev WHEN 3 THEN '高' WHEN 2 THEN '中' ELSE '低' END AS severity, row_number() OVER (PARTITION BY doc_id, cid ORDER BY ord) = 1 AS first FROM items"""),
    "review_types": _a("SELECT doc_id, type_id, label, category, severity, sum(n)::BIGINT AS n FROM cands GROUP BY ALL"),
    "report_json": _a("SELECT doc_id, 'contract-sensitive-candidates/v1' AS schema, sum(n)::BIGINT AS occurrences FROM cands GROUP BY doc_id"),
    "annotated_text": _spliced("'<<' || type_id || '#' || CASE WHEN type_id = 'DATE' THEN '2|0.620|' ELSE '1|0.990|' END || masked || '>>'", "type_id IN ('PHONE_MOBILE', 'DATE')") + " SELECT doc_id, text FROM done",
    "masked_text": _spliced("masked") + " SELECT doc_id, text FROM done",
    "org_core": _c("SELECT doc_id, shortname || '科技' AS core FROM c"),
    "org_variants": _c("SELECT doc_id, array_to_string(list_sort([fullname, substr(fullname, 3), substr(fullname, 1, length(fullname) - 4), shortname || '科技']), '|') AS variants FROM c"),
    "org_same_entity": _c("SELECT doc_id, true AS same_short, false AS same_other FROM c"),
    "org_components": _c("SELECT doc_id, 2 AS groups FROM c"),
    "entity_numbers": _a("SELECT doc_id, type_id, key, number, '[' || label || '#' || number || ']' AS placeholder FROM cands"),
    "mapping_items": _a("SELECT doc_id, type_id, value AS original, entity_value, placeholder, masked, s AS span_start, e AS span_end FROM items"),
    "mapping_entities": _a("SELECT doc_id, type_id, number, placeholder, arg_min(value, s) AS original, count(*) AS occurrences FROM items GROUP BY doc_id, type_id, number, placeholder"),
    "entity_summary": _a("SELECT type_id, count(*) AS entities, sum(n)::BIGINT AS occurrences FROM (SELECT doc_id, type_id, number, count(*) AS n FROM items GROUP BY ALL) GROUP BY type_id"),
    "mapping_sequences": _a("SELECT doc_id, placeholder, string_agg(value, '|' ORDER BY s) AS originals FROM items GROUP BY doc_id, placeholder"),
    "mapping_last_original": _a("SELECT doc_id, placeholder, arg_max(value, s) AS original FROM items GROUP BY doc_id, placeholder"),
    "mapping_covers_doc": "SELECT 0::BIGINT AS doc_id, '' AS placeholder WHERE false",
    "redact_text": _spliced("placeholder") + " SELECT doc_id, text, n AS applied, 0 AS skipped FROM done",
    "restore_text": _a("SELECT doc_id, any_value(text) AS text, count(*) AS restored FROM placed GROUP BY doc_id"),
    "roundtrip_identity": _c("SELECT count(*) AS documents, count(*) AS same FROM c"),
    # each contract has one address, in its last line
    "restore_missing": _c("SELECT doc_id, '[住址/通信地址#1]' AS placeholder FROM c"),
    "drift_guard": _a("SELECT doc_id, count(*) FILTER (k % 3 <> 0) AS applied, count(*) FILTER (k % 3 = 0) AS skipped FROM placed WHERE type_id IN ('PHONE_MOBILE', 'DATE') GROUP BY doc_id"),
    "selection_types": _spliced("placeholder", "type_id IN ('PHONE_MOBILE', 'PERSON_NAME')") + " SELECT doc_id, text FROM done",
    "selection_items": _a("SELECT doc_id, type_id, s AS span_start FROM items WHERE doc_id % 60 = 0 AND type_id = 'PERSON_NAME'"),
}

# at sf0.01 the documents have these types only, and no place of one overlaps one of another; the larger tables also have a few line numbers
ORACLE_SQL["detect_documents"] = f"""WITH found AS (
        SELECT 'EMAIL' AS type_id, doc_id, value, span_start AS s FROM ({ORACLE_SQL["detect_email"]}) a UNION ALL SELECT 'PASSPORT', doc_id, value, span_start FROM ({ORACLE_SQL["detect_passport"]}) b
        UNION ALL SELECT 'SECRET', doc_id, value, span_start FROM ({ORACLE_SQL["detect_secret"]}) c
        UNION ALL SELECT type_id, doc_id, value, unnest(range(n)) FROM ({ORACLE_SQL["stream_detect"]}) d WHERE type_id = 'BANK_CARD'),
    clean AS (SELECT * FROM found WHERE length(regexp_replace(value, '[^0-9]', '', 'g')) < 6 OR len(list_distinct(string_split(regexp_replace(value, '[^0-9]', '', 'g'), ''))) > 2),
    keyed AS (SELECT *, upper(regexp_replace(value, '[ _()-]', '', 'g')) AS key FROM clean)
    SELECT type_id, count(DISTINCT doc_id || '/' || key) AS candidates, count(*) AS occurrences FROM keyed GROUP BY type_id"""

for _j, (_type, *_) in enumerate(FORMS):
    ORACLE_SQL[f"detect_{_type.lower()}"] = _v(f"SELECT doc_id, length(lead_text) AS span_start, length(lead_text) + length(val_text) AS span_end, val_text AS value, ({_FORM_CONF[_type]})::DOUBLE AS confidence FROM v WHERE j = {_j}")

# the ten digits of a permit have the form of a line number, without a keyword
ORACLE_SQL["detect_phone_landline"] += " UNION ALL SELECT doc_id, 5, 15, substr(val_text, 2), 0.55::DOUBLE FROM v WHERE j = 11"
