"""People, addresses and organisations: spans that depend on what stands around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.arrays import at, let
from inkveil.functions.spans import any_word, constant, keyword_context, made_of, matches, none, one_of, span
from inkveil.functions.text import first_word, like
from inkveil.registry import ADDRESS_ORD, COMPOUND_SURNAMES, ORG_ORD, PERSON_ORD, Settings

HAN = "一-鿿"

# Words before names. Parties need a colon, the others don't.
PARTIES = ("甲方", "乙方", "丙方", "丁方", "戊方", "被上诉人", "被申请人", "上诉人", "原告", "被告", "第三人")
ROLES = (
    "法定代表人", "法人代表", "法人", "负责人", "联系人", "授权代表", "签约代表", "经办人", "承办人", "签字", "签名", "署名", "姓名", "受托人",
    "委托人", "代理人", "当事人", "开户名", "户名", "账户名", "收款人", "付款人", "借款人", "出借人", "保证人", "抵押人", "质权人", "员工", "劳动者",
    "乙方代表", "甲方代表", "项目负责人", "技术负责人", "项目经理", "设计师", "工程师", "顾问", "证人", "申请人", "产品负责人", "业务负责人",
    "商务负责人", "财务负责人", "内容负责人", "运营负责人", "客户负责人", "客户经理", "法务负责人", "法务合规", "艺人商务", "舆情值班", "角色",
    "人员", "代表", "主持人", "主播", "艺人", "代言人", "嘉宾", "对接人", "接口人", "资源方",
)
NAME_STOPWORDS = (
    "商务", "商业", "权利", "义务", "解除", "终止", "权限", "确认", "签署", "签订", "生效", "失效", "变更", "转让", "授权", "委托", "代理", "保证",
    "抵押", "质押", "违约", "赔偿", "损失", "费用", "价款", "金额", "付款", "收款", "结算", "开始", "结束", "截止", "起算", "计算", "通知", "送达",
    "披露", "保密", "书面", "口头", "电子", "网络", "线上", "线下", "现场", "当面", "甲方", "乙方", "丙方", "双方", "各方", "对方", "第三方", "本人",
    "公司", "企业", "单位", "部门", "小组", "团队", "中心", "合同", "协议", "附件", "附录", "清单", "确认单", "变更单", "双确认", "方式签署",
    "商业合作", "合法权益", "商业秘密", "个人信息", "不可抗力", "适用法律", "争议解决", "仲裁条款", "艺人商务", "舆情值班", "法务合规", "中国大陆",
    "中华人民共和国",
)
ROLE_WORDS = (
    "经理", "总监", "主管", "主任", "秘书", "助理", "专员", "代表", "工程师", "设计师", "顾问", "律师", "会计", "出纳", "监理", "施工", "项目",
    "负责", "联系", "经办", "承办", "签字", "签名", "署名", "姓名", "当事", "受托", "委托", "代理", "保证", "抵押", "质权", "员工", "劳动", "证人",
    "申请", "甲方", "乙方", "丙方", "双方", "公司", "单位", "部门", "小组", "团队", "中心", "科室", "应于", "应在", "应当", "应向", "应为", "已将",
    "将于", "并于", "需于", "应自", "应就",
)
NAME_TAILS = ("先生", "女士", "小姐", "同志", "老师", "教授", "医生", "律师", "的", "等", "与", "和", "及")
NAME_CUES = (
    "身份证", "证件号", "联系电话", "手机号", "电话", "邮箱", "住址", "联系方式", "先生", "女士", "工号", "员工", "护照", "项目", "产品", "商务",
    "内容", "法务", "财务", "运营", "客户", "艺人", "代言", "对接", "联系", "渠道", "企业微信", "舆情值班",
)
ID_CUES = ("身份证", "证件号", "手机号", "联系电话", "住址", "联系方式")
ACTIONS = (
    "向", "与", "和", "及", "于", "将", "已", "曾", "应当", "支付", "收到", "收取", "转账", "借款", "签订", "签署", "提出", "主张", "表示", "认为",
    "要求", "同意", "拒绝", "承认", "否认", "陈述", "辩称", "诉称", "提交", "提供", "出具", "负责", "委托", "购买", "交付", "返还", "归还", "承担",
    "赔偿", "随后", "先生", "女士", "律师",
)
LEADS = ("向", "与", "和", "及", "由", "经", "通知", "告知", "要求", "委托")
ORG_STOPWORDS = (
    "甲方", "乙方", "丙方", "丁方", "戊方", "双方", "各方", "单方", "对方", "第三方", "本公司", "贵公司", "该公司", "子公司", "母公司", "总公司",
    "借款人", "出租人", "承租人", "出卖人", "买受人", "发包人", "承包人", "委托人", "受托人", "保证人", "债权人", "债务人", "甲方公司", "乙方公司",
    "开户银行", "收款银行", "付款银行", "开户行", "银行账号", "仲裁委员会", "人民法院",
)

# Words before addresses, fields that end one, parts of one.
ADDRESS_LABELS = (
    "通讯地址", "通信地址", "联系地址", "详细地址", "送达地址", "注册地址", "住所地", "住所", "住址", "地址", "经营场所", "所在地", "注册地",
    "办公地址", "邮寄地址",
)
ADDRESS_STOPS = "，。；、,;；\n\t（）()【】[]：:"
ADDRESS_FIELDS = ("邮编", "邮政编码", "电话", "手机", "邮箱", "电子邮箱", "传真", "联系人", "开户", "账号", "帐号", "税号", "网址", "法定代表人")
ADDRESS_PARTS = (
    "省", "自治区", "市", "区", "县", "旗", "镇", "乡", "村", "路", "街", "道", "巷", "弄", "号", "栋", "幢", "楼", "单元", "室", "层", "号楼",
    "大院", "园区",
)
BARE_ADDRESS = (
    rf"[{HAN}]{{2,7}}(?:省|自治区)[{HAN}]{{2,10}}(?:市|自治州|地区|盟)[{HAN}]{{2,20}}?(?:[{HAN}]{{1,12}}(?:区|县|市|旗))?"
    rf"[{HAN}0-9]{{2,30}}?(?:路|街|道|巷|弄|大道|园区|工业区)[{HAN}0-9\-]{{0,20}}?(?:号|栋|幢|号楼|室|层)"
)

# Endings of organisations' names, what may not be in one, what is cut off before one.
ORG_STRONG = (
    "股份有限公司", "有限责任公司", "有限公司", "集团有限公司", "（有限合伙）", "(有限合伙)", "有限合伙", "股份合作公司", "集团公司", "总公司",
    "分公司", "子公司", "律师事务所", "会计师事务所", "税务师事务所", "研究院", "设计院", "勘察院", "大学", "学院", "医院", "银行", "信用社",
    "合作社", "基金会", "商会", "行业协会", "支行", "分行", "营业部",
)
ORG_WEAK = ("事务所", "中心", "研究院", "实验室", "集团", "协会", "学会", "管委会", "办事处", "工作室")
ORG_BREAKS = "由与和或给被把以并为在及至向从对等第是:,;"
ORG_LEADS = (
    "本人", "该公司", "该司", "该行", "该店", "该厂", "该社", "该院", "该中心", "其本", "我方", "你方", "对方", "本行", "本院", "本店", "本厂",
    "本社", "本中心", "号院", "号楼", "号室", "号层", "号店", "号厂", "号区",
)
ORG_PARTIES = ("甲方", "乙方", "丙方", "供方", "需方", "卖方", "买方", "签约", "受托方", "委托方")

#: Characters before an ending that are searched first for the beginning of an organisation's name; a name that fills them is
#: searched for in the whole text before the ending.
ORG_REACH = 100


def _has_han(text: Column) -> Column:
    """A quick look that spares texts without Han characters the long alternations."""
    return like(text, f"[{HAN}]")


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _firsts(*words: tuple[str, ...]) -> str:
    """The characters that words begin with: a look at one spares most places the alternation."""
    return "".join(sorted({w[0] for ws in words for w in ws}))


def _has_surname(name: Column, settings: Settings) -> Column:
    return F.contains(F.lit(settings.surnames), F.substring(name, 1, 1)) | one_of(F.substring(name, 1, 2), COMPOUND_SURNAMES)


_PAREN = r"(?:\s*[（(【][^)）】]{0,12}[）)】])?"
_LABEL = rf"(?=[{_firsts(PARTIES, ROLES)}])(?>(?:{_any(PARTIES)})\s*{_PAREN}\s*[:=][ \t]*|(?:{_any(ROLES)})\s*{_PAREN}\s*[:=]?[ \t]*)"
_NAME_END = rf"(?=·|{_any(NAME_TAILS)}|(?![{HAN}]))"


def labelled_names(text: Column, settings: Settings) -> Column:
    """Names after a label: the longest of 2 to 4 characters that ends where a run of Han characters or a title does."""

    def make(x: Column, parts: Column) -> Column:
        name = F.regexp_extract(x["m"], rf"^{_LABEL}([{HAN}]{{2,4}})$", 1)
        placed = lambda n: F.struct(n.alias("n"), (x["start"] + F.length(x["m"]) - F.length(n)).alias("s"), x["m"].alias("m"))
        return let(let(name, placed), lambda p: kept(p, parts))

    def kept(p: Column, parts: Column) -> Column:
        name, start = p["n"], p["s"]
        bad = one_of(name, [*PARTIES, *ROLES, *ORG_STOPWORDS, *NAME_STOPWORDS]) | like(name, any_word(ROLE_WORDS))
        keep = (name != "") & _has_surname(name, settings) & ~bad
        told = lambda c, s: F.struct((c & like(at(parts, start + F.length(name), 30), any_word(ID_CUES))).alias("near"), c.alias("cue"), s["strict"].alias("strict"), s["label"].alias("label"))  # noqa: E501, E731
        label = F.trim(F.substring(p["m"], F.lit(1), F.length(p["m"]) - F.length(name)))
        led = let(label, lambda w: F.struct(w.alias("label"), like(w, "[:=]").alias("strict")))
        seen = let(led, lambda s: let(like(at(parts, start, 40), any_word(NAME_CUES)), lambda c: told(c, s)))
        return F.when(keep, let(seen, lambda s: scored(p, s)))

    def scored(p: Column, s: Column) -> Column:
        name, start, label, strict, cue, near = p["n"], p["s"], s["label"], s["strict"], s["cue"], s["near"]
        end = start + F.length(name)
        conf = F.when(strict, F.lit(0.78)).otherwise(F.lit(0.78) - F.lit(0.08)) + F.when(near, F.lit(0.1)).otherwise(F.lit(0.0))
        conf = F.when(~strict & ~cue, F.least(conf, F.lit(0.45))).otherwise(conf)
        reasons = F.array_compact(
            F.array(
                F.concat(F.lit("标签「"), label, F.lit("」后出现中文人名")),
                F.lit("姓氏命中常见姓氏表"),
                F.when(near, F.lit("后续紧跟证件/联系方式")),
                F.when(~strict & ~cue, F.lit("无冒号引导且缺少佐证，降级")),
            )
        )
        return span(PERSON_ORD, "PERSON_NAME", start, end, F.least(conf, F.lit(0.97)), reasons, name)

    found = matches(text, rf"{_LABEL}[{HAN}]{{2,4}}{_NAME_END}", _has_han(text) & like(text, any_word([*PARTIES, *ROLES])))
    return made_of(found, text, make)


_LEFT = rf"(?:[，,。；;：:！？!?\n\s]|(?=[{_firsts(LEADS)}])(?:{'|'.join(LEADS)}))"
_BODY = rf"(?:^|{_LEFT})([{HAN}]{{2,4}})(?={any_word(ACTIONS)}|[，,。；;：:！？!?\s]|$)"


def body_names(text: Column, settings: Settings) -> Column:
    """Names in running text: a surname between a border or verb and an action, or after 通知, 告知, 委托."""

    def make(x: Column, parts: Column) -> Column:
        # only at the start of the text can a match be a name alone
        alone = (x["start"] == 0) & like(x["m"], f"^[{HAN}]{{2,4}}$")
        name = F.when(alone, x["m"]).otherwise(F.regexp_extract(x["m"], rf"^{_LEFT}([{HAN}]{{2,4}})$", 1))
        placed = lambda n: F.struct(n.alias("n"), (x["start"] + F.length(x["m"]) - F.length(n)).alias("s"), x["m"].alias("m"))
        return let(let(name, placed), lambda p: scored(p, parts))

    def scored(p: Column, parts: Column) -> Column:
        name, start = p["n"], p["s"]
        end = start + F.length(name)
        led = like(F.substring(p["m"], F.lit(1), F.length(p["m"]) - F.length(name)), "(?:通知|告知|委托)$")
        acts = like(at(parts, end, 4), f"^{any_word(ACTIONS)}")
        bad = like(name, any_word([*NAME_STOPWORDS, *ROLE_WORDS])) | one_of(name, [*PARTIES, *ROLES, *ORG_STOPWORDS])
        keep = (name != "") & _has_surname(name, settings) & (acts | led) & ~bad
        reasons = F.array(F.lit("正文姓名候选：姓氏与动作/称谓语境匹配，需人工复核"))
        return F.when(keep, span(PERSON_ORD, "PERSON_NAME", start, end, F.lit(0.72), reasons, name))

    return made_of(matches(text, _BODY, _has_han(text)), text, make)


def address_parts(value: Column) -> Column:
    """How many of the words that make up addresses the value contains."""
    return F.size(F.filter(constant(ADDRESS_PARTS, "array<string>"), lambda w: F.contains(value, w)))


_STOPS = ADDRESS_STOPS.replace("[", r"\[").replace("]", r"\]")
_LIVES = r"(?:^|(?<=[，,。；;\n]))[ \t]*住[ \t]*(?=[" + HAN + "])"
_ADDRESS_LABEL = rf"(?>(?=[{_firsts(ADDRESS_LABELS)}])(?:{_any(ADDRESS_LABELS)})\s*(?:[:=]|\n)\s*|{_LIVES})"
_ADDRESS_BODY = rf"[^{_STOPS}]{{0,5}}(?:(?!{any_word(ADDRESS_FIELDS)})[^{_STOPS}])*"


def addresses(text: Column) -> Column:
    """Addresses after a label, or after 住 at the start of a clause, and bare ones from province to number."""

    def make(x: Column) -> Column:
        label = F.regexp_extract(x["m"], rf"^(?:(?:{_any(ADDRESS_LABELS)})\s*(?:[:=]|\n)\s*|[ \t]*住[ \t]*)", 0)
        value = lambda w: F.substring(x["m"], F.length(w) + 1, F.length(x["m"]))
        placed = lambda w: F.struct(F.btrim(w, F.lit(" \n")).alias("l"), value(w).alias("w"), F.btrim(value(w), F.lit(" \n")).alias("v"), (x["start"] + F.length(w)).alias("s"))  # noqa: E501, E731
        told = lambda p: F.struct(p.alias("p"), address_parts(p["v"]).alias("n"), like(p["v"], "[0-9]").alias("digit"))
        return let(let(let(label, placed), told), scored)

    def scored(x: Column) -> Column:
        p, n, digit = x["p"], x["n"], x["digit"]
        label, value = p["l"], p["v"]
        conf = F.lit(0.55) + F.lit(0.1) * F.least(n, F.lit(3)) + F.when(digit, F.lit(0.08)).otherwise(F.lit(0.0))
        reasons = F.array_compact(
            F.array(
                F.concat(F.lit("地址标签「"), label, F.lit("」引导")),
                F.concat(F.lit("含 "), n.cast("string"), F.lit(" 个行政区划/门牌要素")),
                F.when(digit, F.lit("含门牌数字")),
            )
        )
        lives = (label != "住") | ((n >= 2) & like(value, "省|自治区|市|区|县|镇|乡|村"))
        keep = (F.length(value) >= 6) & like(value, f"[{HAN}]") & lives
        return F.when(keep, span(ADDRESS_ORD, "ADDRESS", p["s"], p["s"] + F.length(p["w"]), F.least(conf, F.lit(0.95)), reasons, value))

    def bare(x: Column) -> Column:
        conf = F.lit(0.6) + F.lit(0.05) * address_parts(x["m"])
        return span(ADDRESS_ORD, "ADDRESS", x["start"], x["start"] + F.length(x["m"]), F.least(conf, F.lit(0.92)), F.array(F.lit("显式行政区划+门牌结构")), x["m"])

    led = matches(text, _ADDRESS_LABEL + _ADDRESS_BODY, _has_han(text) & like(text, any_word([*ADDRESS_LABELS, "住"])))
    led = F.filter(F.transform(led, make), lambda s: s.isNotNull())
    return F.concat(led, F.transform(matches(text, BARE_ADDRESS, _has_han(text) & like(text, "省|自治区")), bare))


_ORG_BODY = rf"[{HAN}A-Za-z0-9（）()·&.\-'\"&&[^{ORG_BREAKS}（）\"']]"


def organisations(text: Column) -> Column:
    """Names that end like an organisation's, back to the last character that can't be in one."""

    def make(x: Column, parts: Column) -> Column:
        end = x["start"] + F.length(x["m"])
        # backwards, a name begins at once; forwards, each place before it would be tried
        back = lambda left: F.reverse(F.regexp_extract(F.reverse(left), f"^{_ORG_BODY}+", 0))
        far = back(F.substring(text, F.lit(1), end))
        whole = let(back(at(parts, end - ORG_REACH, ORG_REACH)), lambda near: F.when((F.length(near) == ORG_REACH) & (end > ORG_REACH), far).otherwise(near))
        placed = lambda w: F.struct(w.alias("w"), F.btrim(w, F.lit(" ·-&\"'")).alias("v"), end.alias("e"), x["m"].alias("x"))
        return let(let(whole, placed), lambda p: trimmed(p, parts))

    def trimmed(p: Column, parts: Column) -> Column:
        v = p["v"]
        for lead in (f"(?:{'|'.join(ORG_LEADS)})(?=.{{4}})", r"\d+\s*号(?=.{4})", "号(?=[^0-9])(?=.{4})", "[本该其某贵](?=.{4})"):
            v = F.regexp_replace(v, f"^{lead}", "")
        placed = lambda w: F.struct(w.alias("v"), (p["e"] - F.length(p["w"]) + F.length(p["v"]) - F.length(w)).alias("s"), p["e"].alias("e"), p["x"].alias("x"), p["v"].alias("o"))  # noqa: E501, E731
        return let(let(v, placed), lambda q: scored(q, parts))

    def scored(p: Column, parts: Column) -> Column:
        v, suffix = p["v"], p["x"]
        keep = (F.length(p["o"]) >= 5) & (F.length(v) >= 5) & ~one_of(v, ORG_STOPWORDS) & ~one_of(p["o"], ORG_STOPWORDS) & F.endswith(v, suffix)
        party = let(keyword_context(parts, p["s"], p["e"], 30), lambda c: first_word(c, ORG_PARTIES).isNotNull())
        return F.when(keep, let(party, lambda y: told(p, y)))

    def told(p: Column, party: Column) -> Column:
        v, suffix = p["v"], p["x"]
        conf = F.when(one_of(suffix, ORG_STRONG), F.lit(0.88)).otherwise(F.lit(0.58)) + F.when(party, F.lit(0.06)).otherwise(F.lit(0.0))
        reasons = F.array_compact(F.array(F.concat(F.lit("含组织机构后缀「"), suffix, F.lit("」")), F.when(party, F.lit("位于合同主体上下文"))))
        return span(ORG_ORD, "ORG_NAME", p["s"], p["e"], F.least(conf, F.lit(0.95)), reasons, v)

    endings = any_word([*ORG_STRONG, *ORG_WEAK])
    return made_of(matches(text, endings, _has_han(text) & like(text, endings)), text, make)


def context_spans(text: Column, settings: Settings) -> list[Column]:
    active, out = set(settings.active()), []
    if "PERSON_NAME" in active:
        out += [labelled_names(text, settings), body_names(text, settings)]
    if "ADDRESS" in active:
        out.append(addresses(text))
    if "ORG_NAME" in active:
        out.append(organisations(text))
    return out or [none()]
