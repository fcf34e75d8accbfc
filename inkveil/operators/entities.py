"""Entities: the core of an organisation's name, which names mean the same, and one number for each entity of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.arrays import before, let, runs
from inkveil.functions.spans import any_word, one_of

# Regions before organisations' names.
REGIONS = (
    "中华人民共和国", "中国", "中华", "全国", "北京", "上海", "天津", "重庆", "广东", "广西", "深圳", "广州", "珠海", "东莞", "佛山", "中山", "惠州",
    "江苏", "南京", "苏州", "无锡", "常州", "南通", "徐州", "扬州", "昆山", "浙江", "杭州", "宁波", "温州", "嘉兴", "绍兴", "金华", "台州", "义乌",
    "山东", "济南", "青岛", "烟台", "潍坊", "临沂", "福建", "福州", "厦门", "泉州", "漳州", "湖南", "长沙", "湖北", "武汉", "河南", "郑州", "洛阳",
    "河北", "石家庄", "唐山", "四川", "成都", "绵阳", "陕西", "西安", "安徽", "合肥", "江西", "南昌", "山西", "太原", "辽宁", "沈阳", "大连", "吉林",
    "长春", "黑龙江", "哈尔滨", "云南", "昆明", "贵州", "贵阳", "南宁", "海南", "海口", "甘肃", "兰州", "青海", "西宁", "宁夏", "银川", "新疆",
    "乌鲁木齐", "内蒙古", "呼和浩特", "西藏", "拉萨",
)

#: Characters that a core has at least, and times that a name is stripped.
CORE_CHARS, ROUNDS = 3, 3


def _endings() -> list[str]:
    from inkveil.operators.context import ORG_STRONG, ORG_WEAK

    return sorted({*ORG_STRONG, *ORG_WEAK, "公司"}, key=lambda w: (-len(w), w))


def _strips(name: Column) -> Column:
    """The name without its longest region, and without its longest ending; null where that leaves too little."""
    regions = "|".join(sorted(REGIONS, key=lambda w: (-len(w), w)))
    # within lambdas what a name stands for twice is computed twice
    front = F.regexp_extract(name, rf"^(?>{regions})(.{{{CORE_CHARS},}})$", 1)
    ending = F.length(F.regexp_extract(name, f"{any_word(_endings())}$", 0))
    rest = let(ending, lambda n: F.when((n > 0) & (F.length(name) - n >= CORE_CHARS), F.substring(name, F.lit(1), F.length(name) - n)).otherwise(F.lit("")))
    return F.filter(F.array(front, rest), lambda v: v != "")


def _empty_name(name: Column) -> Column:
    return one_of(name, [*REGIONS, *_endings()])


def org_core(name: Column) -> Column:
    """The name stripped of region and ending, region first, up to ROUNDS times, but not down to a region or an ending."""
    for _ in range(ROUNDS):
        name = let(name, lambda n: F.coalesce(F.get(F.filter(_strips(n), lambda v: ~_empty_name(v)), F.lit(0)), n))
    return name


def org_variants(name: Column) -> Column:
    """All names that stripping in any order gives, the name itself too; sorted."""
    out = F.array(name)
    for _ in range(ROUNDS):
        out = let(out, lambda o: F.array_distinct(F.concat(o, F.flatten(F.transform(o, _strips)))))
    return F.array_sort(F.filter(out, lambda v: (F.length(v) >= CORE_CHARS) & ~_empty_name(v)))


def same_org(a: Column, b: Column) -> Column:
    """Whether two arrays of variants share one, or one of four characters or more begins with one of the other."""
    pair = lambda x, y: (x == y) | ((F.length(x) >= 4) & F.startswith(x, y)) | ((F.length(y) >= 4) & F.startswith(y, x))
    return let(b, lambda bs: F.exists(a, lambda x: F.exists(bs, lambda y: pair(x, y))))


def org_groups(orgs: Column) -> Column:
    """Connected groups of array<struct<key, first>> of one document as array<struct<first, keys, variants>>.

    Each name in turn joins all groups that it belongs to into one.
    """
    empty = F.array().cast("array<struct<first:int,keys:array<string>,variants:array<string>>>")

    def step(acc: Column, o: Column) -> Column:
        joined = lambda v: let(F.filter(acc, lambda g: same_org(g["variants"], v)), lambda same: F.concat(others(v, same), F.array(merged(same, o, v))))
        others = lambda v, same: F.when(F.size(same) == 0, acc).otherwise(F.filter(acc, lambda g: ~same_org(g["variants"], v)))
        return let(org_variants(o["key"]), joined)

    def merged(groups: Column, o: Column, v: Column) -> Column:
        first = F.array_min(F.concat(F.transform(groups, lambda g: g["first"]), F.array(o["first"])))
        keys = F.concat(F.flatten(F.transform(groups, lambda g: g["keys"])), F.array(o["key"]))
        variants = F.array_distinct(F.concat(F.flatten(F.transform(groups, lambda g: g["variants"])), v))
        return F.struct(first.alias("first"), keys.alias("keys"), variants.alias("variants"))

    return F.aggregate(orgs, empty, step)


def entity_numbers(items: Column) -> Column:
    """Numbers of array<struct<type_id, key, first>> of one document, as array<struct<type_id, key, number>> in the same order.

    Within a type entities count from 1 by their first position; organisations that are the same share a number.
    """
    orgs = F.transform(F.array_sort(F.transform(F.filter(items, lambda i: i["type_id"] == "ORG_NAME"), lambda i: F.struct(i["first"], i["key"]))), lambda i: F.struct(i["key"].alias("key"), i["first"].alias("first")))

    def numbered(known: Column) -> Column:
        def rooted(i: Column, n: Column) -> Column:
            org = F.get(known["roots"], before(known["keys"], i["key"]))
            return F.struct(i["type_id"].alias("type_id"), F.when(i["type_id"] == "ORG_NAME", org).otherwise(i["first"]).alias("root"), n.alias("n"), i["key"].alias("key"))

        def number(entity: Column, k: Column) -> Column:
            return F.transform(entity, lambda i: F.struct(i["n"].alias("n"), i["type_id"].alias("type_id"), i["key"].alias("key"), (k + 1).alias("number")))

        # spans of one type don't overlap, so equal first positions are the same entity
        of_type = runs(F.array_sort(F.transform(items, rooted)), lambda a, b: a["type_id"] != b["type_id"])
        every = F.flatten(F.transform(of_type, lambda t: F.flatten(F.transform(runs(t, lambda a, b: a["root"] != b["root"]), number))))
        return F.transform(F.array_sort(every), lambda i: F.struct(i["type_id"].alias("type_id"), i["key"].alias("key"), i["number"].alias("number")))

    roots = F.flatten(F.transform(org_groups(orgs), lambda g: F.transform(g["keys"], lambda k: F.struct(k.alias("key"), g["first"].alias("root")))))
    by_key = lambda r: F.struct(F.transform(r, lambda x: x["key"]).alias("keys"), F.transform(r, lambda x: x["root"]).alias("roots"))
    return let(F.array_sort(roots), lambda r: let(by_key(r), numbered))


def placeholder(label: Column, number: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("#"), number.cast("string"), F.lit("]"))


#: A placeholder; groups: label and number.
PLACEHOLDER = r"\[([^\[\]#\s]{1,20})#(\d{1,6})\]"


def parse_placeholder(value: Column) -> tuple[Column, Column]:
    """Label and number of a whole placeholder; nulls for anything else."""
    v, whole = F.btrim(value, F.lit(" \t\n\r")), f"^{PLACEHOLDER}$"
    return F.when(v.rlike(whole), F.regexp_extract(v, whole, 1)), F.when(v.rlike(whole), F.regexp_extract(v, whole, 2).cast("int"))
