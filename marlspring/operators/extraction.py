"""Fields from free text: a table of rules, scanned in one pass of a text, and the filling of what is still unknown.

A label's value is the rest of its line (or of the next line with text); a token is its own value; a shape's value is its first group.
All labels and tokens of a table are one pattern that branches letter by letter, so a text is read once, however many
rules there are. A rule takes no label inside its own last value; different rules may overlap.

Defined results: null and empty texts have no matches; letter case doesn't count; a label without a value is no match; rows that
repeat a key are scanned each on its own, and ``fields`` takes them together; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspring.functions.scalars import strip


class Rule(NamedTuple):
    """One rule; those of a field count in the order of the table. ``many`` fields keep all values, others the first."""

    field: str
    kind: str  # label, token, shape or block
    terms: tuple[str, ...]
    many: bool = False


def _labels(field: str, *terms: str, many: bool = False) -> list[Rule]:
    """A rule for each pair of a Chinese and an English label."""
    return [Rule(field, "label", tuple(t.split("|")), many) for t in terms]


#: The labels, tokens and shapes of the survey's tables.
METEORITE = [
    *_labels("name", "陨石|meteorite", "名称|name", "样本|sample"),
    Rule("name", "shape", (r"([A-Z]{2,4}\d{4,6})", r"([A-Z]{2,4}-\d{4,6})")),
    *_labels("classification", "分类|classification", "类型|type"),
    Rule("classification", "token", ("chondrite", "achondrite", "iron", "stony-iron", "carbonaceous")),
    Rule("classification", "token", ("普通球粒陨石", "碳质球粒陨石", "顽辉石球粒陨石")),
    *_labels("location", "发现地点|location|found at", "发现位置|discovery site", "来源|origin"),
    *_labels("weight", "重量|weight|mass"),
    Rule("weight", "shape", (r"(\d+\.?\d*)\s*(?:g|kg|克|千克)", r"(\d+\.?\d*)\s*(?:grams?|kilograms?)")),
    *_labels("date", "发现日期|date|found"),
    Rule("date", "shape", (r"(\d{4}年\d{1,2}月\d{1,2}日)", r"(\d{4}-\d{1,2}-\d{1,2})", r"(\d{4}/\d{1,2}/\d{1,2})")),
]
ORGANIC = [
    *_labels("compounds", "有机化合物|organic compound", "氨基酸|amino acid", "蛋白质|protein", "脂质|lipid", "碳水化合物|carbohydrate", "核酸|nucleic acid", "糖类|sugar", "醇类|alcohol", "酸类|acid", "胺类|amine", many=True),
    *_labels("concentration", "浓度|concentration", "含量|content"),
    Rule("concentration", "shape", (r"(\d+\.?\d*)\s*(?:ppm|ppb|%|mg/kg|μg/g)",)),
    *_labels("detection_method", "检测方法|detection method", "分析方法|analysis method", many=True),
    Rule("detection_method", "token", ("GC-MS", "LC-MS", "HPLC", "NMR", "FTIR", "XPS", "TEM", "SEM"), True),
    Rule("detection_method", "token", ("气相色谱", "液相色谱", "核磁共振", "红外光谱", "X射线光电子能谱"), True),
    *_labels("distribution", "分布|distribution", "位置|location", "区域|region"),
]
MINERAL = [
    *_labels("relationships", "矿物关系|mineral relationship", "矿物相互作用|mineral interaction", "矿物组合|mineral assemblage", "矿物共生|mineral paragenesis", "矿物结构|mineral structure", many=True),
    *_labels("minerals", "矿物种类|mineral species", "矿物成分|mineral composition", "主要矿物|major minerals", "次要矿物|minor minerals", many=True),
    Rule("minerals", "token", ("olivine", "pyroxene", "plagioclase", "feldspar", "quartz", "carbonate", "sulfide", "oxide"), True),
    Rule("minerals", "token", ("橄榄石", "辉石", "长石", "石英", "碳酸盐", "硫化物", "氧化物"), True),
    *_labels("interactions", "相互作用|interaction", "反应机制|reaction mechanism", "形成过程|formation process", "变质作用|metamorphism", "蚀变作用|alteration", many=True),
    *_labels("organic_mineral_relations", "矿物-有机质|mineral-organic", "有机质-矿物|organic-mineral", "矿物表面|mineral surface", "吸附作用|adsorption", "催化作用|catalysis", many=True),
]
INSIGHTS = [
    *_labels("significance", "科学意义|scientific significance", "研究意义|research significance", "科学价值|scientific value", "重要性|importance", "意义|significance", many=True),
    *_labels("conclusions", "结论|conclusion", "主要结论|main conclusion", "研究发现|research finding", "结果|result", "发现|finding", many=True),
    *_labels("implications", "影响|implication", "科学影响|scientific implication", "研究影响|research implication", "应用前景|application prospect", "未来研究|future research", many=True),
    *_labels("life_origin_insights", "生命起源|origin of life", "天体生物学|astrobiology", "生命前化学|prebiotic chemistry", "有机合成|organic synthesis", "化学演化|chemical evolution", many=True),
    *_labels("cosmochemistry_insights", "宇宙化学|cosmochemistry", "太阳系形成|solar system formation", "行星形成|planetary formation", "星际介质|interstellar medium", "分子云|molecular cloud", many=True),
]
REFERENCES = [Rule("references", "block", tuple(t.split("|"))) for t in ("参考文献|reference|references", "引用文献|cited reference|cited references", "文献列表|bibliography", "引用|citation")]

_AFTER = re.compile(r"[\s:：]*([^\n]*)")
_BLOCK = re.compile(r"[\s:：]*(.+?)(?:\n\n|\Z)", re.S)


def _branches(terms: list[str]) -> str:
    """A pattern that matches the longest of some words at a place, branching letter by letter."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def text(node: dict) -> str:
        ways = [re.escape(c) + text(child) for c, child in sorted(node.items()) if c]
        inner = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        return f"(?:{inner})?" if "" in node and inner else inner

    return text(tree)


def scanner(rules: list[Rule]) -> Callable[[str], list[tuple[str, int, bool, str, int, int]]]:
    """A function from a text to its matches (field, rule, many, value, start, end), by start and rule."""
    at: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        if rule.kind != "shape":
            for term in rule.terms:
                at.setdefault(term.casefold(), []).append(i)
    # Words that begin another one of the table are found with it.
    within = {w: [(max(len(p) for p in at if w.startswith(p) and i in at[p]), i) for i in sorted({i for p in at if w.startswith(p) for i in at[p]})] for w in at}
    words = re.compile(_branches(list(at)), re.I) if at else None
    shapes = [(i, re.compile("|".join(rule.terms), re.I)) for i, rule in enumerate(rules) if rule.kind == "shape"]

    def scan(text: str) -> list[tuple[str, int, bool, str, int, int]]:
        found, busy = [], [0] * len(rules)
        place = words.search(text) if words else None
        while place:
            start = place.start()
            for n, i in within.get(place[0].casefold(), ()):
                if start < busy[i]:
                    continue
                kind, end = rules[i].kind, start + n
                if kind == "token":
                    value = text[start:end]
                else:
                    m = (_BLOCK if kind == "block" else _AFTER).match(text, end)
                    value, end = (m[1].strip(), m.end(1)) if m else ("", end)
                if value:
                    found.append((rules[i].field, i, rules[i].many, value, start, end))
                    busy[i] = end
            place = words.search(text, start + 1)
        for i, shape in shapes:
            for m in shape.finditer(text):
                found.append((rules[i].field, i, rules[i].many, next(g for g in m.groups() if g is not None), m.start(), m.end()))
        return sorted(found, key=lambda f: (f[4], f[1]))

    return scan


def longest_spans(found: list[tuple]) -> list[tuple]:
    """Of matches of one field whose spans overlap, the longest, then the earliest."""
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (f[4] - f[5], f[4], f[1])):
        if not any(f[0] == k[0] and f[4] < k[5] and k[4] < f[5] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[4], f[1]))


def scan(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text", resolve: bool = False) -> DataFrame:
    """key, field, rule, many, value, start, stop (code points) of every match; ``resolve`` keeps one of overlapping spans of a field."""
    keys = docs.select(F.col(key)).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner(rules)
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                some = find(t or "")
                some = longest_spans(some) if resolve else some
                found += some
                rows += [i] * len(some)
            told = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *told], [key, "field", "rule", "many", "value", "start", "stop"])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {keys.dataType.simpleString()}, field string, rule int, many boolean, value string, start long, stop long")


def fields(matches: DataFrame, key: str = "doc_id", separator: str = "; ") -> DataFrame:
    """key, field, value: a field's first value by rule and place, or all its different values, joined in that order."""
    g = matches.groupBy(key, "field", "many").agg(F.array_sort(F.collect_list(F.struct("rule", "start", "value"))).alias("v"))
    every = F.array_join(F.array_distinct(F.col("v.value")), separator)
    return g.select(key, "field", F.when(F.col("many"), every).otherwise(F.col("v")[0]["value"]).alias("value"))


def reference_lines(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos, line: the lines of the first block of references."""
    first = Window.partitionBy(key).orderBy("rule", "start")
    block = matches.where("field = 'references'").withColumn("_k", F.row_number().over(first)).where("_k = 1")
    lines = F.filter(F.transform(F.split("value", "\n"), strip), lambda x: x != "")
    return block.select(key, F.posexplode(lines).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


#: What counts as unknown, and the patterns that fill it from a context.
UNKNOWN = ["", "Unknown", "Not specified"]
CLASS = r"(?i)\b(CI|CM|CO|CV|CR|CK|CH|CB|H|L|LL)\s?([1-7])\b"
NAME = r"\b([A-Z][a-zA-Z\-']{2,}\s?(?:[A-Z][a-zA-Z\-']{2,})?)\s+(?:meteorite|chondrite)\b"
PLACE = r"\b(?:found|discovered|collected|from|at|in)\s+([A-Z][A-Za-z\- ]{2,})(?:\.|,|;|\))"
ORIGIN = r"(?i)\b(parent\s+body|origin)\s*[:\-]?\s*([A-Za-z0-9\- ]{3,})\b"


def missing(c: Column) -> Column:
    return c.isNull() | strip(c).isin(UNKNOWN)


def guesses(context: Column) -> dict[str, Column]:
    """What a context says of each field; null where it says nothing."""
    t = F.coalesce(context, F.lit(""))
    some = lambda c: F.when(c != "", c)
    place = strip(F.regexp_extract(t, PLACE, 1))
    return {
        "classification": some(F.concat(F.upper(F.regexp_extract(t, CLASS, 1)), F.regexp_extract(t, CLASS, 2))),
        "name": some(strip(F.regexp_extract(t, NAME, 1))),
        "discovery_location": some(F.when(F.size(F.split(place, r"\s+")) <= 6, place)),
        "origin": some(strip(F.regexp_extract(t, ORIGIN, 2))),
    }


def fill_missing(rows: DataFrame, context: str) -> DataFrame:
    """Fields that are there and unknown get what the context says; others stay; ``filled`` counts those that changed."""
    said = {f: g for f, g in guesses(F.col(context)).items() if f in rows.columns}
    changed = sum((F.when(missing(F.col(f)) & g.isNotNull(), 1).otherwise(0) for f, g in said.items()), F.lit(0))
    new = {f: F.when(missing(F.col(f)), F.coalesce(g, F.col(f))).otherwise(F.col(f)) for f, g in said.items()}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in rows.columns], changed.cast("long").alias("filled"))
