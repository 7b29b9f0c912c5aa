"""Measures of JSON values, and recovery of JSON from a model's answer: folds of a stack over tokens, a row each.

Strings are tokens of their own, so braces and escapes within them never count. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: Strings, marks, and runs of anything else that is no white space.
_TOKENS = rf'(?s){_STRING}|[{{}}\[\],:]|[^\s{{}}\[\],:"]+'
_OPEN, _CLOSE = ["{", "["], ["}", "]"]


def json_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_TOKENS), F.lit(0))


def measures(c: Column) -> Column:
    """depth, fields, nested, size (characters without white space between tokens) of a JSON text; null if it isn't JSON.

    A scalar has depth 0 and no fields; an object's members and an array's elements count as fields, at every level; nested means
    that a member or element is an object or an array. Repeated names count each.
    """
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("fields"), F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        stack = F.when(t.isin(_OPEN), F.concat(s["stack"], t)).when(t.isin(_CLOSE), F.left(s["stack"], F.length(s["stack"]) - 1)).otherwise(s["stack"])
        in_array = F.right(s["stack"], F.lit(1)) == "["
        new = (t == ":") | ((s["last"] == "[") & (t != "]")) | ((t == ",") & in_array)
        return F.struct(stack.alias("stack"), F.greatest(s["depth"], F.length(stack)).alias("depth"), (s["fields"] + F.when(new, 1).otherwise(0)).alias("fields"), t.alias("last"))

    tokens = json_tokens(c)
    size = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t)).cast("long")
    told = F.aggregate(tokens, start, step, lambda s: F.struct(s["depth"].cast("long").alias("depth"), s["fields"].alias("fields"), (s["depth"] > 1).alias("nested"), size.alias("size")))
    return F.when(F.try_parse_json(c).isNotNull(), told)


def keywords(c: Column) -> Column:
    """The path of every field (parts joined by dots, elements by their number) and every string of over two characters in lower case, each once, in order."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("stack"), none.alias("path"), none.alias("words"), F.lit("").alias("last"))
    text = lambda t: F.coalesce(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0], t)

    def step(s: Column, t: Column) -> Column:
        in_array, is_text = F.right(s["stack"], F.lit(1)) == "[", t.startswith('"')
        element = in_array & (((s["last"] == "[") & (t != "]")) | (s["last"] == ","))
        key = ~in_array & is_text & s["last"].isin("{", ",")
        outer = F.slice(s["path"], 1, F.greatest(F.size(s["path"]) - 1, F.lit(0)))
        number = (F.element_at(s["path"], -1).cast("int") + 1).cast("string")
        path = F.when(key, F.concat(outer, F.array(text(t)))).when(element, F.concat(outer, F.array(number))).otherwise(s["path"])
        words = F.when(key | element, F.concat(s["words"], F.array(F.array_join(path, ".")))).otherwise(s["words"])
        value = is_text & ~key & (F.size(s["path"]) > 0) & (F.length(text(t)) > 2)
        words = F.when(value, F.concat(words, F.array(F.lower(text(t))))).otherwise(words)
        stack = F.when(t.isin(_OPEN), F.concat(s["stack"], t)).when(t.isin(_CLOSE), F.left(s["stack"], F.length(s["stack"]) - 1)).otherwise(s["stack"])
        path = F.when(t == "{", F.concat(path, F.array(F.lit("")))).when(t == "[", F.concat(path, F.array(F.lit("-1")))).when(t.isin(_CLOSE), outer).otherwise(path)
        return F.struct(stack.alias("stack"), path.alias("path"), words.alias("words"), t.alias("last"))

    return F.when(F.try_parse_json(c).isNotNull(), F.aggregate(json_tokens(c), start, step, lambda s: F.array_distinct(s["words"])))


def object_measures(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth, fields, nested, size of each row's JSON; all null where it is none."""
    return rows.select(key, measures(F.col(json)).alias("m")).select(key, "m.depth", "m.fields", "m.nested", "m.size")


#: As tokens, but a string may lack its end (the text was cut), and nothing is left out.
_PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}\[\]]|[^{}\[\]"]+'


def balanced_json(c: Column) -> Column:
    """The first balanced JSON object of a text, or that of a cut text closed; null if neither parses.

    Marks of fenced blocks and control characters but tab and line breaks are dropped, then a stack runs from the first opening brace; braces in strings
    don't count. If the text ends first, an open string is closed, a comma, colon or name without a value at the end is dropped, and
    the open brackets are closed in their order.
    """
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    at = F.instr(t, F.lit("{"))
    body = F.when(at > 0, F.substring(t, at, F.length(t)))
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        stack = F.when(p.isin(_OPEN), F.concat(s["stack"], p)).when(p.isin(_CLOSE), F.left(s["stack"], F.greatest(F.length(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        now = F.struct(stack.alias("stack"), (s["n"] + F.length(p)).alias("n"), (stack == "").alias("done"))
        return F.when(s["done"], s).otherwise(now)

    run = F.aggregate(F.regexp_extract_all(body, F.lit(_PIECES), F.lit(0)), start, step)
    part = F.left(body, run["n"])
    # A string is open if the rest after all whole strings still has a quote.
    open_string = F.regexp_replace(part, rf"(?s){_STRING}", "").contains('"')
    shut = F.when(open_string, F.concat(F.regexp_replace(part, r"(?s)(?<!\\)((?:\\\\)*)\\\z", "$1"), F.lit('"'))).otherwise(part)
    closers = F.translate(F.reverse(run["stack"]), "{[", "}]")
    tidy = F.regexp_replace(shut, r"[\s,]+\z", "")
    named = F.regexp_replace(tidy, rf"(?s)(?<=[{{,])\s*{_STRING}\s*:?\s*\z", "")
    tries = [F.concat(x, closers) for x in (tidy, F.regexp_replace(named, r"[\s,]+\z", ""))]
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.when(run["done"], ok(part)).otherwise(F.coalesce(*[ok(x) for x in tries]))
