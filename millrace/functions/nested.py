"""Tolerant decoding of JSON text, unions and tool-call arguments."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """VARIANT of a JSON text, null if it is none."""
    return F.try_parse_json(c)


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def arguments(c: Column) -> Column:
    """(value, malformed) of a tool call's argument text: empty text is an empty object; text that is no object is malformed."""
    blank = F.coalesce(F.trim(c), F.lit("")) == ""
    return F.struct(F.when(blank, F.lit("{}")).when(is_object(c), c).alias("value"), (~blank & ~is_object(c)).alias("malformed"))


def repaired(c: Column) -> Column:
    """The first of the text and three repairs of it that parses: outer quotes removed, last commas removed, a brace added."""
    stripped = F.regexp_replace(F.trim(c), r"^\"|\"$", "")
    tries = [c, F.replace(stripped, F.lit('\\"'), F.lit('"')), F.regexp_replace(c, r",\s*([}\]])", "$1"), F.concat(c, F.lit("}"))]
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in tries))


def interval_pairs(c: Column) -> Column:
    """Pairs of numbers `a - b` or `[a, b]` in a text with a < b."""
    number = r"([0-9]+(?:\.[0-9]+)?)\s*(?:-|,|to)\s*([0-9]+(?:\.[0-9]+)?)"
    zipped = F.arrays_zip(F.regexp_extract_all(c, F.lit(number), 1).alias("s"), F.regexp_extract_all(c, F.lit(number), 2).alias("e"))
    pairs = F.transform(zipped, lambda p: F.struct(p["s"].cast("double").alias("s"), p["e"].cast("double").alias("e")))
    return F.filter(pairs, lambda p: p["s"] < p["e"])


def interval_items(c: Column) -> Column:
    """Intervals of a JSON list of objects (start, end) or of pairs, or of a text; only those with start < end."""
    items = F.from_json(c, "array<string>")
    number = lambda x, name, at: F.coalesce(F.get_json_object(x, f"$.{name}"), F.get_json_object(x, f"$[{at}]")).try_cast("double")
    found = F.transform(items, lambda x: F.struct(number(x, "start", 0).alias("s"), number(x, "end", 1).alias("e")))
    return F.when(F.ltrim(c).startswith("["), F.filter(F.coalesce(found, F.array().cast("array<struct<s:double,e:double>>")), lambda p: p["s"] < p["e"])).otherwise(interval_pairs(c))


def embedded_object(c: Column) -> Column:
    """The whole text if it is JSON, else the part from the first to the last brace, if that is."""
    part = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(*(F.when(F.try_parse_json(t).isNotNull(), t) for t in (c, part)))


def overall_verdict(c: Column) -> Column:
    """True or false from a line `Overall: PASS` or `FAIL`, else null."""
    word = F.upper(F.regexp_extract(c, r"(?i)overall\s*:?\s*(pass|fail)", 1))
    return F.when(word == "PASS", True).when(word == "FAIL", False)


def close_truncated(text: str | None) -> str | None:
    """A JSON text cut off at any place, closed: open string, last comma or colon, open brackets. Null if that is not JSON either."""
    if text is None:
        return None
    stack, inside, escaped = [], False, False
    for ch in text:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    base = (text[:-1] if escaped else text) + ('"' if inside else "")
    ends = "".join(reversed(stack))
    for body in (base, base.rstrip().rstrip(","), base.rstrip() + " null", base + ": null"):
        try:
            json.loads(body + ends)
        except ValueError:
            continue
        return body + ends
    return None


def closed(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(close_truncated, na_action="ignore"), "string")(c)


#: A JSON string and the colon after it, if it is a name.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'


def leaves(c: Column) -> Column:
    """All strings of a nested JSON text, at any depth and in order, names left out; empty if it is no JSON. In a JSON text a string is a name if, and only if, a colon follows, so nothing need be descended into."""
    found = F.transform(F.regexp_extract_all(c, F.lit(JSON_STRING), F.lit(0)), lambda m: F.rtrim(m, F.lit(" \t\r\n")))
    values = F.filter(found, lambda m: ~m.endswith(":"))
    text = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
    return F.when(c.isNotNull(), F.when(F.try_parse_json(c).isNotNull(), F.from_json(text, "array<string>")).otherwise(F.array().cast("array<string>")))


def depth(c: Column) -> Column:
    """How deep the brackets of a JSON text are nested."""
    marks = F.regexp_replace(F.regexp_replace(c, JSON_STRING, ""), r"[^\[\]{}]", "")
    step = lambda s, ch: F.struct((s["now"] + F.when(ch.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(ch.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.coalesce(F.aggregate(F.filter(F.split(marks, ""), lambda x: x != ""), start, step)["most"], F.lit(0))


def flattened(df: DataFrame, column: str, deepest: int | None = None) -> DataFrame:
    """A row for each innermost value of a JSON text, with path (`root.a[0].b`), names (all along the path) and value (its text; null for null and for an empty object or list). Texts that are no JSON give no row; other columns stay.

    A level is opened at a time and innermost values pass on, so all levels are one pass over the rows; how many there
    are is counted before, unless it is told.
    """
    if deepest is None:
        deepest = df.agg(F.max(depth(F.col(column)))).first()[0] or 0
    keep = [c for c in df.columns if c != column]
    now = df.withColumn("_v", F.try_parse_json(column)).filter("_v is not null").withColumns({"path": F.lit("root"), "names": F.array().cast("array<string>")})
    for _ in range(deepest):
        kind = F.schema_of_variant("_v")
        opened = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.col("_v"))
        now = now.withColumn("_in", opened).lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_in").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).when(F.col("pos").isNotNull(), F.concat(F.lit("["), F.col("pos"), F.lit("]"))).otherwise("")
        empty = F.col("_in").isNotNull() & F.col("pos").isNull()
        now = now.select(*keep, F.when(F.col("_in").isNull(), F.col("_v")).when(~empty, F.col("value")).alias("_v"), F.concat("path", step).alias("path"), F.when(F.col("key").isNotNull(), F.array_append("names", F.col("key"))).otherwise(F.col("names")).alias("names"))
    return now.select(*keep, "path", "names", F.try_variant_get("_v", "$", "string").alias("value"))


def boxes_by_time(c: Column) -> Column:
    """(time, box) of a JSON or Python-literal list of objects with a time and one box or several; boxes as given."""

    def one(text: str) -> list[tuple]:
        for read in (json.loads, ast.literal_eval):
            try:
                items = read(text)
                break
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                items = []
        out = []
        for item in items if isinstance(items, list) else []:
            if not isinstance(item, dict):
                continue
            found = next((item[k] for k in ("bbox_2d", "boxes", "bbox", "box") if item.get(k)), [])
            found = found if isinstance(found, (list, tuple)) else []
            found = [found] if len(found) == 4 and not isinstance(found[0], (list, tuple)) else found
            try:
                time = float(item.get("time", item.get("timestamp")))
                out += [(time, [float(x) for x in b]) for b in found if isinstance(b, (list, tuple)) and len(b) == 4]
            except (TypeError, ValueError):
                continue
        return out

    kind = "array<struct<t:double,box:array<double>>>"
    return F.pandas_udf(lambda s: s.map(lambda x: [{"t": t, "box": b} for t, b in one(x)], na_action="ignore"), kind)(c)


def tolerant(c: Column) -> Column:
    """VARIANT of a JSON text in which line ends and tabs may stand bare inside strings; null if it is none."""
    return F.from_json(F.trim(c, F.lit(" \t\r\n")), "variant", {"allowUnquotedControlChars": "true"})


def commands(c: Column) -> Column:
    """Command texts of tool arguments in any of their forms: an object with `commands` (objects, texts, or one text) or with one `keystrokes`, or a list or text of its own. Keystrokes that are no text come as their JSON text; null ones, and entries of other kinds, are left out; text that is no JSON has none."""
    v = tolerant(c)
    at = lambda x, path, kind: F.try_variant_get(x, path, kind)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("NULL"))
    given = F.json_object_keys(F.to_json(v))
    whole = F.when(kind(v).startswith("OBJECT"), F.when(F.array_contains(given, "commands"), at(v, "$.commands", "variant")).when(F.array_contains(given, "keystrokes"), v)).otherwise(v)
    one = F.when((kind(whole) == "STRING") | kind(whole).startswith("OBJECT"), F.array(whole))
    listed = F.coalesce(F.when(kind(whole).startswith("ARRAY"), at(whole, "$", "array<variant>")), one, F.array().cast("array<variant>"))
    text = lambda x: F.when(kind(x) == "STRING", at(x, "$", "string")).when(kind(x).startswith("OBJECT"), at(x, "$.keystrokes", "string"))
    return F.when(c.isNotNull(), F.filter(F.transform(listed, text), lambda x: x.isNotNull()))


def argument_map(c: Column) -> Column:
    """Arguments of a call as a map of names to texts (the JSON text of what is no string): empty for empty text, for text that is no JSON, and for JSON that is no object."""
    return F.coalesce(F.when(is_object(c), F.from_json(c, "map<string,string>")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def as_number(c: Column) -> Column:
    """The number that a whole text is, blanks around it and single underscores between digits allowed, `inf` and `nan` in any case too; else null. Spark's own cast would also take a suffix letter."""
    t = F.lower(F.trim(c.cast("string"), F.lit(" \t\r\n\f\x0b")))
    digits = r"[0-9](?:_?[0-9])*"
    ok = t.rlike(rf"^[-+]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[-+]?{digits})?|inf(?:inity)?|nan)$")
    return F.when(ok, F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
