"""Typed front matter: a line automaton over the block between the leading --- lines, as one fold inside Spark.

Blank lines and lines that begin with # are passed over. `key: value` is an entry, `key:` opens a list that the lines
`- item` right after it fill; any other line closes the list. Lines that are neither (no colon, or a key with a space or
a dot) are bad: they close a list and give nothing. A key that stands twice keeps its last value.

A value ends before " #". In quotes it is text without them; in brackets a list of what stands between commas, empty
parts left out; items lose quotes at both ends. true and false (any case) are boolean, then integers and numbers are
told apart by their form, and text that begins with a date YYYY-MM-DD is a date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import front_matter, strip

_ENTRY = "struct<key:string,type:string,text:string,items:array<string>>"
_STATE = f"struct<entries:array<{_ENTRY}>,open:string,items:array<string>,bad:array<string>>"
_NONE = "cast(null as string)"


def unquoted(item: Column) -> Column:
    return F.regexp_replace(strip(item), "^['\"]+|['\"]+$", "")


def typed(value: Column) -> Column:
    """type, text, items of a value: boolean, integer, number, date, string, or array_string with its items."""
    plain = strip(F.regexp_replace(value, r"(?s) #.*$", ""))
    quoted = plain.rlike(r"""(?s)^(["'])(?:.*\1)?$""")
    listed = plain.rlike(r"(?s)^\[.*\]$") & ~quoted
    text = F.when(quoted, F.regexp_replace(plain, r"(?s)^.|(?<=.).$", "")).otherwise(plain)
    items = F.filter(F.transform(F.split(F.regexp_replace(plain, r"^\[|\]$", ""), ","), unquoted), lambda x: x != "")
    number = (
        F.when(quoted, F.lit(None)).when(F.lower(plain).isin("true", "false"), "boolean").when(plain.rlike(r"^[+-]?\d+$"), "integer")
        .when(plain.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?$"), "number")
    )
    kind = F.when(listed, "array_string").otherwise(F.coalesce(number, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), "date"), F.lit("string")))
    return F.struct(kind.alias("type"), F.when(~listed, text).alias("text"), F.when(listed, items).alias("items"))


def parsed(block: Column) -> Column:
    """entries (key, type, text, items) in order, and bad lines, of a front-matter block; null without one."""
    none = F.lit(None).cast("string")
    nothing = F.array().cast("array<string>")

    def entry(key: Column, kind: Column, text: Column, items: Column) -> Column:
        return F.struct(key.alias("key"), kind.alias("type"), text.alias("text"), items.alias("items")).cast(_ENTRY)

    def closed(s: Column) -> Column:
        return F.when(s["open"].isNull(), s["entries"]).otherwise(F.concat(s["entries"], F.array(entry(s["open"], F.lit("array_string"), none, s["items"]))))

    def state(entries: Column, open_: Column, items: Column, bad: Column) -> Column:
        return F.struct(entries.alias("entries"), open_.alias("open"), items.alias("items"), bad.alias("bad")).cast(_STATE)

    def step(s: Column, line: Column) -> Column:
        t = strip(line)
        key = strip(F.substring_index(t, ":", 1))
        value = strip(F.substring(t, F.locate(":", t) + 1, F.length(t)))
        good = (F.locate(":", t) > 1) & ~key.rlike("[. ]")
        found = typed(value)
        return (
            F.when((t == "") | t.startswith("#"), s)
            .when(s["open"].isNotNull() & t.startswith("- "), state(s["entries"], s["open"], F.concat(s["items"], F.array(unquoted(F.substring(t, F.lit(3), F.length(t))))), s["bad"]))
            .when(~good, state(closed(s), none, nothing, F.concat(s["bad"], F.array(t))))
            .when(value == "", state(closed(s), key, nothing, s["bad"]))
            .otherwise(state(F.concat(closed(s), F.array(entry(key, found["type"], found["text"], found["items"]))), none, nothing, s["bad"]))
        )

    begin = state(F.array().cast(f"array<{_ENTRY}>"), none, nothing, nothing)
    return F.aggregate(F.split(block, "\n"), begin, step, lambda s: F.struct(closed(s).alias("entries"), s["bad"].alias("bad")))


def front_matter_entries(content: Column) -> Column:
    """The entries of a page, the last of each key, in order of the keys; null without front matter."""

    def once(p: Column) -> Column:
        last = F.filter(p["entries"], lambda x, k: ~F.exists(F.slice(p["entries"], k + 2, F.size(p["entries"])), lambda y: y["key"] == x["key"]))
        return F.array_sort(last, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))

    return F.transform(F.array(parsed(front_matter(content))), once)[0]  # so that the block is parsed once


def front_matter_value(content: Column, name: str) -> Column:
    """type, text, items of one key, or null."""
    return F.get(F.filter(front_matter_entries(content), lambda x: x["key"] == name), F.lit(0))
