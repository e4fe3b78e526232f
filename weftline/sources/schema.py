"""JSON Schema compiled to column expressions: a document's violations as rows of an array, without leaving Spark.

Known keywords: type (one or several), enum, const, pattern, minLength, maxLength, minimum, maximum, exclusiveMinimum,
exclusiveMaximum, multipleOf, required, properties, additionalProperties (false or a schema), items, minItems, maxItems, anyOf,
allOf, not. Others that only describe ($schema, $id, title, description, default, examples, format) are passed over; any
other is refused when the schema is compiled, so nothing is silently unchecked. A keyword speaks of values of its own type
alone, as the standard has it; integers are numbers, and 1.0 is an integer.

A text that is no JSON has the one violation "json"; a null text has none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIPTIVE = {"$schema", "$id", "title", "description", "default", "examples", "format", "$comment"}
_ISSUE = "array<struct<path:string,keyword:string>>"


def _kind(v: Column) -> Column:
    """The JSON type of a variant, null for a missing value."""
    name = F.schema_of_variant(v)
    whole = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull(), F.lit(None)).when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").when((name == "BIGINT") | (whole == F.floor(whole)), "integer").otherwise("number")
    )


def _child(name: str) -> str:
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']" if not name.isidentifier() else f"$.{name}"


def violations(schema: dict | bool, v: Column, path: Column | None = None) -> Column:
    """An array of (path, keyword) over a variant; missing values violate nothing."""
    path = F.lit("$") if path is None else path
    none = F.array().cast(_ISSUE)
    if isinstance(schema, bool):
        return none if schema else F.when(v.isNotNull(), _one(path, "false")).otherwise(none)
    kind = _kind(v)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    is_text, is_number, is_object, is_array = kind == "string", kind.isin("integer", "number"), kind == "object", kind == "array"
    parts = F.when(is_array, F.try_variant_get(v, "$", "array<variant>"))
    fields = F.when(is_object, F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    out: list[Column] = []

    def bad(keyword: str, when: Column) -> None:
        out.append(F.when(F.coalesce(when, F.lit(False)) & v.isNotNull(), _one(path, keyword)).otherwise(none))

    for keyword, want in schema.items():
        if keyword in DESCRIPTIVE:
            continue
        if keyword == "type":
            wanted = [want] if isinstance(want, str) else list(want)
            bad(keyword, ~kind.isin(wanted + ["integer"] * ("number" in wanted)))
        elif keyword in ("enum", "const"):
            values = want if keyword == "enum" else [want]
            bad(keyword, ~F.to_json(v).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True) for x in values]))
        elif keyword == "pattern":
            bad(keyword, is_text & ~text.rlike(want))
        elif keyword in ("minLength", "maxLength"):
            bad(keyword, is_text & (F.length(text) < want if keyword == "minLength" else F.length(text) > want))
        elif keyword == "minimum":
            bad(keyword, is_number & (number < want))
        elif keyword == "maximum":
            bad(keyword, is_number & (number > want))
        elif keyword == "exclusiveMinimum":
            bad(keyword, is_number & (number <= want))
        elif keyword == "exclusiveMaximum":
            bad(keyword, is_number & (number >= want))
        elif keyword == "multipleOf":
            bad(keyword, is_number & (number / want != F.floor(number / want)))
        elif keyword in ("minItems", "maxItems"):
            bad(keyword, is_array & (F.size(parts) < want if keyword == "minItems" else F.size(parts) > want))
        elif keyword == "required":
            lacking = F.filter(F.array(*map(F.lit, want)), lambda name: ~F.array_contains(fields, name))
            out.append(F.when(is_object, F.transform(lacking, lambda name: F.struct(F.concat(path, F.lit("."), name).alias("path"), F.lit("required").alias("keyword")))).otherwise(none))
        elif keyword == "properties":
            for name, own in want.items():
                out.append(violations(own, F.when(is_object, F.try_variant_get(v, _child(name), "variant")), F.concat(path, F.lit(f".{name}"))))
        elif keyword == "additionalProperties":
            if want is not True:
                known = F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else F.array().cast("array<string>")
                other = F.map_filter(F.when(is_object, F.try_variant_get(v, "$", "map<string,variant>")), lambda k, _: ~F.array_contains(known, k))
                own = lambda e: _one(F.concat(path, F.lit("."), e["key"]), keyword) if want is False else violations(want, e["value"], F.concat(path, F.lit("."), e["key"]))  # noqa: E731, B023
                out.append(F.coalesce(F.flatten(F.transform(F.map_entries(other), own)), none))
        elif keyword == "items":
            own = lambda x, k: violations(want, x, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))  # noqa: E731, B023
            out.append(F.coalesce(F.flatten(F.transform(parts, own)), none))
        elif keyword == "allOf":
            out += [violations(s, v, path) for s in want]
        elif keyword == "anyOf":
            bad(keyword, F.forall(F.array(*[F.size(violations(s, v, path)) > 0 for s in want]), lambda x: x))
        elif keyword == "not":
            bad(keyword, F.size(violations(want, v, path)) == 0)
        else:
            raise ValueError(f"schema keyword {keyword} is not known")
    return F.concat(*out).cast(_ISSUE) if out else none


def _one(path: Column, keyword: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))).cast(_ISSUE)


def validate(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """rows (without the column) with path and keyword, a row for each violation of the schema by a column of JSON text."""
    v = F.try_parse_json(column)
    found = F.when(F.col(column).isNotNull() & v.isNull(), _one(F.lit("$"), "json")).otherwise(violations(schema, F.col("_v")))
    out = rows.withColumn("_v", v).withColumn("_x", F.explode(found))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c != column), F.col("_x.path").alias("path"), F.col("_x.keyword").alias("keyword"))


def valid(rows: DataFrame, column: str, schema: dict) -> DataFrame:
    """rows whose JSON text keeps to the schema."""
    v = F.try_parse_json(column)
    held = rows.withColumn("_v", v).where(F.col(column).isNotNull() & F.col("_v").isNotNull()).where(F.size(violations(schema, F.col("_v"))) == 0)
    return held.drop("_v")
