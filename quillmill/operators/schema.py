"""Documents held against a JSON schema, compiled to expressions over ``variant``.

A schema becomes one column: an array of findings (path, keyword, property, detail) in the order of a
walk that goes into depth first and takes properties as the schema declares them. Nothing is decoded
in Python; a keyword that is not supported is an error when the column is built, never ignored.

Supported: $ref (into ``$defs`` of the same schema, not recursive), type, const, enum, properties, required,
additionalProperties (false), items, minItems, maxItems, uniqueItems, minLength, maxLength, pattern,
minimum, maximum, oneOf (branches told apart by the const of their ``type``), if with then.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ANNOTATIONS = {"$id", "$schema", "title", "description", "$defs"}
CONSTRAINTS = {"$ref", "type", "const", "enum", "properties", "required", "additionalProperties", "items", "minItems", "maxItems", "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "oneOf", "if", "then"}
FINDING = "array<struct<path:string,keyword:string,property:string,detail:string>>"


def _none() -> Column:
    return F.array().cast(FINDING)


def _finding(path: Column, keyword: str, detail, name: str | None = None) -> Column:
    shown = F.when(path == "", "(root)").otherwise(path)
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.array(F.struct(shown.alias("path"), F.lit(keyword).alias("keyword"), F.lit(name).cast("string").alias("property"), detail.cast("string").alias("detail"))).cast(FINDING)


def _when(test: Column, found: Column) -> Column:
    return F.when(test, found).otherwise(_none())


def json_type(v: Column) -> Column:
    """null, boolean, string, array, object, integer or number; 1.0 is an integer. Null for no value."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull(), F.lit(None))
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(number == F.floor(number), "integer")
        .otherwise("number")
    )


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _equals(v: Column, kind: Column, value) -> Column:
    """Whether a variant is a schema's constant; containers never are."""
    if value is None:
        return kind == "null"
    if isinstance(value, bool):
        return F.coalesce((kind == "boolean") & (F.try_variant_get(v, "$", "boolean") == F.lit(value)), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((kind == "string") & (_text(v) == F.lit(value)), F.lit(False))
    if isinstance(value, (int, float)):
        return F.coalesce(kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") == F.lit(float(value))), F.lit(False))
    return F.lit(False)


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, "$." + name if name.isidentifier() else f'$["{name}"]', "variant")


def _below(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit("." + name)))


class Compiler:
    def __init__(self, schema: dict):
        self.root = schema

    def resolve(self, schema: dict, above: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        while "$ref" in schema:
            ref = schema["$ref"]
            if ref in above:
                raise ValueError(f"{ref} refers to itself")
            node = self.root
            for part in ref.removeprefix("#/").split("/"):
                node = node[part]
            above, schema = (*above, ref), node
        return schema, above

    def walk(self, v: Column, schema: dict, path: Column, above: tuple[str, ...] = ()) -> Column:
        if unknown := set(schema) - ANNOTATIONS - CONSTRAINTS:
            raise ValueError(f"keywords that are not supported: {sorted(unknown)}")
        schema, above = self.resolve(schema, above)
        if "oneOf" in schema:
            return self.one_of(v, schema["oneOf"], path, above)
        kind = json_type(v)
        stop: list[tuple[Column, Column]] = []
        if "const" in schema:
            stop.append((~_equals(v, kind, schema["const"]), _finding(path, "const", json.dumps(schema["const"]))))
        if "enum" in schema:
            fits = F.lit(False)
            for value in schema["enum"]:
                fits = fits | _equals(v, kind, value)
            stop.append((~fits, _finding(path, "enum", ", ".join(map(json.dumps, schema["enum"])))))
        if "type" in schema:
            wanted = schema["type"]
            fits = kind.isin("integer", "number") if wanted == "number" else kind == wanted
            stop.append((~fits, _finding(path, "type", F.concat(F.lit(f"{wanted}, found "), kind))))
        found = [self.text(v, kind, schema, path), self.number(v, kind, schema, path), self.array(v, kind, schema, path, above), self.object(v, kind, schema, path, above)]
        found = [x for x in found if x is not None]
        if "if" in schema and "then" in schema:
            found.append(F.when(F.size(self.walk(v, schema["if"], path, above)) == 0, self.walk(v, schema["then"], path, above)).otherwise(_none()))
        out = F.concat(*found) if found else _none()
        for test, finding in reversed(stop):
            out = F.when(test, finding).otherwise(out)
        return out

    def one_of(self, v: Column, branches: list[dict], path: Column, above: tuple[str, ...]) -> Column:
        known = []
        for branch in branches:
            own, deeper = self.resolve(branch, above)
            known.append((own["properties"]["type"]["const"], own, deeper))
        kind, tag = json_type(v), _member(v, "type")
        out = _finding(F.concat(path, F.lit(".type")), "oneOf", ", ".join(json.dumps(k) for k, _, _ in known), "type")
        for name, own, deeper in reversed(known):
            out = F.when(_equals(tag, json_type(tag), name), self.walk(v, own, path, deeper)).otherwise(out)
        return F.when(kind != "object", _finding(path, "oneOf", F.concat(F.lit("object, found "), kind))).otherwise(out)

    def text(self, v, kind, schema, path):
        rules, t = [], _text(v)
        if "minLength" in schema:
            rules.append(_when(F.length(t) < schema["minLength"], _finding(path, "minLength", F.length(t))))
        if "maxLength" in schema:
            rules.append(_when(F.length(t) > schema["maxLength"], _finding(path, "maxLength", F.length(t))))
        if "pattern" in schema:
            rules.append(_when(~t.rlike(schema["pattern"]), _finding(path, "pattern", schema["pattern"])))
        return _when(kind == "string", F.concat(*rules)) if rules else None

    def number(self, v, kind, schema, path):
        rules, n = [], F.try_variant_get(v, "$", "double")
        if "minimum" in schema:
            rules.append(_when(n < schema["minimum"], _finding(path, "minimum", _text(v))))
        if "maximum" in schema:
            rules.append(_when(n > schema["maximum"], _finding(path, "maximum", _text(v))))
        return _when(kind.isin("integer", "number"), F.concat(*rules)) if rules else None

    def array(self, v, kind, schema, path, above):
        rules, items = [], F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        if "minItems" in schema:
            rules.append(_when(F.size(items) < schema["minItems"], _finding(path, "minItems", F.size(items))))
        if "maxItems" in schema:
            rules.append(_when(F.size(items) > schema["maxItems"], _finding(path, "maxItems", F.size(items))))
        if schema.get("uniqueItems") is True:
            texts = F.transform(items, lambda x: F.to_json(x))
            again = F.flatten(F.transform(texts, lambda t, i: _when(F.array_position(texts, t) <= i, _finding(at(i), "uniqueItems", t))))
            rules.append(_when(F.size(F.array_distinct(texts)) < F.size(texts), again))
        if "items" in schema:
            rules.append(F.flatten(F.transform(items, lambda x, i: self.walk(x, schema["items"], at(i), above))))
        return _when(kind == "array", F.concat(*rules)) if rules else None

    def object(self, v, kind, schema, path, above):
        rules, properties = [], schema.get("properties", {})
        for name in schema.get("required", []):
            rules.append(_when(_member(v, name).isNull(), _finding(_below(path, name), "required", "missing", name)))
        if "additionalProperties" in schema:
            if schema["additionalProperties"] is not False:
                raise ValueError("additionalProperties may be false only")
            keys = F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
            extra = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, properties)) if properties else F.array().cast("array<string>"))
            prefix = F.when(path == "", "").otherwise(F.concat(path, F.lit(".")))
            rules.append(F.transform(extra, lambda k: F.struct(F.concat(prefix, k).alias("path"), F.lit("additionalProperties").alias("keyword"), k.alias("property"), F.lit("not part of the schema").alias("detail"))).cast(FINDING))
        for name, own in properties.items():
            member = _member(v, name)
            rules.append(F.when(member.isNull(), _none()).otherwise(self.walk(member, own, _below(path, name), above)))
        return _when(kind == "object", F.concat(*rules)) if rules else None


def schema_findings(value: Column, schema: dict) -> Column:
    """The findings of a JSON text; a text that is null or no JSON has one finding ``json``."""
    v = F.try_parse_json(value)
    return F.when(v.isNull(), _finding(F.lit(""), "json", "no JSON text")).otherwise(Compiler(schema).walk(v, schema, F.lit("")))
