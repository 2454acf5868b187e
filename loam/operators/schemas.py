"""Objects against JSON schemas, compiled to expressions over variants that run inside Spark's own plan."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What the type of a JSON value is called at the head of a variant's schema.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",), "null": ("VOID",)}
#: What texts of a format look like; other formats are not looked at.
FORMATS = {
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "email": r"^[^@\s]+@[^@\s]+$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}(?<!\.)$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "uuid": r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
}
#: How often a reference may stand inside what it refers to; what lies deeper is told as an error, never passed over.
LEVELS = 3
NONE = "array<string>"


def load_schemas(spark: SparkSession, path: str) -> dict[str, dict]:
    """Type -> schema from the files under ``path``, references put in place; a file that is no schema is passed over.

    Schemas are a vendored set of some dozens of small files. The type is the file's name. A reference is a path from the file
    that it stands in, a pointer into a file, both, or the $id of another file.
    """
    files: dict[str, dict] = {}
    for row in spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value").collect():
        try:
            schema = json.loads(row.value)
        except ValueError:
            continue
        if isinstance(schema, dict):
            files[row.p] = schema
    names = {schema["$id"]: file for file, schema in files.items() if isinstance(schema.get("$id"), str)}
    return {file.rsplit("/", 1)[-1].removesuffix(".json"): resolved(schema, file, files, names) for file, schema in files.items()}


def resolved(schema: Any, file: str = "", files: dict[str, dict] | None = None, names: dict[str, str] | None = None, inside: tuple[tuple[str, str], ...] = ()) -> Any:
    """A schema with what it refers to in place of its references, as one more part that must hold."""
    files, names = files if files is not None else {file: schema}, names or {}
    again = lambda x, at=file, within=inside: resolved(x, at, files, names, within)
    if isinstance(schema, list):
        return [again(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: v if k in ("enum", "const", "definitions", "$defs") else again(v) for k, v in schema.items() if k != "$ref"}
    if isinstance(schema.get("$ref"), str):
        place, _, pointer = schema["$ref"].partition("#")
        there = file if not place else place if place in files else names.get(place) or posixpath.normpath(posixpath.join(posixpath.dirname(file), place)).replace("file:/", "file:///", 1)
        there = there if there in files else next((f for f in files if f.replace("///", "/") == there.replace("///", "/")), there)
        target: Any = files.get(there)
        for key in filter(None, pointer.split("/")):
            key = key.replace("~1", "/").replace("~0", "~")
            target = target.get(key) if isinstance(target, dict) else None
        if target is None:
            raise ValueError(f"no schema at {schema['$ref']} of {file}")
        step = (there, pointer)
        part = {"deep": True} if inside.count(step) >= LEVELS else again(target, there, (*inside, step))
        out["allOf"] = [*out.get("allOf", []), part]
    return out


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is made once, however often it is looked at."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


class Compiler:
    """Schema and variant -> array of errors, each a kind and the path of the value at fault."""

    def __init__(self, formats: bool):
        self.formats = formats

    def errors(self, schema: Any, value: Column, path: Column) -> Column:
        """``value`` is present; ``path`` ends in no slash and is empty at the top."""
        if schema is True or schema == {}:
            return F.array().cast(NONE)
        if schema is False:
            return F.array(self._told("forbidden", path))
        return _bound(value, lambda v: _bound(F.substring(F.schema_of_variant(v), 1, 7), lambda kind: self._errors(schema, v, kind, path)))

    def _errors(self, schema: Any, value: Column, kind: Column, path: Column) -> Column:
        """errors() of a value whose kind is known: the whole value is looked through to find it, so that is done once."""
        if schema is True or schema == {} or schema is False:
            return self.errors(schema, value, path)
        is_ = lambda *names: F.rlike(kind, F.lit(f"^({'|'.join(k for n in names for k in KINDS[n])})"))
        single = [test for make in (self._any, self._strings, self._numbers) for test in make(schema, value, path, is_)]
        several = [*self._objects(schema, value, path, is_), *self._arrays(schema, value, path, is_), *self._parts(schema, value, kind, path)]
        told = F.filter(F.array(*single), lambda e: e.isNotNull()) if single else F.array().cast(NONE)
        return F.concat(told, *several) if several else told

    @staticmethod
    def _told(kind: str, path: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), path)

    @staticmethod
    def _under(path: Column, key: Column) -> Column:
        return F.when(path == "", key).otherwise(F.concat(path, F.lit("/"), key))

    def _valid(self, schema: Any, value: Column) -> Column:
        return F.size(self.errors(schema, value, F.lit("x"))) == 0

    def _any(self, schema: dict, value: Column, path: Column, is_: Callable) -> list[Column]:
        tests = []
        if schema.get("deep"):
            tests.append(self._told("deep", path))
        if "type" in schema:
            wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            fits = is_(*wanted)
            if "integer" in wanted and "number" not in wanted:  # 2.0 is whole
                number = F.try_variant_get(value, "$", "double")
                fits = fits | (is_("number") & F.coalesce(number == F.floor(number), F.lit(False)))
            tests.append(F.when(~fits, self._told("type", path)))
        allowed = schema["enum"] if "enum" in schema else [schema["const"]] if "const" in schema else None
        if allowed is not None:
            same = F.to_json(value).isin([json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True) for v in allowed])
            tests.append(F.when(~same, self._told("value", path)))
        return tests

    def _strings(self, schema: dict, value: Column, path: Column, is_: Callable) -> list[Column]:
        text = F.try_variant_get(value, "$", "string")
        tests = []
        if "pattern" in schema:
            tests.append(("pattern", ~F.rlike(text, F.lit(schema["pattern"]))))
        if self.formats and schema.get("format") in FORMATS:
            tests.append(("format", ~F.rlike(text, F.lit(FORMATS[schema["format"]]))))
        if "minLength" in schema:
            tests.append(("short", F.length(text) < schema["minLength"]))
        if "maxLength" in schema:
            tests.append(("long", F.length(text) > schema["maxLength"]))
        return [F.when(is_("string") & bad, self._told(name, path)) for name, bad in tests]

    def _numbers(self, schema: dict, value: Column, path: Column, is_: Callable) -> list[Column]:
        number = F.try_variant_get(value, "$", "double")
        bounds = (("minimum", "small", lambda b: number < b), ("exclusiveMinimum", "small", lambda b: number <= b), ("maximum", "large", lambda b: number > b), ("exclusiveMaximum", "large", lambda b: number >= b))
        tests = [(name, bad(schema[k])) for k, name, bad in bounds if isinstance(schema.get(k), (int, float)) and not isinstance(schema[k], bool)]
        if schema.get("multipleOf"):
            share = number / F.lit(float(schema["multipleOf"]))
            tests.append(("multiple", share != F.floor(share)))
        return [F.when(is_("number") & bad, self._told(name, path)) for name, bad in tests]

    def _objects(self, schema: dict, value: Column, path: Column, is_: Callable) -> list[Column]:
        none, is_object = F.array().cast(NONE), is_("object")
        within = lambda e: F.when(is_object, e).otherwise(none)
        child = lambda name: F.try_variant_get(value, f"$['{name}']" if "'" not in name else f'$["{name}"]', "variant")
        under = lambda name: self._under(path, F.lit(name))
        found = []
        missing = [F.when(child(f).isNull(), self._told("missing", under(f))) for f in schema.get("required", [])]
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string, variant>"))
        sizes = (("minProperties", "short", lambda n: F.size(keys) < n), ("maxProperties", "long", lambda n: F.size(keys) > n))
        missing += [F.when(bad(schema[k]), self._told(name, path)) for k, name, bad in sizes if k in schema]
        for f, needed in {**schema.get("dependencies", {}), **schema.get("dependentRequired", {})}.items():
            if isinstance(needed, list):
                missing += [F.when(child(f).isNotNull() & child(g).isNull(), self._told("missing", under(g))) for g in needed]
        if missing:
            found.append(within(F.filter(F.array(*missing), lambda e: e.isNotNull())))
        for f, rule in schema.get("properties", {}).items():
            found.append(within(_bound(child(f), lambda c: F.when(c.isNotNull(), self.errors(rule, c, under(f))).otherwise(none))))  # noqa: B023
        known, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string, variant>"))
        each = lambda chosen, rule: within(F.coalesce(F.flatten(F.transform(F.filter(entries, lambda e: chosen(e["key"])), lambda e: self.errors(rule, e["value"], self._under(path, e["key"])))), none))
        found += [each(lambda key, p=p: F.rlike(key, F.lit(p)), rule) for p, rule in patterns.items() if rule not in (True, {})]
        if rest not in (True, {}):
            def other(key: Column) -> Column:
                new = ~key.isin(list(known)) if known else F.lit(True)
                for p in patterns:
                    new = new & ~F.rlike(key, F.lit(p))
                return new

            if rest is False:
                found.append(within(F.coalesce(F.transform(F.filter(keys, other), lambda key: self._told("unknown", self._under(path, key))), none)))
            else:
                found.append(each(other, rest))
        if "propertyNames" in schema:
            found.append(within(F.coalesce(F.flatten(F.transform(keys, lambda key: self.errors(schema["propertyNames"], F.try_variant_get(F.to_variant_object(F.array(key)), "$[0]", "variant"), self._under(path, key)))), none)))
        return found

    def _arrays(self, schema: dict, value: Column, path: Column, is_: Callable) -> list[Column]:
        if not {"minItems", "maxItems", "uniqueItems", "contains", "items", "prefixItems"} & set(schema):
            return []
        whole = F.try_variant_get(value, "$", "array<variant>")
        return [F.when(is_("array"), _bound(whole, lambda items: self._items(schema, items, path))).otherwise(F.array().cast(NONE))]

    def _items(self, schema: dict, items: Column, path: Column) -> Column:
        none = F.array().cast(NONE)
        tests = [F.when(bad, self._told(name, path)) for k, name, bad in (("minItems", "short", F.size(items) < schema.get("minItems", 0)), ("maxItems", "long", F.size(items) > schema.get("maxItems", 0))) if k in schema]
        if schema.get("uniqueItems"):
            fewer = lambda text: F.size(F.array_distinct(F.transform(items, text))) < F.size(items)
            alike = fewer(lambda x: F.try_variant_get(x, "$", "string"))  # quick, and true of all that are equal, but also of 1 and "1"
            tests.append(F.when(F.when(alike, fewer(lambda x: F.to_json(x))), self._told("repeated", path)))
        if "contains" in schema:
            tests.append(F.when(~F.exists(items, lambda x: self._valid(schema["contains"], x)), self._told("no_match", path)))
        found = [F.filter(F.array(*tests), lambda e: e.isNotNull())] if tests else []
        fixed = schema["items"] if isinstance(schema.get("items"), list) else schema.get("prefixItems", [])
        rest = schema.get("additionalItems", True) if isinstance(schema.get("items"), list) else schema.get("items", True)
        at = lambda k: self._under(path, k.cast("string"))
        for k, rule in enumerate(fixed):
            found.append(F.when(F.size(items) > k, self.errors(rule, F.try_element_at(items, F.lit(k + 1)), at(F.lit(k)))).otherwise(none))
        if rest not in (True, {}):
            told = F.transform(items, lambda x, k: F.when(k >= len(fixed), self.errors(rest, x, at(k))).otherwise(none))
            found.append(F.flatten(told))
        return F.concat(none, *found)

    def _parts(self, schema: dict, value: Column, kind: Column, path: Column) -> list[Column]:
        none = F.array().cast(NONE)
        valid = lambda part: F.size(self._errors(part, value, kind, F.lit("x"))) == 0
        found = [self._errors(part, value, kind, path) for part in schema.get("allOf", [])]
        if "anyOf" in schema:
            any_ = F.exists(F.array(*[valid(part) for part in schema["anyOf"]]), lambda x: x)
            found.append(F.when(any_, none).otherwise(F.array(self._told("no_match", path))))
        if "oneOf" in schema:
            n = F.size(F.filter(F.array(*[valid(part) for part in schema["oneOf"]]), lambda x: x))
            found.append(F.when(n == 1, none).when(n == 0, F.array(self._told("no_match", path))).otherwise(F.array(self._told("several", path))))
        if "not" in schema:
            found.append(F.when(valid(schema["not"]), F.array(self._told("forbidden", path))).otherwise(none))
        if "if" in schema:
            holds = valid(schema["if"])
            found.append(F.when(holds, self._errors(schema.get("then", True), value, kind, path)).otherwise(self._errors(schema.get("else", True), value, kind, path)))
        return found


def schema_errors(raw: DataFrame, schemas: dict[str, dict], formats: bool = False) -> DataFrame:
    """(bundle, id, type, error) for (bundle, position, body: JSON text); types without a schema pass, and so do bodies that are no JSON objects.

    An error is a kind and the path of the value from the top, its parts joined by slashes: missing for a required field that is absent, type and
    value for one of another kind or outside its values, unknown for one that a closed schema does not name, pattern, format (only
    if ``formats`` are asked for, as validators look at them only then), short and long for lengths and counts, small, large and multiple for
    numbers, repeated for equal items, no_match and several for alternatives of which none or too many hold, forbidden for what must not hold, and
    deep for what lies inside itself too often to be looked at. The checks of a schema are expressions of one projection; a body is parsed once.
    """
    make, none = Compiler(formats), F.array().cast(NONE)
    parsed = raw.select("bundle", F.try_parse_json("body").alias("v"))
    v, own = F.col("v"), F.try_variant_get(F.col("v"), "$.type", "string")
    out = parsed.select("bundle", F.try_variant_get(v, "$.id", "string").alias("id"), own.alias("type"), "v")
    found = none
    for name, schema in schemas.items():
        found = F.when(F.col("type") == name, make.errors(resolved(schema), v, F.lit(""))).otherwise(found)
    told = out.select("bundle", "id", "type", F.explode_outer(F.array_distinct(found)).alias("error"))  # before an inner explode Spark would look for errors once more, to filter
    return told.where("error is not null")


def vocabulary(schema_text: str, name: str) -> tuple[str, ...]:
    """The values of a named enumeration in a schema's definitions; none if it is not there."""
    definitions = json.loads(schema_text).get("definitions", {})
    return tuple(definitions.get(name, {}).get("enum", ()))
