"""Every keyword of a schema has a body that passes and one that fails, with the path of what is wrong."""

import json

import pytest

from loam.operators import schemas

T = {"type": {"const": "t"}}
CASES = [
    ({"required": ["a"]}, {"a": None}, {}, ["missing:a"]),
    ({"properties": {"a": {"type": "string"}}}, {"a": "x"}, {"a": None}, ["type:a"]),
    ({"properties": {"a": {"type": ["null", "boolean"]}}}, {"a": None}, {"a": 1}, ["type:a"]),
    ({"properties": {"a": {"type": "integer"}}}, {"a": 2.0}, {"a": 2.5}, ["type:a"]),
    ({"properties": {"a": {"type": "number"}}}, {"a": 2.5}, {"a": "2"}, ["type:a"]),
    ({"properties": {"a": {"type": "object"}}}, {"a": {}}, {"a": []}, ["type:a"]),
    ({"properties": {"a": {"type": "array"}}}, {"a": []}, {"a": {}}, ["type:a"]),
    ({"properties": {"a": {"enum": ["x", 1, None, [1, 2]]}}}, {"a": [1, 2]}, {"a": "1"}, ["value:a"]),
    ({"properties": {"a": {"const": {"b": 1, "c": "é\""}}}}, {"a": {"c": "é\"", "b": 1}}, {"a": {"b": 2}}, ["value:a"]),
    ({"properties": {"a": {"properties": {"b": {"required": ["c"]}}}}}, {"a": {"b": 1}}, {"a": {"b": {}}}, ["missing:a/b/c"]),
    ({"properties": {"it's": {"type": "string"}}}, {"it's": "x"}, {"it's": 1}, ["type:it's"]),
    ({"properties": {"type": {}, "a": {}}, "additionalProperties": False}, {"a": 1}, {"b": 1, "c": 2}, ["unknown:b", "unknown:c"]),
    ({"properties": {"type": {}}, "additionalProperties": {"type": "integer"}}, {"b": 1}, {"b": "x"}, ["type:b"]),
    ({"patternProperties": {"^x_": {"type": "string"}}, "properties": {"type": {}}, "additionalProperties": False}, {"x_1": "v"}, {"x_1": 1, "y": 2}, ["type:x_1", "unknown:y"]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, {"ab": 1}, {"A": 1}, ["pattern:A"]),
    ({"minProperties": 2, "maxProperties": 3}, {"a": 1}, {}, ["short:"]),
    ({"maxProperties": 2}, {"a": 1}, {"a": 1, "b": 2}, ["long:"]),
    ({"dependencies": {"a": ["b"]}}, {"b": 1}, {"a": 1}, ["missing:b"]),
    ({"properties": {"a": {"items": {"type": "string"}}}}, {"a": ["x", "y"]}, {"a": ["x", 1, None]}, ["type:a/1", "type:a/2"]),
    ({"properties": {"a": {"items": {"items": {"type": "integer"}}}}}, {"a": [[1], []]}, {"a": [[1], [2, "x"]]}, ["type:a/1/1"]),
    ({"properties": {"a": {"items": [{"type": "string"}], "additionalItems": False}}}, {"a": ["x"]}, {"a": [1, 2]}, ["forbidden:a/1", "type:a/0"]),
    ({"properties": {"a": {"minItems": 1, "maxItems": 2}}}, {"a": [1]}, {"a": [1, 2, 3]}, ["long:a"]),
    ({"properties": {"a": {"minItems": 1}}}, {"a": "not a list"}, {"a": []}, ["short:a"]),
    ({"properties": {"a": {"uniqueItems": True}}}, {"a": [1, "1"]}, {"a": [{"b": 1}, {"b": 1}]}, ["repeated:a"]),
    ({"properties": {"a": {"contains": {"const": 3}}}}, {"a": [1, 3]}, {"a": [1]}, ["no_match:a"]),
    ({"properties": {"a": {"pattern": "^ab--[0-9]+$"}}}, {"a": "ab--1"}, {"a": "xab--1"}, ["pattern:a"]),
    ({"properties": {"a": {"minLength": 2, "maxLength": 3}}}, {"a": "éé"}, {"a": "é"}, ["short:a"]),
    ({"properties": {"a": {"maxLength": 3}}}, {"a": 12345}, {"a": "long"}, ["long:a"]),
    ({"properties": {"a": {"minimum": 1, "maximum": 5}}}, {"a": 5}, {"a": 0.5}, ["small:a"]),
    ({"properties": {"a": {"exclusiveMinimum": 1, "exclusiveMaximum": 5}}}, {"a": 4.9}, {"a": 5}, ["large:a"]),
    ({"properties": {"a": {"multipleOf": 0.5}}}, {"a": 1.5}, {"a": 1.2}, ["multiple:a"]),
    ({"properties": {"a": {"format": "date-time"}}}, {"a": "2024-02-03T04:05:06.789Z"}, {"a": "2024-13-03T04:05:06Z"}, ["format:a"]),
    ({"properties": {"a": {"format": "ipv4"}, "b": {"format": "email"}, "c": {"format": "uri"}}}, {"a": "10.0.0.1", "b": "a@b", "c": "http://x"}, {"a": "10.0.0.256", "b": "a b", "c": "x"}, ["format:a", "format:b", "format:c"]),
    ({"allOf": [{"required": ["a"]}, {"properties": {"a": {"type": "string"}}}]}, {"a": "x"}, {"a": 1}, ["type:a"]),
    ({"anyOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"b": 1}, {"c": 1}, ["no_match:"]),
    ({"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"a": 1}, {"a": 1, "b": 1}, ["several:"]),
    ({"oneOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"b": 1}, {}, ["no_match:"]),
    ({"not": {"required": ["a"]}}, {}, {"a": 1}, ["forbidden:"]),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, {"a": 1, "b": 1}, {"a": 1}, ["missing:b"]),
    ({"if": {"required": ["a"]}, "else": {"required": ["c"]}}, {"a": 1}, {}, ["missing:c"]),
    ({"definitions": {"d/e": {"items": {"type": "integer"}}}, "properties": {"a": {"$ref": "#/definitions/d~1e"}}}, {"a": [1]}, {"a": ["x"]}, ["type:a/0"]),
    ({"definitions": {"tree": {"properties": {"sub": {"$ref": "#/definitions/tree"}, "n": {"type": "integer"}}}}, "allOf": [{"$ref": "#/definitions/tree"}]}, {"sub": {"sub": {"n": 1}}}, {"sub": {"sub": {"n": "x"}}}, ["type:sub/sub/n"]),
    ({"definitions": {"tree": {"properties": {"sub": {"$ref": "#/definitions/tree"}}}}, "allOf": [{"$ref": "#/definitions/tree"}]}, {}, {"sub": {"sub": {"sub": {}}}}, ["deep:sub/sub/sub"]),
]


def test_each_keyword_passes_and_fails(spark):
    known = {f"t{k}": schema for k, (schema, *_) in enumerate(CASES)}
    bodies = [(k, side, json.dumps({"type": f"t{k}", **body})) for k, (_, good, bad, _) in enumerate(CASES) for side, body in enumerate((good, bad))]
    found = {}
    raw = spark.createDataFrame(bodies, "bundle long, position long, body string")
    for start in range(0, len(CASES), 15):  # a plan of bounded size each
        some = {name: known[name] for name in list(known)[start : start + 15]}
        for side in (0, 1):
            for r in schemas.schema_errors(raw.where(f"position = {side}"), some, formats=True).collect():
                found.setdefault((r.bundle, side), []).append(r.error)
    for k, (schema, good, bad, errors) in enumerate(CASES):
        assert (k, 0) not in found, (schema, good, found[k, 0])
        assert sorted(found.get((k, 1), [])) == errors, (schema, bad)


def test_references_between_files_and_odd_bodies(spark, tmp_path):
    (tmp_path / "common").mkdir()
    (tmp_path / "things").mkdir()
    core = {"$id": "http://example.org/core", "definitions": {"word": {"pattern": "^[a-z]+$"}}, "required": ["id"], "properties": {"id": {"$ref": "#/definitions/word"}}}
    (tmp_path / "common" / "core.json").write_text(json.dumps(core))
    thing = {"allOf": [{"$ref": "../common/core.json"}, {"properties": {"w": {"$ref": "http://example.org/core#/definitions/word"}}}], "properties": {"v": {"$ref": "../common/core.json#/definitions/word"}}}
    (tmp_path / "things" / "thing.json").write_text(json.dumps(thing))
    (tmp_path / "list.json").write_text("[1]")
    known = schemas.load_schemas(spark, str(tmp_path))
    assert set(known) == {"core", "thing"}
    rows = [(1, 0, '{"type": "thing", "id": "a", "v": "B", "w": "C"}'), (2, 0, '{"type": "thing", "v": "b"}'), (3, 0, None), (4, 0, "[1, 2]"), (5, 0, "{"), (6, 0, '{"type": 7}'), (7, 0, '{"type": "thing", "id": "A"}'), (7, 0, '{"type": "thing", "id": "A"}')]
    found = schemas.schema_errors(spark.createDataFrame(rows, "bundle long, position long, body string"), known)
    assert sorted((r.bundle, r.id, r.error) for r in found.collect() if r.id) == [(1, "a", "pattern:v"), (1, "a", "pattern:w"), (7, "A", "pattern:id"), (7, "A", "pattern:id")]
    assert [(r.bundle, r.error) for r in found.collect() if not r.id] == [(2, "missing:id")]
    (tmp_path / "things" / "thing.json").write_text('{"$ref": "../nowhere.json"}')
    with pytest.raises(ValueError):
        schemas.load_schemas(spark, str(tmp_path))
