"""Declared HTTP contracts with their references, and nested shapes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import nesting
from latticework.sources import extract, openapi, receivers
from tests.conftest import rows

SPEC = {
    "openapi": "3.0.3", "security": [{"bearerAuth": []}],
    "components": {
        "parameters": {"Id": {"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}, "Alias": {"$ref": "#/components/parameters/Second"}, "Second": {"$ref": "#/components/parameters/Id"}, "A": {"$ref": "#/components/parameters/B"}, "B": {"$ref": "#/components/parameters/A"}},
        "requestBodies": {"Create": {"required": True, "content": {}}, "Loose": {"content": {}}, "a/b": {"required": True}},
    },
    "paths": {
        "/orders/{id}": {
            "parameters": [{"$ref": "#/components/parameters/Alias"}, {"name": "trace", "in": "header", "required": True, "schema": {"type": "string"}}],
            "get": {"operationId": "find", "parameters": [{"name": "trace", "in": "header", "schema": {"type": "integer"}}, {"name": "trace", "in": "query"}], "responses": {"200": {}, "404": {}}},
            "delete": {"security": [], "parameters": [{"$ref": "#/components/parameters/A"}]},
        },
        "/orders": {
            "post": {"operationId": "create", "requestBody": {"$ref": "#/components/requestBodies/Create"}, "responses": {"201": {}}},
            "put": {"requestBody": {"$ref": "#/components/requestBodies/Loose"}}, "patch": {"requestBody": {"$ref": "#/components/requestBodies/Nowhere"}},
            "head": {"requestBody": {"required": True}}, "options": {"requestBody": {"$ref": "#/components/requestBodies/a~1b"}},
        },
    },
}
OLD = {"swagger": "2.0", "parameters": {"Body": {"name": "b", "in": "body", "required": True}}, "paths": {"/old": {"post": {"parameters": [{"$ref": "#/parameters/Body"}]}, "get": {"parameters": [{"name": "q", "in": "query", "type": "string"}]}}}}


def test_contracts_of_documents(spark):
    files = [("openapi.json", json.dumps(SPEC)), ("old/swagger.json", json.dumps(OLD)), ("bad.json", "{"), ("other.json", '{"paths": {"/x": {"get": {}}}}'), ("list.json", "[]"), ("odd.json", '{"openapi": "3.0.0", "paths": {"/x": [], "/y": {"get": 1, "post": {"parameters": 3, "responses": []}}}}')]
    facts = extract.extract(spark.createDataFrame(files, "path string, text string")).cache()
    got = {(r["method"], r["name"]): json.loads(r["formal"]) for r in openapi.contracts(facts).collect()}
    by = lambda *key: {(p["name"], p["in"]): (p["required"], p["type"], p["unresolved"]) for p in got[key]["parameters"]}
    assert by("GET", "/orders/{id}") == {("id", "path"): (True, "string", None), ("trace", "header"): (False, "integer", None), ("trace", "query"): (False, None, None)}
    assert by("DELETE", "/orders/{id}") == {("id", "path"): (True, "string", None), ("trace", "header"): (True, "string", None), ("#/components/parameters/A", None): (False, None, "#/components/parameters/A")}
    assert [got[m, "/orders"]["request_body_required"] for m in ("POST", "PUT", "PATCH", "HEAD", "OPTIONS")] == [True, False, None, True, True]
    assert (got["GET", "/orders/{id}"]["request_body_required"], got["DELETE", "/orders/{id}"]["request_body_required"]) == (False, None)
    assert got["POST", "/old"]["request_body_required"] is True and got["GET", "/old"]["request_body_required"] is False
    assert (got["GET", "/orders/{id}"]["security"], got["DELETE", "/orders/{id}"]["security"], got["GET", "/old"]["security"]) == ("required", "not_required", "unspecified")
    assert got["GET", "/orders/{id}"]["response_statuses"] == ["200", "404"] and got["POST", "/y"]["response_statuses"] == []
    assert len(got) == 10
    assert openapi.contracts(facts.limit(0)).count() == 0


def test_yaml_documents_have_lines(spark):
    pytest.importorskip("yaml")
    text = 'openapi: 3.0.3\nsecurity:\n  - bearerAuth: []\npaths:\n  /orders:\n    post:\n      operationId: createOrder\n      requestBody:\n        required: true\n      responses:\n        "201": {}\n        "409": {}\n'
    facts = extract.extract(spark.createDataFrame([("openapi.yaml", text), ("bad.yml", "openapi: [\n")], "path string, text string"))
    one = [json.loads(r["formal"]) for r in openapi.contracts(facts.cache()).collect()]
    assert one == [{"format": "openapi", "operation_id": "createOrder", "request_body_required": True, "response_statuses": ["201", "409"], "security": "required", "parameters": None, "evidence": {"file": "openapi.yaml", "start_line": 7, "end_line": 7}}]


def test_unfolding_equals_brute_force(spark):
    r = random.Random(13)
    fields = [(r.choice("st"), f"T{r.randrange(7)}", f"f{r.randrange(4)}", r.choice(["T0", "T1", "T3", "T5", "int", None])) for _ in range(45)] + [("s", "T0", None, "int"), ("s", None, "x", "int")]
    some = {f for f in fields if f[1] is not None and f[2] is not None}
    want = set()

    def follow(by, root, owner, path, way, depth):
        for b, o, name, kind in some:
            if (b, o) == (by, owner):
                known = any((x[0], x[1]) == (by, kind) for x in some)
                state = "leaf" if not known else "recursive" if kind in way else "deep" if depth == 3 else "nested"
                want.add((by, root, ".".join([*path, name]), kind, depth, state))
                if state == "nested":
                    follow(by, root, kind, [*path, name], [*way, kind], depth + 1)

    for by, owner in {(f[0], f[1]) for f in some}:
        follow(by, owner, owner, [], [owner], 1)
    got = nesting.unfolded(spark.createDataFrame(fields, "service string, owner string, name string, type string"), ["service"], 3)
    assert set(rows(got, "service", "root", "path", "type", "depth", "state")) == want and {w[5] for w in want} == {"leaf", "recursive", "deep", "nested"}


def test_shapes_of_two_declarations_are_not_told(spark):
    files = spark.createDataFrame([("a/A.java", "class A {\n  private B b;\n}\n"), ("a/B.java", "class B {\n  private String x;\n}\n"), ("b/B.java", "class B {\n  private String y;\n}\n")], "path string, text string")
    declared = receivers.declared(files).withColumn("service", F.substring("path", 1, 1))
    asked = spark.createDataFrame([("a", "A"), ("b", "B"), ("b", "C"), ("a", None)], "service string, type string")
    by_service = {(a, t): s and json.loads(s) for a, t, s in rows(receivers.with_nested_shapes(asked, declared, "type", ["service"]), "service", "type", "shape")}
    assert [f["path"] for f in by_service["a", "A"]] == ["b", "b.x"] and [f["path"] for f in by_service["b", "B"]] == ["y"] and by_service["b", "C"] is None
    over_all = {t: s and json.loads(s) for t, s in rows(receivers.with_nested_shapes(asked.drop("service"), declared, "type"), "type", "shape")}
    assert [f["path"] for f in over_all["A"]] == ["b"] and over_all["B"] is None
