"""From folders to catalogs: runs, reuse, failures, locks and records."""

import pytest
from latticework.plans import indexing
from latticework.sources.catalog import Catalog
from tests.conftest import rows

JAVA = """package shop;
@RestController
@RequestMapping("/orders")
public class OrderController {
  @GetMapping("/{id}")
  public Order one(String id) { return null; }
  @PostMapping("/")
  public Order add(Order o) { return null; }
}
"""


def tree(root):
    (root / "orders/src").mkdir(parents=True)
    (root / "orders/pom.xml").write_text("<artifactId>spring-boot-starter</artifactId>")
    (root / "orders/src/OrderController.java").write_text(JAVA)
    (root / "web").mkdir()
    (root / "web/package.json").write_text('{"scripts": {"start": "node a.js"}, "dependencies": {"express": "4"}}')
    (root / "web/a.js").write_text("const express = require('express');\nconst app = express();\napp.get('/health', function health(req, res) { res.send('ok'); });\n")


def describe(prompt, unit):
    if "POST" in prompt and unit == "endpoint":
        return None
    return {"summary": f"about {unit}", "description": "d", "request_shape": "", "response_shape": "", "short_desc": "s", "long_desc": "l", "usage": {"input_tokens": 10}}


def test_a_tree_becomes_a_catalog_and_is_reused(spark, tmp_path):
    tree(tmp_path / "shop")
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    first = rows(indexing.index_path(spark, catalog, f"file://{tmp_path}/shop", "shop", describe), "service", "state", "units", "failed")
    assert [x[:2] for x in first] == [("orders", "new"), ("web", "new")] and [x[3] for x in first] == [1, 0]
    assert rows(catalog.read("services"), "name", "root_path", "stack", "short_desc") == [("orders", "orders", "jvm", "s"), ("web", "web", "node", "s")]
    assert rows(catalog.read("entrypoints").filter("kind = 'http'"), "method", "name")[:2] == [("GET", "/health"), ("GET", "/orders/{id}")]
    assert rows(catalog.read("apis"), "method", "path", "summary") == [("GET", "/health", "about endpoint"), ("GET", "/orders/{id}", "about endpoint")]
    assert catalog.read("static_analysis_snapshots").count() == 2
    assert {r["service_id"] for r in catalog.read("indexed_files").collect()} == {r["id"] for r in catalog.read("services").filter("name = 'web'").collect()}
    assert rows(catalog.read("index_runs"), "status") == [("ok",), ("partial",)]
    assert catalog.read("search_documents").count() >= 4

    ids = rows(catalog.read("services"), "id", "name")
    (tmp_path / "shop/web/a.js").write_text("const express = require('express');\nconst app = express();\napp.get('/ready', function ready(req, res) { res.send('ok'); });\n")
    second = rows(indexing.index_path(spark, catalog, f"file://{tmp_path}/shop", "shop"), "service", "state")
    assert second == [("orders", "reused"), ("web", "changed")]
    assert rows(catalog.read("services"), "id", "name") == ids
    assert rows(catalog.read("entrypoints").filter("kind = 'http'"), "name") == [("/orders",), ("/orders/{id}",), ("/ready",)]
    assert rows(catalog.read("apis"), "path") == [("/orders/{id}",)]
    assert catalog.read("architecture_runs").count() == 2


def test_locks_runs_and_records(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    with indexing.Lock(catalog, "a"):
        with pytest.raises(indexing.Locked):
            indexing.Lock(catalog, "a").acquire()
        indexing.Lock(catalog, "b").acquire()
    indexing.Lock(catalog, "a").acquire()
    indexing.Lock(catalog, "a").acquire(steal=True)
    run = indexing.start_index_run(catalog, 7)
    assert indexing.recover_unfinished_runs(catalog, 7) == 1 and indexing.recover_unfinished_runs(catalog, 7) == 0
    other = indexing.start_index_run(catalog, 7)
    indexing.finish_index_run(catalog, other, "ok", 3, indexing.Usage(1, 5, None, None) + indexing.Usage(1, None, None, 0.5))
    assert rows(catalog.read("index_runs"), "id", "status", "llm_calls", "input_tokens", "output_tokens", "cost_usd") == [(run, "failed", None, None, None, None), (other, "ok", 2, 5, None, 0.5)]

    result = spark.createDataFrame([("a", "primary", 0.9, "r"), ("b", "contract", 0.5, "r"), ("c", "else", 0.1, "r")], "service string, role string, confidence double, reason string")
    surface = indexing.record_change_surface_run(catalog, "task", "x", result)
    assert rows(catalog.read("change_surface_findings"), "run_id", "service") == [(surface, "a"), (surface, "b")]
    plan = indexing.record_plan(catalog, surface, 2000, open_decisions=1)
    assert rows(catalog.read("change_plans"), "status") == [("draft",)]
    indexing.finalize_decisions(catalog, plan)
    indexing.update_measurements(catalog, plan, 50, True)
    assert rows(catalog.read("change_plans"), "status", "estimated_tokens", "truncated") == [("ready", 50, True)]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "service string")
    indexing.record_surface_verification(catalog, surface, "r", "c0", names("a", "b"), names("b", "c"))
    indexing.record_surface_verification(catalog, surface, "r", "c0", names(), names("c"))
    got = rows(catalog.read("change_surface_verifications"), "id", "precision", "recall", "true_positives", "false_positives", "false_negatives")
    assert got == [(1, 0.5, 0.5, ["b"], ["a"], ["c"]), (2, None, 0.0, [], [], ["c"])]
    context = indexing.record_context_run(catalog, epic_type="x", requested_budget=10)
    indexing.update_response_measurements(catalog, context, 100, 25)
    indexing.record_context_verification(catalog, context, "r", "c0", None, 1.0, 0.0)
    assert rows(catalog.read("context_runs"), "response_bytes", "estimated_tokens") == [(100, 25)] and catalog.read("context_verifications").count() == 1
    response = indexing.measured({"a": "x" * 100})
    assert response["estimated_tokens"] == indexing.measured(response)["estimated_tokens"]


def test_hints_and_excerpts(spark):
    services = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    calls = spark.createDataFrame([(1, "stripe", "http", "pay", "external"), (1, "b", "http", "x", "internal"), (2, "s3", "sdk", "y", "external")], "from_service_id long, to_service_name string, call_kind string, reason string, target_kind string")
    relevant = spark.createDataFrame([("a",)], "service string")
    assert rows(indexing.dependency_hints(calls, services, relevant, "external"), "service", "target") == [("a", "stripe")]
    assert rows(indexing.unknowns_from_unmapped(indexing.dependency_hints(calls, services, relevant, "internal")), "service", "subject") == [("a", "b")]
    entities = spark.createDataFrame([(1, "orders", "table", "postgres"), (2, "x", "table", "mysql")], "service_id long, name string, kind string, engine string")
    assert rows(indexing.persistence_for(entities, services, relevant), "service", "name") == [("a", "orders")]
    pieces = spark.createDataFrame([("k", "b.py", 3, "two"), ("k", "a.py", 1, "one"), ("k", "a.py", 1, "one")], "key string, path string, start_line int, excerpt string")
    assert rows(indexing.joined_excerpts(pieces, ["key"]), "excerpt") == [("--- a.py:1\none\n\n--- b.py:3\ntwo",)]
    files = spark.createDataFrame([("a/b/c/d.txt",), ("e.txt",)], "path string")
    assert rows(indexing.folder_tree(files), "path") == [("a",), ("a/b",), ("a/b/c",), ("e.txt",)]
    assert indexing.folder_tree(files, most=2).count() == 2
