"""Questions to a small catalog: a payment graph."""

import pytest
from pyspark.sql import functions as F

from latticework.plans.api import Ambiguous, Api
from latticework.sources import catalog as sources
from latticework.sources.catalog import Catalog
from tests.conftest import rows
from tests.test_detectors import EV

EVIDENCE = "struct<file:string,start_line:int,end_line:int>"


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    c = Catalog(spark, f"file://{tmp_path_factory.mktemp('api')}")
    t = lambda schema, *r: spark.createDataFrame(list(r), schema)
    c.overwrite("repositories", t("id long, name string", (1, "shop"), (2, "bank")))
    c.overwrite("services", t("id long, repository_id long, name string, root_path string, short_desc string", (1, 1, "checkout", "svc/checkout", "takes the cart to payment"), (2, 1, "payments", "svc/payments", "charges cards"), (3, 1, "ledger", "svc/ledger", "books"), (4, 1, "twin", "a", ""), (5, 2, "twin", "b", "")))
    c.overwrite("apis", t("id long, service_id long, method string, path string, summary string", (1, 1, "POST", "/checkout", "pay"), (2, 2, "POST", "/charge", "charge a card")))
    c.overwrite("service_calls", t("id long, from_service_id long, from_api_id long, to_service_id long, to_service_name string, call_kind string, target_kind string", (1, 1, 1, 2, "payments", "http", "internal"), (2, 2, 2, None, "Stripe", "http", "external")))
    c.overwrite("messages", t("service_id long, direction string, channel string", (2, "publishes", "paid"), (3, "consumes", "paid")))
    c.overwrite("entrypoints", t(f"id long, service_id long, kind string, method string, name string, symbol string, evidence {EVIDENCE}", (1, 1, "http", "POST", "/checkout", "Checkout.post", EV)))
    c.overwrite("flow_edges", t(f"id long, service_id long, from_symbol string, to_symbol string, kind string, origin string, evidence {EVIDENCE}", (1, 1, "Checkout.post", "Cart.save", "writes", "static", EV), (2, 1, "Cart.save", "x", "invokes", "static", EV)))
    c.overwrite("static_service_calls", t(f"service_id long, source string, target_service string, protocol string, target_method string, target_path string, evidence {EVIDENCE}", (1, "Cart.save", "payments", "http", "POST", "/charge", EV)))
    c.overwrite("static_error_contracts", t(f"service_id long, source string, role string, error_kind string, internal_type string, protocol string, transport_code string, evidence {EVIDENCE}", (2, "Charge", "raises", "conflict", "Declined", "http", "409", EV)))
    c.overwrite("search_documents", sources.search_documents(c.read("services"), c.read("apis"), c.read("persistence_entities"), c.read("messages"), c.read("service_calls")))
    return Api(c)


def test_catalogue(api):
    assert rows(api.list_repositories(), "name", "services") == [("bank", 1), ("shop", 4)]
    assert rows(api.list_services("bank"), "name", "apis") == [("twin", 0)]
    assert rows(api.list_apis("checkout"), "path", "total", "truncated") == [("/checkout", 1, False)]
    assert api.describe_service("checkout").collect()[0]["calls"] == ["payments http"]
    assert api.describe_api("payments", "post", "/charge").collect()[0]["calls"][0]["to_service_name"] == "Stripe"
    with pytest.raises(Ambiguous):
        api.list_apis("twin")
    assert api.service_id("twin", "bank") == 5
    with pytest.raises(Ambiguous):
        api.list_apis("nobody")


def test_flows_and_graph(api):
    assert [(r["edge"], r["truncated"]) for r in api.describe_entrypoint("checkout", "http", "post", "/checkout", 1).collect()] == [(1, True)]
    flow = api.describe_error_flow("checkout", "http", "POST", "/checkout").collect()
    assert [(r["target"], r["error_type"], r["mapped"]) for r in flow] == [("payments", "Declined", False)]
    assert [h["label"] for h in api.trace_flow("checkout", "ledger").collect()[0]["path"]] == ["http", "channel:paid"]
    assert rows(api.get_relationships("payments"), "source", "target", "direction") == [("checkout", "payments", "inbound"), ("payments", "ledger", "outbound")]


def test_runtime_evidence_adds_up(api):
    good = '{"from": "Checkout.post", "to": "Cart.save", "kind": "writes", "count": 3}'
    for _ in range(2):
        assert tuple(api.ingest_runtime_evidence("checkout", "otel", [good, "{}"]).collect()[0]) == (1, 1)
    assert rows(api.catalog.read("runtime_flow_observations"), "observed_count") == [(6,)]
    assert rows(api.describe_runtime_divergence("checkout"), "to_symbol", "state") == [("x", "static_only")]


def test_search_and_surface(api):
    assert api.search("charge").first()["service"] == "payments"
    found = {r["service"] for r in api.find_change_surface("Support charging cards").collect()}
    assert {"payments", "checkout"} <= found and "twin" not in found
    assert api.get_change_context("charge cards", 2).count() == 2


def test_architecture_runs_and_trend(api):
    assert api.recompute_architecture() == 1
    first = {r["kind"] for r in api.find_architecture_smells().collect()}
    assert "possible_missing_http_resilience_policy" in first and "possible_unmapped_downstream_error" in first
    api.catalog.overwrite("static_service_calls", api.catalog.read("static_service_calls").limit(0))
    assert api.recompute_architecture() == 2
    assert {r["change"] for r in api.architecture_trend().collect()} <= {"resolved", "new"}
    units, decisions = api.plan_change("charge cards")
    assert rows(decisions, "contract") == [("paid",)]
    pick = api.spark.createDataFrame([("event-compatibility:payments:paid", "preserve")], "decision_id string, option string")
    assert rows(api.refine_change_plan(decisions, pick), "action") == [("validate",)]
    with pytest.raises(ValueError):
        api.refine_change_plan(decisions, pick.withColumn("option", F.lit("other")))


def test_verification_and_feedback(api):
    s = api.spark
    api.catalog.overwrite("change_surface_findings", s.createDataFrame([(1, "checkout", "primary"), (1, "payments", "primary")], "run_id long, service string, role string"))
    changed = s.createDataFrame([("svc/checkout/a.py",), ("README.md",)], "path string")
    got = api.verify_change_surface(1, changed).collect()[0]
    assert (got["precision"], got["recall"], got["false_positives"]) == (0.5, 1.0, ["payments"])
    api.record_change_surface_feedback(1, "checkout", "confirmed")
    with pytest.raises(ValueError):
        api.record_change_surface_feedback(1, "ledger", "confirmed")
    api.record_change_context_feedback(1, "sufficient", "fine")
    assert len(rows(api.catalog.read("context_feedback"), "note_sha256")[0][0]) == 64
