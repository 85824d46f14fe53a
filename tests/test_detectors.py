"""Minimal evidence gives a finding; changing one fact takes it away."""

import pytest

from latticework import schemas
from latticework.plans import detectors as d
from latticework.plans.detector_queries import QUERIES, code_facts

EV = ("src/a.py", 1, 2)
SERVICES = [(1, 1, "orders"), (2, 1, "payments"), (3, 1, "stock")]


def facts(spark, **tables):
    tables = {"services": SERVICES_ROWS, "repositories": [{"id": 1, "name": "shop"}]} | tables
    made = {}
    for name, rows in tables.items():
        schema = schemas.struct(name)
        made[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return d.Facts(spark, made)


SERVICES_ROWS = [{"id": i, "repository_id": r, "name": n} for i, r, n in SERVICES]


def call(a, b, **more):
    return {"id": a * 10 + (b or 0), "from_service_id": a, "to_service_id": b, "to_service_name": "x", "call_kind": "http", "target_kind": "internal"} | more


def edge(i, kind, to, source="Order.place", service=1, entry=None, origin="static"):
    return {"id": i, "service_id": service, "entrypoint_id": entry, "from_symbol": source, "to_symbol": to, "kind": kind, "origin": origin, "evidence": EV}


RETRY = {"service_id": 1, "source": "Order.place", "kind": "retry", "mechanism": "reactor", "value": 3, "unit": "retries", "evidence": EV}
TIMEOUT = RETRY | {"kind": "timeout", "unit": "milliseconds"}
HTTP = {"service_id": 1, "source": "Order.place", "target_service": "payments", "protocol": "http", "target_method": "POST", "target_path": "/charge", "evidence": EV}
WRITE, PUBLISH = edge(1, "writes", "orders"), edge(2, "publishes", "order.placed")
CONSUMES = {"service_id": 2, "source": "Pay.on", "direction": "consumes", "channel": "order.placed", "evidence": EV}
CONSUMER = {"id": 9, "service_id": 2, "kind": "message", "method": "CONSUME", "name": "order.placed", "symbol": "Pay.on", "evidence": EV}
CONSUMER_WRITE = edge(3, "writes", "ledger", "Pay.on", 2)
CONTRACT = {"entrypoint_id": 9, "contract": '{"transport": "rabbitmq", "direction": "consumes"}'}
RAISES = {"service_id": 1, "source": "Order.place", "role": "raises", "error_kind": "not_found", "internal_type": "NoOrder", "protocol": "http", "transport_code": "404", "retryability": "not_retryable", "exposes_internal_detail": False, "evidence": EV}
ENTRY = {"id": 5, "service_id": 1, "kind": "http", "method": "GET", "name": "/orders", "symbol": "Order.place", "evidence": EV}
IAC = {"repository_id": 1, "service_id": 1, "provider": "aws", "resource_type": "queue", "iac_resource_type": "aws_sqs_queue", "logical_name": "q", "physical_name": "jobs", "attributes": {}, "evidence": EV}
BUCKET = IAC | {"resource_type": "object_storage", "iac_resource_type": "aws_s3_bucket", "physical_name": "files"}
CLOUD = {"service_id": 1, "source": "Order.place", "provider": "aws", "resource_type": "queue", "target_name": "jobs", "operation": "send", "evidence": EV}
K8S = {"service_id": 1, "environment_key": "URL", "source_kind": "config_map", "source_name": "conf", "source_key": "url", "evidence": EV, "declaration_evidence": EV}
ENTITY = {"service_id": 1, "name": "Orders", "engine": "postgres"}
FACT = {"service_id": 1, "name": "Order", "kind": "sql_table", "owner": "OrderEntity", "evidence": EV}
RETRY_FLOW = {"static_resilience_policies": [RETRY], "flow_edges": [WRITE, PUBLISH]}
REACHED = {"static_resilience_policies": [RETRY], "flow_edges": [WRITE, PUBLISH, CONSUMER_WRITE], "static_message_contracts": [CONSUMES], "entrypoints": [CONSUMER]}

# detector, facts that give one finding, its kind and services, and one table whose change takes it away
CASES = [
    ("cycles", {"service_calls": [call(1, 2), call(2, 1)]}, "cycle", ["orders", "payments"], {"service_calls": [call(1, 2)]}),
    ("component_cycles", {"flow_edges": [edge(1, "invokes", "B.y", "A.x"), edge(2, "invokes", "A.z", "B.y")]}, "component_cycle", ["orders"], {"flow_edges": [edge(1, "invokes", "B.y", "A.x")]}),
    ("shared_database", {"persistence_entities": [ENTITY, ENTITY | {"service_id": 2, "name": "orders"}]}, "shared_database", ["orders", "payments"], {"persistence_entities": [ENTITY, ENTITY | {"service_id": 2, "engine": "unknown"}]}),
    ("ownership_overlap", {"static_persistence_facts": [FACT, FACT | {"service_id": 2, "name": "ORDER"}]}, "possible_aggregate_ownership_overlap", ["orders", "payments"], {"static_persistence_facts": [FACT]}),
    ("duplicate_integrations", {"service_calls": [call(1, None, target_kind="external", to_service_name="Stripe"), call(2, None, target_kind="external", to_service_name="stripe", id=7)]}, "duplicate_external_integration", ["orders", "payments"], {"service_calls": [call(1, None, target_kind="external", to_service_name="Stripe")]}),
    ("read_side_effects", {"entrypoints": [ENTRY], "flow_edges": [edge(1, "writes", "orders", entry=5)]}, "possible_read_entrypoint_side_effect", ["orders"], {"flow_edges": [edge(1, "writes", "orders", entry=5, origin="runtime")]}),
    ("broad_handlers", {"static_error_contracts": [RAISES | {"role": "maps", "internal_type": "java.lang.Exception"}]}, "possible_overbroad_exception_handler", ["orders"], {"static_error_contracts": [RAISES | {"role": "maps"}]}),
    ("broad_handlers_over_timeouts", {"static_error_contracts": [RAISES | {"role": "maps", "internal_type": "Throwable", "transport_code": "500"}], "static_service_calls": [HTTP], "static_resilience_policies": [TIMEOUT]}, "possible_broad_handler_swallows_timeout", ["orders"], {"static_resilience_policies": [RETRY]}),
    ("policies_on_write_flows", {"static_service_calls": [HTTP], "static_resilience_policies": [TIMEOUT], "flow_edges": [WRITE]}, "possible_resilience_policy_on_partial_write_flow", ["orders"], {"flow_edges": [PUBLISH]}),
    ("retry_write_publish", RETRY_FLOW, "possible_retry_on_write_publish_flow", ["orders"], {"static_resilience_policies": [TIMEOUT]}),
    ("retry_reaches_consumers", RETRY_FLOW | {"static_message_contracts": [CONSUMES]}, "possible_retry_write_publish_reaches_consumer", ["orders", "payments"], {"static_message_contracts": [CONSUMES | {"service_id": 1}]}),
    ("retry_reaches_persistent_consumers", REACHED, "possible_retry_write_publish_reaches_persistent_consumer", ["orders", "payments"], {"flow_edges": [WRITE, PUBLISH]}),
    ("retry_reaches_unrecovered_consumers", REACHED | {"entrypoint_contracts": [CONTRACT]}, "possible_retry_write_publish_reaches_unrecovered_persistent_consumer", ["orders", "payments"], {"flow_boundaries": [{"service_id": 2, "source": "Pay.on", "kind": "retry", "evidence": EV}]}),
    ("non_atomic_service_publish", {"flow_edges": [WRITE, PUBLISH]}, "possible_non_atomic_service_publish", ["orders"], {"flow_boundaries": [{"service_id": 1, "source": "Order.place", "kind": "transaction", "evidence": EV}]}),
    ("error_semantics_lost", {"static_error_contracts": [RAISES, RAISES | {"role": "maps", "source": "Advice.on", "transport_code": "503"}]}, "possible_error_semantics_lost", ["orders"], {"static_error_contracts": [RAISES, RAISES | {"role": "maps", "transport_code": "5xx"}]}),
    ("unhandled_endpoint_errors", {"entrypoints": [ENTRY], "static_error_contracts": [RAISES]}, "possible_unhandled_endpoint_error", ["orders"], {"static_error_contracts": [RAISES, RAISES | {"role": "maps"}]}),
    ("internal_error_exposures", {"static_error_contracts": [RAISES | {"role": "maps", "exposes_internal_detail": True}]}, "possible_internal_error_exposure", ["orders"], {"static_error_contracts": [RAISES | {"exposes_internal_detail": True}]}),
    ("calls_without_policy", {"static_service_calls": [HTTP]}, "possible_missing_http_resilience_policy", ["orders"], {"static_resilience_policies": [TIMEOUT]}),
    ("retries_on_non_idempotent_calls", {"static_service_calls": [HTTP], "static_resilience_policies": [RETRY]}, "possible_retry_on_non_idempotent_http_call", ["orders"], {"static_service_calls": [HTTP | {"target_method": "GET"}]}),
    ("retries_on_permanent_errors", {"static_error_contracts": [RAISES], "static_resilience_policies": [RETRY]}, "possible_retry_on_non_retryable_error", ["orders"], {"static_error_contracts": [RAISES | {"retryability": "unknown"}]}),
    ("retries_on_downstream_errors", {"static_service_calls": [HTTP], "static_resilience_policies": [RETRY], "static_error_contracts": [RAISES | {"service_id": 2}]}, "possible_retry_on_downstream_client_error", ["orders", "payments"], {"static_error_contracts": [RAISES | {"service_id": 2, "transport_code": "40x"}]}),
    ("timeouts_without_fallback", {"static_service_calls": [HTTP], "static_resilience_policies": [TIMEOUT]}, "possible_timeout_without_local_fallback", ["orders"], {"static_error_contracts": [RAISES | {"role": "handles", "error_kind": "timeout"}]}),
    ("timeout_fallbacks_masking", {"static_service_calls": [HTTP], "entrypoints": [ENTRY], "static_error_contracts": [RAISES | {"role": "handles", "error_kind": "timeout", "transport_code": "200"}]}, "possible_timeout_fallback_masks_failure", ["orders"], {"static_error_contracts": [RAISES | {"role": "handles", "error_kind": "timeout", "transport_code": "503"}]}),
    ("timeouts_as_500", {"static_error_contracts": [RAISES | {"role": "maps", "error_kind": "timeout", "transport_code": "500"}]}, "possible_timeout_mapped_as_internal_server_error", ["orders"], {"static_error_contracts": [RAISES | {"role": "maps", "error_kind": "timeout", "transport_code": "504"}]}),
    ("unmapped_downstream_errors", {"static_service_calls": [HTTP], "static_error_contracts": [RAISES | {"service_id": 2}]}, "possible_unmapped_downstream_error", ["orders", "payments"], {"static_error_contracts": [RAISES | {"service_id": 2}, RAISES | {"role": "maps"}]}),
    ("consumers_without_recovery", {"entrypoints": [CONSUMER], "entrypoint_contracts": [CONTRACT]}, "possible_message_consumer_without_recovery_policy", ["payments"], {"entrypoint_contracts": [CONTRACT | {"contract": '{"transport": "rabbitmq", "direction": "consumes", "retry_delay_ms": 5}'}]}),
    ("cloud_code_without_iac", {"static_cloud_facts": [CLOUD]}, "cloud_dependency_without_iac", ["orders"], {"cloud_iac_resources": [IAC]}),
    ("cloud_iac_unused", {"cloud_iac_resources": [IAC]}, "cloud_iac_resource_unused", ["orders"], {"static_cloud_facts": [CLOUD]}),
    ("shared_cloud_resource", {"static_cloud_facts": [CLOUD, CLOUD | {"service_id": 2}]}, "shared_cloud_resource", ["orders", "payments"], {"static_cloud_facts": [CLOUD]}),
    ("k8s_key_mismatches", {"k8s_key_mismatches": [K8S]}, "possible_kubernetes_configuration_key_not_declared", ["orders"], {"k8s_key_mismatches": [K8S | {"service_id": None}]}),
    ("k8s_source_unknowns", {"k8s_source_unknowns": [K8S]}, "possible_kubernetes_configuration_source_not_declared_locally", ["orders"], {"k8s_source_unknowns": []}),
    ("k8s_import_unknowns", {"k8s_import_unknowns": [K8S | {"optional": None}]}, "possible_kubernetes_configuration_source_import_not_declared_locally", ["orders"], {"k8s_import_unknowns": []}),
    ("missing_dead_letter_queue", {"cloud_iac_resources": [IAC]}, "possible_missing_dead_letter_queue", ["orders"], {"cloud_iac_resources": [IAC | {"attributes": {"redrive_policy": "true"}}]}),
    ("public_storage", {"cloud_iac_resources": [BUCKET | {"attributes": {"acl": "public-read"}}]}, "possible_public_object_storage", ["orders"], {"cloud_iac_resources": [BUCKET | {"attributes": {"acl": "private"}}]}),
    ("unencrypted", {"cloud_iac_resources": [BUCKET]}, "possible_unencrypted_cloud_resource", ["orders"], {"cloud_iac_resources": [BUCKET | {"attributes": {"encryption_configured": "true"}}]}),
    ("missing_versioning", {"cloud_iac_resources": [BUCKET]}, "possible_missing_bucket_versioning", ["orders"], {"cloud_iac_resources": [BUCKET | {"attributes": {"versioning": "true"}}]}),
]


@pytest.mark.parametrize("name, tables, kind, services, change", CASES, ids=[c[0] for c in CASES])
def test_evidence_gives_a_finding_and_a_mutation_takes_it_away(spark, name, tables, kind, services, change):
    detector = d.DETECTORS[name]
    found = [(r["kind"], r["services"]) for r in detector(facts(spark, **tables)).collect()]
    assert found == [(kind, services)]
    assert detector(facts(spark, **(tables | change))).collect() == []


def test_flow_hypotheses(spark):
    entry = ENTRY | {"kind": "graphql", "method": "MUTATION"}
    tables = {"entrypoints": [entry], "flow_edges": [edge(1, "writes", "orders", entry=5), edge(2, "publishes", "order.placed", entry=5)]}
    kinds = {r["kind"] for r in d.flow_hypotheses(facts(spark, **tables)).collect()}
    assert kinds == {"possible_bff_domain_leakage", "possible_non_atomic_publish"}
    closed = tables | {"flow_boundaries": [{"service_id": 1, "source": "Order.place", "kind": "transaction", "evidence": EV}]}
    assert {r["kind"] for r in d.flow_hypotheses(facts(spark, **closed)).collect()} == {"possible_bff_domain_leakage"}


def test_fan_imbalance_counts_distinct_peers(spark):
    services = [{"id": i, "repository_id": 1, "name": f"s{i}"} for i in range(6)]
    calls = [call(0, b, id=b) for b in range(1, 5)] + [call(0, 1, id=99)]
    found = d.fan_imbalance(facts(spark, services=services, service_calls=calls)).collect()
    assert [(r["kind"], r["services"], d.detail_of(r)["count"]) for r in found] == [("fan_out", ["s0"], 4)]


def test_component_fan(spark):
    edges = [edge(i, "invokes", f"C{i}.m", "Hub.m") for i in range(5)] + [edge(10 + i, "invokes", "Leaf.m", f"C{i}.m") for i in range(5)] + [edge(30, "invokes", "Leaf.n", "Leaf.m")]
    found = {r["kind"] for r in d.component_fan_imbalance(facts(spark, flow_edges=edges)).collect()}
    assert "component_fan_out" in found


def test_all_detectors_share_a_schema_and_find_nothing_in_nothing(spark):
    assert d.all_findings(facts(spark)).collect() == []
    assert len(d.DETECTORS) == 39


def test_diff_of_a_run_with_itself_is_empty(spark):
    f = facts(spark, service_calls=[call(1, 2), call(2, 1)])
    assert d.diff(d.cycles(f), d.cycles(f)).collect() == []
    changes = [r["change"] for r in d.diff(d.cycles(facts(spark)), d.cycles(f)).collect()]
    assert changes == ["new"]


@pytest.mark.parametrize("detector", sorted(d.PER_CHANNEL))
def test_channel_findings_are_counted_before_services_are_named(spark, detector):
    """Producers that consume, that do not and that share a name: the counts equal those of the findings, and no flow carries a list of services."""
    services = [{"id": i, "repository_id": 1, "name": "twin" if i in (4, 5) else f"s{i}"} for i in range(1, 8)]
    at = lambda row, i: row | {"service_id": i}
    edges = [at(e, i) | {"id": i * 10 + k} for i in range(1, 8) for k, e in enumerate((WRITE, PUBLISH, CONSUMER_WRITE))]
    edges += [at(PUBLISH, 1) | {"id": 99, "to_symbol": "order.lost"}]
    consuming = (1, 2, 4, 5, 6)
    f = facts(
        spark, services=services, flow_edges=edges, static_resilience_policies=[at(RETRY, i) for i in range(1, 8)],
        static_message_contracts=[at(CONSUMES, i) for i in consuming] + [at(CONSUMES, 1) | {"channel": "order.lost"}],
        entrypoints=[at(CONSUMER, i) | {"id": 900 + i} for i in consuming], entrypoint_contracts=[CONTRACT | {"entrypoint_id": 900 + i} for i in consuming],
    )
    full = d.DETECTORS[detector](f).selectExpr("kind", "array_join(services, ',') AS services", "subject", "CAST(size(evidence) AS BIGINT) AS evidence", "confidence")
    want = full.groupBy(*full.columns).count().collect()
    assert sorted(map(tuple, d.per_channel_counts(f, detector).collect())) == sorted(map(tuple, want)) and len(want) > 1
    flows, _ = d._per_channel(f, d.PER_CHANNEL[detector][0](f))
    assert not [c.name for c in flows.schema if c.dataType.simpleString() == "array<string>"]


def test_unmapped_errors_are_counted_before_callers_meet_answers(spark):
    """Twins by name on both sides, equal rows, endpoints, calls without a path and inferred calls: the counts equal those of the findings."""
    services = [{"id": i, "repository_id": 1, "name": n} for i, n in ((1, "orders"), (2, "payments"), (3, "Payments"), (4, "orders"), (5, "stock"), (6, "orders"), (7, "payments"))]
    at = lambda row, i, **more: row | {"service_id": i} | more
    asks = [at(HTTP, i) for i in (1, 1, 4, 5, 6)] + [at(HTTP, 4, target_method=None, target_path=None), at(HTTP, 6, target_method="post", target_service="PAYMENTS"), at(HTTP, 1, target_service=None), at(HTTP, 9)]
    errors = [at(RAISES, i, internal_type=t) for i in (2, 2, 3, 5, 7) for t in ("Gone", "Denied")] + [at(RAISES, 2, source="Pay.other"), at(RAISES, 7, source=None), at(RAISES, 3, transport_code="500")]
    errors += [at(RAISES, i, role="maps", internal_type=t) for i, t in ((4, "Gone"), (4, "Gone"), (6, "Gone"), (5, "Denied"), (1, "Other"))]
    entry = {"id": 20, "service_id": 2, "kind": "http", "method": "POST", "name": "/charge", "symbol": "Pay.charge", "evidence": EV}
    f = facts(
        spark, services=services, static_service_calls=asks, static_error_contracts=errors, entrypoints=[entry], flow_edges=[edge(1, "invokes", RAISES["source"], "Pay.charge", 2)],
        apis=[{"id": 900 + i, "service_id": i, "method": "GET", "path": "/a"} for i in range(1, 8)],
        service_calls=[call(a, b, from_api_id=900 + a) for a, b in ((1, 5), (5, 1), (4, 5), (6, 5), (6, 5), (1, 2), (2, 5), (3, 5), (7, None), (5, 9))],
    )
    full = d.unmapped_downstream_errors(f).selectExpr("kind", "array_join(services, ',') AS services", "subject", "CAST(size(evidence) AS BIGINT) AS evidence", "confidence")
    want = full.groupBy(*full.columns).count().collect()
    assert sorted(map(tuple, d.unmapped_downstream_counts(f).collect())) == sorted(map(tuple, want))
    assert {r["confidence"] for r in want} == {0.75, 0.6, 0.35} and max(r["count"] for r in want) > 4


def test_unmapped_errors_are_paired_from_counted_tables(spark):
    """The step that pairs reads neither lines nor parts: reading them once for each use, with the parts collected each time, filled the driver."""
    read = QUERIES["finds_unmapped_downstream_errors"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [x for x in read if x.endswith(("lineitem.parquet", "part.parquet"))]
    stated = code_facts(spark, "/root/testdata/sf0.001", spread=True)["static_error_contracts"]
    assert "BroadcastHashJoin" not in stated._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("detector", ["retry_reaches_persistent_consumers", "retry_reaches_unrecovered_consumers"])
def test_channel_findings_are_named_from_counted_tables(spark, detector):
    """The step that names services reads neither lines nor parts: flows and consumers that carried evidence through every join filled the disk."""
    read = QUERIES[f"finds_{detector}"](spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not [x for x in read if x.endswith(("lineitem.parquet", "part.parquet"))]


def test_evidence_of_few_consumers_stands_for_all(spark):
    """Seven consumers, twins among the first names, a flow of each: what the first names' consumers show is what all flows show."""
    at = lambda row, i, **more: row | {"service_id": i} | more
    services = [{"id": i, "repository_id": 1, "name": "a" if i in (1, 5) else f"b{9 - i}"} for i in range(1, 9)]
    writes = [at(CONSUMER_WRITE, i, id=100 * i + k, to_symbol=f"t{k}") for i in range(1, 8) for k in range(i % 4 + 1)]
    flows = [at(e, i, id=10 * i + k) for i in range(1, 9) for k, e in enumerate((WRITE, PUBLISH))]
    f = facts(
        spark, services=services, flow_edges=flows + writes, static_resilience_policies=[at(RETRY, i, value=k) for i in range(1, 9) for k in range(i)],
        static_message_contracts=[at(CONSUMES, i, evidence=(f"f{k}", k, k)) for i in range(1, 8) for k in range(i % 3 + 1)], entrypoints=[at(CONSUMER, i, id=900 + i) for i in range(1, 8)],
    )
    full = d.retry_reaches_persistent_consumers(f).selectExpr("kind", "array_join(services, ',') AS services", "subject", "CAST(size(evidence) AS BIGINT) AS evidence", "confidence")
    want = full.groupBy(*full.columns).count().collect()
    assert sorted(map(tuple, d.per_channel_counts(f, "retry_reaches_persistent_consumers").collect())) == sorted(map(tuple, want)) and len({r["evidence"] for r in want}) > 3


def test_a_service_is_put_at_its_place_among_the_names(spark):
    """First, last, between, beside a prefix and a longer name, and none; letters of several bytes."""
    names = ["b", "bé", "d,d", "é"]
    added = ["a", "ba", "b ", "c", "z", "éa", "日", None]
    counts = spark.createDataFrame([("t", "s", 1, a, 1) for a in added], "channel string, subject string, evidence long, added string, n long")
    found = d._with_services(counts, spark.createDataFrame([("t", n) for n in names], "channel string, name string")).collect()
    assert {r["added"]: r["services"] for r in found} == {a: ",".join(sorted([*names, *([a] if a else [])], key=str.encode)) for a in added}
