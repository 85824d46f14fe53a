"""Review units, decisions, filters, surfaces and assessments on small literal tables."""

import pytest
from pyspark.sql import functions as F

from latticework.plans import assess, review, runtime_config, surface
from tests.conftest import rows
from tests.test_detectors import CONTRACT, EV, PUBLISH, REACHED, RETRY_FLOW, facts
from latticework.plans import detectors as d

EVS = "array<struct<file:string,start_line:int,end_line:int>>"


def primary(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "service string")


def families(units):
    return sorted(r["id"].split(":")[0] for r in units.collect())


def test_specific_reviews_suppress_general_ones(spark):
    def found(**tables):
        f = facts(spark, **tables)
        parts = [d.DETECTORS[n](f) for n in ("retry_write_publish", "retry_reaches_consumers", "retry_reaches_persistent_consumers", "retry_reaches_unrecovered_consumers", "non_atomic_service_publish", "consumers_without_recovery")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.cache()

    p = primary(spark, "orders", "payments")
    assert families(review.units_from_findings(found(flow_edges=[RETRY_FLOW["flow_edges"][0], PUBLISH]), p)) == ["non-atomic-service-publish"]
    assert families(review.units_from_findings(found(**RETRY_FLOW), p)) == ["retry-write-publish"]
    assert families(review.units_from_findings(found(**REACHED), p)) == ["retry-delivery"]
    assert families(review.units_from_findings(found(**(REACHED | {"entrypoint_contracts": [CONTRACT]})), p)) == ["retry-unrecovered-consumer-delivery"]
    assert families(review.units_from_findings(found(**REACHED), primary(spark, "stock"))) == []


def test_units_from_facts(spark):
    ev = f"service string, name string, kind string, evidence struct<file:string,start_line:int,end_line:int>"
    persisted = spark.createDataFrame([("orders", "Orders", "sql_table", EV), ("orders", "x", "document", EV)], ev)
    migrations = spark.createDataFrame([("orders", "ORDERS", True, ("m.sql", 1, 1)), ("orders", "other", False, EV)], "service string, table_name string, destructive boolean, evidence struct<file:string,start_line:int,end_line:int>")
    units = review.migration_units(persisted, migrations, primary(spark, "orders")).collect()
    assert [u["id"] for u in units] == ["persistence-migration:orders:Orders"] and len(units[0]["validation"]) == 2 and len(units[0]["evidence"]) == 2
    flags = spark.createDataFrame([("orders", "ld", "new-ui", EV), ("orders", "ld", "new-ui", ("b.py", 3, 3)), ("orders", "", "x", EV)], "service string, provider string, flag_key string, evidence struct<file:string,start_line:int,end_line:int>")
    assert [len(u["evidence"]) for u in review.feature_flag_units(flags, primary(spark, "orders")).collect()] == [2]


def test_decisions(spark):
    risk = spark.createDataFrame([("order.placed", "orders", ["payments"]), ("quiet", "orders", []), ("other", "stock", ["orders"])], "channel string, producer string, consumers array<string>")
    decisions = review.decision_points(risk, primary(spark, "orders"))
    assert [r["id"] for r in decisions.collect()] == ["event-compatibility:orders:order.placed"]
    pick = lambda *o: spark.createDataFrame(list(o), "decision_id string, option string")
    good = ("event-compatibility:orders:order.placed", "version")
    assert review.checked_selections(decisions, pick(good)).collect() == []
    assert [r["problem"] for r in review.checked_selections(decisions, pick(good, good)).collect()] == ["several choices"]
    assert rows(review.checked_selections(decisions, pick(("x", "version"))), "problem") == [("no choice",), ("unknown decision",)]
    assert [r["action"] for r in review.units_from_decisions(decisions, pick(good)).collect()] == ["modify"]


def test_runtime_filters(spark):
    schema = "service_id long, environment_key string, source_kind string, source_name string, source_key string, workload_kind string, workload_name string, container_name string, evidence struct<file:string,start_line:int,end_line:int>"
    b = spark.createDataFrame([(1, "URL", "config_map", "c", "url", "Deployment", "web", "app", ("a.yaml", 5, 8)), (1, "KEY", "secret", "s", "key", "Job", "once", "app", ("b.yaml", 1, 2))], schema)
    status = runtime_config.binding_status(b, b.filter("source_kind = 'secret'"), b)
    assert rows(status, "environment_key", "status") == [("KEY", "key_mismatch"), ("URL", "source_unknown")]
    dims = runtime_config.conditions(workloads=runtime_config.scopes([{"workload_kind": "Deployment", "workload_name": "web", "container_name": "app"}]), evidence_ranges=runtime_config.ranges([{"file": "a.yaml", "start_line": 8, "end_line": 20}]), statuses=["source_unknown"])
    assert rows(runtime_config.filtered(status, dims), "environment_key") == [("URL",)]
    t = runtime_config.totals(status, dims).collect()[0]
    assert (t["total"], t["workloads"], t["statuses"], t["all"]) == (2, 1, 1, 1)
    many = dims | runtime_config.conditions(source_kinds=["secret"], evidence_files=["a.yaml"])
    groups = runtime_config.check_complexity(many)
    assert groups and groups[0][0] == "evidence_ranges"
    with pytest.raises(ValueError):
        runtime_config.filtered(status, many)
    assert [n for _, n in runtime_config.group_order(status, many, [["source_kinds"], ["workloads", "source_kinds"]])] == [0, 1]
    for bad in ([], ["x", ""], ["y"]):
        with pytest.raises(ValueError):
            runtime_config.choices(bad, "statuses", runtime_config.STATUSES)
    with pytest.raises(ValueError):
        runtime_config.ranges([{"file": "a", "start_line": 3, "end_line": 2}])


def test_surface(spark):
    docs = spark.createDataFrame([("checkout", "POST /checkout charges the card"), ("payments", "charge a card"), ("search", "find things")], "service string, content_text string")
    edges = spark.createDataFrame([("checkout", "payments"), ("payments", "ledger")], "source string, target string")
    services = spark.createDataFrame([(i, n) for i, n in enumerate(["checkout", "payments", "search", "ledger"])], "id long, name string")
    task = spark.createDataFrame([(1, "charge")], "query_id long, query string")
    feedback = spark.createDataFrame([("payments", "rejected")] * 3, "service string, outcome string")
    got = {r["service"]: (r["role"], r["confidence"]) for r in surface.analyse(docs, task, edges, services, feedback).collect()}
    assert set(got) == {"checkout", "payments", "ledger"} and "search" not in got
    assert [r for r, _ in got.values()].count("primary") == 1
    judged = spark.createDataFrame([("payments", 0.8), ("checkout", 0.5)], "service string, confidence double")
    assert rows(surface.recalibrated(judged, feedback), "service", "confidence") == [("checkout", 0.5), ("payments", 0.56)]
    messages = spark.createDataFrame([("a", "publishes", "t"), ("b", "consumes", "t"), ("a", "consumes", "t"), ("a", "publishes", "u")], "service string, direction string, channel string")
    assert rows(surface.contracts_at_risk(messages, primary(spark, "a"))) == [("t", "a", ["b"]), ("u", "a", [])]
    s = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 2, "x")], "name string, repository_id long, source_commit string")
    assert rows(surface.freshness(s, spark.createDataFrame([(1, "x")], "repository_id long, head string"))) == [("a", False), ("b", True), ("c", None)]


def test_assessment(spark):
    roots = spark.createDataFrame([("orders", "svc/orders"), ("root", "")], "name string, root_path string")
    units = spark.createDataFrame([("u1", "orders", [("a.py", 1, 2)], ["c1", "c2"]), ("u2", "orders", [("b.py", 1, 2)], ["c"]), ("u3", "orders", [("/abs.py", 1, 1), ("../up.py", 1, 1)], [])], f"id string, service string, evidence {EVS}, validation array<string>")
    changed = spark.createDataFrame([("svc/orders/a.py",), ("docs/x.md",)], "path string")
    states = assess.assessed_units(units, changed, roots)
    assert rows(states) == [("u1", "covered"), ("u2", "omitted"), ("u3", "unassessable")]
    assert rows(assess.outside_roots(changed, roots.filter("name = 'orders'"))) == [("docs/x.md",)]
    assert rows(assess.changed_services(changed, roots.filter("name = 'orders'"))) == [("orders",)]
    results = spark.createDataFrame([("u1", 0, "failed", 1), ("u1", 0, "passed", 2)], "change_unit_id string, check_index int, status string, seq long")
    manual = assess.manual_states(units, results)
    assert rows(manual) == [("u1", 0, "passed"), ("u1", 1, "pending"), ("u2", 0, "pending")]
    assert rows(assess.manual_roll_up(manual), "id", "status") == [("u1", "pending"), ("u2", "pending")]
    assert assess.closure(states, manual).collect()[0]["state"] == "attention_required"


def test_verification(spark):
    got = assess.verified(primary(spark, "checkout", "payments"), primary(spark, "checkout")).collect()[0]
    assert (got["true_positives"], got["false_positives"], got["false_negatives"], got["precision"], got["recall"]) == (["checkout"], ["payments"], [], 0.5, 1.0)
    empty = assess.verified(primary(spark).limit(0), primary(spark, "orders")).collect()[0]
    assert empty["precision"] is None and empty["recall"] == 0.0 and empty["false_negatives"] == ["orders"]


def test_contract_breaks(spark):
    schema = "service string, source string, role string, protocol string, transport_code string, public_code string"
    before = spark.createDataFrame([("o", "A", "maps", "http", "404", None), ("o", "B", "maps", "http", "400", None), ("o", "B", "maps", "http", "401", None)], schema)
    after = spark.createDataFrame([("o", "A", "maps", "http", "410", None), ("o", "B", "maps", "http", "402", None)], schema)
    assert rows(assess.contract_breaks(before, after), "source", "before", "after") == [("A", "404/", "410/")]


def test_usage_totals_are_null_without_runs(spark):
    runs = spark.createDataFrame([], "input_tokens long, output_tokens long, cost_usd double, llm_calls long")
    assert assess.usage_totals(runs).collect()[0]["cost_usd"] is None
    assert F.lit(1) is not None
