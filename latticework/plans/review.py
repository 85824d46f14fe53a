"""Review units and decisions of a change plan, derived from findings and facts by rules in a table.

A unit has id, service, role, symbol, action, reason, related_contracts, validation, confidence and evidence. A rule takes
findings of one kind at or above a confidence, on a primary service, and makes one unit of each, or one for each channel. More
specific reviews suppress the more general ones of the same flow: an anti join on what they cover.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import paths, relational

UNIT = ["id", "service", "role", "symbol", "action", "reason", "related_contracts", "validation", "confidence", "evidence"]


@dataclass(frozen=True)
class Rule:
    """How findings of a kind become units of a family."""

    kind: str
    family: str
    least: float
    role: str
    contracts: tuple[str, ...] = ()
    only: str | None = None
    per_channel: bool = False
    suppressed_by: tuple[str, ...] = field(default=())


# Kinds of findings, the families of units they make, and the least confidence for each.
RULES = [
    Rule("possible_aggregate_ownership_overlap", "aggregate-ownership", 0.65, "persistence", ("database",)),
    Rule("cloud_dependency_without_iac", "cloud-dependency-iac", 0.7, "deployment", ("cloud",)),
    Rule("possible_missing_dead_letter_queue", "cloud-dead-letter-queue", 0.45, "deployment", ("cloud:queue",)),
    Rule("possible_unencrypted_cloud_resource", "cloud-encryption", 0.4, "deployment", ("cloud:encryption",)),
    Rule("possible_missing_bucket_versioning", "cloud-versioning", 0.4, "deployment", ("cloud:object_storage",)),
    Rule("possible_public_object_storage", "public-object-storage", 0.85, "deployment", ("cloud:object_storage",)),
    Rule("possible_broad_handler_swallows_timeout", "broad-timeout-handler", 0.65, "error_mapping", ("error",), "get_json_object(detail, '$.status') = '500'"),
    Rule("possible_internal_error_exposure", "error-exposure", 0.75, "error_mapping", ("error",)),
    Rule("possible_timeout_mapped_as_internal_server_error", "timeout-error-mapping", 0.8, "error_mapping", ("error",)),
    Rule("possible_overbroad_exception_handler", "broad-error-handler", 0.75, "error_mapping", ("error",)),
    Rule("possible_unmapped_downstream_error", "downstream-error-mapping", 0.75, "error_mapping", ("error",), "get_json_object(detail, '$.scope') = 'endpoint_flow'"),
    Rule("possible_unhandled_endpoint_error", "error-mapping-gap", 0.75, "error_mapping", ("error",)),
    Rule("possible_error_semantics_lost", "error-mapping", 0.8, "error_mapping", ("error",)),
    Rule("possible_missing_http_resilience_policy", "http-resilience-policy", 0.5, "resilience", ("http",)),
    Rule("possible_retry_on_non_retryable_error", "retry-policy", 0.8, "resilience", ("error",)),
    Rule("possible_retry_on_non_idempotent_http_call", "retry-http-idempotency", 0.65, "resilience", ("http",)),
    Rule("possible_retry_on_downstream_client_error", "retry-downstream-error", 0.8, "resilience", ("http",)),
    Rule("possible_resilience_policy_on_partial_write_flow", "partial-write-resilience", 0.7, "resilience", ("http",)),
    Rule("possible_timeout_fallback_masks_failure", "timeout-fallback", 0.8, "resilience", ("http",)),
    Rule("possible_timeout_without_local_fallback", "timeout-local-fallback", 0.55, "resilience", ("http",)),
    Rule("possible_read_entrypoint_side_effect", "read-entrypoint-side-effect", 0.8, "entrypoint", ("http",)),
    Rule("possible_retry_write_publish_reaches_unrecovered_persistent_consumer", "retry-unrecovered-consumer-delivery", 0.65, "messaging", ("message",)),
    Rule("possible_retry_write_publish_reaches_persistent_consumer", "retry-delivery", 0.8, "messaging", ("message",), suppressed_by=("retry-unrecovered-consumer-delivery",)),
    Rule("possible_retry_write_publish_reaches_consumer", "retry-consumer-delivery", 0.75, "messaging", ("message",), suppressed_by=("retry-unrecovered-consumer-delivery", "retry-delivery")),
    Rule("possible_retry_on_write_publish_flow", "retry-write-publish", 0.7, "messaging", ("message",), per_channel=True, suppressed_by=("retry-unrecovered-consumer-delivery", "retry-delivery", "retry-consumer-delivery")),
    Rule("possible_non_atomic_service_publish", "non-atomic-service-publish", 0.5, "messaging", ("message",), per_channel=True, suppressed_by=("retry-unrecovered-consumer-delivery", "retry-delivery", "retry-consumer-delivery", "retry-write-publish")),
    Rule("possible_message_consumer_without_recovery_policy", "message-consumer-recovery", 0.45, "messaging", ("rabbitmq",)),
]


def _owner() -> Column:
    """The service that a finding is about: its producer or caller if it tells one, else the first."""
    tell = lambda k: F.get_json_object("detail", f"$.{k}")
    return F.coalesce(tell("producer"), tell("caller"), F.get("services", 0))


def _of_rule(findings: DataFrame, primary: DataFrame, rule: Rule) -> DataFrame:
    """One rule's units before suppression."""
    rows = findings.filter((F.col("kind") == rule.kind) & (F.col("confidence") >= rule.least))
    if rule.only:
        rows = rows.filter(rule.only)
    p = primary.select(F.col("service").alias("_primary")).distinct()
    if rule.family == "aggregate-ownership":  # of one primary service and others; two primaries are a decision of their own
        rows = rows.withColumn("_p", F.explode("services")).join(p, F.col("_p") == F.col("_primary"))
        keys = [c for c in findings.columns]
        rows = rows.groupBy(*keys).agg(F.collect_set("_primary").alias("_all")).filter("size(_all) = 1").withColumn("service", F.col("_all")[0]).drop("_all")
    else:
        rows = rows.withColumn("service", _owner()).join(p, F.col("service") == F.col("_primary"), "left_semi")
    if rule.per_channel:
        channels = F.from_json(F.get_json_object("detail", "$.channels"), "array<string>")
        rows = rows.withColumn("subject", F.explode(F.transform(channels, lambda c: F.concat_ws(" ", "subject", c))))
    contracts = F.array(*(F.concat(F.lit(f"{c}:"), F.element_at(F.split("subject", " "), -1)) for c in rule.contracts))
    unit = rows.select(
        F.concat_ws(":", F.lit(rule.family), "service", F.replace("subject", F.lit(" "), F.lit(":"))).alias("id"), "service", F.lit(rule.role).alias("role"), F.col("subject").alias("symbol"), F.lit("review").alias("action"),
        "reason", contracts.alias("related_contracts"), F.array(F.concat(F.lit("verify before changing: "), "reason")).alias("validation"), "confidence", "evidence",
    )
    return relational.first_per_key(unit, ["id"], ["confidence", "evidence"]).select(*UNIT)


def units_from_findings(findings: DataFrame, primary: DataFrame) -> DataFrame:
    """All units of all rules for the primary services, the general ones suppressed where a specific one covers their flow."""
    made: dict[str, DataFrame] = {}
    for rule in RULES:
        units = _of_rule(findings, primary, rule)
        for family in rule.suppressed_by:
            units = relational.without(units, made[family], ["service", "symbol"])
        made[rule.family] = units
    covered = findings.filter(F.col("kind") == "possible_retry_write_publish_reaches_unrecovered_persistent_consumer").withColumn("service", _owner())
    covered = covered.join(primary.select("service").distinct(), "service", "left_semi").select(F.explode(F.from_json(F.get_json_object("detail", "$.consumer_services"), "array<string>")).alias("service"), F.get_json_object("detail", "$.channel").alias("channel"))
    recovery = made["message-consumer-recovery"].withColumn("channel", F.substring_index("symbol", " ", 1))
    made["message-consumer-recovery"] = relational.without(recovery, covered, ["service", "channel"]).select(*UNIT)
    return reduce(DataFrame.unionByName, made.values())


def _unit(rows: DataFrame, family: str, role: str, keys: list[str], reason: Column, contract: Column, confidence: float, validation: Column | None = None) -> DataFrame:
    return rows.select(F.concat_ws(":", F.lit(family), "service", *keys).alias("id"), "service", F.lit(role).alias("role"), F.concat_ws(":", *keys).alias("symbol"), F.lit("review").alias("action"), reason.alias("reason"), contract.alias("related_contracts"), (F.array(reason) if validation is None else validation).alias("validation"), F.lit(confidence).alias("confidence"), "evidence")


def _evidence(*columns: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array(*columns)))))


def migration_units(persisted: DataFrame, migrations: DataFrame, primary: DataFrame) -> DataFrame:
    """One unit for each table of a primary service that migrations name too, whatever the case; destructive ones ask for a rollback plan."""
    p = persisted.filter("kind = 'sql_table'").join(primary.select("service").distinct(), "service", "left_semi").select("service", F.col("name").alias("entity"), F.col("evidence").alias("e1"))
    m = migrations.select("service", F.lower("table_name").alias("_t"), "destructive", F.col("evidence").alias("e2"))
    rows = p.withColumn("_t", F.lower("entity")).join(m, ["service", "_t"]).groupBy("service", "entity").agg(F.count("*").alias("n"), F.bool_or("destructive").alias("destructive"), _evidence("e1", "e2").alias("evidence"))
    reason = F.concat("entity", F.lit(" is met by "), F.col("n").cast("string"), F.lit(" migration operations."))
    checks = F.when(F.col("destructive"), F.array(reason, F.lit("verify order, backup and rollback of destructive operations"))).otherwise(F.array(reason))
    return _unit(rows, "persistence-migration", "persistence", ["entity"], reason, F.array(F.concat(F.lit("database:"), "entity")), 1.0, checks)


def http_contract_units(calls: DataFrame, endpoints: DataFrame, services: DataFrame, primary: DataFrame) -> DataFrame:
    """One unit for each HTTP contract that a primary service's calls reach in another indexed service.

    calls: (service_id, source, target_service, protocol, target_method, target_path, evidence). endpoints: (service_id, kind,
    method, name). services: (id, repository_id, name). A call reaches the endpoint with the most specific template that its path
    fits, in the only service of that name, else in the only one of it in the caller's repository. Calls without a method or path,
    and of no known endpoint, make no unit; calls of one contract from several places make one, with all their evidence.
    """
    home = services.select(F.col("id").alias("service_id"), "repository_id", F.col("name").alias("service"))
    asked = calls.filter("protocol = 'http' AND target_method IS NOT NULL AND target_path IS NOT NULL").join(home, "service_id")
    asked = asked.join(primary.select("service").distinct(), "service", "left_semi").select("service", "repository_id", "source", "target_service", "target_method", "target_path", "evidence")
    known = relational.resolve_reference(asked, services, "target_service").filter("resolved_id IS NOT NULL").drop("repository_id")
    known = known.withColumn("_method", F.upper("target_method"))
    there = endpoints.filter("kind = 'http'").select(F.col("service_id").alias("resolved_id"), F.upper("method").alias("_method"), F.col("name").alias("contract_path")).distinct()
    met = paths.matched_templates(known, there, ["resolved_id", "_method"], "target_path", "contract_path")
    names = services.select(F.col("id").alias("resolved_id"), F.col("name").alias("target"))
    rows = met.join(names, "resolved_id").groupBy("service", "target", F.col("_method").alias("method"), F.col("contract_path").alias("path")).agg(_evidence("evidence").alias("evidence"))
    reason = F.concat_ws(" ", F.lit("A proven HTTP call reaches"), "target", "method", F.concat("path", F.lit(".")))
    contract = F.concat_ws(" ", "method", "path")
    checks = F.array(F.concat(F.lit("verify that both sides agree on "), contract))
    return _unit(rows, "http-contract", "integration", ["target", "method", "path"], reason, F.array(contract), 1.0, checks)


def feature_flag_units(flags: DataFrame, primary: DataFrame) -> DataFrame:
    """One unit for each flag, by provider and key, that a primary service reads."""
    rows = flags.filter("provider <> '' AND flag_key <> ''").join(primary.select("service").distinct(), "service", "left_semi").groupBy("service", "provider", "flag_key").agg(_evidence("evidence").alias("evidence"))
    return _unit(rows, "feature-flag", "feature_flag", ["provider", "flag_key"], F.concat("flag_key", F.lit(" guards code in "), F.size("evidence").cast("string"), F.lit(" places.")), F.array(F.concat_ws(":", F.lit("feature_flag"), "provider", "flag_key")), 1.0)


def runtime_configuration_units(code: DataFrame, bindings: DataFrame, primary: DataFrame) -> DataFrame:
    """One unit for each environment key that both the code of a primary service reads and a workload binds."""
    a = code.filter("kind = 'environment'").join(primary.select("service").distinct(), "service", "left_semi").groupBy("service", F.col("config_key").alias("key")).agg(F.collect_set("evidence").alias("e1"))
    b = bindings.groupBy("service", F.col("environment_key").alias("key")).agg(F.collect_set("evidence").alias("e2"), F.sort_array(F.collect_set(F.concat_ws(":", F.lit("configuration"), "source_kind", "source_name", "source_key"))).alias("sources"))
    rows = a.join(b, ["service", "key"]).withColumn("evidence", F.sort_array(F.array_union("e1", "e2")))
    return _unit(rows, "runtime-configuration", "configuration", ["key"], F.concat("key", F.lit(" is read in code and bound at run time.")), F.array_union(F.array(F.concat(F.lit("configuration:environment:"), "key")), "sources"), 1.0)


def configuration_fact_units(facts: DataFrame, primary: DataFrame, family: str, confidence: float, keys: list[str]) -> DataFrame:
    """One unit for each key conflict, unknown source or unknown import of a primary service; by which keys tells which."""
    rows = facts.join(primary.select("service").distinct(), "service", "left_semi").groupBy("service", *keys).agg(_evidence("evidence").alias("evidence"))
    return _unit(rows, family, "configuration", keys, F.concat_ws(" ", F.lit("check"), *keys), F.array(F.concat_ws(":", F.lit("configuration"), *keys)), confidence)


# --- decisions ------------------------------------------------------------------------------------------------------


def decision_points(contracts_at_risk: DataFrame, primary: DataFrame) -> DataFrame:
    """(id, owner, contract, options): each event of a primary service with a consumer asks whether to keep or version its contract."""
    rows = contracts_at_risk.filter("size(consumers) > 0").join(primary.select(F.col("service").alias("producer")).distinct(), "producer", "left_semi").select("producer", "channel").distinct()
    return rows.select(F.concat_ws(":", F.lit("event-compatibility"), "producer", "channel").alias("id"), F.col("producer").alias("owner"), F.col("channel").alias("contract"), F.array(F.lit("preserve"), F.lit("version")).alias("options"))


def checked_selections(decisions: DataFrame, selections: DataFrame) -> DataFrame:
    """(id, problem): decisions without just one valid choice, and choices for no decision; none if all is well."""
    s = selections.groupBy(F.col("decision_id").alias("_id")).agg(F.count("*").alias("_n"), F.min("option").alias("_o"))
    both = decisions.join(s, decisions["id"] == s["_id"], "full")
    problem = F.when(F.col("id").isNull(), "unknown decision").when(F.col("_id").isNull(), "no choice").when(F.col("_n") > 1, "several choices").when(~F.array_contains("options", F.col("_o")), "unknown option")
    return both.select(F.coalesce("id", "_id").alias("id"), problem.alias("problem")).filter("problem IS NOT NULL")


def units_from_decisions(decisions: DataFrame, selections: DataFrame) -> DataFrame:
    """(id, service, action): to preserve is to validate, to version is to modify."""
    rows = decisions.join(selections.select(F.col("decision_id").alias("id"), "option"), "id")
    return rows.select(F.concat_ws(":", F.lit("event-contract"), "owner", "contract").alias("id"), F.col("owner").alias("service"), F.when(F.col("option") == "preserve", "validate").otherwise("modify").alias("action"))
