"""The declared schema of every fact table: nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_EVIDENCE = "struct<file:string,start_line:int,end_line:int>"

#: Table: columns as DDL. A service is known by (repository_id, name), never by its name alone.
TABLES: dict[str, str] = {
    "repositories": "id long, name string, root_path string",
    "services": "id long, repository_id long, name string, root_path string, stack string, short_desc string, long_desc string, indexed_at timestamp, source_commit string",
    "apis": "id long, service_id long, method string, path string, summary string, description string, response_shape string, request_shape string",
    "api_validations": "api_id long, kind string, description string",
    "components": "id long, service_id long, name string, file_path string, summary string",
    "service_calls": "id long, from_service_id long, from_api_id long, to_service_id long, to_service_name string, call_kind string, reason string, data_needed array<string>, purpose_kind string, confidence double, target_kind string, resource_type string",
    "persistence_entities": "service_id long, name string, kind string, engine string, schema_json string",
    "messages": "service_id long, direction string, channel string, provider string, description string",
    "static_persistence_facts": f"service_id long, name string, kind string, owner string, evidence {_EVIDENCE}",
    "static_migration_facts": f"service_id long, operation string, table_name string, column_name string, destructive boolean, evidence {_EVIDENCE}",
    "static_configuration_bindings": f"service_id long, source string, config_key string, kind string, sensitive boolean, evidence {_EVIDENCE}",
    "static_feature_flags": f"service_id long, source string, provider string, flag_key string, evidence {_EVIDENCE}",
    "static_message_contracts": f"service_id long, source string, direction string, channel string, routing_key string, payload_type string, message_version string, evidence {_EVIDENCE}",
    "static_cloud_facts": f"service_id long, source string, provider string, resource_type string, service_name string, operation string, operation_kind string, sdk string, target_name string, evidence {_EVIDENCE}",
    "static_error_contracts": f"service_id long, source string, role string, error_kind string, internal_type string, protocol string, transport_code string, public_code string, exposes_internal_detail boolean, retryability string, evidence {_EVIDENCE}",
    "static_service_calls": f"service_id long, source string, target_service string, protocol string, target_method string, target_path string, evidence {_EVIDENCE}",
    "static_resilience_policies": f"service_id long, source string, kind string, mechanism string, value int, unit string, evidence {_EVIDENCE}",
    "entrypoints": f"id long, service_id long, kind string, method string, name string, symbol string, evidence {_EVIDENCE}",
    "entrypoint_contracts": "entrypoint_id long, contract string",
    "flow_edges": f"id long, service_id long, entrypoint_id long, from_symbol string, to_symbol string, kind string, confidence string, origin string, evidence {_EVIDENCE}",
    "flow_boundaries": f"service_id long, source string, kind string, evidence {_EVIDENCE}",
    "ci_commands": "repository_id long, workflow_path string, job string, kind string, command string, start_line int",
    "cloud_iac_resources": f"repository_id long, service_id long, provider string, resource_type string, iac_resource_type string, logical_name string, physical_name string, source_format string, confidence string, attributes map<string,string>, evidence {_EVIDENCE}",
    "k8s_bindings": f"repository_id long, service_id long, environment_key string, source_kind string, source_name string, source_key string, workload_kind string, workload_name string, container_name string, container_role string, evidence {_EVIDENCE}",
    "k8s_imports": f"repository_id long, service_id long, source_kind string, source_name string, prefix string, optional boolean, container_role string, workload_kind string, workload_name string, container_name string, evidence {_EVIDENCE}",
    "k8s_import_unknowns": f"repository_id long, service_id long, source_kind string, source_name string, prefix string, optional boolean, container_role string, workload_kind string, workload_name string, container_name string, evidence {_EVIDENCE}",
    "k8s_key_mismatches": f"repository_id long, service_id long, environment_key string, source_kind string, source_name string, source_key string, workload_kind string, workload_name string, container_name string, evidence {_EVIDENCE}, declaration_evidence {_EVIDENCE}",
    "k8s_source_unknowns": f"repository_id long, service_id long, environment_key string, source_kind string, source_name string, source_key string, workload_kind string, workload_name string, container_name string, evidence {_EVIDENCE}",
    "security_findings": "service_id long, kind string, severity string, file_path string, line int, reason string",
    "indexed_files": "service_id long, file_path string, content_hash string, category string",
    "index_runs": "id long, service_id long, status string, files_changed long, llm_calls long, input_tokens long, output_tokens long, cost_usd double, started_at timestamp, finished_at timestamp",
    "static_analysis_snapshots": "service_id long, input_digest string, analysis_version string",
    "architecture_runs": "id long, services_indexed long, created_at timestamp",
    "architecture_findings": f"run_id long, kind string, severity string, services array<string>, subject string, reason string, confidence double, evidence array<{_EVIDENCE}>, detail string",
    "change_surface_runs": "id long, task_text string, backend string, created_at timestamp",
    "change_surface_findings": "run_id long, service string, role string, confidence double, reason string",
    "change_surface_feedback": "id long, run_id long, service string, outcome string",
    "change_surface_verifications": "id long, run_id long, repository string, since_commit string, precision double, recall double, true_positives array<string>, false_positives array<string>, false_negatives array<string>",
    "synthesis_cache": "cache_key string, backend string, result string",
    "change_plans": "id long, change_surface_run_id long, status string, requested_tokens long, estimated_tokens long, truncated boolean",
    "ci_validation_results": "plan_id long, repository_id long, workflow_path string, start_line int, kind string, status string, duration_ms long, seq long",
    "manual_validation_results": "plan_id long, change_unit_id string, check_index int, status string, seq long",
    "context_runs": "id long, epic_type string, requested_budget int, truncated boolean, included_ids array<long>, omitted_ids array<long>, response_bytes long, estimated_tokens long",
    "context_feedback": "run_id long, outcome string, note_sha256 string, missing_service_ids array<long>",
    "context_query_executions": "run_id long, tool string, service_id long",
    "context_verifications": "run_id long, repository string, since_commit string, precision double, recall double, omission_rate double",
    "runtime_flow_observations": "service_id long, source string, from_symbol string, to_symbol string, kind string, observed_count long, first_seen timestamp, last_seen timestamp",
    "service_embeddings": "service_id long, model_name string, vector array<float>",
    "run_embeddings": "run_id long, model_name string, vector array<float>",
    "search_documents": "service_id long, kind string, ref string, snippet string, content_text string",
}


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
