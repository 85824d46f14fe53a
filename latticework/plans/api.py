"""The query API over a catalog: one function for each question, each answered by a DataFrame.

Services are named by name and, where that is not enough, by repository; a name that stands for no service or for several is an
error. Lists are pages: ordered rows with `total` and `truncated`, 50 by default and at most 500.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions import constants, text
from latticework.operators import graph, relational, retrieval
from latticework.plans import assess, detectors, follow_up, review, runtime_config, surface
from latticework.sources.catalog import Catalog
from latticework.streaming import counters

FLOW_EDGES, FLOW_EDGES_MOST = 50, 200


class Ambiguous(ValueError):
    """A name that stands for no service, or for several."""


class Api:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def _t(self, table: str) -> DataFrame:
        return self.catalog.read(table)

    def facts(self) -> detectors.Facts:
        return detectors.Facts(self.spark, {t: self._t(t) for t in ("repositories", "services", "apis", "service_calls", "persistence_entities", "static_persistence_facts", "entrypoints", "entrypoint_contracts", "flow_edges", "flow_boundaries", "static_error_contracts", "static_service_calls", "static_resilience_policies", "static_message_contracts", "static_cloud_facts", "cloud_iac_resources", "k8s_key_mismatches", "k8s_source_unknowns", "k8s_import_unknowns")})

    def service_id(self, name: str, repository: str | None = None) -> int:
        rows = self._t("services").filter(F.col("name") == name)
        if repository is not None:
            rows = rows.join(self._t("repositories").filter(F.col("name") == repository).select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
        found = rows.select("id").limit(2).collect()
        if len(found) != 1:
            raise Ambiguous(f"{name} stands for {'several services' if found else 'no service'}")
        return found[0]["id"]

    def _of(self, table: str, name: str, repository: str | None, key: str = "service_id") -> DataFrame:
        return self._t(table).filter(F.col(key) == self.service_id(name, repository))

    def _named(self, df: DataFrame) -> DataFrame:
        names = relational.display_names(self._t("services"), self._t("repositories"))
        return df.join(names.select(F.col("id").alias("service_id"), F.col("display").alias("service")), "service_id")

    # --- catalogue --------------------------------------------------------------------------------------------------

    def describe_indexing_capabilities(self) -> DataFrame:
        """(language, endings, facts): what extraction understands."""
        code = "entrypoints, calls, messages, errors, policies, persistence, configuration"
        return self.spark.createDataFrame([("jvm", "java kt", code), ("go", "go", code), ("node", "js ts", code), ("python", "py", "entrypoints, calls, configuration, cloud"), ("schemas", "proto graphql json", "entrypoints, operations"), ("migrations", "sql xml prisma", "operations, entities"), ("declarations", "tf yaml yml", "resources, bindings, imports, sources")], "language string, endings string, facts string")

    def list_repositories(self) -> DataFrame:
        return relational.with_count(self._t("repositories"), self._t("services"), "id", "repository_id", "services").orderBy("name")

    def list_services(self, repository: str | None = None) -> DataFrame:
        rows = self._t("services").join(self._t("repositories").select(F.col("id").alias("repository_id"), F.col("name").alias("repository")), "repository_id", "left")
        if repository is not None:
            rows = rows.filter(F.col("repository") == repository)
        return relational.with_count(rows, self._t("apis"), "id", "service_id", "apis").orderBy("repository", "name")

    def describe_ci_commands(self, repository: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
        one = self._t("repositories").filter(F.col("name") == repository).select(F.col("id").alias("repository_id"))
        return relational.page(self._t("ci_commands").join(one, "repository_id", "left_semi"), ["workflow_path", "start_line"], limit, offset)

    def list_apis(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        return relational.page(self._of("apis", service, repository).select("method", "path", "summary"), ["path", "method"], limit, offset)

    def walk(self, table: str, service: str, keys: list[str], limit: int = constants.PAGE_DEFAULT, token: str | None = None, repository: str | None = None) -> tuple[list, str | None]:
        """(rows, token): a service's rows of a table, page by page, for as long as the catalog stays the same; keys tell them apart."""
        asked = {"table": table, "service": service, "repository": repository}
        return follow_up.page(self._of(table, service, repository), keys, asked, follow_up.version_of(self.catalog, [table, "services", "repositories"]), limit, token)

    def describe_service(self, service: str, repository: str | None = None) -> DataFrame:
        """One row: the service with its first APIs, calls, callers and entities."""
        one = self._t("services").filter(F.col("id") == self.service_id(service, repository))
        return one.withColumnRenamed("id", "service_id").join(surface.context(one, self._t("apis"), self._t("service_calls"), self._t("persistence_entities")), "service_id")

    def describe_api(self, service: str, method: str, path: str, repository: str | None = None) -> DataFrame:
        api = self._of("apis", service, repository).filter((F.col("method") == method.upper()) & (F.col("path") == path))
        checks = self._t("api_validations").groupBy(F.col("api_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("kind", "description"))).alias("validations"))
        calls = self._t("service_calls").groupBy(F.col("from_api_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("to_service_name", "call_kind", "reason"))).alias("calls"))
        return api.join(checks, "id", "left").join(calls, "id", "left")

    # --- flows ------------------------------------------------------------------------------------------------------

    def list_entrypoints(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        return relational.page(self._of("entrypoints", service, repository), ["kind", "method", "name", "id"], limit, offset)

    def describe_entrypoint(self, service: str, kind: str, method: str, name: str, max_edges: int = FLOW_EDGES, repository: str | None = None) -> DataFrame:
        """The edges that an entrypoint reaches, in order, at most so many, with `truncated`."""
        entry = self._of("entrypoints", service, repository).filter((F.col("kind") == kind) & (F.col("method") == method.upper()) & (F.col("name") == name))
        most = min(max_edges, FLOW_EDGES_MOST)
        edges = graph.reachable_edges(self._t("flow_edges"), entry.select("service_id", F.col("symbol").alias("root")).distinct(), most + 1, by=["service_id"])
        more = edges.agg((F.count("*") > most).alias("truncated"))
        return edges.filter(F.col("position") <= most).join(F.broadcast(more)).orderBy("position")

    def _reached(self, service_id: int, symbol_of: DataFrame) -> DataFrame:
        e = graph.reachable_edges(self._t("flow_edges"), symbol_of, FLOW_EDGES_MOST, by=["service_id"])
        return symbol_of.select(F.col("root").alias("source")).unionByName(e.select(F.explode(F.array("from_symbol", "to_symbol")).alias("source"))).distinct()

    def describe_error_flow(self, service: str, kind: str, method: str, name: str, repository: str | None = None) -> DataFrame:
        """(target, error_type, transport_code, caller_source, mapped): errors of called endpoints, and whether the caller maps one of the same identity."""
        sid = self.service_id(service, repository)
        entry = self._t("entrypoints").filter((F.col("service_id") == sid) & (F.col("kind") == kind) & (F.col("method") == method.upper()) & (F.col("name") == name))
        sources = self._reached(sid, entry.select("service_id", F.col("symbol").alias("root")).distinct())
        calls = self._t("static_service_calls").filter(F.col("service_id") == sid).join(sources, "source", "left_semi")
        targets = relational.unambiguous(self._t("services").select(F.col("id").alias("to"), F.col("name").alias("target_service")), "target_service")
        errors = self._t("static_error_contracts").select(F.col("service_id").alias("to"), "internal_type", "public_code", "transport_code")
        met = calls.join(targets, "target_service").join(errors, "to").withColumn("met", F.xxhash64("source", "target_service", "target_method", "target_path", "internal_type", "public_code", "transport_code"))
        own = self._t("static_error_contracts").filter((F.col("service_id") == sid) & (F.col("role") == "maps")).withColumn("own", F.xxhash64("source", "internal_type", "public_code", "transport_code"))
        same = relational.same_identity(met, own, "internal_type", "public_code", "met", "own").select("met").distinct().withColumn("mapped", F.lit(True))
        return met.join(same, "met", "left").select(F.col("target_service").alias("target"), F.col("internal_type").alias("error_type"), "transport_code", F.col("source").alias("caller_source"), F.coalesce("mapped", F.lit(False)).alias("mapped"))

    def ingest_runtime_evidence(self, service: str, source: str, observations: list[str], repository: str | None = None) -> DataFrame:
        """(accepted, rejected); accepted observations are added to the counters."""
        sid = self.service_id(service, repository)
        rows = self.spark.createDataFrame([(sid, source, o) for o in observations], "service_id long, source string, observation string").withColumn("ts", F.current_timestamp())
        now = self._t("runtime_flow_observations")
        self.catalog.overwrite("runtime_flow_observations", counters.added(now, counters.merged(counters.parsed(rows))))
        return counters.accepted(rows)

    def describe_runtime_divergence(self, service: str, repository: str | None = None) -> DataFrame:
        keys = ["from_symbol", "to_symbol", "kind"]
        return graph.divergence(self._of("flow_edges", service, repository), self._of("runtime_flow_observations", service, repository).withColumnRenamed("observed_count", "count"), keys)

    def list_security_findings(self, service: str, repository: str | None = None) -> DataFrame:
        return relational.by_severity(self._of("security_findings", service, repository), "file_path", "line")

    # --- data and configuration -------------------------------------------------------------------------------------

    def describe_persistence(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        sid = self.service_id(service, repository)
        mine = lambda t: self._t(t).filter(F.col("service_id") == sid)
        rows = mine("persistence_entities").select(F.lit("entity").alias("kind"), "name", F.col("engine").alias("about"))
        rows = rows.unionByName(mine("static_persistence_facts").select(F.lit("declaration").alias("kind"), "name", F.col("owner").alias("about")))
        rows = rows.unionByName(mine("static_migration_facts").select(F.lit("migration").alias("kind"), F.col("table_name").alias("name"), F.col("operation").alias("about")))
        return relational.page(rows, ["kind", "name", "about"], limit, offset)

    def describe_configuration(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        rows = runtime_config.configuration_with_sources(self._of("static_configuration_bindings", service, repository), self._t("k8s_bindings"))
        return relational.page(rows.withColumnRenamed("total", "source_total"), ["config_key", "source"], limit, offset)

    def describe_runtime_configuration(self, service: str, surface_name: str = "bindings", repository: str | None = None, limit: int = constants.PAGE_DEFAULT, offset: int = 0, **filters) -> DataFrame:
        """Bindings or imports of a service by any of the filters of `runtime_config.conditions`."""
        if surface_name == "bindings":
            rows = runtime_config.binding_status(self._of("k8s_bindings", service, repository), self._t("k8s_key_mismatches"), self._t("k8s_source_unknowns"))
        else:
            rows = runtime_config.import_status(self._of("k8s_imports", service, repository), self._t("k8s_import_unknowns"))
        return relational.page(runtime_config.filtered(rows, runtime_config.conditions(**filters)), ["source_kind", "source_name", "workload_name"], limit, offset)

    def describe_feature_flags(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        return relational.page(self._of("static_feature_flags", service, repository), ["provider", "flag_key", "source"], limit, offset)

    def describe_messages(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        sid = self.service_id(service, repository)
        rows = self._t("messages").filter(F.col("service_id") == sid).select("direction", "channel", F.col("description").alias("about"))
        rows = rows.unionByName(self._t("static_message_contracts").filter(F.col("service_id") == sid).select("direction", "channel", F.col("payload_type").alias("about")))
        return relational.page(rows.distinct(), ["channel", "direction", "about"], limit, offset)

    def describe_cloud_dependencies(self, service: str, limit: int = constants.PAGE_DEFAULT, offset: int = 0, repository: str | None = None) -> DataFrame:
        sid = self.service_id(service, repository)
        rows = self._t("static_cloud_facts").filter(F.col("service_id") == sid).select(F.lit("code").alias("side"), "provider", "resource_type", F.col("target_name").alias("name"))
        rows = rows.unionByName(self._t("cloud_iac_resources").filter(F.col("service_id") == sid).select(F.lit("declared").alias("side"), "provider", "resource_type", F.coalesce("physical_name", "logical_name").alias("name")))
        return relational.page(rows, ["side", "provider", "resource_type", "name"], limit, offset)

    # --- search and graphs ------------------------------------------------------------------------------------------

    def search(self, query: str, repository: str | None = None, limit: int = 20) -> DataFrame:
        docs = self._t("search_documents")
        if repository is not None:
            mine = self._t("services").join(self._t("repositories").filter(F.col("name") == repository).select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
            docs = docs.join(mine.select(F.col("id").alias("service_id")), "service_id", "left_semi")
        docs = self._named(docs).withColumn("doc", F.xxhash64("service_id", "kind", "ref", "content_text"))
        hits = retrieval.bm25(docs, self.spark.createDataFrame([(0, query)], "query_id int, query string"), "doc", "content_text", limit=limit)
        return hits.join(docs, "doc").select("rank", "score", "service", "kind", "ref", "snippet").orderBy("rank")

    def edges(self) -> DataFrame:
        return graph.relationship_edges(self._t("service_calls"), relational.channel_links(self._t("messages")), self._t("services"))

    def get_relationships(self, service: str, direction: str = "both", repository: str | None = None) -> DataFrame:
        self.service_id(service, repository)
        return graph.relationships(self.edges(), service, direction)

    def trace_flow(self, from_service: str, to_service: str, max_hops: int = 6) -> DataFrame:
        self.service_id(from_service), self.service_id(to_service)
        return graph.shortest_path(self.edges(), from_service, to_service, max_hops, label="via")

    # --- architecture -----------------------------------------------------------------------------------------------

    def recompute_architecture(self) -> int:
        """Runs all detectors and appends a run with its findings; the run's id."""
        last = self._t("architecture_runs").agg(F.max("id")).collect()[0][0] or 0
        found = detectors.all_findings(self.facts()).withColumn("run_id", F.lit(last + 1).cast("long"))
        self.catalog.append("architecture_findings", found)
        n = self._t("services").count()
        self.catalog.append("architecture_runs", self.spark.createDataFrame([(last + 1, n)], "id long, services_indexed long").withColumn("created_at", F.current_timestamp()))
        return last + 1

    def find_architecture_smells(self) -> DataFrame:
        """The findings of the latest run, in order."""
        last = self._t("architecture_runs").agg(F.max("id").alias("run_id"))
        return detectors.to_page(self._t("architecture_findings").join(F.broadcast(last), "run_id"))

    def architecture_trend(self) -> DataFrame:
        """What is new, resolved or changed between the last two runs."""
        runs = [r["id"] for r in self._t("architecture_runs").select("id").orderBy(F.desc("id")).limit(2).collect()]
        of = lambda i: self._t("architecture_findings").filter(F.col("run_id") == (runs[i] if i < len(runs) else -1))
        return detectors.diff(of(1), of(0))

    # --- changes ----------------------------------------------------------------------------------------------------

    def find_change_surface(self, task: str, synthesizer: surface.Synthesizer = surface.by_rank) -> DataFrame:
        docs = self._named(self._t("search_documents")).select("service", "content_text")
        ask = self.spark.createDataFrame([(0, task)], "query_id int, query string").select("query_id", F.array_join(text.keywords(F.col("query")), " ").alias("query"))
        return surface.analyse(docs, ask, self.edges().select("source", "target").distinct(), self._t("services"), self._t("change_surface_feedback"), synthesizer)

    def get_change_context(self, task: str, max_services: int = 3) -> DataFrame:
        """Cards of the first services of a task's surface, at most five, with what they offer and call."""
        if not 1 <= max_services <= 5:
            raise ValueError("max_services goes from 1 to 5")
        judged = self.find_change_surface(task).orderBy(F.desc("confidence"), "service").limit(max_services)
        ids = self._t("services").join(judged, F.col("name") == F.col("service")).select("id", "service", "role", "confidence")
        return ids.join(surface.context(ids, self._t("apis"), self._t("service_calls"), self._t("persistence_entities")), F.col("id") == F.col("service_id")).drop("id")

    def plan_change(self, task: str) -> tuple[DataFrame, DataFrame]:
        """(units, decisions) for the primary services of a task's surface."""
        primary = self.find_change_surface(task).filter("role = 'primary'").select("service")
        units = review.units_from_findings(self.find_architecture_smells(), primary)
        return units, review.decision_points(surface.contracts_at_risk(self._named(self._t("messages")), primary), primary)

    def refine_change_plan(self, decisions: DataFrame, selections: DataFrame) -> DataFrame:
        wrong = review.checked_selections(decisions, selections).collect()
        if wrong:
            raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in wrong))
        return review.units_from_decisions(decisions, selections)

    def describe_change_unit(self, units: DataFrame, unit_id: str) -> DataFrame:
        return units.filter(F.col("id") == unit_id)

    def assess_working_change(self, units: DataFrame, changed: DataFrame) -> DataFrame:
        return assess.assessed_units(units, changed, self._t("services"))

    def record_ci_validation_result(self, plan_id: int, repository_id: int, workflow_path: str, start_line: int, status: str, duration_ms: int | None = None) -> None:
        if status not in ("passed", "failed") or start_line < 1 or (duration_ms is not None and not 0 <= duration_ms <= 86_400_000):
            raise ValueError("status is passed or failed, lines start at 1, a run takes at most a day")
        command = self._t("ci_commands").filter((F.col("repository_id") == repository_id) & (F.col("workflow_path") == workflow_path) & (F.col("start_line") == start_line) & F.col("kind").isin("test", "build")).select("kind").limit(1).collect()
        if not command:
            raise ValueError("no indexed test or build command is there")
        row = self.spark.createDataFrame([(plan_id, repository_id, workflow_path, start_line, command[0]["kind"], status, duration_ms)], "plan_id long, repository_id long, workflow_path string, start_line int, kind string, status string, duration_ms long")
        self.catalog.upsert("ci_validation_results", row, ["plan_id", "repository_id", "workflow_path", "start_line"])

    def record_change_unit_validation_result(self, plan_id: int, units: DataFrame, unit_id: str, check_index: int, status: str) -> None:
        there = units.filter((F.col("id") == unit_id) & (F.size("validation") > check_index))
        if status not in ("passed", "failed") or check_index < 0 or there.isEmpty():
            raise ValueError("status is passed or failed, for a check that the unit has")
        row = self.spark.createDataFrame([(plan_id, unit_id, check_index, status)], "plan_id long, change_unit_id string, check_index int, status string")
        self.catalog.upsert("manual_validation_results", row, ["plan_id", "change_unit_id", "check_index"])

    def describe_change_plan_validation_status(self, plan_id: int, units: DataFrame, limit: int = constants.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
        results = self._t("manual_validation_results").filter(F.col("plan_id") == plan_id)
        return relational.page(assess.manual_roll_up(assess.manual_states(units, results)), ["id"], limit, offset)

    def describe_change_validation_status(self, plan_id: int) -> DataFrame:
        results = self._t("ci_validation_results").filter(F.col("plan_id") == plan_id).select("repository_id", "workflow_path", "start_line", "status", F.coalesce("seq", F.lit(0)).alias("seq"))
        return relational.status_roll_up(assess.ci_states(assess.ci_commands_to_run(self._t("ci_commands")), results), ["repository_id"])

    def review_change_closure(self, plan_id: int, units: DataFrame, changed: DataFrame) -> DataFrame:
        manual = assess.manual_states(units, self._t("manual_validation_results").filter(F.col("plan_id") == plan_id))
        return assess.closure(self.assess_working_change(units, changed), manual)

    # --- feedback and telemetry -------------------------------------------------------------------------------------

    def record_change_surface_feedback(self, run_id: int, service: str, outcome: str) -> None:
        known = not self._t("change_surface_findings").filter((F.col("run_id") == run_id) & (F.col("service") == service)).isEmpty()
        if outcome not in ("confirmed", "rejected") or not known:
            raise ValueError("outcome is confirmed or rejected, for a service that the run found")
        self.catalog.append("change_surface_feedback", self.spark.createDataFrame([(run_id, service, outcome)], "run_id long, service string, outcome string"))

    def record_change_context_feedback(self, run_id: int, outcome: str, note: str | None = None, missing: list[int] = ()) -> None:
        if outcome not in ("sufficient", "insufficient", "excessive"):
            raise ValueError("outcome is sufficient, insufficient or excessive")
        row = self.spark.createDataFrame([(run_id, outcome, note, list(missing))], "run_id long, outcome string, note string, missing_service_ids array<long>")
        self.catalog.append("context_feedback", row.withColumn("note_sha256", F.sha2("note", 256)).drop("note"))

    def record_context_query_execution(self, run_id: int, tool: str, service: str | None = None) -> None:
        sid = self.service_id(service) if service else None
        self.catalog.append("context_query_executions", self.spark.createDataFrame([(run_id, tool, sid)], "run_id long, tool string, service_id long"))

    def get_context_budget_metrics(self, epic_type: str | None = None) -> dict[str, DataFrame]:
        runs = self._t("context_runs")
        if epic_type is not None:
            runs = runs.filter(F.col("epic_type") == epic_type)
        mine = lambda t: self._t(t).join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
        return {"totals": assess.budget_totals(runs), "budgets": assess.by_budget(runs), "outcomes": assess.outcomes_by_epic(runs, mine("context_feedback")), "missing": assess.missing_services(mine("context_feedback")), "executions": mine("context_query_executions").groupBy("tool").agg(F.count("*").alias("n")).orderBy("tool"), "verification": assess.verification_means(mine("context_verifications"))}

    def verify_change_surface(self, run_id: int, changed: DataFrame) -> DataFrame:
        predicted = self._t("change_surface_findings").filter((F.col("run_id") == run_id) & (F.col("role") == "primary"))
        return assess.verified(predicted, assess.changed_services(changed, self._t("services")))

    def verify_context_budget(self, run_id: int, changed: DataFrame) -> DataFrame:
        ids = self._t("context_runs").filter(F.col("id") == run_id).select(F.explode("included_ids").alias("id"))
        predicted = self._t("services").join(ids, "id").select(F.col("name").alias("service"))
        return assess.verified(predicted, assess.changed_services(changed, self._t("services")))
