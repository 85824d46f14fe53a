"""From a folder to a filled catalog: discovery, extraction, synthesis of descriptions, runs and locks.

A run reads the tree once, finds its services, and compares a digest of each service's files with the one of its last
snapshot. Services whose digest has not changed keep their facts; the facts of all others are extracted in one job and
replace the old ones. Descriptions come from a backend, a function of a prompt that gives a dict or None; units (endpoints,
components, entities, messages, overviews) are rows, so they are synthesised by many workers at once, and only for units
whose files changed. A run that dies leaves the old versions of all tables, and its run is closed as failed by the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import schemas
from latticework.functions import text
from latticework.operators import relational
from latticework.plans import detectors
from latticework.sources import catalog as catalogs
from latticework.sources import extract, openapi, queues, receivers, scanning, stacks
from latticework.sources.folders import checkpointed, workers_find_us

ANALYSIS_VERSION = "2"
MOST_EXCERPT, TREE_DEPTH, TREE_LINES, ATTEMPTS = 20_000, 2, 200, 2
Backend = Callable[[str, str], dict | None]

#: Facts of the extractor by catalog table: the fact's kind, and columns whose names differ.
TABLES_OF_FACTS: dict[str, tuple[str, dict[str, str]]] = {
    "entrypoints": ("entrypoint", {"kind": "transport"}),
    "flow_edges": ("flow_edge", {"kind": "edge_kind"}),
    "flow_boundaries": ("boundary", {"kind": "boundary"}),
    "static_resilience_policies": ("policy", {"kind": "policy"}),
    "static_error_contracts": ("error_contract", {}),
    "static_service_calls": ("service_call", {}),
    "static_message_contracts": ("message_contract", {}),
    "static_persistence_facts": ("persistence", {"kind": "entity_kind"}),
    "static_migration_facts": ("migration", {}),
    "static_configuration_bindings": ("configuration", {"kind": "key_kind"}),
    "static_feature_flags": ("feature_flag", {}),
    "static_cloud_facts": ("cloud_fact", {}),
    "cloud_iac_resources": ("iac_resource", {}),
    "k8s_bindings": ("k8s_binding", {}),
    "k8s_imports": ("k8s_import", {}),
}
BUCKETS = ("primary", "dependency", "contract", "persistence", "unknown")


# --- runs and locks -------------------------------------------------------------------------------------------------


class Locked(RuntimeError):
    """Another run holds the service."""


class Lock:
    """One writer for each key: a file that only one can create, in the catalog's folder."""

    def __init__(self, catalog: catalogs.Catalog, key: str):
        spark = catalog.spark
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{catalog.root}/locks/{key}")
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.key = key

    def acquire(self, steal: bool = False) -> None:
        """Fails while another holds it; `steal` takes over what a dead run left."""
        if steal:
            self.release()
        try:
            self.system.create(self.path, False).close()
        except Exception as e:
            raise Locked(self.key) from e

    def release(self) -> None:
        self.system.delete(self.path, False)

    def __enter__(self) -> Lock:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _next_id(catalog: catalogs.Catalog, table: str) -> int:
    return (catalog.read(table).agg(F.max("id")).collect()[0][0] or 0) + 1


def _append_one(catalog: catalogs.Catalog, table: str, **values) -> None:
    """One row; what is not given is null."""
    schema = schemas.struct(table)
    row = catalog.spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)
    if "started_at" in schema.names:
        row = row.withColumn("started_at", F.current_timestamp())
    if "created_at" in schema.names:
        row = row.withColumn("created_at", F.current_timestamp())
    catalog.append(table, row)


def _set(catalog: catalogs.Catalog, table: str, where: Column, **values: Column) -> None:
    rows = catalog.read(table)
    for name, value in values.items():
        rows = rows.withColumn(name, F.when(where, value).otherwise(F.col(name)))
    catalog.overwrite(table, rows)


def start_index_run(catalog: catalogs.Catalog, service_id: int) -> int:
    run = _next_id(catalog, "index_runs")
    _append_one(catalog, "index_runs", id=run, service_id=service_id, status="partial")
    return run


def finish_index_run(catalog: catalogs.Catalog, run: int, status: str, files_changed: int, usage: Usage) -> None:
    of = {k: F.lit(v) for k, v in {"status": status, "files_changed": files_changed, "llm_calls": usage.calls, "input_tokens": usage.input_tokens, "output_tokens": usage.output_tokens, "cost_usd": usage.cost_usd}.items()}
    _set(catalog, "index_runs", F.col("id") == run, finished_at=F.current_timestamp(), **of)


def recover_unfinished_runs(catalog: catalogs.Catalog, service_id: int) -> int:
    """Runs of a service that never ended count as failed; how many there were."""
    open_ = (F.col("service_id") == service_id) & F.col("finished_at").isNull()
    n = catalog.read("index_runs").filter(open_).count()
    if n:
        _set(catalog, "index_runs", open_, status=F.lit("failed"), finished_at=F.current_timestamp())
    return n


@dataclass
class Usage:
    """What a backend used up; None: not told. The sum of nothing told is None."""

    calls: int = 0
    input_tokens: int | None = None
    output_tokens: int | None = None
    cost_usd: float | None = None

    def __add__(self, other: Usage) -> Usage:
        both = lambda a, b: a if b is None else b if a is None else a + b
        return Usage(self.calls + other.calls, both(self.input_tokens, other.input_tokens), both(self.output_tokens, other.output_tokens), both(self.cost_usd, other.cost_usd))


# --- what runs of change surfaces, plans and contexts leave ---------------------------------------------------------


def record_change_surface_run(catalog: catalogs.Catalog, task: str, backend: str, result: DataFrame) -> int:
    """A run and its findings: result has service, role (one of BUCKETS), confidence and reason."""
    run = _next_id(catalog, "change_surface_runs")
    _append_one(catalog, "change_surface_runs", id=run, task_text=task, backend=backend)
    catalog.append("change_surface_findings", result.filter(F.col("role").isin(*BUCKETS)).withColumn("run_id", F.lit(run)))
    return run


def record_plan(catalog: catalogs.Catalog, surface_run: int, requested_tokens: int, open_decisions: int = 0) -> int:
    """A plan, a draft while decisions are open."""
    plan = _next_id(catalog, "change_plans")
    _append_one(catalog, "change_plans", id=plan, change_surface_run_id=surface_run, status="draft" if open_decisions else "ready", requested_tokens=requested_tokens)
    return plan


def finalize_decisions(catalog: catalogs.Catalog, plan: int) -> None:
    _set(catalog, "change_plans", F.col("id") == plan, status=F.lit("ready"))


def update_measurements(catalog: catalogs.Catalog, plan: int, estimated_tokens: int, truncated: bool) -> None:
    _set(catalog, "change_plans", F.col("id") == plan, estimated_tokens=F.lit(estimated_tokens), truncated=F.lit(truncated))


def record_context_run(catalog: catalogs.Catalog, **metadata) -> int:
    run = _next_id(catalog, "context_runs")
    _append_one(catalog, "context_runs", id=run, **metadata)
    return run


def update_response_measurements(catalog: catalogs.Catalog, run: int, response_bytes: int, estimated_tokens: int) -> None:
    _set(catalog, "context_runs", F.col("id") == run, response_bytes=F.lit(response_bytes), estimated_tokens=F.lit(estimated_tokens))


def record_context_verification(catalog: catalogs.Catalog, run: int, repository: str, since_commit: str, precision: float | None, recall: float | None, omission_rate: float | None) -> None:
    _append_one(catalog, "context_verifications", run_id=run, repository=repository, since_commit=since_commit, precision=precision, recall=recall, omission_rate=omission_rate)


def record_surface_verification(catalog: catalogs.Catalog, run: int, repository: str, since_commit: str, predicted: DataFrame, actual: DataFrame) -> int:
    """Predicted against actual services, by name, with the three lists and both ratios (null over nothing)."""
    both = predicted.select("service", F.lit(True).alias("p")).distinct().join(actual.select("service", F.lit(True).alias("a")).distinct(), "service", "full")
    of = lambda keep: F.sort_array(F.collect_list(F.when(keep, F.col("service"))))
    p, a = F.coalesce("p", F.lit(False)), F.coalesce("a", F.lit(False))
    lists = both.agg(of(p & a).alias("true_positives"), of(p & ~a).alias("false_positives"), of(a & ~p).alias("false_negatives"))
    tp, fp, fn = (F.size(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives"))
    verification = _next_id(catalog, "change_surface_verifications")
    row = lists.select("*", F.lit(verification).alias("id"), F.lit(run).alias("run_id"), F.lit(repository).alias("repository"), F.lit(since_commit).alias("since_commit"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
    catalog.append("change_surface_verifications", row)
    return verification


def measured(response: dict, rounds: int = 3) -> dict:
    """The response with its own estimated tokens in it: told again until the count no longer changes."""
    tokens = None
    for _ in range(rounds):
        response = {**response, "estimated_tokens": tokens}
        now = -(-len(json.dumps(response, separators=(",", ":")).encode()) // 4)
        if now == tokens:
            break
        tokens = now
    return {**response, "estimated_tokens": tokens}


def page_fingerprint(payload: Column) -> Column:
    """What tells one page of canonical JSON from another."""
    return text.fingerprint(payload)


# --- hints for a change surface -------------------------------------------------------------------------------------


def dependency_hints(calls: DataFrame, services: DataFrame, relevant: DataFrame, kind: str) -> DataFrame:
    """Outbound calls of one target kind from the relevant services, by name: (service, target, call_kind, reason)."""
    names = services.join(relevant.select(F.col("service").alias("name")).distinct(), "name", "left_semi").select(F.col("id").alias("from_service_id"), F.col("name").alias("service"))
    return calls.filter(F.col("target_kind") == kind).join(names, "from_service_id").select("service", F.col("to_service_name").alias("target"), "call_kind", "reason").distinct()


def cloud_hints(facts: DataFrame, services: DataFrame, relevant: DataFrame) -> DataFrame:
    """Cloud resources that the code of the relevant services uses, proven: confidence 1."""
    names = services.join(relevant.select(F.col("service").alias("name")).distinct(), "name", "left_semi").select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    rows = facts.join(names, "service_id")
    return rows.select("service", "provider", "resource_type", F.coalesce("target_name", "service_name").alias("target"), "operation", F.lit(1.0).alias("confidence"), "evidence")


def persistence_for(entities: DataFrame, services: DataFrame, relevant: DataFrame) -> DataFrame:
    names = services.join(relevant.select(F.col("service").alias("name")).distinct(), "name", "left_semi").select(F.col("id").alias("service_id"), F.col("name").alias("service"))
    return entities.join(names, "service_id").select("service", "name", "kind", "engine")


def unknowns_from_unmapped(hints: DataFrame) -> DataFrame:
    """What remains unknown, restated: internal targets that no indexed service stands for."""
    return hints.select("service", F.col("target").alias("subject"), F.concat("target", F.lit(" is called, but no indexed service has this name.")).alias("reason"))


# --- synthesis ------------------------------------------------------------------------------------------------------


def joined_excerpts(excerpts: DataFrame, keys: list[str], most: int = MOST_EXCERPT) -> DataFrame:
    """(keys, excerpt): (path, start_line, excerpt) rows of each key, in order, under headers, cut at so many characters."""
    head = F.concat(F.lit("--- "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("\n"), "excerpt")
    lists = excerpts.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("path", "start_line", head.alias("text")))).alias("_l"))
    return lists.select(*keys, F.substring(F.array_join(F.transform("_l", lambda x: x["text"]), "\n\n"), 1, most).alias("excerpt"))


def folder_tree(files: DataFrame, depth: int = TREE_DEPTH, most: int = TREE_LINES) -> DataFrame:
    """(path): folders and files of at most so many levels, the first so many in order."""
    parts = F.split("path", "/")
    cut = F.array_join(F.slice(parts, 1, depth + 1), "/")
    return files.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth + 1))), lambda n: F.array_join(F.slice(F.split(cut, "/"), 1, n), "/"))).alias("path")).distinct().orderBy("path").limit(most)


def synthesised(units: DataFrame, backend: Backend, attempts: int = ATTEMPTS) -> DataFrame:
    """(unit, key, result JSON, calls, input_tokens, output_tokens, cost_usd) of (unit, key, prompt) rows; result is null where every attempt failed.

    The backend runs where the rows are; it gets the prompt and the kind of unit, and gives a dict, which may hold `usage`.
    """
    workers_find_us(units.sparkSession)
    schema = "unit string, key string, result string, calls long, input_tokens long, output_tokens long, cost_usd double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for unit, key, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, calls = None, 0
                while found is None and calls < attempts:
                    calls += 1
                    try:
                        found = backend(prompt, unit)
                    except Exception:
                        found = None  # told as a failed unit
                usage = (found or {}).pop("usage", None) or {}
                out.append((unit, key, None if found is None else json.dumps(found), calls, usage.get("input_tokens"), usage.get("output_tokens"), usage.get("cost_usd")))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.string()] * 3 + [pa.int64()] * 3 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["unit", "key", "result", "calls", "input_tokens", "output_tokens", "cost_usd"])

    return checkpointed(units.select("unit", "key", "prompt").mapInArrow(run, schema))


def used(results: DataFrame) -> Usage:
    r = results.agg(F.sum("calls"), F.sum("input_tokens"), F.sum("output_tokens"), F.sum("cost_usd")).collect()[0]
    return Usage(r[0] or 0, r[1], r[2], r[3])


# --- a run ----------------------------------------------------------------------------------------------------------


def _with_owner(files: DataFrame, services: DataFrame) -> DataFrame:
    """Files with the service whose root is the longest that holds them; a root of '' holds all."""
    deep = relational.owner_by_prefix(files, services.filter("root_path <> ''").select("root_path", F.col("id").alias("name"))).withColumnRenamed("owner", "service_id").drop("roots")
    whole = services.filter("root_path = ''").agg(F.min("id").alias("_whole"))
    return deep.join(F.broadcast(whole)).withColumn("service_id", F.coalesce("service_id", "_whole").cast("long")).drop("_whole")


def fact_rows(facts: DataFrame, table: str, *also: str) -> DataFrame:
    """The facts of one catalog table, fields as columns, with service and evidence; `also` are fields beyond the table's."""
    kind, names = TABLES_OF_FACTS[table]
    fields = [f for f in schemas.struct(table).names if f not in ("id", "service_id", "repository_id", "evidence", "attributes")]
    evidence = F.struct(F.col("path").alias("file"), "start_line", "end_line").alias("evidence")
    rows = facts.filter(F.col("kind") == kind)
    cols = [F.nullif(F.col("fields")[names.get(f, f)], F.lit("")).alias(f) for f in [*fields, *also]]
    out = rows.select("service_id", "repository_id", *cols, evidence)
    return out.withColumn("id", F.xxhash64("service_id", F.to_json(F.struct(*fields, "evidence")))) if "id" in schemas.struct(table).names else out


def index_path(spark: SparkSession, catalog: catalogs.Catalog, root: str, repository: str, backend: Backend | None = None, force: bool = False) -> DataFrame:
    """Index a tree as a repository: (service_id, service, state, units, failed) of every service, state being new, changed or reused."""
    files = checkpointed(scanning.files(spark, root))
    repo = _repository(catalog, repository, root)
    found = stacks.discovered(files).select(F.col("root").alias("root_path"), "stack", "name", F.lit(repo).cast("long").alias("repository_id"))
    with Lock(catalog, f"repository-{repo}"):
        known = catalog.read("services").filter(F.col("repository_id") == repo)
        top = catalog.read("services").agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
        old = known.select(F.col("root_path"), F.col("id").alias("_id"))
        fresh = relational.numbered(found.join(old, "root_path", "left_anti"), ["root_path"], "_n")
        new = fresh.join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n")).drop("_top", "_n")
        kept = found.join(old, "root_path").withColumn("id", F.col("_id")).drop("_id")
        services = checkpointed(kept.unionByName(new).select("id", "repository_id", "name", "root_path", "stack"))
        gone = checkpointed(known.join(services, "id", "left_anti").select("id"))
        if not gone.isEmpty():
            catalog.delete_services(gone)
        described = catalog.read("services").select("id", "short_desc", "long_desc", "source_commit")
        catalog.upsert("services", services.join(described, "id", "left").withColumn("indexed_at", F.current_timestamp()), ["id"])

        owned = checkpointed(_with_owner(files, services).filter("service_id IS NOT NULL"))
        digests = checkpointed(scanning.digest(owned, ANALYSIS_VERSION, "service_id"))
        before = catalog.read("static_analysis_snapshots").filter(F.col("analysis_version") == ANALYSIS_VERSION).select("service_id", F.col("input_digest").alias("_old"))
        state = F.when(F.lit(force), "changed").when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("digest"), "reused").otherwise("changed")
        states = checkpointed(services.select(F.col("id").alias("service_id"), F.col("name").alias("service")).join(digests, "service_id", "left").join(before, "service_id", "left").select("service_id", "service", "digest", state.alias("state")))
        stale = states.filter("state <> 'reused'").select("service_id")
        hashes = owned.select("service_id", F.col("path").alias("file_path"), F.sha2("text", 256).alias("content_hash"), F.lit("source").alias("category"))
        changes = checkpointed(_changes(catalog.read("indexed_files").join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi"), hashes))

        facts = checkpointed(extract.extract(owned.join(stale, "service_id", "left_semi")).join(owned.select("path", "service_id"), "path").withColumn("repository_id", F.lit(repo).cast("long")))
        said = receivers.declared(owned.join(stale, "service_id", "left_semi")).join(owned.select("path", "service_id"), "path")
        said = checkpointed(said.withColumn("repository_id", F.lit(repo).cast("long")))
        contracts = checkpointed(_contracts(facts, said))
        owned_before = catalog.read("entrypoints").join(stale, "service_id", "left_semi").select(F.col("id").alias("entrypoint_id"))
        catalog.replace("entrypoint_contracts", owned_before.unionByName(contracts.select("entrypoint_id")), contracts, "entrypoint_id")
        for table in TABLES_OF_FACTS:
            catalog.replace(table, stale, _by_receivers(fact_rows(facts, table), table, facts, said))
        catalog.replace("ci_commands", services.select("repository_id").distinct(), scanning.workflow_commands(files).select(F.lit(repo).cast("long").alias("repository_id"), F.col("path").alias("workflow_path"), "kind", "command", F.col("line").alias("start_line")), "repository_id")
        # What was read counts as a snapshot only if it is still what lies there.
        now = scanning.digest(_with_owner(scanning.files(spark, root), services).filter("service_id IS NOT NULL"), ANALYSIS_VERSION, "service_id")
        same = states.join(now, ["service_id", "digest"], "left_semi")
        catalog.replace("static_analysis_snapshots", states, same.select("service_id", F.col("digest").alias("input_digest"), F.lit(ANALYSIS_VERSION).alias("analysis_version")))

        done = _described(catalog, services, owned, changes, backend, force)
        failed = done.filter("result IS NULL").select("service_id").distinct()
        # Files of services with a failed unit stay unindexed, so the next run tries again.
        catalog.replace("indexed_files", states.join(failed, "service_id", "left_anti"), hashes.join(failed, "service_id", "left_anti"))
        _reconcile(catalog)
        run = detectors.all_findings(detectors.Facts(spark, {t: catalog.read(t) for t in schemas.TABLES if catalog.current(t) is not None}))
        number = _next_id(catalog, "architecture_runs")
        _append_one(catalog, "architecture_runs", id=number, services_indexed=catalog.read("services").count())
        catalog.append("architecture_findings", run.withColumn("run_id", F.lit(number)))
        catalog.overwrite("search_documents", catalogs.search_documents(*(catalog.read(t) for t in ("services", "apis", "persistence_entities", "messages", "service_calls"))))
        _close_runs(catalog, states, changes, done)
    units = done.groupBy("service_id").agg(F.count("*").alias("units"), F.count_if(F.col("result").isNull()).alias("failed"))
    return states.join(units, "service_id", "left").select("service_id", "service", "state", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("failed", F.lit(0)).alias("failed"))


def _joined_objects(objects: str | Column, *more: Column) -> Column:
    """JSON objects, an array of them or several columns, as one; nulls and empty ones add nothing."""
    every = F.array(objects, *more) if more else F.col(objects)
    inner = F.filter(F.transform(every, lambda o: F.regexp_extract(o, r"(?s)^\{(.*)\}$", 1)), lambda o: o.isNotNull() & (o != ""))
    return F.when(F.size(inner) > 0, F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}")))


def _contracts(facts: DataFrame, declarations: DataFrame) -> DataFrame:
    """(entrypoint_id, contract): what code says of an entrypoint, with the nested fields of its body, its formal contract and its queue."""
    kinds = extract.kinds_of(facts)
    entries = fact_rows(facts, "entrypoints", "contract").select("id", "service_id", "kind", "method", "name", "contract").distinct()
    whole = entries.filter("contract IS NOT NULL").select("id", "service_id", F.col("contract").alias("said"))
    if not declarations.filter("kind = 'shape'").isEmpty():
        asked = whole.withColumn("_type", F.get_json_object("said", "$.request.type"))
        shaped = receivers.with_nested_shapes(asked, declarations, "_type", ["service_id"])
        fields = F.when(F.col("shape").isNotNull(), F.concat(F.lit('{"request_fields":'), "shape", F.lit("}")))
        whole = shaped.select("id", _joined_objects(F.col("said"), fields).alias("said"))
    whole = whole.select("id", "said")
    if "openapi" in kinds:
        files = facts.filter("kind = 'openapi'").select("path", "service_id").distinct()
        declared = openapi.contracts(facts).join(files, "path")
        formal = openapi.declared_for(entries.filter("kind = 'http'").drop("contract"), declared, ["service_id"])
        whole = whole.unionByName(formal.select("id", F.concat(F.lit('{"formal_contract":'), "formal", F.lit("}")).alias("said")))
    if "message_contract" in kinds:
        field = lambda name: F.col("fields")[name]
        consumed = facts.filter((F.col("kind") == "message_contract") & (field("direction") == "consumes") & (field("transport") == "rabbitmq"))
        channels = consumed.select("service_id", field("channel").alias("channel")).distinct()
        consumers = entries.filter("kind = 'message' AND method = 'CONSUME'").select("id", "service_id", F.col("name").alias("channel")).join(channels, ["service_id", "channel"], "left_semi")
        told = queues.consumer_contracts(consumers, queues.queue_contracts(facts, ["service_id"]), ["service_id"])
        whole = whole.unionByName(told.select("id", F.col("contract").alias("said")))
    # What one entrypoint is told: at most one object of each sort.
    whole = whole.groupBy("id").agg(F.sort_array(F.collect_list("said")).alias("all")).withColumn("contract", _joined_objects("all"))
    return whole.select(F.col("id").alias("entrypoint_id"), "contract").filter("contract IS NOT NULL")


def _by_receivers(rows: DataFrame, table: str, facts: DataFrame, declarations: DataFrame) -> DataFrame:
    """A table's facts with what declarations add: kinds of flow edges, handlers of generated servers, and calls of declared and generated clients."""
    if table == "flow_edges":
        return receivers.classified(rows.withColumn("path", F.col("evidence.file")), declarations).drop("path")
    rpcs = facts.filter("kind = 'entrypoint' AND fields['transport'] = 'rpc'")
    rpcs = rpcs.select(F.substring_index(F.col("fields")["name"], "/", 1).alias("service"), F.substring_index(F.col("fields")["name"], "/", -1).alias("method"), F.col("fields")["method"].alias("way"))
    if table == "entrypoints":
        return rows.unionByName(_rpc_handlers(rows, rpcs, declarations))
    if table == "static_service_calls":
        edges = fact_rows(facts, "flow_edges").withColumn("path", F.col("evidence.file"))
        at = edges.groupBy("path", F.col("from_symbol").alias("source")).agg(F.min("service_id").alias("service_id"), F.min("repository_id").alias("repository_id"), F.min("evidence").alias("evidence"))
        generated = receivers.grpc_calls(edges, declarations, rpcs.select("service", "method").distinct())
        name = F.split("name", "/")
        generated = generated.select("path", "source", name[0].alias("target_service"), F.lit("grpc").alias("protocol"), name[1].alias("target_method"), F.lit(None).cast("string").alias("target_path"))
        calls = receivers.remote_calls(edges, declarations).unionByName(generated).join(at, ["path", "source"])
        return rows.unionByName(calls.select(*rows.columns))
    return rows


def _rpc_handlers(rows: DataFrame, rpcs: DataFrame, declarations: DataFrame) -> DataFrame:
    """Entrypoints of the handlers of declared RPCs, in the columns of entrypoints."""
    handlers = receivers.grpc_entrypoints(declarations, rpcs.select("service", "method").distinct())
    ways = rpcs.groupBy(F.concat_ws("/", "service", "method").alias("name")).agg(F.min("way").alias("method"))
    evidence = F.struct(F.col("path").alias("file"), "start_line", "end_line")
    at = declarations.filter("kind = 'grpc_handler'").groupBy("path", F.col("fields")["symbol"].alias("symbol"))
    at = at.agg(F.min("service_id").alias("service_id"), F.min("repository_id").alias("repository_id"), F.min(evidence).alias("evidence"))
    found = handlers.join(at, ["path", "symbol"]).join(ways, "name").withColumn("kind", F.lit("grpc"))
    number = F.xxhash64("service_id", F.to_json(F.struct("kind", "method", "name", "symbol", "evidence")))
    return found.withColumn("id", number).select(*rows.columns)


def _repository(catalog: catalogs.Catalog, name: str, root: str) -> int:
    rows = catalog.read("repositories").filter(F.col("name") == name).select("id").limit(1).collect()
    if rows:
        return rows[0]["id"]
    number = _next_id(catalog, "repositories")
    _append_one(catalog, "repositories", id=number, name=name, root_path=root)
    return number


def _changes(known: DataFrame, found: DataFrame) -> DataFrame:
    """(service_id, file_path, change) by content hash."""
    a = known.select("service_id", "file_path", F.col("content_hash").alias("_old"))
    both = a.join(found.select("service_id", "file_path", F.col("content_hash").alias("_new")), ["service_id", "file_path"], "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select("service_id", "file_path", change.alias("change")).filter("change IS NOT NULL")


def _described(catalog: catalogs.Catalog, services: DataFrame, owned: DataFrame, changes: DataFrame, backend: Backend | None, force: bool) -> DataFrame:
    """Units that need a description anew, with what the backend made of them: (service_id, unit, key, result, ...)."""
    spark = catalog.spark
    http = catalog.read("entrypoints").filter("kind = 'http'").join(services.select(F.col("id").alias("service_id")), "service_id", "left_semi")
    endpoints = relational.first_per_key(http.select("service_id", "method", F.col("name").alias("path"), "symbol", "evidence"), ["service_id", "method", "path"], ["symbol"])
    catalog.prune("apis", endpoints, ["service_id", "method", "path"], services.select(F.col("id").alias("service_id")))
    old = catalog.read("apis").select("service_id", "method", "path", F.lit(True).alias("_there"))
    touched = changes.select("service_id", F.col("file_path").alias("_file")).distinct().withColumn("_touched", F.lit(True))
    e = endpoints.withColumn("_file", F.col("evidence.file")).join(old, ["service_id", "method", "path"], "left").join(touched, ["service_id", "_file"], "left")
    e = e.filter(F.lit(force) | F.col("_there").isNull() | F.col("_touched").isNotNull())
    body = owned.select(F.col("service_id"), F.col("path").alias("_file"), "text")
    lines = F.slice(F.split("text", "\n"), F.greatest(F.col("evidence.start_line") - 3, F.lit(1)), F.lit(64))
    e = e.join(body, ["service_id", "_file"]).withColumn("excerpt", text.redacted(F.array_join(lines, "\n")))
    endpoint_units = e.select("service_id", F.lit("endpoint").alias("unit"), F.concat_ws(" ", "method", "path").alias("key"), F.concat_ws("\n", F.lit("Describe this endpoint."), F.concat_ws(" ", "method", "path"), "excerpt").alias("prompt"))
    first = _run_units(endpoint_units, backend)
    made = F.from_json("result", "summary string, description string, request_shape string, response_shape string")
    ready = first.filter("unit = 'endpoint' AND result IS NOT NULL").withColumn("r", made)
    ids = catalog.read("apis").select("service_id", "method", "path", F.col("id").alias("_id"))
    split = F.split("key", " ", 2)
    apis = ready.select("service_id", split[0].alias("method"), split[1].alias("path"), "r.*").join(ids, ["service_id", "method", "path"], "left").withColumn("id", F.coalesce("_id", F.xxhash64("service_id", "method", "path")))
    catalog.upsert("apis", apis, ["id"])
    # Components and overviews are composed of what was just written.
    component = F.coalesce(text.owner(F.col("symbol")), F.lit("module"))
    summaries = endpoints.join(catalog.read("apis").select("service_id", "method", "path", "summary"), ["service_id", "method", "path"]).withColumn("component", component)
    again = first.select("service_id").distinct()
    grouped = summaries.join(again, "service_id", "left_semi").groupBy("service_id", "component").agg(F.min("evidence.file").alias("file_path"), F.sort_array(F.collect_set(F.concat_ws(" ", "method", "path", "summary"))).alias("lines"))
    component_units = grouped.select("service_id", F.lit("component").alias("unit"), F.concat_ws("\t", "component", "file_path").alias("key"), F.concat_ws("\n", F.lit("Summarise this component."), "component", F.array_join("lines", "\n")).alias("prompt"))
    moved = changes.select("service_id").distinct() if not force else services.select(F.col("id").alias("service_id"))
    tree = owned.join(moved, "service_id", "left_semi").groupBy("service_id").agg(F.slice(F.array_sort(F.collect_set(F.array_join(F.slice(F.split("path", "/"), 1, TREE_DEPTH + 1), "/"))), 1, TREE_LINES).alias("tree"))
    overview_units = tree.join(services.select(F.col("id").alias("service_id"), "name"), "service_id").select("service_id", F.lit("overview").alias("unit"), F.col("name").alias("key"), F.concat_ws("\n", F.lit("Describe this service."), "name", F.array_join("tree", "\n")).alias("prompt"))
    second = _run_units(component_units.unionByName(overview_units), backend)
    parts = second.filter("unit = 'component' AND result IS NOT NULL").select("service_id", F.split("key", "\t")[0].alias("name"), F.split("key", "\t")[1].alias("file_path"), F.get_json_object("result", "$.summary").alias("summary"))
    catalog.upsert("components", parts.withColumn("id", F.xxhash64("service_id", "name", "file_path")), ["id"])
    told = second.filter("unit = 'overview' AND result IS NOT NULL").select(F.col("service_id").alias("id"), F.get_json_object("result", "$.short_desc").alias("_s"), F.get_json_object("result", "$.long_desc").alias("_l"))
    now = catalog.read("services").join(told, "id", "left").withColumn("short_desc", F.coalesce("_s", "short_desc")).withColumn("long_desc", F.coalesce("_l", "long_desc")).drop("_s", "_l")
    catalog.overwrite("services", now)
    # Entities and messages that the source declares need no backend.
    stale = services.select(F.col("id").alias("service_id"))
    catalog.replace("persistence_entities", stale, catalog.read("static_persistence_facts").join(stale, "service_id", "left_semi").select("service_id", "name", "kind", F.lit("unknown").alias("engine")).distinct())
    catalog.replace("messages", stale, catalog.read("static_message_contracts").join(stale, "service_id", "left_semi").select("service_id", "direction", "channel").distinct())
    return checkpointed(first.unionByName(second)) if backend else spark.createDataFrame([], first.schema)


def _run_units(units: DataFrame, backend: Backend | None) -> DataFrame:
    """The units' results, with their service; without a backend nothing is asked."""
    units = checkpointed(units)
    if backend is None:
        units = units.limit(0)
    keyed = units.withColumn("key", F.concat_ws("\n", F.col("service_id").cast("string"), "key"))
    out = synthesised(keyed, backend)
    split = F.split("key", "\n", 2)
    return out.withColumn("service_id", split[0].cast("long")).withColumn("key", split[1])


def _reconcile(catalog: catalogs.Catalog) -> None:
    """Static HTTP calls become calls between services, resolved where the target's name is told exactly."""
    services = catalog.read("services")
    rows = catalog.read("static_service_calls").select(F.col("service_id").alias("from_service_id"), F.col("target_service").alias("to_service_name"), F.col("protocol").alias("call_kind")).distinct()
    kinds = stacks.target_kinds(rows, services, "to_service_name").withColumn("to_service_id", F.lit(None).cast("long"))
    names = services.select(F.col("name").alias("to_service_name"), F.col("id").alias("_to"), F.count("*").over(_by_name()).alias("_n")).filter("_n = 1")
    done = kinds.join(names, "to_service_name", "left").withColumn("to_service_id", F.col("_to")).withColumn("target_kind", F.when(F.col("_to").isNotNull(), "internal").otherwise(F.col("target_kind"))).drop("_to", "_n")
    catalog.overwrite("service_calls", done.withColumn("id", F.xxhash64("from_service_id", "to_service_name", "call_kind")))


def _by_name():
    from pyspark.sql import Window

    return Window.partitionBy("name")


def _close_runs(catalog: catalogs.Catalog, states: DataFrame, changes: DataFrame, done: DataFrame) -> None:
    """One finished run for each service; runs that an earlier process left open count as failed."""
    open_ = F.col("finished_at").isNull()
    _set(catalog, "index_runs", open_, status=F.lit("failed"), finished_at=F.current_timestamp())
    n = changes.groupBy("service_id").agg(F.count("*").alias("files_changed"))
    usage = done.groupBy("service_id").agg(F.sum("calls").alias("llm_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("result").isNull()).alias("_failed"))
    rows = states.join(n, "service_id", "left").join(usage, "service_id", "left")
    status = F.when(F.coalesce("_failed", F.lit(0)) > 0, "partial").otherwise("ok")
    rows = rows.select(F.xxhash64("service_id", F.current_timestamp()).alias("id"), "service_id", status.alias("status"), F.coalesce("files_changed", F.lit(0)).alias("files_changed"), F.coalesce("llm_calls", F.lit(0)).alias("llm_calls"), "input_tokens", "output_tokens", "cost_usd", F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"))
    catalog.append("index_runs", rows)
