"""Every detector over facts that order lines state, each beside the SQL that it must equal.

Suppliers are services, nations their repositories, and a part's brand is a source symbol. What a line states follows from its
flag and quantity: A up to 25 pieces an error contract, up to 47 a flow edge, beyond a persistence fact; R up to 4 a declared
cloud resource, up to 6 a configuration reference, up to 10 a boundary, beyond a policy; N up to 10 the use of a cloud
resource, up to 30 a message contract, beyond a call. A brand is also an entrypoint of its supplier, the last of them apart. All lines are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.plans import detectors
from latticework.plans.adapters import table
from latticework.sources.folders import checkpointed

#: The facts as views of SQL, by the names that the oracles use; the tables of `code_facts` hold the same.
_VIEWS = """b AS (SELECT l_suppkey, l_linenumber AS ln, l_quantity AS q, l_discount, l_tax, l_returnflag AS flag, l_linestatus AS st, 'o' || l_orderkey AS file, p_name, p_brand, p_type,
      CAST(substr(p_brand, 7) AS BIGINT) AS bn FROM lineitem JOIN part ON l_partkey = p_partkey),
    svc AS (SELECT s_suppkey AS service_id, s_name AS service, s_nationkey AS repository_id FROM supplier),
    errors AS (SELECT l_suppkey AS service_id, p_brand AS source, CASE WHEN ln <= 3 THEN 'raises' WHEN ln <= 6 THEN 'maps' ELSE 'handles' END AS role,
      CASE WHEN q <= 5 THEN 'validation' WHEN q <= 10 THEN 'not_found' WHEN q <= 15 THEN 'timeout' ELSE 'internal' END AS error_kind,
      CASE WHEN p_type = 'SMALL' THEN 'java.lang.Exception' WHEN ln = 3 THEN 'Raw' || p_type WHEN p_type <> 'LARGE' THEN p_type || 'Error' END AS internal_type, CASE WHEN l_tax < 0.02 THEN 'graphql' ELSE 'http' END AS protocol,
      CASE WHEN l_discount < 0.03 THEN '500' WHEN l_discount < 0.06 THEN '404' WHEN l_discount < 0.08 THEN '200' END AS code, p_name AS public_code, st = 'O' AS exposes, q <= 12 AS permanent, file, ln
      FROM b WHERE flag = 'A' AND q <= 25),
    edges AS (SELECT l_suppkey AS service_id, p_brand AS source, CASE WHEN st = 'O' THEN l_suppkey * 100 + bn END AS entrypoint_id, CASE WHEN q <= 33 THEN 'writes' WHEN q <= 40 THEN 'publishes' ELSE 'invokes' END AS kind,
      CASE WHEN q <= 33 THEN p_name WHEN q <= 40 THEN 'topic.' || lower(p_type) ELSE 'Brand#' || ln END AS to_symbol, CASE WHEN ln <= 5 THEN 'static' ELSE 'inferred' END AS origin, file, ln FROM b WHERE flag = 'A' AND q > 25 AND q <= 47),
    owned AS (SELECT l_suppkey AS service_id, CASE WHEN st = 'O' THEN upper(p_name) ELSE p_name END AS name, CASE WHEN ln <= 3 THEN 'entity' ELSE 'table' END AS kind, p_brand AS owner FROM b WHERE flag = 'A' AND q > 47),
    iac AS (SELECT s_nationkey AS repository_id, CASE WHEN ln <= 6 THEN l_suppkey END AS service_id, CASE WHEN st = 'O' THEN 'aws' ELSE 'gcp' END AS provider, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'queue' ELSE 'object_storage' END AS resource_type,
      st, q, p_brand AS logical_name, CASE WHEN ln <= 4 THEN p_name END AS physical_name FROM b JOIN supplier ON l_suppkey = s_suppkey WHERE flag = 'R' AND q <= 4),
    config AS (SELECT CASE WHEN ln <= 6 THEN l_suppkey END AS service_id, upper(p_type) AS environment_key, CASE WHEN ln <= 4 THEN 'ConfigMap' ELSE 'Secret' END AS source_kind, p_name AS source_name, p_brand AS source_key,
      CASE WHEN st = 'O' THEN 'optional' WHEN ln <= 4 THEN 'required' ELSE 'unknown' END AS optional, q, st, file, ln FROM b WHERE flag = 'R' AND q > 4 AND q <= 6),
    boundaries AS (SELECT l_suppkey AS service_id, p_brand AS source, CASE WHEN st = 'O' THEN 'transaction' ELSE 'retry' END AS kind FROM b WHERE flag = 'R' AND q > 6 AND q <= 10),
    policies AS (SELECT l_suppkey AS service_id, p_brand AS source, CASE WHEN q > 30 THEN 'retry' ELSE 'timeout' END AS kind FROM b WHERE flag = 'R' AND q > 10),
    cloud AS (SELECT l_suppkey AS service_id, CASE WHEN st = 'O' THEN 'aws' ELSE 'gcp' END AS provider, CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'queue' ELSE 'object_storage' END AS resource_type, CASE WHEN ln <= 5 THEN p_name END AS target_name
      FROM b WHERE flag = 'N' AND q <= 10),
    messages AS (SELECT l_suppkey AS service_id, CASE WHEN st = 'O' THEN 'consumes' ELSE 'publishes' END AS direction, 'topic.' || lower(p_type) AS channel, file, ln FROM b WHERE flag = 'N' AND q > 10 AND q <= 30),
    calls AS (SELECT l_suppkey AS service_id, p_brand AS source, s_suppkey AS to_service_id, s_name AS target, CASE WHEN st = 'O' THEN 'POST' ELSE 'GET' END AS method, '/' || lower(p_brand) AS path,
      CASE WHEN st = 'O' THEN 'POST ' ELSE 'GET ' END || s_name || '/' || lower(p_brand) AS call FROM b JOIN supplier ON s_suppkey = ln WHERE flag = 'N' AND q > 30),
    service_calls AS (SELECT l_suppkey AS from_service_id, CASE WHEN st = 'O' THEN bn END AS to_service_id, p_type AS to_name, st = 'O' AS internal, l_suppkey * 100 + bn AS api FROM b WHERE flag = 'N' AND q > 30 AND ln <= 2),
    entrypoints AS (SELECT DISTINCT l_suppkey * 100 + bn AS id, l_suppkey AS service_id, bn, p_brand AS symbol, CASE WHEN bn <= 10 THEN 'http' WHEN bn <= 16 THEN 'graphql' WHEN bn <= 22 THEN 'message' ELSE 'cli' END AS kind,
      CASE WHEN bn <= 5 THEN 'GET' WHEN bn <= 10 THEN 'POST' WHEN bn <= 13 THEN 'QUERY' WHEN bn <= 16 THEN 'MUTATION' WHEN bn <= 22 THEN 'CONSUME' ELSE 'RUN' END AS method,
      CASE WHEN bn <= 10 THEN '/' || lower(p_brand) WHEN bn BETWEEN 17 AND 22 THEN 'topic.' || ['medium', 'promo', 'economy', 'small', 'standard', 'large'][bn - 16] ELSE lower(p_brand) END AS name FROM b WHERE bn < 25)"""
CHANNELS = ["medium", "promo", "economy", "small", "standard", "large"]


def code_facts(spark: SparkSession, sf_dir: str, spread: bool = False, channels: bool = False, services: DataFrame | None = None) -> dict[str, DataFrame]:
    """The facts that all lines state; `spread`: parts, whose file is a small part of their size in memory, are never collected by the driver; `channels`: of entrypoints only those of messages, found once and written; `services`: (service_id), only what their lines state."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("service_id"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("q"), "l_discount", "l_tax", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("st"), "l_orderkey")
    if services is not None:
        lines = lines.join(services, "service_id", "left_semi")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.col("p_brand").alias("source"), "p_type", F.substring("p_brand", 7, 9).cast("long").alias("bn"))
    evidence = F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("ln").alias("start_line"), F.col("ln").alias("end_line"))
    b = lines.join(parts.hint("merge") if spread else parts, "l_partkey").withColumn("evidence", evidence)
    of = lambda flag, low, high: b.filter((F.col("flag") == flag) & (F.col("q") > low) & (F.col("q") <= high))
    by = lambda c, *steps: _steps(F.col(c), steps)
    is_open, brand, kind = F.col("st") == "O", F.lower("source"), F.lower("p_type")
    topic = F.concat(F.lit("topic."), kind)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("repository_id"), F.col("s_name").alias("name"))
    provider, resource = F.when(is_open, "aws").otherwise("gcp").alias("provider"), F.when(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), "queue").otherwise("object_storage")
    endpoint = F.col("service_id") * 100 + F.col("bn")

    errors = of("A", 0, 25).select(
        "service_id", "source", by("ln", (3, "raises"), (6, "maps"), "handles").alias("role"), by("q", (5, "validation"), (10, "not_found"), (15, "timeout"), "internal").alias("error_kind"),
        F.when(F.col("p_type") == "SMALL", "java.lang.Exception").when(F.col("ln") == 3, F.concat(F.lit("Raw"), "p_type")).when(F.col("p_type") != "LARGE", F.concat("p_type", F.lit("Error"))).alias("internal_type"), F.when(F.col("l_tax") < 0.02, "graphql").otherwise("http").alias("protocol"),
        F.when(F.col("l_discount") < 0.03, "500").when(F.col("l_discount") < 0.06, "404").when(F.col("l_discount") < 0.08, "200").alias("transport_code"), F.col("p_name").alias("public_code"), is_open.alias("exposes_internal_detail"),
        F.when(F.col("q") <= 12, "not_retryable").otherwise("retryable").alias("retryability"), "evidence",
    )
    edges = of("A", 25, 47).select(
        F.xxhash64("service_id", "source", "l_orderkey", "ln", "q", "p_name", "st", "l_tax", "l_discount").alias("id"), "service_id", F.when(is_open, endpoint).alias("entrypoint_id"), F.col("source").alias("from_symbol"),
        F.when(F.col("q") <= 33, F.col("p_name")).when(F.col("q") <= 40, topic).otherwise(F.concat(F.lit("Brand#"), F.col("ln").cast("string"))).alias("to_symbol"), by("q", (33, "writes"), (40, "publishes"), "invokes").alias("kind"),
        F.when(F.col("ln") <= 5, "static").otherwise("inferred").alias("origin"), "evidence",
    )
    owned = of("A", 47, 1e9).select("service_id", F.when(is_open, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), by("ln", (3, "entity"), "table").alias("kind"), F.col("source").alias("owner"), "evidence")
    settings = [{"redrive_policy": '{"max":3}', "acl": "private"}, {"kms_master_key_id": "key", "versioning": "false", "acl": "public-read"}, {"RedrivePolicy": "x", "BucketEncryption": "aes", "AccessControl": "PublicRead"}, {"server_side_encryption_configuration": "[]", "versioning": "true", "KmsMasterKeyId": "0"}]
    attributes = F.coalesce(*(F.when(F.col("q") == i + 1, F.create_map(*(F.lit(x) for kv in s.items() for x in kv))) for i, s in enumerate(settings)))
    form = F.when(resource == "queue", F.when(is_open, "aws_sqs_queue").otherwise("AWS::SQS::Queue")).otherwise(F.when(is_open, "aws_s3_bucket").otherwise("AWS::S3::Bucket"))
    home = supplier.select(F.col("id").alias("service_id"), "repository_id")
    iac = of("R", 0, 4).join(home, "service_id").select("repository_id", F.when(F.col("ln") <= 6, F.col("service_id")).alias("service_id"), provider, resource.alias("resource_type"), form.alias("iac_resource_type"), F.col("source").alias("logical_name"), F.when(F.col("ln") <= 4, F.col("p_name")).alias("physical_name"), attributes.alias("attributes"), "evidence")
    config = of("R", 4, 6).select(
        F.when(F.col("ln") <= 6, F.col("service_id")).alias("service_id"), F.upper("p_type").alias("environment_key"), by("ln", (4, "ConfigMap"), "Secret").alias("source_kind"), F.col("p_name").alias("source_name"), F.col("source").alias("source_key"),
        F.when(F.col("ln") <= 3, F.col("source")).alias("prefix"), F.when(is_open, True).when(F.col("ln") <= 4, False).alias("optional"), by("ln", (5, "container"), "init_container").alias("container_role"), F.lit("Deployment").alias("workload_kind"),
        F.col("p_type").alias("workload_name"), F.col("source").alias("container_name"), "evidence", F.col("evidence").alias("declaration_evidence"), "q", "st",
    )
    entrypoints = b.select("service_id", "source").distinct().withColumn("bn", F.substring("source", 7, 9).cast("long")).filter("bn < 25").select(  # the last brand is no entrypoint
        endpoint.alias("id"), "service_id", by("bn", (10, "http"), (16, "graphql"), (22, "message"), "cli").alias("kind"), by("bn", (5, "GET"), (10, "POST"), (13, "QUERY"), (16, "MUTATION"), (22, "CONSUME"), "RUN").alias("method"),
        F.when(F.col("bn") <= 10, F.concat(F.lit("/"), brand)).when(F.col("bn").between(17, 22), F.concat(F.lit("topic."), F.element_at(F.array(*map(F.lit, CHANNELS)), F.greatest(F.col("bn") - 16, F.lit(1)).cast("int")))).otherwise(brand).alias("name"),
        F.col("source").alias("symbol"), F.struct(F.concat(F.lit("e"), "source").alias("file"), F.col("bn").cast("int").alias("start_line"), F.col("bn").cast("int").alias("end_line")).alias("evidence"), "bn",
    )
    if channels:
        entrypoints = checkpointed(entrypoints.filter("kind = 'message'"))
    contract = F.when(F.col("bn") >= 21, '{"transport":"rabbitmq","direction":"consumes","dead_letter_routing_key":"dead"}').otherwise('{"transport":"rabbitmq","direction":"consumes"}')
    targets = supplier.select(F.col("id").cast("int").alias("ln"), F.col("name").alias("target_service"))
    return {
        "services": supplier,
        "repositories": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        "static_error_contracts": errors,
        "flow_edges": edges,
        "static_persistence_facts": owned,
        "cloud_iac_resources": iac,
        "k8s_key_mismatches": config.filter("q = 5 AND st = 'O'"),
        "k8s_source_unknowns": config.filter("q = 5 AND st = 'F'"),
        "k8s_import_unknowns": config.filter("q = 6"),
        "flow_boundaries": of("R", 6, 10).select("service_id", "source", F.when(is_open, "transaction").otherwise("retry").alias("kind"), "evidence"),
        "static_resilience_policies": of("R", 10, 1e9).select("service_id", "source", F.when(F.col("q") > 30, "retry").otherwise("timeout").alias("kind"), F.lit("annotation").alias("mechanism"), F.col("ln").alias("value"), "evidence"),
        "static_cloud_facts": of("N", 0, 10).select("service_id", "source", provider, resource.alias("resource_type"), F.when(F.col("ln") <= 5, F.col("p_name")).alias("target_name"), "evidence"),
        "static_message_contracts": of("N", 10, 30).select("service_id", "source", F.when(is_open, "consumes").otherwise("publishes").alias("direction"), topic.alias("channel"), "evidence"),
        "static_service_calls": of("N", 30, 1e9).join(targets, "ln").select("service_id", "source", "target_service", F.lit("http").alias("protocol"), F.when(is_open, "POST").otherwise("GET").alias("target_method"), F.concat(F.lit("/"), brand).alias("target_path"), "evidence"),
        "service_calls": of("N", 30, 1e9).filter("ln <= 2").select(F.col("service_id").alias("from_service_id"), F.when(is_open, F.col("bn")).alias("to_service_id"), F.col("p_type").alias("to_service_name"), F.when(is_open, "internal").otherwise("external").alias("target_kind"), F.lit("http").alias("call_kind"), endpoint.alias("from_api_id")),
        "entrypoints": entrypoints,
        "entrypoint_contracts": entrypoints.filter("kind = 'message'").select(F.col("id").alias("entrypoint_id"), contract.alias("contract")),
        "apis": entrypoints.filter("kind = 'http'").select("id", "service_id", "method", F.col("name").alias("path")),
    }


def _steps(value: Column, steps: tuple) -> Column:
    """The name of the first step that the value does not exceed; the last name has no bound."""
    out = F.lit(steps[-1])
    for bound, name in reversed(steps[:-1]):
        out = F.when(value <= bound, name).otherwise(out)
    return out


def found(detector: str) -> Callable[[SparkSession, str], DataFrame]:
    """The findings of one detector over the facts of all lines: how often each kind, services, subject, evidence and confidence occurs."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = detectors.DETECTORS[detector](detectors.Facts(spark, code_facts(spark, sf_dir)))
        out = out.select("kind", F.array_join("services", ",").alias("services"), "subject", F.size("evidence").cast("long").alias("evidence"), "confidence")
        return out.groupBy(*out.columns).agg(F.count("*").alias("n"))

    def per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = code_facts(spark, sf_dir, channels=detector != "retry_reaches_consumers")
        return detectors.per_channel_counts(detectors.Facts(spark, tables, lambda few: code_facts(spark, sf_dir, services=few)), detector)

    def unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detectors.unmapped_downstream_counts(detectors.Facts(spark, code_facts(spark, sf_dir, spread=True)))

    query = per_channel if detector in detectors.PER_CHANNEL else unmapped if detector == "unmapped_downstream_errors" else query
    query.__name__ = f"finds_{detector}"
    return query


def _sql(kind: str, services: str, subject: str, evidence: str, confidence: float | str, rest: str, views: str = "") -> str:
    """The oracle of one detector; `rest` is what follows SELECT's list."""
    return f"""WITH RECURSIVE {_VIEWS}{views and ", " + views}, found AS (SELECT {kind} AS kind, {services} AS services, {subject} AS subject, CAST({evidence} AS BIGINT) AS evidence, CAST({confidence} AS DOUBLE) AS confidence {rest})
    SELECT kind, services, subject, evidence, confidence, count(*) AS n FROM found GROUP BY ALL"""


_P = "pol AS (SELECT service_id, source, least(count(*), 3) AS p, kind FROM policies GROUP BY service_id, source, kind), any_pol AS (SELECT service_id, source, least(count(*), 3) AS p FROM policies GROUP BY 1, 2)"
_W = "wr AS (SELECT service_id, source, least(count(*), 3) AS w FROM edges WHERE kind = 'writes' GROUP BY 1, 2), pu AS (SELECT service_id, source, least(count(*), 3) AS p FROM edges WHERE kind = 'publishes' GROUP BY 1, 2)"
_BROAD = "lower(split_part(internal_type, '.', -1)) IN ('error', 'exception', 'runtimeexception', 'throwable')"
_CLIENT = "error_kind IN ('authorization', 'conflict', 'not_found', 'rate_limit', 'validation')"
_OPS = "ops AS (SELECT e.*, svc.service, o.writes, o.publishes FROM entrypoints e JOIN (SELECT entrypoint_id, count(*) FILTER (WHERE kind = 'writes') AS writes, count(*) FILTER (WHERE kind = 'publishes') AS publishes FROM edges WHERE entrypoint_id IS NOT NULL AND origin = 'static' AND kind IN ('writes', 'publishes') GROUP BY 1) o ON e.id = o.entrypoint_id JOIN svc ON e.service_id = svc.service_id)"
_AT = "kind || ' ' || method || ' ' || name || ' ' || symbol"
_REACH = """walk(service_id, root, node) AS (SELECT service_id, symbol, symbol FROM entrypoints WHERE kind = 'http' UNION SELECT w.service_id, root, to_symbol FROM walk w JOIN edges e ON w.service_id = e.service_id AND w.node = e.source)"""
_CHANNEL = f"""{_P}, {_W}, flows AS (SELECT e.service_id, e.source, e.to_symbol AS channel, pol.p + wr.w + 1 AS shown FROM (SELECT DISTINCT service_id, source, to_symbol FROM edges WHERE kind = 'publishes') e
    JOIN pol ON e.service_id = pol.service_id AND e.source = pol.source AND pol.kind = 'retry' JOIN wr ON e.service_id = wr.service_id AND e.source = wr.source)"""
_PERSISTENT = """per AS (SELECT m.channel, m.service_id, e.symbol, m.file, m.ln, wr.w, e.bn FROM messages m JOIN entrypoints e ON m.service_id = e.service_id AND m.channel = e.name AND e.kind = 'message' JOIN wr ON wr.service_id = e.service_id AND wr.source = e.symbol WHERE m.direction = 'consumes')"""
_UNRECOVERED = "unrec AS (SELECT service_id, symbol, bn, name FROM entrypoints e WHERE kind = 'message' AND bn < 21 AND NOT EXISTS (SELECT 1 FROM boundaries r WHERE r.kind = 'retry' AND r.service_id = e.service_id AND r.source = e.symbol))"


def _per_channel_sql(kind: str, consumers: str, confidence: float, views: str) -> str:
    """Consumers are (channel, service_id, symbol, k), k being how many pieces of evidence each shows; they are sorted by service and symbol."""
    views = f"""{_CHANNEL}, {views}, cons AS ({consumers}),
    each_ AS (SELECT DISTINCT f.service_id, f.source, f.channel, f.shown, svc.service AS other, c.symbol, c.files, c.k FROM flows f JOIN cons c ON f.channel = c.channel AND c.service_id <> f.service_id JOIN svc ON svc.service_id = c.service_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY service_id, source, channel ORDER BY other, symbol, files) AS r FROM each_),
    per_flow AS (SELECT service_id, source, channel, shown, array_agg(DISTINCT other) AS others, sum(k) FILTER (WHERE r <= 3) AS k FROM top GROUP BY ALL)"""
    return _sql(f"'{kind}'", "array_to_string(list_sort(list_distinct(list_append(others, service))), ',')", "source || ' ' || channel", "shown + k", confidence, "FROM per_flow JOIN svc USING (service_id)", views)


def _lacks(kind: str, lacking: str) -> str:
    return _sql(f"'{kind}'", "service", "coalesce(physical_name, logical_name)", "1", 0.45 if "dead_letter" in kind else 0.4, f"FROM iac JOIN svc USING (service_id) WHERE {lacking}")


_SCOPED = f"""{_REACH}, client AS (SELECT * FROM errors WHERE role IN ('raises', 'maps') AND protocol = 'http' AND internal_type IS NOT NULL AND code = '404'),
    met AS (SELECT c.*, e.symbol FROM tried c LEFT JOIN entrypoints e ON e.kind = 'http' AND e.service_id = c.to_service_id AND e.method = c.method AND e.name = c.path),
    scoped AS (SELECT m.*, k.source AS error_source, k.internal_type, 'endpoint_flow' AS scope FROM met m JOIN walk w ON w.service_id = m.to_service_id AND w.root = m.symbol JOIN client k ON k.service_id = m.to_service_id AND k.source = w.node WHERE m.symbol IS NOT NULL
      UNION ALL SELECT m.*, k.source, k.internal_type, 'service_contracts' FROM met m JOIN client k ON k.service_id = m.to_service_id WHERE m.symbol IS NULL)"""
_MEMBERS = "string_agg(DISTINCT service, ',' ORDER BY service)"
_MAPPED = "mapped AS (SELECT DISTINCT service_id, internal_type FROM errors WHERE role = 'maps' AND protocol = 'http' AND internal_type IS NOT NULL AND code = '404')"

_INNER = "inner_ AS (SELECT DISTINCT from_service_id AS u, to_service_id AS v FROM service_calls WHERE internal), reach(u, v) AS (SELECT u, v FROM inner_ WHERE u <> v UNION SELECT r.u, i.v FROM reach r JOIN inner_ i ON r.v = i.u)"
_COMPONENT = "local AS (SELECT DISTINCT service_id, source FROM edges2), comp AS (SELECT DISTINCT e.service_id, e.source AS u, e.target AS v FROM edges2 e JOIN local l ON l.service_id = e.service_id AND l.source = e.target WHERE e.source <> e.target)"
_COMPONENT = "edges2 AS (SELECT service_id, split_part(source, '.', 1) AS source, split_part(to_symbol, '.', 1) AS target FROM edges), " + _COMPONENT

ORACLES: dict[str, str] = {
    "cycles": _sql("'cycle'", "string_agg(service, ',' ORDER BY service)", "''", "0", 1, "FROM parts JOIN svc ON node = service_id GROUP BY part", f"{_INNER}, parts AS (SELECT a.u AS node, min(least(a.u, a.v)) AS part FROM reach a JOIN reach b ON a.u = b.v AND a.v = b.u WHERE a.u <> a.v GROUP BY 1)"),
    "fan_imbalance": _sql("way", "service", "''", "0", 1, "FROM f JOIN svc ON node = service_id WHERE peers >= 4", f"{_INNER}, f AS (SELECT u AS node, 'fan_out' AS way, count(DISTINCT v) AS peers FROM inner_ WHERE u <> v GROUP BY 1 UNION ALL SELECT v, 'fan_in', count(DISTINCT u) FROM inner_ WHERE u <> v GROUP BY 1)"),
    "component_cycles": _sql("'component_cycle'", "service", "members", "0", 1, "FROM groups JOIN svc USING (service_id)", f"""{_COMPONENT}, reach(service_id, u, v) AS (SELECT service_id, u, v FROM comp UNION SELECT r.service_id, r.u, c.v FROM reach r JOIN comp c ON r.service_id = c.service_id AND r.v = c.u),
        parts AS (SELECT a.service_id, a.u AS node, min(least(a.u, a.v)) AS part FROM reach a JOIN reach b ON a.service_id = b.service_id AND a.u = b.v AND a.v = b.u WHERE a.u <> a.v GROUP BY 1, 2), groups AS (SELECT service_id, string_agg(node, ' ' ORDER BY node) AS members FROM parts GROUP BY service_id, part)"""),
    "component_fan_imbalance": _sql("way", "service", "node", "0", 1, "FROM f JOIN svc USING (service_id) WHERE peers >= 5", f"{_COMPONENT}, f AS (SELECT service_id, u AS node, 'component_fan_out' AS way, count(DISTINCT v) AS peers FROM comp GROUP BY 1, 2 UNION ALL SELECT service_id, v, 'component_fan_in', count(DISTINCT u) FROM comp GROUP BY 1, 2)"),
    "ownership_overlap": _sql("'possible_aggregate_ownership_overlap'", "members", "entity || ' ' || pk", "k", 0.65, "FROM g WHERE n > 1", f"g AS (SELECT lower(name) AS entity, kind AS pk, {_MEMBERS} AS members, count(DISTINCT service_id) AS n, count(*) AS k FROM owned JOIN svc USING (service_id) GROUP BY 1, 2)"),
    "duplicate_integrations": _sql("'duplicate_external_integration'", "members", "vendor", "0", 1, "FROM g WHERE n > 1", f"g AS (SELECT lower(to_name) AS vendor, {_MEMBERS} AS members, count(DISTINCT from_service_id) AS n FROM service_calls JOIN svc ON from_service_id = service_id WHERE NOT internal GROUP BY 1)"),
    "flow_hypotheses": _sql("kind", "service", "subject", "evidence", "confidence", "FROM both_", f"""{_OPS}, both_ AS (SELECT 'possible_bff_domain_leakage' AS kind, service, {_AT} AS subject, writes + publishes AS evidence, 0.6 AS confidence FROM ops WHERE kind = 'graphql' AND method = 'MUTATION'
        UNION ALL SELECT 'possible_non_atomic_publish', service, {_AT}, 2, 0.5 FROM ops WHERE writes > 0 AND publishes > 0 AND NOT EXISTS (SELECT 1 FROM boundaries t WHERE t.kind = 'transaction' AND t.service_id = ops.service_id AND t.source = symbol))"""),
    "read_side_effects": _sql("'possible_read_entrypoint_side_effect'", "service", _AT, "writes + publishes", 0.8, "FROM ops WHERE (kind = 'http' AND method IN ('GET', 'HEAD', 'OPTIONS')) OR (kind = 'graphql' AND method = 'QUERY')", _OPS),
    "broad_handlers": _sql("'possible_overbroad_exception_handler'", "service", "source || ' ' || internal_type", "1", 0.75, f"FROM errors JOIN svc USING (service_id) WHERE role = 'maps' AND {_BROAD}"),
    "broad_handlers_over_timeouts": _sql("'possible_broad_handler_swallows_timeout'", "service", "h.source || ' ' || internal_type || ' ' || c.source || ' ' || call", "2 + p", 0.65, f"FROM errors h JOIN calls c USING (service_id) JOIN pol ON pol.service_id = c.service_id AND pol.source = c.source AND pol.kind = 'timeout' JOIN svc ON svc.service_id = c.service_id WHERE role = 'maps' AND h.protocol = 'http' AND code = '500' AND {_BROAD}", _P),
    "policies_on_write_flows": _sql("'possible_resilience_policy_on_partial_write_flow'", "service", "c.source || ' ' || call", "1 + any_pol.p + w", 0.7, "FROM calls c JOIN any_pol ON any_pol.service_id = c.service_id AND any_pol.source = c.source JOIN wr ON wr.service_id = c.service_id AND wr.source = c.source JOIN svc ON svc.service_id = c.service_id", f"{_P}, {_W}"),
    "retry_write_publish": _sql("'possible_retry_on_write_publish_flow'", "service", "pol.source", "pol.p + w + pu.p", 0.7, "FROM pol JOIN wr ON wr.service_id = pol.service_id AND wr.source = pol.source JOIN pu ON pu.service_id = pol.service_id AND pu.source = pol.source JOIN svc ON svc.service_id = pol.service_id WHERE pol.kind = 'retry'", f"{_P}, {_W}"),
    "retry_reaches_consumers": _per_channel_sql("possible_retry_write_publish_reaches_consumer", "SELECT channel, service_id, '' AS symbol, file || ' ' || ln AS files, 1 AS k FROM messages WHERE direction = 'consumes'", 0.75, "one_ AS (SELECT 1)"),
    "retry_reaches_persistent_consumers": _per_channel_sql("possible_retry_write_publish_reaches_persistent_consumer", "SELECT channel, service_id, symbol, file || ' ' || ln AS files, 1 + w AS k FROM per", 0.8, _PERSISTENT),
    "retry_reaches_unrecovered_consumers": _per_channel_sql("possible_retry_write_publish_reaches_unrecovered_persistent_consumer", "SELECT channel, service_id, symbol, file || ' ' || ln AS files, 2 + w AS k FROM per SEMI JOIN unrec USING (service_id, symbol)", 0.65, f"{_PERSISTENT}, {_UNRECOVERED}"),
    "non_atomic_service_publish": _sql("'possible_non_atomic_service_publish'", "service", "wr.source", "w + p", 0.5, """FROM wr JOIN pu ON wr.service_id = pu.service_id AND wr.source = pu.source JOIN svc ON svc.service_id = wr.service_id
        WHERE NOT EXISTS (SELECT 1 FROM entrypoints e WHERE e.service_id = wr.service_id AND e.symbol = wr.source) AND NOT EXISTS (SELECT 1 FROM boundaries t WHERE t.kind = 'transaction' AND t.service_id = wr.service_id AND t.source = wr.source)""", _W),
    "error_semantics_lost": _sql("'possible_error_semantics_lost'", "service", "r.internal_type || ' ' || r.source || ' ' || m.source", "2", 0.85, f"FROM errors r JOIN errors m ON r.service_id = m.service_id AND r.internal_type = m.internal_type JOIN svc ON svc.service_id = r.service_id WHERE r.role = 'raises' AND r.{_CLIENT} AND m.role = 'maps' AND m.protocol = 'http' AND m.code = '500'"),
    "unhandled_endpoint_errors": _sql("'possible_unhandled_endpoint_error'", "service", "method || ' ' || name || ' ' || symbol || ' ' || internal_type", "2", 0.75, "FROM hit JOIN svc USING (service_id)", f"""{_REACH},
        raised AS (SELECT DISTINCT service_id, source, internal_type FROM errors r WHERE role = 'raises' AND internal_type IS NOT NULL AND {_CLIENT} AND NOT EXISTS (SELECT 1 FROM errors m WHERE m.role = 'maps' AND m.protocol = 'http' AND m.service_id = r.service_id AND m.internal_type = r.internal_type)),
        hit AS (SELECT DISTINCT e.service_id, e.method, e.name, e.symbol, r.internal_type FROM entrypoints e JOIN walk w ON w.service_id = e.service_id AND w.root = e.symbol JOIN raised r ON r.service_id = e.service_id AND r.source = w.node WHERE e.kind = 'http')"""),
    "internal_error_exposures": _sql("'possible_internal_error_exposure'", "service", "concat_ws(' ', source, protocol, code, public_code)", "1", 0.9, "FROM errors JOIN svc USING (service_id) WHERE exposes AND ((role = 'maps' AND protocol = 'http') OR (role = 'raises' AND protocol = 'graphql'))"),
    "calls_without_policy": _sql("'possible_missing_http_resilience_policy'", "service", "c.source || ' ' || call", "1", 0.5, "FROM calls c JOIN svc USING (service_id) WHERE NOT EXISTS (SELECT 1 FROM policies p WHERE p.service_id = c.service_id AND p.source = c.source)"),
    "retries_on_non_idempotent_calls": _sql("'possible_retry_on_non_idempotent_http_call'", "service", "c.source || ' ' || call", "1 + p", 0.65, "FROM calls c JOIN pol ON pol.service_id = c.service_id AND pol.source = c.source AND pol.kind = 'retry' JOIN svc ON svc.service_id = c.service_id WHERE method = 'POST'", _P),
    "retries_on_permanent_errors": _sql("'possible_retry_on_non_retryable_error'", "service", "concat_ws(' ', e.source, error_kind, internal_type)", "1 + p", 0.8, f"FROM errors e JOIN pol ON pol.service_id = e.service_id AND pol.source = e.source AND pol.kind = 'retry' JOIN svc ON svc.service_id = e.service_id WHERE role = 'raises' AND permanent AND {_CLIENT}", _P),
    "retries_on_downstream_errors": _sql("'possible_retry_on_downstream_client_error'", "array_to_string(list_sort([service, target]), ',')", "source || ' ' || call || ' ' || error_source || ' ' || internal_type", "2 + p", "CASE scope WHEN 'endpoint_flow' THEN 0.8 ELSE 0.65 END", "FROM scoped JOIN svc USING (service_id)",
        f"{_P}, tried AS (SELECT c.*, p FROM calls c JOIN pol ON pol.service_id = c.service_id AND pol.source = c.source AND pol.kind = 'retry'), {_SCOPED}"),
    "timeouts_without_fallback": _sql("'possible_timeout_without_local_fallback'", "service", "c.source || ' ' || call", "1 + p", 0.55, """FROM calls c JOIN pol ON pol.service_id = c.service_id AND pol.source = c.source AND pol.kind = 'timeout' JOIN svc ON svc.service_id = c.service_id
        WHERE NOT EXISTS (SELECT 1 FROM errors e WHERE e.role = 'handles' AND e.error_kind = 'timeout' AND e.service_id = c.service_id AND e.source = c.source)""", _P),
    "timeout_fallbacks_masking": _sql("'possible_timeout_fallback_masks_failure'", "service", "h.source || ' ' || e.method || ' ' || name || ' ' || call", "2", 0.8, "FROM errors h JOIN entrypoints e ON e.service_id = h.service_id AND e.symbol = h.source JOIN calls c ON c.service_id = h.service_id AND c.source = h.source JOIN svc ON svc.service_id = h.service_id WHERE role = 'handles' AND error_kind = 'timeout' AND h.protocol = 'http' AND code = '200'"),
    "timeouts_as_500": _sql("'possible_timeout_mapped_as_internal_server_error'", "service", "concat_ws(' ', source, internal_type)", "1", 0.8, "FROM errors JOIN svc USING (service_id) WHERE role = 'maps' AND error_kind = 'timeout' AND protocol = 'http' AND code = '500'"),
    "unmapped_downstream_errors": _sql("'possible_unmapped_downstream_error'", "services", "subject", "evidence", "confidence", "FROM both_", f"""tried AS (SELECT * FROM calls), {_SCOPED}, {_MAPPED},
        both_ AS (SELECT array_to_string(list_sort([service, target]), ',') AS services, source || ' ' || call || ' ' || error_source || ' ' || internal_type AS subject, 2 AS evidence, CASE scope WHEN 'endpoint_flow' THEN 0.75 ELSE 0.6 END AS confidence FROM scoped s JOIN svc USING (service_id)
          WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.service_id = s.service_id AND m.internal_type = s.internal_type)
          UNION ALL SELECT array_to_string(list_sort([a.service, t.service]), ','), e.method || ' ' || e.name || ' ' || k.source || ' ' || k.internal_type, 1, 0.35 FROM service_calls c JOIN entrypoints e ON e.id = c.api AND e.kind = 'http' JOIN client k ON k.service_id = c.to_service_id
          JOIN svc a ON a.service_id = c.from_service_id JOIN svc t ON t.service_id = c.to_service_id WHERE c.internal AND NOT EXISTS (SELECT 1 FROM mapped m WHERE m.service_id = c.from_service_id AND m.internal_type = k.internal_type)
          AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.service_id = c.from_service_id AND p.to_service_id = c.to_service_id))"""),
    "consumers_without_recovery": _sql("'possible_message_consumer_without_recovery_policy'", "service", "name || ' ' || symbol", "1", 0.45, "FROM unrec JOIN svc USING (service_id)", _UNRECOVERED),
    "cloud_code_without_iac": _sql("'cloud_dependency_without_iac'", "service", "provider || ' ' || resource_type || ' ' || target_name", "1", 0.7, "FROM cloud c JOIN svc USING (service_id) WHERE target_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM iac i WHERE i.repository_id = svc.repository_id AND i.provider = c.provider AND i.resource_type = c.resource_type AND i.physical_name = c.target_name)"),
    "cloud_iac_unused": _sql("'cloud_iac_resource_unused'", "service", "provider || ' ' || resource_type || ' ' || physical_name", "1", 0.6, "FROM iac i JOIN svc USING (service_id) WHERE physical_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cloud c JOIN svc s ON s.service_id = c.service_id WHERE s.repository_id = i.repository_id AND i.provider = c.provider AND i.resource_type = c.resource_type AND i.physical_name = c.target_name)"),
    "shared_cloud_resource": _sql("'shared_cloud_resource'", "members", "provider || ' ' || resource_type || ' ' || target_name", "0", 1, "FROM g WHERE n > 1", f"g AS (SELECT provider, resource_type, target_name, {_MEMBERS} AS members, count(DISTINCT service_id) AS n FROM cloud JOIN svc USING (service_id) WHERE target_name IS NOT NULL GROUP BY 1, 2, 3)"),
    "k8s_key_mismatches": _sql("'possible_kubernetes_configuration_key_not_declared'", "service", "concat_ws(' ', environment_key, source_kind, source_name, source_key)", "2", 0.9, "FROM config JOIN svc USING (service_id) WHERE q = 5 AND st = 'O'"),
    "k8s_source_unknowns": _sql("'possible_kubernetes_configuration_source_not_declared_locally'", "service", "concat_ws(' ', environment_key, source_kind, source_name, source_key)", "1", 0.4, "FROM config JOIN svc USING (service_id) WHERE q = 5 AND st = 'F'"),
    "k8s_import_unknowns": _sql("'possible_kubernetes_configuration_source_import_not_declared_locally'", "service", "source_kind || ' ' || source_name", "k", 0.4, "FROM g JOIN svc USING (service_id)", "g AS (SELECT service_id, source_kind, source_name, count(DISTINCT file || ' ' || ln) AS k FROM config WHERE q = 6 AND service_id IS NOT NULL GROUP BY 1, 2, 3)"),
    "missing_dead_letter_queue": _lacks("possible_missing_dead_letter_queue", "resource_type = 'queue' AND q <> CASE st WHEN 'O' THEN 1 ELSE 3 END"),
    "public_storage": _sql("'possible_public_object_storage'", "service", "coalesce(physical_name, logical_name)", "1", 0.85, "FROM iac JOIN svc USING (service_id) WHERE resource_type = 'object_storage' AND q IN (2, 3)"),
    "unencrypted": _lacks("possible_unencrypted_cloud_resource", "CASE WHEN resource_type = 'queue' THEN st <> 'O' OR q <> 2 ELSE st = 'O' OR q <> 3 END"),
    "missing_versioning": _lacks("possible_missing_bucket_versioning", "resource_type = 'object_storage' AND (st <> 'O' OR q <> 4)"),
}
ORACLES = {f"finds_{name}": sql for name, sql in ORACLES.items()}
QUERIES = {name: found(name.removeprefix("finds_")) for name in ORACLES}
