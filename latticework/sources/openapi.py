"""HTTP contracts that files declare: operations with parameters, bodies, statuses and security, references resolved.

Each document is read once into its operations, the parameters of these and of their paths, and the parts that references may
name; pointers within a document are then followed as tables, by `paths.mounted`: a part that only refers to another hangs on it,
so chains of any length are resolved, and cycles and pointers to nothing are told as unresolved. A parameter of an operation
takes the place of that of its path which has the same name and place. YAML is read where its library is installed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import paths
from latticework.sources.folders import checkpointed

try:
    import yaml
except ImportError:  # documents in JSON are still read
    yaml = None

Fact = tuple[str, int, int, dict[str, str]]
METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
_SECTIONS = ["parameters", "requestBodies", "responses", "schemas", "pathItems"]


def _document(path: str, text: str) -> dict | None:
    if path.endswith(".json"):
        document = json.loads(text)
    elif yaml and re.search(r"^(openapi|swagger)\s*:", text, re.M):
        try:
            document = yaml.safe_load(text)
        except yaml.YAMLError:
            return None
    else:
        return None
    if not isinstance(document, dict):
        return None
    return document if isinstance(document.get("openapi"), str) or str(document.get("swagger")) == "2.0" else None


def _dict(x) -> dict:
    return x if isinstance(x, dict) else {}


def _reference(x) -> str:
    ref = _dict(x).get("$ref")
    return ref if isinstance(ref, str) else ""


def _packed(x) -> dict[str, str]:
    return {"ref": _reference(x), "value": json.dumps(x, sort_keys=True, default=str)}


def facts_in(path: str, text: str) -> Iterator[Fact]:
    document = _document(path, text)
    if document is None:
        return
    components = _dict(document.get("components")) | {k: document.get(k) for k in ("definitions",) if k in document}
    if "components" not in document:
        components |= {k: document.get(k) for k in ("parameters", "responses") if k in document}
    head = "#/components/" if "components" in document else "#/"
    for section, parts in components.items():
        for name, part in _dict(parts).items():
            yield "openapi_component", 1, 1, {"pointer": f"{head}{section}/{str(name).replace('~', '~0').replace('/', '~1')}"} | _packed(part)
    for route, item in _dict(document.get("paths")).items():
        if not isinstance(route, str) or not isinstance(item, dict):
            continue
        at = max(text.find(route), 0)
        for method in (m for m in item if isinstance(m, str) and m.lower() in METHODS and isinstance(item[m], dict)):
            operation = item[method]
            number = operation.get("operationId") if isinstance(operation.get("operationId"), str) else ""
            place = text.find(number, at) if number else at
            line = text.count("\n", 0, max(place, 0)) + 1
            security = operation.get("security", document.get("security"))
            key = {"method": method.upper(), "name": route}
            body = operation.get("requestBody")
            statuses = [str(s) for s in _dict(operation.get("responses"))]
            yield "openapi", line, line, key | {
                "operation_id": number, "statuses": ",".join(sorted(statuses)), "security": ("required" if security else "not_required") if isinstance(security, list) else "unspecified",
                "body": str(isinstance(body, dict)).lower(), "body_ref": _reference(body), "body_required": str(_dict(body).get("required") is True).lower(),
            }
            for level, holder in (("path", item), ("operation", operation)):
                given = holder.get("parameters")
                for position, parameter in enumerate(given if isinstance(given, list) else []):
                    if isinstance(parameter, dict):
                        yield "openapi_parameter", line, line, key | {"level": level, "position": str(position)} | _packed(parameter)


# --- tables ---------------------------------------------------------------------------------------------------------


def _fields(facts: DataFrame, kind: str, *names: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind).select("path", *(F.nullif(F.col("fields")[n], F.lit("")).alias(n) for n in names), "start_line", "end_line")


def contracts(facts: DataFrame) -> DataFrame:
    """(path, method, name, formal): every declared operation with its contract as JSON.

    request_body_required is null where it depends on a reference that leads nowhere; an unresolved parameter has only its pointer.
    """
    node = lambda pointer: F.concat("path", F.lit("\n"), pointer)
    parts = checkpointed(_fields(facts, "openapi_component", "pointer", "ref", "value").withColumn("node", node("pointer")))
    aliases = parts.filter("ref IS NOT NULL").select(F.col("node").alias("child"), node("ref").alias("parent"), F.lit("").alias("prefix"))
    ends = paths.mounted(aliases, parts.filter("ref IS NULL").select("node"))
    whole = ends.join(parts.filter("ref IS NULL").select(F.col("node").alias("root"), F.col("value").alias("_found")), "root").select(F.col("node").alias("_node"), "_found")

    said = _fields(facts, "openapi_parameter", "method", "name", "level", "position", "ref", "value").withColumn("_node", node("ref"))
    said = said.join(whole, "_node", "left").withColumn("value", F.when(F.col("ref").isNull(), F.col("value")).otherwise(F.col("_found")))
    tell = lambda column, field: F.get_json_object(column, f"$.{field}")
    said = said.withColumn("where", tell("value", "in")).withColumn("label", F.coalesce(tell("value", "name"), "ref"))
    key = ["path", "method", "name"]
    rank = F.struct(F.when(F.col("level") == "operation", 0).otherwise(1).alias("level"), F.col("position").cast("int").alias("position"))
    kind = F.coalesce(tell("value", "schema.type"), tell("value", "type"))
    one = F.struct(
        F.col("label").alias("name"), F.col("where").alias("in"), F.coalesce(tell("value", "required") == "true", F.lit(False)).alias("required"),
        kind.alias("type"), F.when(F.col("value").isNull(), F.col("ref")).alias("unresolved"),
    )
    merged = said.groupBy(*key, "where", "label").agg(F.min_by(one, rank).alias("one"))
    merged = merged.groupBy(*key).agg(F.sort_array(F.collect_list("one")).alias("parameters"))  # the parameters of one operation

    told = _fields(facts, "openapi", "method", "name", "operation_id", "statuses", "security", "body", "body_ref", "body_required").withColumn("_node", node("body_ref"))
    told = told.join(whole, "_node", "left").join(merged, key, "left")
    through = F.when(F.col("_found").isNotNull(), F.coalesce(tell("_found", "required") == "true", F.lit(False)))
    by_parameters = F.when(F.exists("parameters", lambda p: p["unresolved"].isNotNull()), None).otherwise(F.coalesce(F.exists("parameters", lambda p: (p["in"] == "body") & p["required"]), F.lit(False)))
    required = F.when(F.col("body") == "false", by_parameters).when(F.col("body_ref").isNotNull(), through).otherwise(F.col("body_required") == "true")
    formal = F.struct(
        F.lit("openapi").alias("format"), "operation_id", required.alias("request_body_required"), F.coalesce(F.split("statuses", ","), F.array().cast("array<string>")).alias("response_statuses"),
        "security", "parameters", F.struct(F.col("path").alias("file"), "start_line", "end_line").alias("evidence"),
    )
    return told.select(*key, F.to_json(formal, {"ignoreNullFields": "false"}).alias("formal"))


def declared_for(endpoints: DataFrame, declared: DataFrame, by: list[str]) -> DataFrame:
    """Endpoints (by, method, name, ...) with `formal` of the only operation of the same `by`, method and path; others go."""
    one = declared.groupBy(*by, "method", "name").agg(F.min("formal").alias("formal"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return endpoints.join(one, [*by, "method", "name"])
