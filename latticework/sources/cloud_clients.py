"""Cloud operations in code: names bound to clients by what files import, followed through aliases, joined with the operations.

A name is bound by a type or a constructor whose import names the package that ships it (kind `cloud_bound`), and passes its
binding on where it is assigned, or where a factory method makes a topic, sender or receiver of it (`cloud_alias`). Names belong to
a function, a class or the whole file: an assignment means the nearest that declares its name, and so does a call. What is bound
to nothing known says nothing. Calls are flow edges (in Python, all calls of a file, kind `cloud_call`); an operation whose
command object is constructed is told by the file alone, as an operation (`cloud_operation`).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import binding
from latticework.sources import routes

Fact = tuple[str, int, int, dict[str, str]]
# Services with their provider and what they are.
SERVICES = {
    "sqs": ("aws", "queue"), "sns": ("aws", "pubsub"), "s3": ("aws", "object_storage"), "eventbridge": ("aws", "event_bus"), "kinesis": ("aws", "stream"),
    "blob_storage": ("azure", "object_storage"), "service_bus": ("azure", "queue"), "event_hub": ("azure", "stream"), "pubsub": ("gcp", "pubsub"),
}
# Operations by family of services; other spellings follow from these (sendMessage, send_message).
OPERATIONS = {
    "aws": {
        "SendMessage": "publish", "SendMessageBatch": "publish", "ReceiveMessage": "consume", "DeleteMessage": "consume", "Publish": "publish", "Subscribe": "admin",
        "PutObject": "write", "GetObject": "read", "DeleteObject": "write", "ListObjectsV2": "read", "PutEvents": "publish", "PutRecord": "publish", "GetRecords": "consume",
    },
    "blob_storage": {"Upload": "write", "Download": "read", "Delete": "write"},
    "pubsub": {"Publish": "publish"},
    "service_bus": {"SendMessages": "publish", "ReceiveMessages": "consume"},
    "event_hub": {"SendBatch": "publish"},
}
# Methods that are an operation under a name of their own.
SPELLINGS = {
    "blob_storage": {"uploadData": "Upload", "upload_blob": "Upload", "downloadToBuffer": "Download", "download_blob": "Download", "deleteBlob": "Delete", "delete_blob": "Delete"},
    "pubsub": {"publishMessage": "Publish"},
}
#: Kinds of facts that only `with_cloud` reads.
KINDS = {"cloud_bound", "cloud_alias", "cloud_call", "cloud_operation"}
EDGE_KINDS = {"publish": "publishes", "consume": "consumes", "read": "reads", "write": "writes", "admin": "invokes"}
# Methods of clients that make a part of them.
FACTORIES = {
    "pubsub": ["topic", "subscription", "Topic", "Subscription"],
    "service_bus": ["createSender", "createReceiver", "create_sender", "create_receiver", "get_queue_sender", "get_queue_receiver", "get_topic_sender", "get_subscription_receiver"],
}
# Types and constructors by the packages that ship them, with service and kit.
JVM_TYPES = {
    "com.amazonaws.services.sqs": (["AmazonSQS", "AmazonSQSClient"], "sqs", "aws-sdk-java-v1"),
    "com.amazonaws.services.sns": (["AmazonSNS", "AmazonSNSClient"], "sns", "aws-sdk-java-v1"),
    "com.amazonaws.services.s3": (["AmazonS3", "AmazonS3Client"], "s3", "aws-sdk-java-v1"),
    "com.amazonaws.services.cloudwatchevents": (["AmazonCloudWatchEvents", "AmazonCloudWatchEventsClient"], "eventbridge", "aws-sdk-java-v1"),
    "com.amazonaws.services.kinesis": (["AmazonKinesis", "AmazonKinesisClient"], "kinesis", "aws-sdk-java-v1"),
    "software.amazon.awssdk.services.sqs": (["SqsClient"], "sqs", "aws-sdk-java-v2"),
    "software.amazon.awssdk.services.sns": (["SnsClient"], "sns", "aws-sdk-java-v2"),
    "software.amazon.awssdk.services.s3": (["S3Client"], "s3", "aws-sdk-java-v2"),
    "software.amazon.awssdk.services.eventbridge": (["EventBridgeClient"], "eventbridge", "aws-sdk-java-v2"),
    "software.amazon.awssdk.services.kinesis": (["KinesisClient"], "kinesis", "aws-sdk-java-v2"),
    "com.azure.storage.blob": (["BlobServiceClient", "BlobContainerClient", "BlobClient"], "blob_storage", "azure-storage-blob"),
    "com.azure.messaging.servicebus": (["ServiceBusSenderClient", "ServiceBusReceiverClient"], "service_bus", "azure-servicebus"),
    "com.azure.messaging.eventhubs": (["EventHubProducerClient"], "event_hub", "azure-eventhub"),
    "com.google.cloud.pubsub.v1": (["Publisher", "Subscriber"], "pubsub", "gcp-pubsub"),
}
GO_PACKAGES = {
    **{f"github.com/aws/aws-sdk-go-v2/service/{s}": (["Client", "New", "NewFromConfig"], s, "aws-sdk-go-v2") for s in ("sqs", "sns", "s3", "eventbridge", "kinesis")},
    "github.com/Azure/azure-sdk-for-go/sdk/storage/azblob": (["Client", "NewClient"], "blob_storage", "azure-storage-blob"),
    "cloud.google.com/go/pubsub": (["Client", "NewClient"], "pubsub", "gcp-pubsub-go"),
}
NODE_TYPES = {
    "@azure/storage-blob": (["BlobServiceClient", "BlobContainerClient", "BlobClient"], "blob_storage", "azure-storage-blob"),
    "@azure/event-hubs": (["EventHubProducerClient"], "event_hub", "azure-eventhub"),
    "@azure/service-bus": (["ServiceBusClient"], "service_bus", "azure-servicebus"),
    "@google-cloud/pubsub": (["PubSub"], "pubsub", "gcp-pubsub"),
}
NODE_COMMANDS = {f"@aws-sdk/client-{s}": s for s in ("sqs", "sns", "s3", "eventbridge", "kinesis")}
PYTHON_SERVICES = {"sqs": "sqs", "sns": "sns", "s3": "s3", "events": "eventbridge", "kinesis": "kinesis"}


# --- one file -------------------------------------------------------------------------------------------------------


class Names:
    """The names that a file declares, by scope: a function's symbol, a class, or '' for the file."""

    def __init__(self, places: list[tuple[int, int, str]]):
        self.places = places
        self.bound: list[tuple[int, str, str, str]] = []
        self.aliases: list[tuple[int, str, str, str, str]] = []

    def scopes(self, at: int) -> list[str]:
        """The scopes around a place, from the inside out."""
        return [name for _, _, name in sorted((p for p in self.places if p[0] <= at < p[1]), key=lambda p: p[1] - p[0])] + [""]

    def bind(self, at: int, scope: str, name: str, kind: str) -> None:
        self.bound.append((at, scope, name, kind))

    def alias(self, at: int, scope: str, name: str, source: str, method: str) -> None:
        self.aliases.append((at, scope, name, source, method))

    def facts(self, line_at) -> Iterator[Fact]:
        declared = {(scope, name) for _, scope, name, _ in self.bound} | {(scope, name) for _, scope, name, _, _ in self.aliases}
        for at, scope, name, kind in self.bound:
            yield "cloud_bound", line_at(at), line_at(at), {"name": f"{scope}#{name}", "family": kind}
        for at, scope, name, source, method in self.aliases:
            home = next((s for s in self.scopes(at) if (s, source) in declared and (s, source) != (scope, name)), None)
            if home is not None:
                yield "cloud_alias", line_at(at), line_at(at), {"name": f"{scope}#{name}", "source": f"{home}#{source}", "method": method}


def _family(service: str, kit: str) -> str:
    return f"{service} {kit}"


def _jvm(text: str, functions, classes: list[tuple[int, int, str]]) -> Names:
    imported = {m[2]: (m[1], m[2]) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)\.(\w+)\s*;?\s*$", text, re.M)}
    known = {name: _family(service, kit) for name, (package, _) in imported.items() if package in JVM_TYPES for types, service, kit in [JVM_TYPES[package]] if name in types}
    names = Names(classes + [(at, end, symbol) for symbol, _, at, _, end in functions])
    if not known:
        return names
    heads = [(at, body, end, symbol) for symbol, _, at, body, end in functions]

    def scope_at(at: int) -> str:
        return names.scopes(at)[0]

    for m in re.finditer(r"\b([A-Z]\w*)(?:<[^<>;]*>)?\s+(\w+)\s*(?=[=;,)])|\b(\w+)\s*:\s*([A-Z]\w*)\b", text):
        kind, name = m[1] or m[4], m[2] or m[3]
        # A type that is none of these shadows a name of the same scope only.
        names.bind(m.start(), scope_at(m.start()), name, known.get(kind, "other"))
    for m in re.finditer(r"(?<![\w.])(this\.)?(?:(?:val|var|final|[A-Z]\w*)\s+)*(\w+)\s*=\s*(?:this\.)?(\w+)(?:\.(\w+)\s*\(|\s*(?=[;\n}]))", text):
        inside = [h for h in heads if h[0] <= m.start() < h[2]]
        owner = next((c for c in names.scopes(m.start()) if any(c == x[2] for x in classes)), "")
        local = inside and not m[1] and any(s == scope_at(m.start()) and n == m[2] for _, s, n, _ in names.bound)
        names.alias(m.start(), scope_at(m.start()) if local or not owner else owner, m[2], m[3], m[4] or "")
    return names


def _go(text: str, functions) -> Names:
    lines = [m for block in re.finditer(r"^import\s*(?:\((.*?)\)|([^\n(]+))", text, re.M | re.S) for m in re.finditer(r"(?:(\w+)\s+)?\"([^\"]+)\"", block[1] or block[2])]
    imported = {m[1] or re.sub(r"/v\d+$", "", m[2]).rsplit("/", 1)[-1]: m[2] for m in lines}
    names = Names([(at, end, symbol) for symbol, _, at, _, end in functions])
    if not any(p in GO_PACKAGES for p in imported.values()):
        return names

    def family(alias: str, what: str) -> str:
        types, service, kit = GO_PACKAGES.get(imported.get(alias, ""), ([], "", ""))
        return _family(service, kit) if what in types else "other"

    for m in re.finditer(r"\b((?:\w+\s*,\s*)*\w+)\s+\*?(\w+)\.(\w+)\b", text):
        if m[2] in imported and m[1] not in ("return", "func", "type"):
            for name in re.split(r"\s*,\s*", m[1]):
                names.bind(m.start(), names.scopes(m.start())[0], name, family(m[2], m[3]))
    for m in re.finditer(r"(?<![\w.])([\w.]+)(?:\s*,\s*\w+)?\s*:?=\s*&?([\w.]+)(?:\s*(\()|\s*$)", text, re.M):
        target, source = m[1].rsplit(".", 1)[-1], m[2].split(".")
        scope = "" if "." in m[1] else names.scopes(m.start())[0]
        if m[3] and len(source) == 2 and source[0] in imported:
            names.bind(m.start(), scope, target, family(*source))
        elif m[3] and len(source) > 1:
            names.alias(m.start(), scope, target, source[-2], source[-1])
        elif not m[3]:
            names.alias(m.start(), scope, target, source[-1], "")
    for m in re.finditer(r"\b(\w+)\s*:\s*(\w+)\s*[,}\n]", text):  # fields of a literal: client: client
        names.alias(m.start(), "", m[1], m[2], "")
    return names


def _node(text: str, functions) -> tuple[Names, list[Fact]]:
    imported = routes.imports(text)
    names = Names([(at, end, symbol) for symbol, _, at, _, end in functions])
    known = {local: _family(service, kit) for local, (module, name) in imported.items() if module in NODE_TYPES for types, service, kit in [NODE_TYPES[module]] if name in types}
    commands = {local: (NODE_COMMANDS[module], name.removesuffix("Command")) for local, (module, name) in imported.items() if module in NODE_COMMANDS and name.endswith("Command") and name.removesuffix("Command") in OPERATIONS["aws"]}
    operations = []
    for m in re.finditer(r"\bnew\s+(\w+)\s*\(", text):
        if m[1] in commands:
            service, operation = commands[m[1]]
            at = routes.line_at(text, m.start())
            operations.append(("cloud_operation", at, at, {"source": names.scopes(m.start())[0], "service_name": service, "operation": operation, "sdk": "aws-sdk-js-v3", "target": m[1]}))
    if not known:
        return names, operations
    for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)(?:\s*:\s*[\w.<>]+)?\s*=\s*(?:await\s+)?(?:new\s+(\w+)\s*\(|([\w.]+)(?:\s*(\()|\s*(?=[;\n])))", text):
        _assigned(names, m, names.scopes(m.start())[0], known)
    for m in re.finditer(r"\bthis\.(\w+)\s*=\s*(?:await\s+)?(?:new\s+(\w+)\s*\(|([\w.]+)(?:\s*(\()|\s*(?=[;\n])))", text):
        _assigned(names, m, "", known)
    for m in re.finditer(r"(?:\b(private|protected|public|readonly)\s+(?:readonly\s+)?)?\b(\w+)\s*\??:\s*(\w+)\s*(?=[,)=;])", text):
        if m[3] in known:
            names.bind(m.start(), "" if m[1] else names.scopes(m.start())[0], m[2], known[m[3]])
    return names, operations


def _assigned(names: Names, m: re.Match, scope: str, known: dict[str, str]) -> None:
    if m[2]:
        names.bind(m.start(), scope, m[1], known.get(m[2], "other"))
        return
    parts = m[3].removeprefix("this.").split(".")
    if m[4] and len(parts) > 1:
        names.alias(m.start(), scope, m[1], parts[-2], parts[-1])
    elif not m[4]:
        names.alias(m.start(), scope, m[1], parts[-1], "")


def _python(text: str) -> Iterator[Fact]:
    tree = ast.parse(text)
    boto = {a.asname or a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names if a.name == "boto3"}
    if not boto:
        return
    functions = [(n.lineno, (n.end_lineno or n.lineno) + 1, n.name) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    names = Names(functions)

    def last(node: ast.AST) -> tuple[str, bool]:
        if isinstance(node, ast.Name):
            return node.id, False
        return (node.attr, True) if isinstance(node, ast.Attribute) else ("", False)

    for n in ast.walk(tree):
        if isinstance(n, ast.Assign):
            for target in n.targets:
                name, member = last(target)
                scope = "" if member else names.scopes(n.lineno)[0]
                value = n.value
                if isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and isinstance(value.func.value, ast.Name) and value.func.value.id in boto:
                    given = value.args[0].value if value.args and isinstance(value.args[0], ast.Constant) else None
                    service = PYTHON_SERVICES.get(given) if value.func.attr in ("client", "resource") else None
                    names.bind(n.lineno, scope, name, _family(service, "boto3") if service else "other")
                elif last(value)[0]:
                    names.alias(n.lineno, scope, name, last(value)[0], "")
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and (receiver := last(n.func.value)[0]):
            yield "cloud_call", n.lineno, n.end_lineno or n.lineno, {"source": names.scopes(n.lineno)[0], "target": f"{receiver}.{n.func.attr}"}
    yield from names.facts(lambda line: line)


def facts_in(language: str, text: str, functions: list, classes: list[tuple[int, int, str]]) -> Iterator[Fact]:
    """What a file says of clients; functions: (symbol, notes, start, body, end); classes: (start, end, name)."""
    if language == "python":
        yield from _python(text)
        return
    operations: list[Fact] = []
    if language == "jvm":
        names = _jvm(text, functions, classes)
    elif language == "go":
        names = _go(text, functions)
    else:
        names, operations = _node(text, functions)
    yield from operations
    if any(kind != "other" for *_, kind in names.bound):
        yield from names.facts(lambda at: routes.line_at(text, at))


# --- tables ---------------------------------------------------------------------------------------------------------


def _spellings(operation: str) -> set[str]:
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", operation).lower()
    return {operation, operation[0].lower() + operation[1:], snake}


def families(spark: SparkSession) -> DataFrame:
    """(family, service_name, provider, resource_type, sdk): a fixed table of rules."""
    kits = {(s, k) for types in (JVM_TYPES, GO_PACKAGES, NODE_TYPES) for _, s, k in types.values()}
    kits |= {(s, "boto3") for s in PYTHON_SERVICES.values()} | {(s, "aws-sdk-js-v3") for s in NODE_COMMANDS.values()}
    rows = [(_family(s, k), s, *SERVICES[s], k) for s, k in sorted(kits)]
    return spark.createDataFrame(rows, "family string, service_name string, provider string, resource_type string, sdk string")


def operations(spark: SparkSession) -> DataFrame:
    """(service_name, method, operation, operation_kind), methods in every spelling: a fixed table of rules."""
    rows = set()
    for service, (provider, _) in SERVICES.items():
        table = OPERATIONS["aws" if provider == "aws" else service]
        rows |= {(service, spelling, name, kind) for name, kind in table.items() for spelling in _spellings(name)}
        rows |= {(service, method, name, table[name]) for method, name in SPELLINGS.get(service, {}).items()}
    return spark.createDataFrame(sorted(rows), "service_name string, method string, operation string, operation_kind string")


def factories(spark: SparkSession) -> DataFrame:
    """(family, method, made): a fixed table of rules."""
    kits = {(s, k) for types in (JVM_TYPES, GO_PACKAGES, NODE_TYPES) for _, s, k in types.values()}
    rows = [(_family(s, k), m, _family(s, k)) for s, k in sorted(kits) for m in FACTORIES.get(s, [])]
    return spark.createDataFrame(rows, "family string, method string, made string")


def _fields(facts: DataFrame, kind: str, *names: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind).select("path", *(F.nullif(F.col("fields")[n], F.lit("")).alias(n) for n in names))


def cloud_calls(facts: DataFrame) -> DataFrame:
    """(path, start_line, end_line, source, target, provider, resource_type, service_name, operation, operation_kind, sdk): calls of operations on bound names.

    A call means the nearest scope that binds its receiver: the function that it stands in, that one's class, the file. The
    tables of rules are joined as they are: they are short and fixed.
    """
    spark = facts.sparkSession
    bound = binding.bound_names(_fields(facts, "cloud_bound", "name", "family"), _fields(facts, "cloud_alias", "name", "source", "method"), factories(spark), ["path"])
    field = lambda n: F.col("fields")[n]
    edges = facts.filter("kind = 'flow_edge'").select("path", "start_line", "end_line", field("from_symbol").alias("source"), field("to_symbol").alias("target"))
    calls = facts.filter("kind = 'cloud_call'").select("path", "start_line", "end_line", field("source").alias("source"), field("target").alias("target"))
    # Only files that bind something are looked at.
    e = edges.unionByName(calls).join(bound.select("path").distinct(), "path", "left_semi").distinct()
    receiver = F.regexp_extract("target", r"(\w+)\.\w+$", 1)
    e = e.withColumn("method", F.substring_index("target", ".", -1)).filter(receiver != "")
    owner = F.regexp_extract("source", r"^(.*)\.\w+$", 1)
    member = F.col("target").rlike(r"^(this|self)\.\w+\.\w+$")
    scopes = F.array_distinct(F.when(member, F.array(owner, F.lit(""))).otherwise(F.array("source", owner, F.lit(""))))
    tried = e.select("*", F.posexplode(F.transform(scopes, lambda s: F.concat(s, F.lit("#"), receiver))).alias("near", "name"))
    met = tried.join(bound, ["path", "name"]).groupBy("path", "start_line", "end_line", "source", "target", "method").agg(F.min_by("family", "near").alias("family"))
    met = met.join(families(spark), "family").join(operations(spark), ["service_name", "method"])
    columns = ["path", "start_line", "end_line", "source", "target", "provider", "resource_type", "service_name", "operation", "operation_kind", "sdk"]
    made = facts.filter("kind = 'cloud_operation'").select("path", "start_line", "end_line", *(field(n).alias(n) for n in ("source", "target", "service_name", "operation", "sdk")))
    kinds = operations(spark).select("service_name", "operation", "operation_kind").distinct()
    made = made.join(families(spark).select("service_name", "provider", "resource_type").distinct(), "service_name").join(kinds, ["service_name", "operation"])
    return met.select(*columns).unionByName(made.select(*columns))


def edge_kind(operation_kind: Column) -> Column:
    """What a flow edge of an operation is."""
    return F.create_map(*(F.lit(x) for kv in EDGE_KINDS.items() for x in kv))[operation_kind]


def with_cloud(facts: DataFrame) -> DataFrame:
    """The same facts with a `cloud_fact` for each cloud operation, whose flow edge takes its kind; what served to find these goes.

    Facts are read several times: they should come from a written table.
    """
    from latticework.sources.folders import checkpointed

    calls = checkpointed(cloud_calls(facts))
    names = ["source", "provider", "resource_type", "service_name", "operation", "operation_kind", "sdk"]
    told = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.col, names)))
    found = calls.select(F.lit("cloud_fact").alias("kind"), "path", "start_line", "end_line", told.alias("fields"))
    kinds = calls.groupBy("path", "start_line", "end_line", F.col("source").alias("_s"), F.col("target").alias("_t")).agg(F.min(edge_kind(F.col("operation_kind"))).alias("_kind"))
    rest = facts.filter(~F.col("kind").isin(*KINDS))
    edges = rest.filter("kind = 'flow_edge'").withColumn("_s", F.col("fields")["from_symbol"]).withColumn("_t", F.col("fields")["to_symbol"])
    edges = edges.join(kinds, ["path", "start_line", "end_line", "_s", "_t"], "left")
    changed = F.map_concat(F.map_filter("fields", lambda k, _: k != "edge_kind"), F.create_map(F.lit("edge_kind"), F.col("_kind")))
    edges = edges.withColumn("fields", F.when(F.col("_kind").isNotNull(), changed).otherwise(F.col("fields")))
    return rest.filter("kind <> 'flow_edge'").unionByName(edges.select(*rest.columns)).unionByName(found)
