"""Extraction from files of every kind, scans, the catalog and counters."""

import json

import pytest
from pyspark.sql import functions as F

from latticework.sources import catalog, extract, scanning
from latticework.streaming import counters
from tests.conftest import rows

FILES = {
    "OrderController.java": '''
@RestController @RequestMapping("/orders")
public class OrderController {
  // repository.save(x) in a comment
  @PostMapping("/{id}/pay") @Transactional
  public void pay(String id) { repository.save(id); rabbitTemplate.convertAndSend("ex", "order.paid"); restTemplate.postForObject("http://payments/charge", id); throw new OrderNotFoundException(); }
  @ExceptionHandler(OrderNotFoundException.class)
  public Response on(OrderNotFoundException e) { return Response.status(HttpStatus.NOT_FOUND).body(e.getMessage()); }
  @RabbitListener(queues = "stock.low")
  public void low(String m) { repository.find(m); }
}
''',
    "main.go": '''
func main() { v1 := r.Group("/v1"); v1.GET("/items", ListItems) }
func ListItems(w http.ResponseWriter, r *http.Request) { http.Get("http://stock:8080/levels?x=1"); http.Error(w, err.Error(), http.StatusNotFound); os.Getenv("DB_URL"); ch.Publish("ex", "item.listed") }
''',
    "app.ts": '''
import express from "express";
const app = express();
app.post('/carts', createCart);
async function createCart(req, res) { await axios.put('http://prices/quote'); channel.sendToQueue('cart.created', x); res.status(409).json({ e: err.message }); client.variation('new-cart', u, false); process.env.REGION }
''',
    "tasks.py": 'import os, requests\n@app.get("/health")\ndef health():\n    os.getenv("MODE")\n    return requests.get("http://inventory/ping")\n',
    "api.proto": "service Stock { // none\n  rpc Reserve (Req) returns (stream Res);\n}\n",
    "schema.graphql": "type Mutation { pay(id: ID!): Order! }\n",
    "V1__x.sql": "-- DROP TABLE a;\nCREATE TABLE shop.orders (id int);\nALTER TABLE orders DROP COLUMN note;\n",
    "changes.xml": '<changeSet><!-- <dropTable tableName="z"/> --><addColumn tableName="orders"/></changeSet>',
    "main.tf": 'resource "aws_s3_bucket" "files" {\n  bucket = "shop-files"\n  acl = "public-read"\n}\nresource "aws_s3_bucket_versioning" "v" {\n  bucket = aws_s3_bucket.files.id\n}\nresource "aws_sqs_queue" "q" {\n  name = "jobs-${var.env}"\n}\n',
    "stack.yaml": "Resources:\n  Jobs:\n    Type: AWS::SQS::Queue\n    Properties:\n      QueueName: jobs\n",
    "deploy.yaml": "kind: Deployment\nmetadata:\n  name: web\nspec:\n  template:\n    spec:\n      containers:\n        - name: app\n          image: x\n          envFrom:\n            - configMapRef:\n                name: shared\n          env:\n            - name: URL\n              valueFrom:\n                configMapKeyRef:\n                  name: conf\n                  key: url\n---\nkind: ConfigMap\nmetadata:\n  name: conf\ndata:\n  other: x\n",
    "api.json": json.dumps({"openapi": "3.0.0", "paths": {"/carts": {"post": {"operationId": "create", "responses": {"201": {}, "409": {}}}}}}),
    "broken.py": "def (:",
    "empty.go": "",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([*FILES.items(), ("null.go", None)], "path string, text string")
    return extract.extract(files).cache()


def test_entrypoints(facts):
    got = rows(extract.facts_of(facts, "entrypoint", "transport", "method", "name", "symbol"), "transport", "method", "name", "symbol")
    assert got == sorted([("http", "POST", "/orders/{id}/pay", "OrderController.pay"), ("message", "CONSUME", "stock.low", "OrderController.low"), ("http", "GET", "/v1/items", "ListItems"), ("http", "POST", "/carts", "createCart"), ("http", "GET", "/health", "health"), ("rpc", "STREAM", "Stock/Reserve", "Stock.Reserve"), ("graphql", "MUTATION", "pay", "Mutation.pay")], key=str)


def test_calls_messages_errors_and_settings(facts):
    assert rows(extract.facts_of(facts, "service_call", "source", "target_service", "target_method", "target_path"), "target_service", "target_method", "target_path") == [("inventory", "GET", "/ping"), ("payments", "POST", "/charge"), ("prices", "PUT", "/quote"), ("stock", "GET", "/levels")]
    assert rows(extract.facts_of(facts, "message_contract", "direction", "channel"), "direction", "channel") == [("consumes", "stock.low"), ("publishes", "cart.created"), ("publishes", "item.listed"), ("publishes", "order.paid")]
    errors = rows(extract.facts_of(facts, "error_contract", "role", "transport_code", "error_kind", "exposes_internal_detail"), "role", "transport_code", "error_kind", "exposes_internal_detail")
    assert errors == sorted([("maps", "404", "not_found", "true"), ("maps", "404", "not_found", "true"), ("maps", "409", "conflict", "true"), ("raises", None, "not_found", None)], key=str)
    assert rows(extract.facts_of(facts, "configuration", "config_key"), "config_key") == [("DB_URL",), ("MODE",), ("REGION",)]
    assert rows(extract.facts_of(facts, "feature_flag", "flag_key"), "flag_key") == [("new-cart",)]
    edges = extract.facts_of(facts, "flow_edge", "from_symbol", "to_symbol", "edge_kind")
    assert ("OrderController.pay", "repository.save", "writes") in rows(edges, "from_symbol", "to_symbol", "edge_kind")
    assert edges.filter("to_symbol = 'repository.save'").count() == 1
    assert rows(extract.facts_of(facts, "boundary", "source", "boundary"), "source", "boundary") == [("OrderController.pay", "transaction")]


def test_declarations(facts):
    assert rows(extract.facts_of(facts, "migration", "operation", "table_name", "destructive"), "operation", "table_name", "destructive") == [("add_column", "orders", "false"), ("create_table", "orders", "false"), ("drop_column", "orders", "true")]
    iac = {(r["logical_name"], r["source_format"]): (r["physical_name"], json.loads(r["attributes"])) for r in extract.facts_of(facts, "iac_resource", "logical_name", "source_format", "physical_name", "attributes").collect()}
    assert iac["files", "terraform"][0] == "shop-files" and iac["files", "terraform"][1]["versioning_configured"] == "true" and iac["files", "terraform"][1]["acl"] == "public-read"
    assert iac["q", "terraform"][0] is None and iac["Jobs", "cloudformation"][0] == "jobs"
    assert rows(extract.facts_of(facts, "k8s_binding", "environment_key", "source_name", "source_key", "container_name"), "environment_key", "source_name", "source_key", "container_name") == [("URL", "conf", "url", "app")]
    assert rows(extract.facts_of(facts, "k8s_import", "source_name"), "source_name") == [("shared",)]
    assert rows(extract.facts_of(facts, "openapi", "name", "statuses"), "name", "statuses") == [("/carts", "201,409")]


def test_key_mismatches_and_unknown_sources(facts):
    from latticework.operators.relational import key_mismatches

    bindings = extract.facts_of(facts, "k8s_binding", "environment_key", "source_kind", "source_name", "source_key")
    sources = extract.facts_of(facts, "k8s_source", "source_kind", "source_name", "keys").withColumn("keys", F.from_json("keys", "array<string>"))
    mismatch, unknown = key_mismatches(bindings, sources.drop("path", "evidence"))
    assert rows(mismatch, "environment_key") == [("URL",)] and unknown.collect() == []


def test_calls_resolve_to_the_only_symbol(spark):
    edges = spark.createDataFrame([("a", "svc.charge"), ("a", "x.run")], "from_symbol string, to_symbol string")
    symbols = spark.createDataFrame([("Payments.charge",), ("A.run",), ("B.run",)], "symbol string")
    assert rows(extract.resolved_calls(edges, symbols), "to_symbol") == [("Payments.charge",), ("x.run",)]


def test_services_get_unique_names(spark):
    marks = [("shop/api/go.mod", "go", 4), ("shop/api/sub/go.mod", "go", 4), ("bank/api/package.json", "node", 1), ("Web App!/package.json", "node", 1)]
    got = rows(scanning.services(spark.createDataFrame(marks, "path string, stack string, priority int")), "root", "name")
    assert got == [("Web App!", "web-app"), ("bank/api", "bank-api"), ("shop/api", "shop-api")]


def test_files_commands_excerpts_and_digests(spark, tmp_path):
    (tmp_path / ".github/workflows").mkdir(parents=True)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".github/workflows/ci.yml").write_text("steps:\n  - run: npm test\n  - run: echo ${{ secrets.X }}\n  - run: |\n      multi\n  - run: ls\n")
    (tmp_path / "node_modules/x.py").write_text("x")
    (tmp_path / "a.py").write_text("class A:\n  pass\ntoken = 'abc'\n")
    (tmp_path / "big.py").write_text("x" * 300_001)
    files = scanning.files(spark, str(tmp_path))
    assert rows(files, "path") == [(".github/workflows/ci.yml",), ("a.py",)]
    assert rows(scanning.workflow_commands(files), "line", "command", "kind") == [(2, "npm test", "test")]
    assert rows(scanning.secret_findings(files, "path"), "path", "line", "kind") == [("a.py", 3, "hardcoded_secret")]
    assert scanning.excerpt(files.filter("path = 'a.py'"), F.lit(2), 1).collect()[0]["excerpt"] == "class A:\n  pass\ntoken = 'abc'"
    d = scanning.digest(files.withColumn("service", F.lit("s")), "1", "service").collect()
    assert d[0]["digest"] != scanning.digest(files.withColumn("service", F.lit("s")), "2", "service").collect()[0]["digest"]


def test_catalog_life_cycles(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/warehouse")
    api = lambda *r: spark.createDataFrame(list(r), "id long, service_id long, method string, path string, summary string")
    c.upsert("apis", api((1, 1, "GET", "/a", "old"), (2, 1, "GET", "/b", "x"), (3, 2, "GET", "/c", "y")), ["service_id", "method", "path"])
    c.upsert("apis", api((1, 1, "GET", "/a", "new")), ["service_id", "method", "path"])
    assert rows(c.read("apis"), "path", "summary") == [("/a", "new"), ("/b", "x"), ("/c", "y")]
    c.prune("apis", api((0, 1, "GET", "/a", "")), ["service_id", "method", "path"], within=api((0, 1, "", "", "")))
    assert rows(c.read("apis"), "path") == [("/a",), ("/c",)]
    c.replace("apis", api((0, 1, "", "", "")), api((9, 1, "PUT", "/z", None)))
    assert rows(c.read("apis"), "path") == [("/c",), ("/z",)]
    c.overwrite("services", spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, repository_id long, name string"))
    c.overwrite("service_calls", spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "id long, from_service_id long, to_service_id long"))
    c.backup(f"file://{tmp_path}/copy")
    c.delete_services(spark.createDataFrame([(2,)], "id long"))
    assert rows(c.read("services"), "name") == [("a",)] and rows(c.read("apis"), "path") == [("/z",)]
    assert rows(c.read("service_calls"), "id", "to_service_id") == [(1, None)]
    c.restore(f"file://{tmp_path}/copy")
    assert rows(c.read("services"), "name") == [("a",), ("b",)]
    with pytest.raises(FileNotFoundError):
        c.restore(f"file://{tmp_path}/nothing")
    files = lambda *r: spark.createDataFrame(list(r), "file_path string, content_hash string")
    assert rows(catalog.changed_files(files(("a", "1"), ("b", "1"), ("c", "1")), files(("a", "1"), ("b", "2"), ("d", "1")))) == [("b", "changed"), ("c", "removed"), ("d", "new")]
    found = catalog.find_or_create(spark.createDataFrame([(5, "x", "/x")], "id long, name string, root_path string"), spark.createDataFrame([("y", "/x"), ("z", "/z")], "name string, root_path string"), "root_path", "name")
    assert rows(found, "name", "id") == [("y", 5), ("z", 6)]


OBSERVED = [
    (1, "otel", '{"from": "a", "to": "b", "kind": "invokes", "count": 2}'), (1, "broker", '{"from": "a", "to": "b", "kind": "invokes", "count": 1}'), (1, "otel", '{"from": "a", "to": "b", "kind": "invokes", "count": 1, "more": 1}'),
    (1, "otel", '{"from": "a", "to": "b", "kind": "strange", "count": 1}'), (1, "otel", '{"from": "a", "to": "b", "kind": "reads", "count": 0}'), (1, "other", '{"from": "a", "to": "b", "kind": "reads", "count": 1}'), (1, "otel", None), (1, "otel", "no json"),
]


def observed(spark):
    return spark.createDataFrame(OBSERVED, "service_id long, source string, observation string").withColumn("ts", F.timestamp_seconds(F.lit(0)))


def test_counters_accept_only_valid_observations(spark):
    assert tuple(counters.accepted(observed(spark)).collect()[0]) == (2, 6)
    assert rows(counters.merged(counters.parsed(observed(spark))), "source", "observed_count") == [("broker", 1), ("otel", 2)]


def test_stream_equals_batch_and_replays_add_up(spark, tmp_path):
    path = f"{tmp_path}/in"
    observed(spark).write.parquet(path)
    stream = lambda: spark.readStream.schema(observed(spark).schema).parquet(path)
    q = counters.live(stream(), "counted", f"{tmp_path}/cp1")
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counted"), "source", "observed_count") == [("broker", 1), ("otel", 2)]
    c = catalog.Catalog(spark, f"file://{tmp_path}/wh")
    seen = []
    static = spark.createDataFrame([(1, "a", "c", "invokes")], "service_id long, from_symbol string, to_symbol string, kind string")
    for turn in ("cp2", "cp3"):
        counters.into_catalog(stream(), c, f"{tmp_path}/{turn}", static, lambda d: seen.append(rows(d, "to_symbol", "state"))).awaitTermination()
    assert rows(c.read("runtime_flow_observations"), "source", "observed_count") == [("broker", 2), ("otel", 4)]
    assert seen[-1] == [("b", "observed_only"), ("c", "static_only")]


def test_stacks_and_kinds(spark):
    from latticework.sources import stacks

    files = [
        ("shop/web/package.json", '{"scripts": {"start": "node ."}, "dependencies": {"express": "4"}}'), ("shop/lib/package.json", '{"dependencies": {"express": "4"}}'), ("shop/py/requirements.txt", "FastAPI==1\n"), ("shop/j/pom.xml", "<artifactId>spring-boot-starter</artifactId>"),
        ("shop/go/go.mod", "module x"), ("shop/go/cmd/app/main.go", "package main"), ("shop/golib/go.mod", "module y"), ("shop/web/src/a.ts", ""),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    found = stacks.discovered(df)
    assert rows(found, "root", "stack") == [("shop/go", "go"), ("shop/j", "jvm"), ("shop/py", "python"), ("shop/web", "node")]
    assert rows(stacks.prefixed_owner(df.filter("path LIKE '%a.ts' OR path LIKE 'shop/lib%'"), found), "path", "owner") == [("shop/lib/package.json", None), ("shop/web/src/a.ts", "web")]


def test_kinds_of_targets_by_name(spark):
    from latticework.sources import stacks

    names = spark.createDataFrame([("Stripe API",), ("jobs-service",), ("who knows",), ("BILLING-service",), ("GitHub",), ("aws lambda",), ("x-worker",), (" ",), (None,), ("my_bucket S3",)], "name string")
    kinds = {r["name"]: r["kind"] for r in stacks.resource_type(names).collect()}
    assert kinds == {"Stripe API": "saas", "jobs-service": "unknown", "who knows": "unknown", "BILLING-service": "unknown", "GitHub": "saas", "aws lambda": "compute", "x-worker": "unknown", " ": "unknown", None: "unknown", "my_bucket S3": "storage"}
    services = spark.createDataFrame([("billing-service",), ("orders",), (None,)], "name string")
    got = {r["name"]: r["target_kind"] for r in stacks.target_kinds(names, services).collect()}
    assert got == {"Stripe API": "external", "jobs-service": "internal", "who knows": "unknown", "BILLING-service": "internal", "GitHub": "external", "aws lambda": "external", "x-worker": "unknown", " ": "unknown", None: "unknown", "my_bucket S3": "external"}
    assert {r["target_kind"] for r in stacks.target_kinds(names, services.limit(0)).filter("name IN ('jobs-service', 'x-worker')").collect()} == {"unknown"}


def test_kinds_of_commands_are_whole_words(spark):

    commands = {"npm i x@latest": None, "make rebuild-docs": None, "npm test": "test", "go test ./...": "test", "./gradlew flywayMigrate": None, "flyway migrate && test": "migration", "buf generate": "client_generation", "docker BUILD .": "build", "mvn package": "build", "go vet": None}
    df = spark.createDataFrame([(c,) for c in commands], "c string")
    assert {r["c"]: r["k"] for r in df.select("c", scanning.command_kind(F.col("c")).alias("k")).collect()} == commands
    flow = ".github/workflows/sub/ci.yaml"
    text = "\n".join(["run: 'npm test'", "- run: npm test --token x", "run: |", "run: >-", "run: build ${{ matrix.x }}", "run: make"])
    assert rows(scanning.workflow_commands(spark.createDataFrame([(flow, text), ("ci.yaml", "run: npm test")], "path string, text string"))) == [(flow, 1, "npm test", "test")]


def test_templates_of_charts(spark):

    files = [("chart/Chart.yaml", "name: x"), ("chart/templates/a.yaml", "kind: Deployment"), ("chart/templates/sub/b.yaml", "kind: Service"), ("other/templates/c.yaml", "kind: Job"), ("k8s/d.yaml", "name: {{ .Values.x }}"), ("k8s/e.yaml", None), ("templates/f.yaml", "kind: Job")]
    df = spark.createDataFrame(files, "path string, text string")
    assert [p for p, h in rows(scanning.with_helm_marks(df), "path", "helm") if h] == ["chart/templates/a.yaml", "chart/templates/sub/b.yaml", "k8s/d.yaml"]
    at_root = df.unionByName(spark.createDataFrame([("Chart.yaml", "")], "path string, text string"))
    assert rows(scanning.with_helm_marks(at_root).filter("path = 'templates/f.yaml'"), "helm") == [(True,)]


def test_exports(spark, tmp_path):
    from latticework.sources import export

    edges = spark.createDataFrame([("a-b", "c", "http"), ("c", "a-b", "channel:paid")], "source string, target string, via string")
    d = export.topology(edges, spark.createDataFrame([("c",)], "service string")).collect()[0]["diagram"]
    assert d.splitlines() == ["flowchart LR", '  a_b["a-b"]', '  c["c"]', "  a_b -->|http| c", "  c -. paid .-> a_b", "  style c stroke:#c00"]
    p = spark.createDataFrame([(1, "orders", '[{"name": "id", "type": "int"}]')], "service_id long, name string, schema_json string")
    assert export.entities(p).collect()[0]["diagram"].splitlines() == ["erDiagram", "  orders {", "    int id", "  }"]
    services = spark.createDataFrame([(1, "a", "does a")], "id long, name string, short_desc string")
    apis = spark.createDataFrame([(1, "GET", "/x", None)], "service_id long, method string, path string, summary string")
    pages = export.pages(services, apis)
    assert rows(pages, "path") == [("a/GET__x.md",), ("a/index.md",)]
    export.written(pages, f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() > 2


def test_versions_marks_and_repeated_rows(spark, tmp_path):
    from latticework.sources import catalog as catalogs

    c = catalogs.Catalog(spark, f"file://{tmp_path}/catalog")
    ci = lambda *r: spark.createDataFrame(list(r), "repository_id long, kind string")
    c.overwrite("ci_commands", ci((1, "test"), (1, "test"), (2, "build")), "first")
    assert c.mark("ci_commands") == "first" and c.mark("services") is None
    c.prune("ci_commands", ci((1, "test")), ["repository_id", "kind"], ci((1, "")), "repository_id")
    assert rows(c.read("ci_commands"), "repository_id", "kind") == [(1, "test"), (1, "test"), (2, "build")] and c.mark("ci_commands") is None
    assert c.vacuum("ci_commands") == 1 and c.read("ci_commands").count() == 3
    now = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "id long, v string")
    assert rows(catalogs.upserted(now, new, ["id"])) == [(1, "a"), (2, "y"), (3, "z")]
