"""Queues from files to deliveries, and HTTP contract units, against hand-made cases and brute force."""

import json
import random

from pyspark.sql import functions as F

from latticework.plans import indexing, review
from latticework.sources import catalog, extract, queues
from tests.conftest import rows

FILES = {
    "a/consumer.go": (
        "package orders\n\nfunc consume(channel *amqp.Channel) {\n"
        '  channel.ExchangeDeclare("orders", "topic", true)\n'
        '  channel.QueueDeclare("orders.created", true, false, false, false, amqp.Table{"x-dead-letter-routing-key": "orders.dlq", "x-message-ttl": 5000})\n'
        '  channel.QueueBind("orders.created", "order.created", "orders", false, nil)\n  other.QueueBind("orders.created", "no", "orders", false, nil)\n'
        '  channel.Consume("orders.created", "", false, false, false, false, nil)\n}\n\n'
        'func publish(channel *amqp.Channel, event Order) error {\n  return channel.PublishWithContext(ctx, "orders", "order.paid", false, false, amqp.Publishing{})\n}\n'
    ),
    "b/QueueConfig.java": (
        'class QueueConfig {\n  Queue orderQueue() { return new Queue("orders.paid"); }\n  TopicExchange orderExchange() { return new TopicExchange("orders"); }\n'
        '  Binding orderBinding() { return BindingBuilder.bind(orderQueue()).to(orderExchange()).with("order.*"); }\n'
        '  Queue slow() { return QueueBuilder.durable("orders.slow").deadLetterExchange("dead").deadLetterRoutingKey("late").ttl(60_000).build(); }\n'
        '  FanoutExchange all() { return new FanoutExchange("all"); }\n  Binding b() { return BindingBuilder.bind(slow()).to(all()); }\n'
        '  Binding c() { return BindingBuilder.bind(unknown()).to(all()); }\n}\n'
        'class OrderListener {\n  @RabbitListener(queues = "orders.paid")\n  void consume(OrderCreated message) { orderService.handle(message); }\n}\n'
    ),
    "c/Config.kt": 'class Config {\n  fun q() = Queue("k")\n  fun e() = DirectExchange("direct")\n  fun b() = BindingBuilder.bind(q()).to(e()).with("k.1")\n}\n',
    "d/app.js": (
        'channel.assertExchange("all", "fanout");\nchannel.assertQueue("node.q", { durable: true, deadLetterRoutingKey: "node.dead", messageTtl: 100 });\nchannel.bindQueue("node.q", "all", "");\nchannel.bindQueue(name, "all", "");\n'
        'function send() {\n  channel.publish("direct", "k.1", body);\n  channel.sendToQueue("node.q", body);\n  channel.publish("all", "anything", body);\n}\n'
    ),
}


def test_queues_of_files(spark):
    facts = extract.extract(spark.createDataFrame(list(FILES.items()), "path string, text string")).cache()
    by = facts.withColumn("service", F.substring("path", 1, 1))
    got = {(r["service"], r["queue"]): r for r in queues.queue_contracts(by, ["service"]).collect()}
    bound = {k: [tuple(b) for b in r["bindings"]] for k, r in got.items() if r["bindings"]}
    assert bound == {("a", "orders.created"): [("orders", "order.created")], ("b", "orders.paid"): [("orders", "order.*")], ("b", "orders.slow"): [("all", "")], ("c", "k"): [("direct", "k.1")], ("d", "node.q"): [("all", "")]}
    options = {k: (r["dead_letter_routing_key"], r["dead_letter_exchange"], r["retry_delay_ms"]) for k, r in got.items()}
    assert options["a", "orders.created"] == ("orders.dlq", None, 5000) and options["b", "orders.slow"] == ("late", "dead", 60000) and options["d", "node.q"] == ("node.dead", None, 100)
    field = lambda n: F.col("fields")[n].alias(n)
    kind = lambda k, *names: facts.filter(F.col("kind") == k).select(*map(field, names))
    sent = kind("message_contract", "direction", "source", "exchange", "routing_key").filter("direction = 'publishes'")
    met = queues.deliveries(sent, kind("queue_binding", "queue", "exchange", "routing_key"), kind("exchange", "exchange", "exchange_kind"))
    assert rows(met, "source", "exchange", "routing_key", "queue") == [
        ("publish", "orders", "order.paid", "orders.paid"), ("send", "", "node.q", "node.q"), ("send", "all", "anything", "node.q"), ("send", "all", "anything", "orders.slow"), ("send", "direct", "k.1", "k"),
    ]


def test_deliveries_equal_brute_force(spark):
    r = random.Random(12)
    kinds = {"t": "topic", "d": "direct", "f": "fanout", "h": "headers"}
    words = ["a", "b", "*", "#"]
    key = lambda words: ".".join(r.choice(words) for _ in range(r.randint(1, 3)))
    bindings = [(f"q{r.randrange(6)}", r.choice("tdfhu"), key(words)) for _ in range(60)] + [("q1", "f", None)]
    sent = [(i, r.choice("tdfhu"), key(["a", "b"])) for i in range(120)] + [(120, "", "q7"), (121, None, "q8"), (122, "f", None)] + [(5, "f", "a")]

    def fits(k, p):
        return (not k) if not p else any(fits(k[i:], p[1:]) for i in range(len(k) + 1)) if p[0] == "#" else bool(k) and p[0] in ("*", k[0]) and fits(k[1:], p[1:])

    want = []
    for i, exchange, k in sent:
        kind = kinds.get(exchange, "topic")
        if not exchange:
            want.append((i, k))
            continue
        want += [(i, q) for q in sorted({q for q, e, p in bindings if e == exchange and (kind == "fanout" or kind == "direct" and (p or "") == (k or "") or kind == "topic" and fits((k or "").split("."), (p or "").split(".")))})]
    got = queues.deliveries(
        spark.createDataFrame(sent, "id int, exchange string, routing_key string"), spark.createDataFrame(bindings, "queue string, exchange string, routing_key string"),
        spark.createDataFrame([*kinds.items(), ("t", "topic")], "exchange string, exchange_kind string"),
    )
    assert rows(got, "id", "queue") == sorted(want, key=str) and len(want) > 100


def test_contracts_of_calls(spark):
    services = spark.createDataFrame([(1, 1, "web"), (2, 1, "orders"), (3, 2, "orders"), (4, 2, "stock")], "id long, repository_id long, name string")
    at = {"file": "a.ts", "start_line": 1, "end_line": 1}
    call = lambda service, target, method, path, line=1: (service, "f", target, "http", method, path, at | {"start_line": line})
    calls = spark.createDataFrame(
        [call(1, "orders", "GET", "/orders/7"), call(1, "orders", "get", "/orders/8?x=1", 2), call(1, "orders", "GET", "/orders/open"), call(1, "stock", "POST", "/levels"), call(1, "stock", "POST", None), call(1, "nobody", "GET", "/a"), call(4, "orders", "GET", "/orders/1"), call(1, "orders", "DELETE", "/orders/7")],
        "service_id long, source string, target_service string, protocol string, target_method string, target_path string, evidence struct<file:string,start_line:int,end_line:int>",
    )
    endpoints = spark.createDataFrame([(2, "http", "GET", "/orders/{id}"), (2, "http", "GET", "/orders/open"), (3, "http", "GET", "/orders/:id"), (4, "http", "POST", "/levels"), (4, "message", "CONSUME", "/levels")], "service_id long, kind string, method string, name string")
    units = review.http_contract_units(calls, endpoints, services, spark.createDataFrame([("web",)], "service string"))
    assert {(r["id"], len(r["evidence"])) for r in units.collect()} == {
        ("http-contract:web:orders:GET:/orders/{id}", 2), ("http-contract:web:orders:GET:/orders/open", 1), ("http-contract:web:stock:POST:/levels", 1),
    }
    assert set(units.columns) == set(review.UNIT)


def test_contracts_routes_queues_and_generated_code_reach_the_catalog(spark, tmp_path):
    root = tmp_path / "shop"
    (root / "web").mkdir(parents=True)
    (root / "web/package.json").write_text('{"scripts": {"start": "node a.js"}, "dependencies": {"express": "4"}}')
    (root / "web/a.js").write_text("const express = require('express');\nconst app = express();\nconst items = require('./items');\napp.use('/items', login, items);\n")
    (root / "web/items.js").write_text("const { Router } = require('express');\nconst r = Router();\nr.get('/:id', check, find);\nmodule.exports = r;\nfunction find(req, res) { return 1; }\n")
    (root / "pay/src").mkdir(parents=True)
    (root / "pay/pom.xml").write_text("<artifactId>spring-boot-starter</artifactId>")
    (root / "pay/src/api.proto").write_text("service Stock {\n  rpc Reserve (Req) returns (Res);\n}\n")
    (root / "pay/src/Server.java").write_text("@GrpcService\nclass Server extends StockGrpc.StockImplBase {\n  @Override\n  public void reserve(Req r, Obs o) { o.next(r); }\n}\n")
    (root / "pay/src/Client.java").write_text("class Client {\n  private final StockGrpc.StockBlockingStub stub;\n  void call(Req r) { stub.reserve(r); }\n}\n")
    (root / "pay/src/Listen.java").write_text(FILES["b/QueueConfig.java"])
    (root / "pay/src/Orders.java").write_text('@RestController @RequestMapping("/orders")\nclass Orders {\n  @PostMapping\n  public Order create(@RequestBody @Valid CreateOrder order) { return null; }\n  @GetMapping("/{id}")\n  public Order one(String id) { return null; }\n}\n')
    (root / "pay/src/CreateOrder.java").write_text("class CreateOrder {\n  private String name;\n  private List<Line> lines;\n}\nclass Line {\n  private Integer count;\n  private CreateOrder parent;\n}\n")
    (root / "pay/openapi.json").write_text(json.dumps({"openapi": "3.0.0", "paths": {"/orders/{id}": {"get": {"operationId": "one"}}, "/orders": {"get": {}}}}))
    shop = catalog.Catalog(spark, f"file://{tmp_path}/catalog")
    indexing.index_path(spark, shop, f"file://{root}", "shop").collect()
    entries = {(r["kind"], r["method"], r["name"], r["symbol"]): r["id"] for r in shop.read("entrypoints").collect()}
    assert {k for k in entries if k[0] in ("http", "grpc", "message")} == {
        ("http", "GET", "/items/:id", "find"), ("http", "POST", "/orders", "Orders.create"), ("http", "GET", "/orders/{id}", "Orders.one"),
        ("grpc", "UNARY", "Stock/Reserve", "Server.reserve"), ("message", "CONSUME", "orders.paid", "OrderListener.consume"),
    }
    assert ("grpc", "Stock", "Reserve", "Client.call") in rows(shop.read("static_service_calls"), "protocol", "target_service", "target_method", "source")
    contracts = {r["entrypoint_id"]: json.loads(r["contract"]) for r in shop.read("entrypoint_contracts").collect()}
    of = lambda *key: contracts[entries[key]]
    assert len(contracts) == 4 and of("http", "GET", "/items/:id", "find") == {"route_middlewares": [{"symbol": "check"}]}
    assert of("message", "CONSUME", "orders.paid", "OrderListener.consume")["bindings"] == [{"exchange": "orders", "routing_key": "order.*"}]
    assert of("http", "GET", "/orders/{id}", "Orders.one")["formal_contract"]["operation_id"] == "one"
    create = of("http", "POST", "/orders", "Orders.create")
    assert create["request"] == {"name": "order", "required": True, "type": "CreateOrder"}
    assert {(f["path"], f["type"], f["state"]) for f in create["request_fields"]} == {("name", "String", "leaf"), ("lines", "Line", "nested"), ("lines.count", "Integer", "leaf"), ("lines.parent", "CreateOrder", "recursive")}


def test_emulators_and_called_definitions(spark):
    head = "services:\n  local:\n    image: localstack/localstack:3\n"
    files = {
        "a/docker-compose.yaml": head + "    environment:\n      - SERVICES=sqs, s3,lambda\n  blobs:\n    image: mcr.microsoft.com/azure-storage/azurite\n  db:\n    image: postgres:16\n",
        "b/compose.yml": head, "c/compose.yml": head + "    environment:\n      SERVICES: \"sns\"\n", "d/other.yaml": head,
        "e/f.js": "function a(x) {\n  b(x);\n  c(x);\n  b(x);\n  d.e(x);\n  gone(x);\n  a(x);\n}\nfunction b(x) { return c(x); }\nfunction c(x) { return 1; }\nfunction e(x) { return 2; }\nfunction z(x) { e(x); c(x); b(x); a(x); }\n",
    }
    facts = extract.extract(spark.createDataFrame(list(files.items()), "path string, text string")).cache()
    iac = extract.facts_of(facts, "iac_resource", "provider", "resource_type", "logical_name", "source_format")
    assert rows(iac, "path", "provider", "resource_type", "logical_name", "source_format") == sorted([
        ("a/docker-compose.yaml", "aws", "queue", "local", "compose_hint"), ("a/docker-compose.yaml", "aws", "object_storage", "local", "compose_hint"),
        ("a/docker-compose.yaml", "azure", "object_storage", "blobs", "compose_hint"), ("c/compose.yml", "aws", "pubsub", "local", "compose_hint"),
    ], key=str)
    got = {}
    for r in extract.called_definitions(facts).orderBy("place").collect():
        got.setdefault(r["caller"], []).append((r["callee"], r["start_line"]))
    assert got == {"a": [("b", 9), ("c", 10), ("e", 11)], "b": [("c", 10)], "z": [("a", 1), ("b", 9), ("c", 10)]}
