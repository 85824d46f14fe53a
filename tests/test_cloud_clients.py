"""Cloud operations on bound names in four languages, and the fixpoint of names, against hand-made cases and brute force."""

import random

import pytest

from latticework.operators import binding
from latticework.sources import extract
from tests.conftest import rows

GO = 'package publisher\n\nimport "github.com/aws/aws-sdk-go-v2/service/sqs"\n\n'
JAVA = "import software.amazon.awssdk.services.sqs.SqsClient;\n\n"
#: path: (text, {(source, service, operation, kind, sdk)}, {(source, target, edge kind)})
CASES = {
    "a/param.go": (GO + "func Publish(client *sqs.Client, body string) {\n\tclient.SendMessage(ctx, &sqs.SendMessageInput{})\n}\n", {("Publish", "sqs", "SendMessage", "publish", "aws-sdk-go-v2")}, {("Publish", "client.SendMessage", "publishes")}),
    "a/field.go": (
        GO + "type OrderHandler struct {\n\tsqsClient *sqs.Client\n}\n\nfunc (h *OrderHandler) CreateOrder(body string) error {\n\t_, err := h.sqsClient.ReceiveMessage(ctx, &sqs.ReceiveMessageInput{})\n\treturn err\n}\n",
        {("OrderHandler.CreateOrder", "sqs", "ReceiveMessage", "consume", "aws-sdk-go-v2")}, {("OrderHandler.CreateOrder", "h.sqsClient.ReceiveMessage", "consumes")},
    ),
    "a/two.go": (
        GO + "func A(client *sqs.Client) {\n\tclient.SendMessage(ctx)\n}\n\nfunc B(client *other.Client) {\n\tclient.SendMessage(ctx)\n}\n\nfunc C(client *sqs.Client) {\n\tclient.Close(ctx)\n}\n",
        {("A", "sqs", "SendMessage", "publish", "aws-sdk-go-v2")}, {("A", "client.SendMessage", "publishes")},
    ),
    "a/wrong.go": ('package p\n\nimport "example.com/internal/sqs"\n\nfunc Publish(client *sqs.Client) {\n\tclient.SendMessage(ctx)\n}\n', set(), set()),
    "a/alias.go": (
        'package p\n\nimport (\n\tq "github.com/aws/aws-sdk-go-v2/service/sns"\n\t"fmt"\n)\n\nfunc Publish() {\n\tclient := q.NewFromConfig(cfg)\n\tsecond := client\n\tthird := second\n\tthird.Publish(ctx)\n}\n',
        {("Publish", "sns", "Publish", "publish", "aws-sdk-go-v2")}, {("Publish", "third.Publish", "publishes")},
    ),
    "a/chain.go": (
        'package p\n\nimport "cloud.google.com/go/pubsub"\n\nfunc Publish(client *pubsub.Client, body string) {\n\ttopic := client.Topic("orders")\n\ttopic.Publish(ctx, &pubsub.Message{})\n\tthing := client.Other("x")\n\tthing.Publish(ctx)\n}\n',
        {("Publish", "pubsub", "Publish", "publish", "gcp-pubsub-go")}, {("Publish", "topic.Publish", "publishes")},
    ),
    "a/Publisher.java": (
        JAVA + "public class Publisher {\n    private final SqsClient sqsClient;\n    private final SqsClient copy;\n    Publisher(SqsClient given) { this.sqsClient = given; this.copy = given; }\n    public void send(String body) {\n        sqsClient.sendMessage(body);\n        this.copy.deleteMessage(body);\n    }\n    public void local() { SqsClient other = sqsClient; other.receiveMessage(); }\n}\n",
        {("Publisher.send", "sqs", "SendMessage", "publish", "aws-sdk-java-v2"), ("Publisher.send", "sqs", "DeleteMessage", "consume", "aws-sdk-java-v2"), ("Publisher.local", "sqs", "ReceiveMessage", "consume", "aws-sdk-java-v2")},
        {("Publisher.send", "sqsClient.sendMessage", "publishes"), ("Publisher.send", "this.copy.deleteMessage", "consumes"), ("Publisher.local", "other.receiveMessage", "consumes")},
    ),
    "a/Old.java": ("import com.amazonaws.services.sqs.AmazonSQSClient;\npublic class Old {\n    private AmazonSQSClient sqs;\n    void send() { sqs.sendMessage(1); }\n}\n", {("Old.send", "sqs", "SendMessage", "publish", "aws-sdk-java-v1")}, {("Old.send", "sqs.sendMessage", "publishes")}),
    "a/Fake.java": ("import com.example.internal.SqsClient;\npublic class Fake {\n    private final SqsClient sqsClient;\n    void send() { sqsClient.sendMessage(1); }\n}\n", set(), set()),
    "a/Bare.java": ("public class Bare {\n    private final SqsClient sqsClient;\n    void send() { sqsClient.sendMessage(1); }\n}\n", set(), set()),
    "a/Pub.kt": (JAVA.replace(";", "") + "class Pub(private val sqsClient: SqsClient) {\n  fun send(body: String) {\n    sqsClient.sendMessage(body)\n  }\n}\n", {("Pub.send", "sqs", "SendMessage", "publish", "aws-sdk-java-v2")}, {("Pub.send", "sqsClient.sendMessage", "publishes")}),
    "a/Hub.java": ("import com.azure.messaging.eventhubs.EventHubProducerClient;\nclass Hub {\n  private final EventHubProducerClient producer;\n  void emit(Object b) { producer.sendBatch(b); }\n}\n", {("Hub.emit", "event_hub", "SendBatch", "publish", "azure-eventhub")}, {("Hub.emit", "producer.sendBatch", "publishes")}),
    "a/command.ts": (
        'import { SQSClient, SendMessageCommand as Send } from "@aws-sdk/client-sqs";\nimport { PutObjectCommand } from "./local";\nasync function publish(body) {\n  await sqs.send(new Send({}));\n  await s3.send(new PutObjectCommand({}));\n}\n',
        {("publish", "sqs", "SendMessage", "publish", "aws-sdk-js-v3")}, {("publish", "Send", "publishes")},
    ),
    "a/blob.ts": ('import { BlobServiceClient } from "@azure/storage-blob";\nconst client = new BlobServiceClient(url);\nasync function put(data) {\n  await client.uploadData(data);\n}\n', {("put", "blob_storage", "Upload", "write", "azure-storage-blob")}, {("put", "client.uploadData", "writes")}),
    "a/fakeblob.ts": ('import { BlobServiceClient } from "./fake";\nconst client = new BlobServiceClient(url);\nasync function put(data) {\n  await client.upload(data);\n}\n', set(), set()),
    "a/bus.ts": (
        'import { ServiceBusClient } from "@azure/service-bus";\nconst bus = new ServiceBusClient(url);\nexport async function publish(body) {\n  const sender = bus.createSender("q");\n  await sender.sendMessages(body);\n  const odd = bus.makeSender("q");\n  await odd.sendMessages(body);\n}\nasync function outside() {\n  await sender.sendMessages(1);\n}\n',
        {("publish", "service_bus", "SendMessages", "publish", "azure-servicebus")}, {("publish", "sender.sendMessages", "publishes")},
    ),
    "a/boto.py": (
        "import boto3\n\nsqs = boto3.client('sqs')\n\ndef publish(body):\n    sqs.send_message(MessageBody=body)\n    other.send_message(body)\n\nclass A:\n    def __init__(self):\n        self.s3 = boto3.resource('s3')\n    def put(self):\n        self.s3.put_object(Key=1)\n",
        {("publish", "sqs", "SendMessage", "publish", "boto3"), ("put", "s3", "PutObject", "write", "boto3")}, set(),
    ),
    "a/top.py": ("import boto3 as b\nk = b.client('kinesis')\nn = k\nn.put_record(Data=1)\nz = b.client('lambda')\nz.publish()\n", {(None, "kinesis", "PutRecord", "publish", "boto3")}, set()),
    "a/broken.py": ("import boto3\ndef broken(:\n", set(), set()),
}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([(p, t) for p, (t, *_) in CASES.items()], "path string, text string")
    return extract.extract(files).cache()


def test_operations_of_bound_names(facts):
    found = {p: set() for p in CASES}
    for r in extract.facts_of(facts, "cloud_fact", "source", "service_name", "operation", "operation_kind", "sdk").collect():
        found[r["path"]].add((r["source"], r["service_name"], r["operation"], r["operation_kind"], r["sdk"]))
    for path, (_, want, _) in CASES.items():
        assert found[path] == want, path
    types = {(r["provider"], r["service_name"], r["resource_type"]) for r in extract.facts_of(facts, "cloud_fact", "provider", "service_name", "resource_type").collect()}
    assert {("aws", "sqs", "queue"), ("gcp", "pubsub", "pubsub"), ("azure", "blob_storage", "object_storage"), ("azure", "event_hub", "stream")} <= types
    assert not {r["kind"] for r in facts.select("kind").distinct().collect()} & {"cloud_bound", "cloud_alias", "cloud_call", "cloud_operation"}


def test_edges_take_the_kind_of_their_operation(facts):
    kinds = {(r["path"], r["from_symbol"], r["to_symbol"]): r["edge_kind"] for r in extract.facts_of(facts, "flow_edge", "from_symbol", "to_symbol", "edge_kind").collect()}
    for path, (_, _, edges) in CASES.items():
        for source, target, kind in edges:
            assert kinds[path, source, target] == kind, (path, source, target)
    where = {r["path"]: r["evidence"]["start_line"] for r in extract.facts_of(facts, "cloud_fact").collect()}
    assert where["a/param.go"] == 6 and where["a/top.py"] == 4


def test_bound_names_equal_brute_force(spark):
    r = random.Random(11)
    bases = [(f"f{r.randrange(4)}", f"n{r.randrange(40)}", r.choice("xyz")) for _ in range(30)] + [("f0", None, "x"), ("f0", "n1", None), (None, "n1", "x")]
    aliases = [(f"f{r.randrange(4)}", f"n{r.randrange(40)}", f"n{r.randrange(40)}", r.choice([None, "make", "other"])) for _ in range(160)] + [("f1", None, "n2", None), ("f1", "n2", None, None)]
    aliases += [("f9", f"c{i + 1}", f"c{i}", None) for i in range(30)]
    bases.append(("f9", "c0", "x"))
    factories = [("x", "make", "y"), ("y", "other", "x")]
    known = {b for b in bases if b[1] is not None and b[2] is not None}
    while True:
        new = {(f, to, fam if m is None else dict(((a, b), c) for a, b, c in factories).get((fam, m))) for f, to, source, m in aliases for g, name, fam in known if f == g and name == source and to}
        new = {n for n in new if n[2] is not None} - known
        if not new:
            break
        known |= new
    want = {k for k in known if len({x[2] for x in known if x[:2] == k[:2]}) == 1}
    got = binding.bound_names(
        spark.createDataFrame(bases, "file string, name string, family string"), spark.createDataFrame(aliases, "file string, name string, source string, method string"),
        spark.createDataFrame(factories, "family string, method string, made string"), ["file"],
    )
    assert set(rows(got, "file", "name", "family")) == want and len(want) > 20 and ("f9", "c30", "x") in want
