"""Queues of message brokers: what each file says of queues, exchanges and bindings, and the joins from producers to consumers.

A file tells bindings (queue, exchange, routing key), the options of queues (dead letters, delays) and the kinds of exchanges, as
literals on a proven channel or in declared factories. Joined over all files of a service they say what a consumer's queue is
bound to; joined with publications they say which queues a message reaches: in a topic exchange by the pattern of the binding
(`paths.matched_topics`), in a direct one by equal keys, in a fanout one always, and in the default exchange (no name) by the
queue's own name. An exchange whose kind nobody declares is taken to be a topic one, in which plain keys match as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import paths
from latticework.sources import routes
from latticework.sources.folders import checkpointed

Fact = tuple[str, int, int, dict[str, str]]
# How options are spelled, in code and in tables of arguments.
_DEAD_LETTER = r"(?:deadLetterRoutingKey|x-dead-letter-routing-key)['\"]?\s*(?:\(|:|=|,)\s*['\"]([^'\"]+)['\"]"
_DEAD_EXCHANGE = r"(?:deadLetterExchange|x-dead-letter-exchange)['\"]?\s*(?:\(|:|=|,)\s*['\"]([^'\"]*)['\"]"
_DELAY = r"(?:messageTtl|ttl|x-message-ttl)['\"]?\s*(?:\(|:|=|,)\s*(\d[\d_]*)"
_KINDS = ["topic", "direct", "fanout", "headers"]
_TEXT = r"['\"]([^'\"]*)['\"]"


def _options(text: str) -> dict[str, str]:
    found = {"dead_letter_routing_key": re.search(_DEAD_LETTER, text), "dead_letter_exchange": re.search(_DEAD_EXCHANGE, text), "retry_delay_ms": re.search(_DELAY, text)}
    return {k: m[1].replace("_", "") if k == "retry_delay_ms" else m[1] for k, m in found.items() if m}


def _binding(queue: str, exchange: str, key: str) -> dict[str, str]:
    return {"queue": queue, "exchange": exchange, "routing_key": key}


def _node(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    for m in re.finditer(r"\.(bindQueue|assertQueue|assertExchange)\s*\(", text):
        given, _ = routes.arguments(text, m.end() - 1)
        names = [routes.literal(g) for g in given]
        if m[1] == "bindQueue" and len(names) >= 3 and None not in names[:3]:
            yield "queue_binding", m.start(), _binding(*names[:3])
        elif m[1] == "assertQueue" and names and names[0] and len(given) > 1 and (found := _options(given[1])):
            yield "queue_options", m.start(), {"queue": names[0]} | found
        elif m[1] == "assertExchange" and len(names) > 1 and names[0] and names[1] in _KINDS:
            yield "exchange", m.start(), {"exchange": names[0], "exchange_kind": names[1]}


def _go(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    channels = set(re.findall(r"\b(\w+)\s+\*?amqp\.Channel\b", text)) | set(re.findall(r"\b(\w+)\s*,\s*\w+\s*:?=\s*\w+\.Channel\(\s*\)", text))
    for m in re.finditer(r"\b(\w+)\.(QueueBind|QueueDeclare|ExchangeDeclare)\s*\(", text):
        if m[1] not in channels:
            continue
        given, _ = routes.arguments(text, m.end() - 1)
        names = [routes.literal(g) for g in given]
        if m[2] == "QueueBind" and len(names) >= 3 and None not in names[:3]:
            yield "queue_binding", m.start(), _binding(names[0], names[2], names[1])
        elif m[2] == "QueueDeclare" and names and names[0] and (found := _options(given[-1])):
            yield "queue_options", m.start(), {"queue": names[0]} | found
        elif m[2] == "ExchangeDeclare" and len(names) > 1 and names[0] and names[1] in _KINDS:
            yield "exchange", m.start(), {"exchange": names[0], "exchange_kind": names[1]}


def _jvm(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    made: dict[str, dict[str, str]] = {"Queue": {}, "Exchange": {}}
    for kind, pattern in (("Queue", r"(?:new\s+)?(?:\w+\.)?Queue"), ("Exchange", r"(?:new\s+)?(?:\w+\.)?(?:Topic|Direct|Fanout|Headers)Exchange")):
        for m in re.finditer(rf"\b(\w+)\s*\([^()]*\)\s*(?:\{{\s*return\s+|(?::\s*[\w.<>?]+\s*)?=\s*)({pattern})\s*\(\s*\"([^\"]+)\"", text):
            made[kind][m[1]] = m[3]
            if kind == "Exchange":
                yield "exchange", m.start(), {"exchange": m[3], "exchange_kind": re.sub(r"^.*?(\w+)Exchange$", r"\1", m[2]).lower()}
    for m in re.finditer(r"\b(\w+)\s*\([^()]*\)\s*(?:\{\s*return\s+|(?::\s*[\w.<>?]+\s*)?=\s*)QueueBuilder\s*\.\s*(?:durable|nonDurable)\s*\(\s*\"([^\"]+)\"\s*\)", text):
        made["Queue"][m[1]] = m[2]
        end = re.compile(r"(?:\s*\.\s*\w+\s*\([^()]*\))*").match(text, m.end()).end()
        if found := _options(text[m.end() : end]):
            yield "queue_options", m.start(), {"queue": m[2]} | found
    for m in re.finditer(r"BindingBuilder\s*\.\s*bind\s*\(\s*(\w+)\s*(?:\(\s*\))?\s*\)\s*\.\s*to\s*\(\s*(\w+)\s*(?:\(\s*\))?\s*\)(?:\s*\.\s*with\s*\(\s*\"([^\"]*)\")?", text):
        queue, exchange = made["Queue"].get(m[1]), made["Exchange"].get(m[2])
        if queue and exchange:
            yield "queue_binding", m.start(), _binding(queue, exchange, m[3] or "")


def facts_in(language: str, text: str) -> Iterator[Fact]:
    rule = {"node": _node, "go": _go, "jvm": _jvm}[language]
    for kind, at, fields in rule(text):
        line = routes.line_at(text, at)
        yield kind, line, line, fields


# --- tables ---------------------------------------------------------------------------------------------------------


def _fields(facts: DataFrame, kind: str, by: list[str], *names: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind).select(*by, *(F.col("fields")[n].alias(n) for n in names))


def queue_contracts(facts: DataFrame, by: list[str]) -> DataFrame:
    """(by, queue, bindings, dead_letter_routing_key, dead_letter_exchange, retry_delay_ms): what is declared of each queue, over all files of `by`.

    Bindings are distinct and in order; of an option that files state differently the greatest is taken.
    """
    bound = _fields(facts, "queue_binding", by, "queue", "exchange", "routing_key").groupBy(*by, "queue").agg(F.sort_array(F.collect_set(F.struct("exchange", "routing_key"))).alias("bindings"))
    options = ["dead_letter_routing_key", "dead_letter_exchange", "retry_delay_ms"]
    told = _fields(facts, "queue_options", by, "queue", *options).withColumn("retry_delay_ms", F.col("retry_delay_ms").cast("long"))
    told = told.groupBy(*by, "queue").agg(*(F.max(o).alias(o) for o in options))
    return bound.join(told, [*by, "queue"], "full")


def consumer_contracts(consumers: DataFrame, queues: DataFrame, by: list[str], channel: str = "channel") -> DataFrame:
    """Consumers with `contract`, as JSON: their queue with its bindings and options, where these are declared."""
    out = consumers.join(queues.withColumnRenamed("queue", channel), [*by, channel], "left")
    names = ["bindings", "dead_letter_routing_key", "dead_letter_exchange", "retry_delay_ms"]
    contract = F.to_json(F.struct(F.lit("rabbitmq").alias("transport"), F.lit("consumes").alias("direction"), F.col(channel).alias("queue"), *names))
    return out.withColumn("contract", contract).drop(*names)


def deliveries(publications: DataFrame, bindings: DataFrame, exchanges: DataFrame, by: list[str] = ()) -> DataFrame:
    """Publications (by, exchange, routing_key, ...) with each `queue` that their message reaches, once.

    bindings: (by, queue, exchange, routing_key). exchanges: (by, exchange, exchange_kind); one declared with two kinds counts as
    a topic exchange. Nobody's headers are known, so headers exchanges deliver nothing here. An empty exchange is the default one.
    """
    by = list(by)
    kinds = exchanges.groupBy(*by, "exchange").agg(F.min("exchange_kind").alias("_kind"), F.max("exchange_kind").alias("_other"))
    kinds = checkpointed(kinds.select(*by, "exchange", F.when(F.col("_kind") == F.col("_other"), F.col("_kind")).otherwise("topic").alias("_kind")))
    key = F.coalesce("routing_key", F.lit(""))
    sent = publications.withColumn("exchange", F.coalesce("exchange", F.lit(""))).withColumn("routing_key", key)
    sent = checkpointed(sent.withColumn("_id", F.monotonically_increasing_id()).join(kinds, [*by, "exchange"], "left"))
    bound = bindings.withColumn("pattern", key).select(*by, "exchange", "pattern", "queue").distinct().join(kinds, [*by, "exchange"], "left")
    bound = checkpointed(bound.withColumn("_kind", F.coalesce("_kind", F.lit("topic"))))
    of = lambda df, kind: df.filter(F.coalesce("_kind", F.lit("topic")) == kind).drop("_kind")
    named = sent.filter("exchange <> ''")
    topic = paths.matched_topics(of(named, "topic"), of(bound, "topic"), [*by, "exchange"])
    direct = of(named, "direct").join(of(bound, "direct").withColumnRenamed("pattern", "routing_key"), [*by, "exchange", "routing_key"])
    fanout = of(named, "fanout").join(of(bound, "fanout").select(*by, "exchange", "queue").distinct(), [*by, "exchange"])
    default = sent.filter("exchange = ''").drop("_kind").withColumn("queue", F.col("routing_key"))
    columns = [*publications.columns, "queue", "_id"]
    found = topic.select(*columns).unionByName(direct.select(*columns)).unionByName(fanout.select(*columns)).unionByName(default.select(*columns))
    return found.dropDuplicates(["_id", "queue"]).drop("_id")
