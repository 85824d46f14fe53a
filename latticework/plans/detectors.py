"""Architecture findings over fact tables: each detector is one declarative plan, and all share one schema.

A finding has kind, severity, services (sorted display names), subject (what tells findings of one kind and services apart),
reason, confidence, evidence and detail (JSON). Lists of evidence show the first three of each sort and keep full counts.
Facts are a dict of DataFrames; a table that is not there counts as empty, and its detectors find nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework import schemas
from latticework.functions import constants, text
from latticework.operators import graph, relational
from latticework.sources.folders import checkpointed

FINDING = "kind string, severity string, services array<string>, subject string, reason string, confidence double, evidence array<struct<file:string,start_line:int,end_line:int>>, detail string"
SHOWN = 3
#: Over so many tasks the findings of one channel are spread when its services are put to them.
TEXT_PARTS = 16
Detector = Callable[["Facts"], DataFrame]


class Facts:
    """The fact tables of one snapshot; missing ones are empty, missing columns null.

    `narrowed` makes the tables from the lines of some services, (service_id), where that is less work than to make all and choose.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], narrowed: Callable[[DataFrame], dict[str, DataFrame]] | None = None):
        self.spark, self.tables, self.narrowed = spark, tables, narrowed

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schemas.TABLES:
            raise AttributeError(name)
        schema = schemas.struct(name)
        if name not in self.tables:
            return self.spark.createDataFrame([], schema)
        df = self.tables[name]
        return df.select(*(df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    def of_services(self, few: DataFrame, *names: str) -> Facts:
        """The same facts, but in the named tables only those of a few services."""
        made = self.narrowed(few) if self.narrowed else self.tables
        return Facts(self.spark, self.tables | {n: made[n].join(few, "service_id", "left_semi") for n in names if n in made})

    def names(self) -> DataFrame:
        """(service_id, service)"""
        return relational.display_names(self.services, self.repositories).select(F.col("id").alias("service_id"), F.col("display").alias("service"))

    def named(self, df: DataFrame, service_id: str = "service_id", service: str = "service") -> DataFrame:
        return df.join(self.names().select(F.col("service_id").alias(service_id), F.col("service").alias(service)), service_id)


def _finding(df: DataFrame, kind: str | Column, severity: str, services: Column, subject: Column, reason: Column, confidence: float | Column = 1.0, evidence: Column | None = None, **detail: Column) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    none = F.array().cast("array<struct<file:string,start_line:int,end_line:int>>")
    shown = none if evidence is None else F.coalesce(evidence.cast("array<struct<file:string,start_line:int,end_line:int>>"), none)
    packed = F.to_json(F.struct(*(v.alias(k) for k, v in detail.items()))) if detail else F.lit("{}")
    return df.select(kind.alias("kind"), F.lit(severity).alias("severity"), F.array_sort(services).alias("services"), F.coalesce(subject.cast("string"), F.lit("")).alias("subject"), reason.alias("reason"), confidence.cast("double").alias("confidence"), shown.alias("evidence"), packed.alias("detail"))


def _one(c: str = "service") -> Column:
    return F.array(F.col(c))


def _key(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


def _items(df: DataFrame, keys: list[str], name: str, *order: str) -> DataFrame:
    """(keys, name): rows of each key as an ordered list with their evidence."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, "evidence"))).alias(name))


def _shown(name: str) -> Column:
    return F.transform(F.slice(name, 1, SHOWN), lambda x: x["evidence"])


def _edges(f: Facts, kind: str, name: str) -> DataFrame:
    """(service_id, source, name): flow edges of one kind by source symbol, whatever their origin."""
    e = f.flow_edges.filter(F.col("kind") == kind).select("service_id", F.col("from_symbol").alias("source"), "to_symbol", "evidence")
    return _items(e, ["service_id", "source"], name, "to_symbol")


def _policies(f: Facts, kind: str | None, name: str = "policies") -> DataFrame:
    p = f.static_resilience_policies if kind is None else f.static_resilience_policies.filter(F.col("kind") == kind)
    return _items(p, ["service_id", "source"], name, "kind", "mechanism", "value", "unit")


def _http_calls(f: Facts) -> DataFrame:
    return f.static_service_calls.filter("protocol = 'http'").withColumn("call", F.concat_ws(" ", F.coalesce("target_method", F.lit("HTTP")), F.concat("target_service", F.coalesce("target_path", F.lit("/")))))


_AT = ["service_id", "source"]


def _count_over(*keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys))


# --- structure ------------------------------------------------------------------------------------------------------


def internal_edges(f: Facts) -> DataFrame:
    return f.service_calls.filter("target_kind = 'internal' AND to_service_id IS NOT NULL").select(F.col("from_service_id").alias("source"), F.col("to_service_id").alias("target")).distinct()


def cycles(f: Facts) -> DataFrame:
    parts = f.named(graph.strong_components(internal_edges(f)).withColumnRenamed("node", "service_id"))
    df = parts.groupBy("component").agg(F.sort_array(F.collect_list("service")).alias("members"))
    return _finding(df, "cycle", "warning", F.col("members"), F.lit(None), F.concat(F.array_join("members", ", "), F.lit(" call each other in a cycle.")), count=F.size("members"))


def fan_imbalance(f: Facts) -> DataFrame:
    df = f.named(relational.fan(internal_edges(f)).withColumnRenamed("node", "service_id").withColumnRenamed("kind", "way"))
    reason = F.concat("service", F.when(F.col("way") == "fan_in", F.lit(" is called by ")).otherwise(F.lit(" calls ")), F.col("peers").cast("string"), F.lit(" services."))
    return _finding(df, F.col("way"), "info", _one(), F.lit(None), reason, count=F.col("peers"))


def component_cycles(f: Facts) -> DataFrame:
    parts = graph.strong_components(graph.component_edges(f.flow_edges), by=["service_id"])
    df = f.named(parts.groupBy("service_id", "component").agg(F.sort_array(F.collect_list("node")).alias("members")))
    return _finding(df, "component_cycle", "warning", _one(), F.array_join("members", " "), F.concat(F.array_join("members", ", "), F.lit(" depend on each other in a cycle.")), components=F.col("members"))


def component_fan_imbalance(f: Facts) -> DataFrame:
    e = graph.component_edges(f.flow_edges)
    both = relational.fan(e, constants.COMPONENT_FAN_THRESHOLD, ["service_id"]).join(relational.instability(e, ["service_id"]), ["service_id", "node"])
    df = f.named(both.withColumn("way", F.concat(F.lit("component_"), "kind")).drop("kind"))
    reason = F.concat_ws(" ", "node", F.when(F.col("way") == "component_fan_in", "is used by").otherwise("uses"), F.col("peers").cast("string"), F.lit("components."))
    return _finding(df, F.col("way"), "info", _one(), F.col("node"), reason, count=F.col("peers"), ce=F.col("ce"), ca=F.col("ca"), instability=F.col("instability"))


def _shared_by(f: Facts, df: DataFrame, keys: list[str]) -> DataFrame:
    return f.named(df).groupBy(*keys).agg(F.sort_array(F.collect_set("service")).alias("members"), F.countDistinct("service_id").alias("n")).filter("n > 1")


def shared_database(f: Facts) -> DataFrame:
    df = f.persistence_entities.filter("engine <> 'unknown'").withColumn("entity", F.lower("name"))
    df = _shared_by(f, df.drop("name"), ["entity", "engine"])
    return _finding(df, "shared_database", "warning", F.col("members"), _key("entity", "engine"), F.concat(F.array_join("members", ", "), F.lit(" share "), "entity", F.lit(" in "), "engine", F.lit(".")), entity=F.col("entity"), engine=F.col("engine"))


def ownership_overlap(f: Facts) -> DataFrame:
    named = f.named(f.static_persistence_facts).withColumn("entity", F.lower("name"))
    df = named.groupBy("entity", F.col("kind").alias("pk")).agg(F.min("name").alias("aggregate"), F.sort_array(F.collect_set("service")).alias("members"), F.countDistinct("service_id").alias("n"), F.sort_array(F.collect_set(F.struct("service", "owner"))).alias("owners"), F.sort_array(F.collect_list(F.struct("service", "owner", "evidence"))).alias("items")).filter("n > 1")
    return _finding(df, "possible_aggregate_ownership_overlap", "warning", F.col("members"), _key("entity", "pk"), F.concat(F.array_join("members", ", "), F.lit(" each declare "), "pk", F.lit(" "), "aggregate", F.lit(" as theirs.")), 0.65, F.transform("items", lambda x: x["evidence"]), aggregate=F.col("aggregate"), owners=F.col("owners"))


def duplicate_integrations(f: Facts) -> DataFrame:
    calls = f.service_calls.filter("target_kind = 'external'").select(F.col("from_service_id").alias("service_id"), F.lower("to_service_name").alias("vendor"), "to_service_name")
    df = f.named(calls).groupBy("vendor").agg(F.min("to_service_name").alias("shown"), F.sort_array(F.collect_set("service")).alias("members"), F.countDistinct("service_id").alias("n")).filter("n > 1")
    return _finding(df, "duplicate_external_integration", "info", F.col("members"), F.col("vendor"), F.concat(F.array_join("members", ", "), F.lit(" each integrate with "), "shown", F.lit(".")), vendor=F.col("shown"))


# --- flows ----------------------------------------------------------------------------------------------------------


def entrypoint_operations(f: Facts) -> DataFrame:
    """Entrypoints with the writes and publications that they own directly, by source-proven edges."""
    ops = f.flow_edges.filter("entrypoint_id IS NOT NULL AND origin = 'static' AND kind IN ('writes', 'publishes')").select("entrypoint_id", F.col("kind").alias("operation"), "to_symbol", "evidence", F.col("id").alias("edge"))
    lists = ops.groupBy("entrypoint_id").agg(F.sort_array(F.collect_list(F.struct("edge", "operation", "to_symbol", "evidence"))).alias("operations"))
    e = f.entrypoints.withColumnRenamed("id", "entrypoint_id").withColumnRenamed("kind", "transport").withColumnRenamed("evidence", "entry_evidence")
    return f.named(e.join(lists, "entrypoint_id"))


def _operations(kind: str) -> Column:
    return F.filter("operations", lambda x: x["operation"] == kind)


def flow_hypotheses(f: Facts) -> DataFrame:
    e = entrypoint_operations(f).withColumn("writes", _operations("writes")).withColumn("publishes", _operations("publishes"))
    at = _key("transport", "method", "name", "symbol")
    leak = _finding(e.filter("transport = 'graphql' AND method = 'MUTATION'"), "possible_bff_domain_leakage", "warning", _one(), at, F.concat(F.lit("Mutation "), "name", F.lit(" changes state itself.")), 0.6, F.transform("operations", lambda x: x["evidence"]), symbol=F.col("symbol"))
    transactions = f.flow_boundaries.filter("kind = 'transaction'").select("service_id", F.col("source").alias("symbol"))
    loose = relational.without(e.filter("size(writes) > 0 AND size(publishes) > 0"), transactions, ["service_id", "symbol"])
    loose = _finding(loose, "possible_non_atomic_publish", "warning", _one(), at, F.concat("symbol", F.lit(" writes and publishes outside a proven transaction.")), 0.5, F.array(F.col("writes")[0]["evidence"], F.col("publishes")[0]["evidence"]), symbol=F.col("symbol"))
    return leak.unionByName(loose)


def read_side_effects(f: Facts) -> DataFrame:
    e = entrypoint_operations(f)
    safe = ((F.col("transport") == "http") & F.col("method").isin(constants.READ_METHODS)) | ((F.col("transport") == "graphql") & (F.col("method") == "QUERY"))
    return _finding(e.filter(safe), "possible_read_entrypoint_side_effect", "warning", _one(), _key("transport", "method", "name", "symbol"), F.concat_ws(" ", "method", "name", F.lit("reads by contract, yet writes or publishes.")), 0.8, F.transform("operations", lambda x: x["evidence"]), operations=F.transform("operations", lambda x: F.struct(x["operation"].alias("kind"), x["to_symbol"].alias("target"))))


def _broad() -> Column:
    return F.lower(text.last_segment(F.col("internal_type"))).isin(constants.BROAD_TYPES)


def broad_handlers(f: Facts) -> DataFrame:
    df = f.named(f.static_error_contracts.filter((F.col("role") == "maps") & F.col("internal_type").isNotNull() & _broad()))
    return _finding(df, "possible_overbroad_exception_handler", "info", _one(), _key("source", "internal_type"), F.concat("source", F.lit(" maps every "), "internal_type", F.lit(" alike.")), 0.75, F.array("evidence"), protocol=F.col("protocol"), status=F.col("transport_code"))


def broad_handlers_over_timeouts(f: Facts) -> DataFrame:
    h = f.static_error_contracts.filter((F.col("role") == "maps") & (F.col("protocol") == "http") & (F.col("transport_code") == "500") & F.col("internal_type").isNotNull() & _broad()).select("service_id", F.col("source").alias("handler"), "internal_type", F.col("evidence").alias("handler_evidence"))
    flows = _http_calls(f).join(_policies(f, "timeout"), _AT)
    df = f.named(h.join(flows, "service_id"))
    return _finding(df, "possible_broad_handler_swallows_timeout", "warning", _one(), _key("handler", "internal_type", "source", "call"), F.concat("handler", F.lit(" may swallow timeouts of "), "call", F.lit(".")), 0.65, F.concat(F.array("handler_evidence", "evidence"), _shown("policies")), status=F.lit("500"))


def policies_on_write_flows(f: Facts) -> DataFrame:
    df = f.named(_http_calls(f).join(_policies(f, None), _AT).join(_edges(f, "writes", "writes"), _AT))
    return _finding(df, "possible_resilience_policy_on_partial_write_flow", "warning", _one(), _key("source", "call"), F.concat("source", F.lit(" writes beside a guarded call.")), 0.7, F.concat(F.array("evidence"), _shown("policies"), _shown("writes")), write_count=F.size("writes"), policy_count=F.size("policies"))


def _retry_write_publish(f: Facts) -> DataFrame:
    return _policies(f, "retry").join(_edges(f, "writes", "writes"), _AT).join(_edges(f, "publishes", "publishes"), _AT)


def retry_write_publish(f: Facts) -> DataFrame:
    df = f.named(_retry_write_publish(f))
    return _finding(df, "possible_retry_on_write_publish_flow", "warning", _one(), F.col("source"), F.concat("source", F.lit(" retries, writes and publishes.")), 0.7, F.concat(_shown("policies"), _shown("writes"), _shown("publishes")), channels=F.array_distinct(F.transform("publishes", lambda x: x["to_symbol"])), write_count=F.size("writes"), publish_count=F.size("publishes"))


def _alone() -> Column:
    """The service that alone has what a group holds; null if several have it."""
    return F.when(F.min("consumer_id") == F.max("consumer_id"), F.min("consumer_id"))


def _least_consumers(distinct: DataFrame) -> DataFrame:
    """(channel, least): see `_consumers_by_channel`."""
    of_service = F.row_number().over(Window.partitionBy("channel", "alone").orderBy("consumer"))
    of_channel = F.row_number().over(Window.partitionBy("channel").orderBy("consumer"))
    least = distinct.withColumn("_n", of_service).filter(f"_n <= {SHOWN}").withColumn("_n", of_channel).filter(f"_n <= {2 * SHOWN}")
    return least.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("consumer", "alone"))).alias("least"))


def _consumers_by_channel(consumers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What flows need to know of a channel's consumers once their own service is left out.

    (channel, total, least, names): how many distinct consumers there are; the least of them, at most three of each service
    and six in all, so that three of other services than any one are among them; and how many names their services have. Then
    (channel, service_id, own, own_name): how many of them, and which name, are of one service alone. What several services share
    is of none. And (channel, consumer_service): the names, once each.
    """
    distinct = consumers.groupBy("channel", "consumer").agg(_alone().alias("alone"))
    least = _least_consumers(distinct)
    own = distinct.groupBy("channel", F.col("alone").alias("service_id")).agg(F.count("*").alias("own"))
    total = own.groupBy("channel").agg(F.sum("own").alias("total"))
    named = consumers.groupBy("channel", "consumer_service").agg(_alone().alias("service_id"))
    names = named.groupBy("channel").agg(F.count("consumer_service").alias("names"))
    own_name = named.filter("service_id IS NOT NULL").groupBy("channel", "service_id").agg(F.min("consumer_service").alias("own_name"))
    own = own.filter("service_id IS NOT NULL").join(own_name, ["channel", "service_id"], "full")
    return total.join(least, "channel").join(names, "channel"), own, named.select("channel", "consumer_service")


def _per_channel(f: Facts, consumers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retrying write-and-publish flows by channel, with the consumers in other services: counted for each channel, never paired.

    Beside them (channel, consumer_service), the services of a channel by name: flows only carry how many others there are.
    """
    channels, own, names = _consumers_by_channel(consumers)
    flows = _retry_write_publish(f).select(*_AT, _shown("policies").alias("policies"), _shown("writes").alias("writes"), F.explode("publishes").alias("p"))
    flows = flows.groupBy(*_AT, F.col("p.to_symbol").alias("channel")).agg(F.min("policies").alias("policies"), F.min("writes").alias("writes"), F.min("p.evidence").alias("publish_evidence"))
    met = flows.join(channels, "channel").join(own, ["channel", "service_id"], "left")
    met = met.withColumn("consumer_count", (F.col("total") - F.coalesce("own", F.lit(0))).cast("int"))
    met = met.filter(F.col("names") > F.col("own_name").isNotNull().cast("int"))
    shown = F.filter("least", lambda x: x["alone"].isNull() | (x["alone"] != F.col("service_id")))
    return f.named(met.withColumn("consumers", F.transform(F.slice(shown, 1, SHOWN), lambda x: x["consumer"]))), names


def _services_by_channel(names: DataFrame) -> DataFrame:
    return names.groupBy("channel").agg(F.sort_array(F.collect_list("consumer_service")).alias("all_services"))


def _per_channel_evidence() -> Column:
    return F.concat("policies", "writes", F.array("publish_evidence"), F.flatten(F.transform("consumers", lambda x: x["evidences"])))


def _per_channel_finding(f: Facts, detector: str) -> DataFrame:
    consumers, kind, confidence, what = PER_CHANNEL[detector]
    df, names = _per_channel(f, consumers(f))
    others = F.when(F.col("own_name").isNull(), F.col("all_services")).otherwise(F.array_remove("all_services", F.col("own_name")))
    df = df.join(_services_by_channel(names), "channel").withColumn("others", others)
    return _finding(
        df, kind, "warning", F.array_union(_one(), F.col("others")), _key("source", "channel"),
        F.concat("source", F.lit(" may deliver twice to "), "channel", F.lit(what)), confidence, _per_channel_evidence(),
        channel=F.col("channel"), producer=F.col("service"), consumer_count=F.col("consumer_count"), consumer_services=F.col("others"),
    )


def _flow_counts(f: Facts) -> DataFrame:
    """(service_id, source, channel, shown): retrying write-and-publish flows by channel, and how many pieces of evidence each shows of its own."""
    count = F.least(F.count("*"), F.lit(SHOWN))
    edges = f.flow_edges.withColumnRenamed("from_symbol", "source")
    policies = f.static_resilience_policies.filter("kind = 'retry'").groupBy(*_AT).agg(count.alias("policies"))
    writes = edges.filter("kind = 'writes'").groupBy(*_AT).agg(count.alias("writes"))
    flows = edges.filter("kind = 'publishes'").select(*_AT, F.col("to_symbol").alias("channel")).distinct()
    return flows.join(writes, _AT).join(policies, _AT).select(*_AT, "channel", (F.col("policies") + F.col("writes") + 1).alias("shown"))


def _first_consumers(f: Facts, consumers: Callable[[Facts], DataFrame], known: DataFrame) -> DataFrame:
    """(channel, least): what the least consumers of each channel show, (alone, shown), from the facts of few services.

    Every name has a consumer, so the three least that a flow meets in other services are among those of the first four names.
    """
    rank = F.dense_rank().over(Window.partitionBy("channel").orderBy("consumer_service"))
    first = checkpointed(known.withColumn("_n", rank).filter(f"_n <= {SHOWN + 1}").select("channel", "consumer_id").distinct())
    few = first.select(F.col("consumer_id").alias("service_id")).distinct()
    found = consumers(f.of_services(few, "static_message_contracts", "flow_edges", "flow_boundaries")).join(first, ["channel", "consumer_id"], "left_semi")
    least = _least_consumers(found.groupBy("channel", "consumer").agg(_alone().alias("alone")))
    return least.select("channel", F.transform("least", lambda x: F.struct(x["alone"].alias("alone"), F.size(x["consumer"]["evidences"]).alias("shown"))).alias("least"))


def _with_services(counts: DataFrame, names: DataFrame) -> DataFrame:
    """Counts by channel with its names, sorted and joined by commas, as `services`; a name in `added`, which is none of them, is put at its place.

    A channel's text is made once, and a place in it is how many bytes the lesser names take.
    """
    width = (F.octet_length("name") + 1).cast("long")
    places = names.select("channel", "name", width.alias("width"), F.lit(False).alias("is_added"))
    places = places.unionByName(counts.filter("added IS NOT NULL").select("channel", F.col("added").alias("name"), F.lit(0).cast("long").alias("width"), F.lit(True).alias("is_added")).distinct())
    before = F.sum("width").over(Window.partitionBy("channel").orderBy("name").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = places.withColumn("before", before).filter("is_added").select("channel", F.col("name").alias("added"), "before")
    # Each text goes to several tasks, or the rows of a channel were all made in one.
    texts = names.groupBy("channel").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").cast("binary").alias("text")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(TEXT_PARTS - 1))))
    rows = counts.join(places, ["channel", "added"], "left").withColumn("_part", F.pmod(F.hash("subject", "evidence", "added"), F.lit(TEXT_PARTS)))
    last = F.col("before") > F.octet_length("text")
    put = F.when(last, F.concat(F.lit(","), "added")).otherwise(F.concat("added", F.lit(","))).cast("binary")
    at = F.least("before", F.octet_length("text").cast("long")).cast("int") + 1
    services = F.when(F.col("added").isNull(), F.col("text")).otherwise(F.overlay("text", put, at, F.lit(0))).cast("string")
    return rows.join(texts, ["channel", "_part"]).withColumn("services", services)


def per_channel_counts(f: Facts, detector: str) -> DataFrame:
    """(kind, services, subject, evidence, confidence, n): how often a detector of channels finds each, its services joined by commas.

    Flows of one channel name the same services: a flow's own is left out of the list and added again. So findings are counted by
    what tells their lists apart, a name that is none of the consumers', and the lists are put to the counts alone. Flows and
    consumers are numbers here; evidence itself is read only of the few consumers that can be shown.
    """
    consumers, kind, confidence, _ = PER_CHANNEL[detector]
    known = checkpointed(consumers(f).select("channel", "consumer_id", "consumer_service").distinct())
    named = checkpointed(known.groupBy("channel", F.col("consumer_service").alias("service")).agg(_alone().alias("alone")))
    channels = _first_consumers(f, consumers, known).join(named.groupBy("channel").agg(F.count("service").alias("names")), "channel")
    met = F.slice(F.filter("least", lambda x: x["alone"].isNull() | (x["alone"] != F.col("service_id"))), 1, SHOWN)
    evidence = F.aggregate(met, F.col("shown"), lambda n, x: n + x["shown"])
    df = _flow_counts(f).join(channels, "channel").select(*_AT, "channel", "names", evidence.alias("evidence"))
    df = f.named(df).join(named.withColumn("known", F.lit(True)), ["channel", "service"], "left")
    own = F.coalesce(F.col("alone") == F.col("service_id"), F.lit(False)).cast("int")
    df = df.filter(F.col("names") > own).select("channel", _key("source", "channel").alias("subject"), "evidence", F.when(F.col("known").isNull(), F.col("service")).alias("added"))
    counts = checkpointed(df.groupBy(*df.columns).agg(F.count("*").alias("n")))
    names = named.filter("service IS NOT NULL").select("channel", F.col("service").alias("name"))
    return _with_services(counts, names).select(F.lit(kind).alias("kind"), "services", "subject", "evidence", F.lit(confidence).alias("confidence"), "n")


def message_consumers(f: Facts) -> DataFrame:
    c = f.named(f.static_message_contracts.filter("direction = 'consumes'").withColumnRenamed("service_id", "consumer_id"), "consumer_id", "consumer_service")
    return c.select("channel", "consumer_id", "consumer_service", F.struct(F.col("consumer_service").alias("service"), F.lit("").alias("symbol"), F.array("evidence").alias("evidences")).alias("consumer"))


def retry_reaches_consumers(f: Facts) -> DataFrame:
    return _per_channel_finding(f, "retry_reaches_consumers")


def persistent_consumers(f: Facts) -> DataFrame:
    """Consumers of a channel whose entrypoint for it writes state."""
    c = f.static_message_contracts.filter("direction = 'consumes'").select("service_id", "channel", F.col("evidence").alias("contract_evidence"))
    e = f.entrypoints.filter("kind = 'message' AND method = 'CONSUME'").select("service_id", F.col("name").alias("channel"), F.col("symbol").alias("source"))
    df = c.join(e, ["service_id", "channel"]).join(_edges(f, "writes", "consumer_writes"), _AT)
    return df.withColumnRenamed("service_id", "consumer_id").withColumnRenamed("source", "consumer_symbol")


def _consumer_rows(f: Facts, df: DataFrame, *first: Column) -> DataFrame:
    df = f.named(df, "consumer_id", "consumer_service")
    evidences = F.concat(F.array("contract_evidence", *first), _shown("consumer_writes"))
    return df.select("channel", "consumer_id", "consumer_service", F.struct(F.col("consumer_service").alias("service"), F.col("consumer_symbol").alias("symbol"), evidences.alias("evidences")).alias("consumer"))


def retry_reaches_persistent_consumers(f: Facts) -> DataFrame:
    return _per_channel_finding(f, "retry_reaches_persistent_consumers")


def unrecovered_consumers(f: Facts) -> DataFrame:
    """RabbitMQ consumers without a retry boundary, a retry delay or a dead-letter route in the source."""
    e = f.entrypoints.filter("kind = 'message' AND method = 'CONSUME'").join(f.entrypoint_contracts.withColumnRenamed("entrypoint_id", "id"), "id")
    field = lambda name: F.get_json_object("contract", f"$.{name}")
    e = e.filter((field("transport") == "rabbitmq") & (field("direction") == "consumes") & field("dead_letter_routing_key").isNull() & field("retry_delay_ms").isNull())
    retried = f.flow_boundaries.filter("kind = 'retry'").select("service_id", F.col("source").alias("symbol"))
    return relational.without(e, retried, ["service_id", "symbol"])


def unrecovered_persistent_consumers(f: Facts) -> DataFrame:
    u = unrecovered_consumers(f).groupBy(F.col("service_id").alias("consumer_id"), F.col("symbol").alias("consumer_symbol")).agg(F.max("evidence").alias("recovery_evidence"))
    return _consumer_rows(f, persistent_consumers(f).join(u, ["consumer_id", "consumer_symbol"]), F.col("recovery_evidence"))


def retry_reaches_unrecovered_consumers(f: Facts) -> DataFrame:
    return _per_channel_finding(f, "retry_reaches_unrecovered_consumers")


#: Detectors of channels: their consumers, and kind, confidence and words of what they find.
PER_CHANNEL = {
    "retry_reaches_consumers": (message_consumers, "possible_retry_write_publish_reaches_consumer", 0.75, ", which others consume."),
    "retry_reaches_persistent_consumers": (lambda f: _consumer_rows(f, persistent_consumers(f)), "possible_retry_write_publish_reaches_persistent_consumer", 0.8, ", whose consumers write state."),
    "retry_reaches_unrecovered_consumers": (unrecovered_persistent_consumers, "possible_retry_write_publish_reaches_unrecovered_persistent_consumer", 0.65, ", whose consumers write state and show no recovery."),
}


def non_atomic_service_publish(f: Facts) -> DataFrame:
    df = _edges(f, "writes", "writes").join(_edges(f, "publishes", "publishes"), _AT)
    df = relational.without_any(df, (f.entrypoints.select("service_id", F.col("symbol").alias("source")), _AT), (f.flow_boundaries.filter("kind = 'transaction'"), _AT))
    df = f.named(df)
    return _finding(df, "possible_non_atomic_service_publish", "warning", _one(), F.col("source"), F.concat("source", F.lit(" writes and publishes outside a proven transaction.")), 0.5, F.concat(_shown("writes"), _shown("publishes")), channels=F.array_distinct(F.transform("publishes", lambda x: x["to_symbol"])), write_count=F.size("writes"), publish_count=F.size("publishes"))


# --- errors ---------------------------------------------------------------------------------------------------------


def _status() -> Column:
    return F.col("transport_code").try_cast("int")


def error_semantics_lost(f: Facts) -> DataFrame:
    c = f.static_error_contracts.filter("internal_type IS NOT NULL")
    raised = c.filter((F.col("role") == "raises") & F.col("error_kind").isin(constants.CLIENT_ERROR_KINDS)).select("service_id", "internal_type", "error_kind", "source", "evidence")
    mapped = c.filter((F.col("role") == "maps") & (F.col("protocol") == "http") & _status().between(500, 599)).select("service_id", "internal_type", F.col("source").alias("mapped_source"), F.col("transport_code").alias("mapped_code"), F.col("evidence").alias("mapped_evidence"))
    df = f.named(raised.join(mapped, ["service_id", "internal_type"]))
    return _finding(df, "possible_error_semantics_lost", "warning", _one(), _key("internal_type", "source", "mapped_source"), F.concat("internal_type", F.lit(", a client's error, leaves as HTTP "), "mapped_code", F.lit(".")), 0.85, F.array("evidence", "mapped_evidence"), error_type=F.col("internal_type"), status=F.col("mapped_code"))


def _reached_sources(f: Facts, entrypoints: DataFrame) -> DataFrame:
    """(service_id, root, source): each entrypoint's own symbol and all that its first 200 flow edges touch."""
    roots = entrypoints.select("service_id", F.col("symbol").alias("root")).distinct()
    edges = graph.reachable_edges(f.flow_edges, roots, 200, by=["service_id"])
    ends = edges.select("service_id", "root", F.explode(F.array("from_symbol", "to_symbol")).alias("source"))
    return roots.select("service_id", "root", F.col("root").alias("source")).unionByName(ends).distinct()


def unhandled_endpoint_errors(f: Facts) -> DataFrame:
    e = f.entrypoints.filter("kind = 'http'").select("service_id", "method", "name", "symbol", F.col("evidence").alias("entry_evidence"))
    raised = f.static_error_contracts.filter((F.col("role") == "raises") & F.col("internal_type").isNotNull() & F.col("error_kind").isin(constants.CLIENT_ERROR_KINDS)).select("service_id", "source", "internal_type", "error_kind", "evidence")
    mapped = f.static_error_contracts.filter("role = 'maps' AND protocol = 'http' AND internal_type IS NOT NULL")
    open_ = relational.without(raised, mapped, ["service_id", "internal_type"])
    met = e.join(_reached_sources(f, e).withColumnRenamed("root", "symbol"), ["service_id", "symbol"]).join(open_, _AT)
    df = f.named(relational.first_per_key(met, ["service_id", "method", "name", "symbol", "internal_type"], ["source", "evidence"]))
    return _finding(df, "possible_unhandled_endpoint_error", "warning", _one(), _key("method", "name", "symbol", "internal_type"), F.concat_ws(" ", "method", "name", F.lit("can raise"), "internal_type", F.lit("unmapped.")), 0.75, F.array("entry_evidence", "evidence"), error_type=F.col("internal_type"), error_kind=F.col("error_kind"))


def internal_error_exposures(f: Facts) -> DataFrame:
    df = f.named(f.static_error_contracts.filter("exposes_internal_detail AND ((role = 'maps' AND protocol = 'http') OR (role = 'raises' AND protocol = 'graphql'))"))
    code = F.when(F.col("protocol") == "http", F.col("transport_code")).otherwise(F.col("public_code"))
    return _finding(df, "possible_internal_error_exposure", "critical", _one(), _key("source", "protocol", "transport_code", "public_code"), F.concat("source", F.lit(" shows internal detail to callers.")), 0.9, F.array("evidence"), protocol=F.col("protocol"), code=code)


def calls_without_policy(f: Facts) -> DataFrame:
    df = f.named(relational.without(_http_calls(f), f.static_resilience_policies, _AT))
    return _finding(df, "possible_missing_http_resilience_policy", "info", _one(), _key("source", "call"), F.concat("source", F.lit(" calls "), "call", F.lit(" without a policy beside it.")), 0.5, F.array("evidence"), call=F.col("call"))


def retries_on_non_idempotent_calls(f: Facts) -> DataFrame:
    df = f.named(_http_calls(f).filter(F.col("target_method").isin(constants.NON_IDEMPOTENT_METHODS)).join(_policies(f, "retry"), _AT))
    return _finding(df, "possible_retry_on_non_idempotent_http_call", "warning", _one(), _key("source", "call"), F.concat("source", F.lit(" retries "), "call", F.lit(".")), 0.65, F.concat(F.array("evidence"), _shown("policies")), method=F.col("target_method"))


def retries_on_permanent_errors(f: Facts) -> DataFrame:
    c = f.static_error_contracts.filter((F.col("role") == "raises") & (F.col("retryability") == "not_retryable") & F.col("error_kind").isin(constants.CLIENT_ERROR_KINDS))
    df = f.named(c.join(_policies(f, "retry"), _AT))
    return _finding(df, "possible_retry_on_non_retryable_error", "warning", _one(), _key("source", "error_kind", "internal_type"), F.concat("source", F.lit(" retries what will fail again.")), 0.8, F.concat(F.array("evidence"), _shown("policies")), error_kind=F.col("error_kind"))


def _targets(f: Facts, unique: bool) -> DataFrame:
    """HTTP calls with the services their target's name, in lower case, stands for; `unique`: the only one, or the only one in the caller's repository."""
    s = f.services.select(F.col("id").alias("to_service_id"), F.lower("name").alias("_name"), F.col("repository_id").alias("_repo"))
    s = s.withColumn("_n", _count_over("_name")).withColumn("_m", _count_over("_name", "_repo"))
    home = f.services.select(F.col("id").alias("service_id"), F.col("repository_id").alias("_home"))
    calls = _http_calls(f).join(home, "service_id")
    met = calls.join(s, F.lower("target_service") == F.col("_name"))
    if unique:
        met = met.filter("_n = 1 OR (_home IS NOT NULL AND _repo = _home AND _m = 1)")
    return met.drop("_name", "_repo", "_n", "_m", "_home")


def _scoped_contracts(f: Facts, calls: DataFrame) -> DataFrame:
    """Client errors that a call can meet: those its indexed endpoint reaches (endpoint_flow), else all of the target (service_contracts)."""
    e = f.entrypoints.filter("kind = 'http'").select(F.col("service_id").alias("to_service_id"), F.col("method").alias("_m"), F.col("name").alias("_p"), "symbol")
    e = relational.first_per_key(e, ["to_service_id", "_m", "_p"], ["symbol"])
    met = calls.join(e, (calls["to_service_id"] == e["to_service_id"]) & (F.upper(calls["target_method"]) == e["_m"]) & (calls["target_path"] == e["_p"]), "left").drop(e["to_service_id"]).drop("_m", "_p")
    c = f.static_error_contracts.filter(text.is_client_error(F.col("role"), F.col("protocol"), F.col("transport_code"), F.col("internal_type")))
    c = c.select(F.col("service_id").alias("to_service_id"), F.col("source").alias("error_source"), "internal_type", "error_kind", "transport_code", "public_code", F.col("evidence").alias("error_evidence"))
    roots = e.join(calls.select("to_service_id").distinct(), "to_service_id", "left_semi").withColumnRenamed("to_service_id", "service_id")
    reached = _reached_sources(f, roots).select(F.col("service_id").alias("to_service_id"), F.col("root").alias("symbol"), F.col("source").alias("error_source"))
    near = met.filter("symbol IS NOT NULL").join(reached, ["to_service_id", "symbol"]).join(c, ["to_service_id", "error_source"]).withColumn("scope", F.lit("endpoint_flow"))
    wide = met.filter("symbol IS NULL").join(c, "to_service_id").withColumn("scope", F.lit("service_contracts"))
    return near.unionByName(wide)


def retries_on_downstream_errors(f: Facts) -> DataFrame:
    calls = _targets(f, unique=True).join(_policies(f, "retry"), _AT)
    df = f.named(f.named(_scoped_contracts(f, calls)), "to_service_id", "target")
    return _finding(df, "possible_retry_on_downstream_client_error", "warning", F.array("service", "target"), _key("source", "call", "error_source", "internal_type"), F.concat("source", F.lit(" retries a call that answers HTTP "), "transport_code", F.lit(".")), F.when(F.col("scope") == "endpoint_flow", 0.8).otherwise(0.65), F.concat(F.array("evidence", "error_evidence"), _shown("policies")), scope=F.col("scope"), status=F.col("transport_code"), caller=F.col("service"))


def timeouts_without_fallback(f: Facts) -> DataFrame:
    handled = f.static_error_contracts.filter("role = 'handles' AND error_kind = 'timeout'")
    df = f.named(relational.without(_http_calls(f).join(_policies(f, "timeout"), _AT), handled, _AT))
    return _finding(df, "possible_timeout_without_local_fallback", "info", _one(), _key("source", "call"), F.concat("source", F.lit(" bounds "), "call", F.lit(" in time but handles no timeout.")), 0.55, F.concat(F.array("evidence"), _shown("policies")), call=F.col("call"))


def timeout_fallbacks_masking(f: Facts) -> DataFrame:
    c = f.static_error_contracts.filter((F.col("role") == "handles") & (F.col("error_kind") == "timeout") & (F.col("protocol") == "http") & _status().between(200, 299)).select("service_id", "source", "internal_type", "transport_code", F.col("evidence").alias("fallback_evidence"))
    e = f.entrypoints.select("service_id", F.col("symbol").alias("source"), "method", "name")
    df = f.named(c.join(e, _AT).join(_http_calls(f), _AT))
    return _finding(df, "possible_timeout_fallback_masks_failure", "warning", _one(), _key("source", "method", "name", "call"), F.concat_ws(" ", "method", "name", F.lit("answers a timeout with HTTP"), "transport_code"), 0.8, F.array("fallback_evidence", "evidence"), status=F.col("transport_code"))


def timeouts_as_500(f: Facts) -> DataFrame:
    df = f.named(f.static_error_contracts.filter("role = 'maps' AND error_kind = 'timeout' AND protocol = 'http' AND transport_code = '500'"))
    return _finding(df, "possible_timeout_mapped_as_internal_server_error", "warning", _one(), _key("source", "internal_type"), F.concat("source", F.lit(" turns a timeout into HTTP 500.")), 0.8, F.array("evidence"), status=F.lit("500"))


def unmapped_downstream_errors(f: Facts) -> DataFrame:
    mapped = f.static_error_contracts.filter((F.col("role") == "maps") & (F.col("protocol") == "http") & F.col("internal_type").isNotNull() & _status().between(400, 499)).select("service_id", "internal_type")
    calls = _targets(f, unique=False)
    proven = f.named(f.named(relational.without(_scoped_contracts(f, calls), mapped, ["service_id", "internal_type"])), "to_service_id", "target")
    reason = F.concat("target", F.lit(" answers HTTP "), "transport_code", F.lit(" for "), "internal_type", F.lit(", which the caller does not map."))
    one = _finding(proven, "possible_unmapped_downstream_error", "info", F.array("service", "target"), _key("source", "call", "error_source", "internal_type"), reason, F.when(F.col("scope") == "endpoint_flow", 0.75).otherwise(0.6), F.array("evidence", "error_evidence"), scope=F.col("scope"), caller=F.col("service"))
    c = f.static_error_contracts.filter(text.is_client_error(F.col("role"), F.col("protocol"), F.col("transport_code"), F.col("internal_type"))).select(F.col("service_id").alias("to_service_id"), F.col("source").alias("error_source"), "internal_type", "transport_code", "evidence")
    inferred = f.service_calls.filter("call_kind = 'http' AND target_kind = 'internal' AND to_service_id IS NOT NULL").select(F.col("from_service_id").alias("service_id"), "to_service_id", F.col("from_api_id").alias("api"))
    inferred = inferred.join(f.apis.select(F.col("id").alias("api"), "method", "path"), "api").join(c, "to_service_id")
    inferred = relational.without_any(inferred, (mapped, ["service_id", "internal_type"]), (calls.select("service_id", "to_service_id"), ["service_id", "to_service_id"]))
    inferred = f.named(f.named(inferred), "to_service_id", "target")
    two = _finding(inferred, "possible_unmapped_downstream_error", "info", F.array("service", "target"), _key("method", "path", "error_source", "internal_type"), reason, 0.35, F.array("evidence"), scope=F.lit("inferred"), caller=F.col("service"))
    return one.unionByName(two)


def unmapped_downstream_counts(f: Facts) -> DataFrame:
    """(kind, services, subject, evidence, confidence, n): how often `unmapped_downstream_errors` finds each, its services joined by commas.

    What calls ask for is asked once, and so is what it may answer; equal calls of callers of one name that map the same errors
    are one row. Only then both sides meet, and a finding occurs as often as the product of both counts. Tables in between are
    written, so that the facts are read once and their joins are planned by true sizes.
    """
    contracts = f.static_error_contracts.filter(text.is_client_error(F.col("role"), F.col("protocol"), F.col("transport_code"), F.col("internal_type")))
    client = checkpointed(contracts.groupBy("service_id", F.col("source").alias("error_source"), "internal_type").agg(F.count("*").alias("errors"), F.max(F.col("role") == "maps").alias("maps")))
    requests = ["asked", "_m", "_p"]
    calls = _http_calls(f).filter("target_service IS NOT NULL").groupBy("service_id", "source", "call", F.lower("target_service").alias("asked"), F.upper("target_method").alias("_m"), F.col("target_path").alias("_p")).agg(F.count("*").alias("calls"))
    calls = checkpointed(calls)
    called = f.services.select(F.col("id").alias("to_service_id"), F.lower("name").alias("asked"))

    e = f.entrypoints.filter("kind = 'http'").select(F.col("service_id").alias("to_service_id"), F.col("method").alias("_m"), F.col("name").alias("_p"), "symbol")
    e = relational.first_per_key(e, ["to_service_id", "_m", "_p"], ["symbol"])
    asked = checkpointed(calls.select(*requests).distinct().join(called, "asked").join(e, ["to_service_id", "_m", "_p"], "left"))
    inferred = f.service_calls.filter("call_kind = 'http' AND target_kind = 'internal' AND to_service_id IS NOT NULL").groupBy(F.col("from_service_id").alias("service_id"), "to_service_id", F.col("from_api_id").alias("api")).agg(F.count("*").alias("calls"))
    inferred = relational.without(inferred.join(called, "to_service_id"), calls, ["service_id", "asked"])
    inferred = checkpointed(inferred.join(f.apis.select(F.col("id").alias("api"), "method", "path"), "api").groupBy("service_id", "to_service_id", "method", "path").agg(F.sum("calls").alias("calls")))

    # Callers that map the same errors are alike; the one of least id stands for all.
    sets = client.filter("maps").groupBy("service_id").agg(F.sort_array(F.collect_set("internal_type")).alias("types"))
    alike = checkpointed(sets.join(sets.groupBy("types").agg(F.min("service_id").alias("like")), "types").select("service_id", "like"))
    mapped = checkpointed(client.filter("maps").join(alike.filter("service_id = like"), "service_id").select("like", "internal_type").distinct())

    answering = asked.select("to_service_id").unionByName(inferred.select("to_service_id")).distinct()
    answers = client.withColumnRenamed("service_id", "to_service_id").join(answering, "to_service_id", "left_semi").drop("maps")
    answers = checkpointed(f.named(answers, "to_service_id", "target"))
    roots = checkpointed(asked.filter("symbol IS NOT NULL").select(F.col("to_service_id").alias("service_id"), "symbol").distinct())
    edges = checkpointed(f.flow_edges.join(roots, "service_id", "left_semi"))
    reached = _reached_sources(Facts(f.spark, {"flow_edges": edges}), roots).select(F.col("service_id").alias("to_service_id"), F.col("root").alias("symbol"), F.col("source").alias("error_source"))
    near = asked.filter("symbol IS NOT NULL").join(reached, ["to_service_id", "symbol"]).join(answers, ["to_service_id", "error_source"]).withColumn("confidence", F.lit(0.75))
    wide = asked.filter("symbol IS NULL").join(answers, "to_service_id").withColumn("confidence", F.lit(0.6))
    met = near.unionByName(wide).groupBy(*requests, "target", "error_source", "internal_type", "confidence").agg(F.sum("errors").alias("errors"))
    met = checkpointed(met.select(*(F.col(c).alias(f"_{c}") for c in requests), *(c for c in met.columns if c not in requests)))

    by_name = lambda df, *keys: f.named(df).join(alike, "service_id", "left").groupBy("service", "like", *keys).agg(F.sum("calls").alias("calls"))
    one = by_name(calls, "source", "call", *requests)
    one = one.join(met, reduce(lambda a, b: a & b, (one[c].eqNullSafe(met[f"_{c}"]) for c in requests)))
    one = relational.without(one, mapped, ["like", "internal_type"]).withColumn("subject", _key("source", "call", "error_source", "internal_type")).withColumn("evidence", F.lit(2).cast("long"))
    two = by_name(inferred, "to_service_id", "method", "path").join(answers, "to_service_id")
    two = relational.without(two, mapped, ["like", "internal_type"]).withColumn("subject", _key("method", "path", "error_source", "internal_type")).withColumn("evidence", F.lit(1).cast("long")).withColumn("confidence", F.lit(0.35))
    services = F.array_join(F.array_sort(F.array("service", "target")), ",").alias("services")
    rows = (df.select(F.lit("possible_unmapped_downstream_error").alias("kind"), services, "subject", "evidence", "confidence", (F.col("calls") * F.col("errors")).alias("n")) for df in (one, two))
    rows = reduce(DataFrame.unionByName, rows)
    return rows.groupBy("kind", "services", "subject", "evidence", "confidence").agg(F.sum("n").alias("n"))


def consumers_without_recovery(f: Facts) -> DataFrame:
    df = f.named(unrecovered_consumers(f))
    return _finding(df, "possible_message_consumer_without_recovery_policy", "warning", _one(), _key("name", "symbol"), F.concat("symbol", F.lit(" consumes "), "name", F.lit(" without a recovery in the source.")), 0.45, F.array("evidence"), queue=F.col("name"), symbol=F.col("symbol"))


# --- cloud and configuration ----------------------------------------------------------------------------------------


def _with_repository(f: Facts, df: DataFrame) -> DataFrame:
    return df.drop("repository_id").join(f.services.select(F.col("id").alias("service_id"), "repository_id"), "service_id")


def cloud_code_without_iac(f: Facts) -> DataFrame:
    code = _with_repository(f, f.static_cloud_facts.filter("target_name IS NOT NULL"))
    declared = f.cloud_iac_resources.withColumn("target_name", F.col("physical_name"))
    df = f.named(relational.without(code, declared, ["provider", "resource_type", "target_name"], ["repository_id"]))
    return _finding(df, "cloud_dependency_without_iac", "warning", _one(), _key("provider", "resource_type", "target_name"), F.concat("service", F.lit(" uses "), "target_name", F.lit(", which nothing here declares.")), 0.7, F.array("evidence"), target_name=F.col("target_name"), operation=F.col("operation"))


def cloud_iac_unused(f: Facts) -> DataFrame:
    declared = _with_repository(f, f.cloud_iac_resources.filter("physical_name IS NOT NULL AND service_id IS NOT NULL"))
    code = _with_repository(f, f.static_cloud_facts).withColumn("physical_name", F.col("target_name"))
    df = f.named(relational.without(declared, code, ["provider", "resource_type", "physical_name"], ["repository_id"]))
    return _finding(df, "cloud_iac_resource_unused", "info", _one(), _key("provider", "resource_type", "physical_name"), F.concat("physical_name", F.lit(" is declared, but no code here uses it.")), 0.6, F.array("evidence"), logical_name=F.col("logical_name"))


def shared_cloud_resource(f: Facts) -> DataFrame:
    keys = ["provider", "resource_type", "target_name"]
    df = _shared_by(f, f.static_cloud_facts.filter("target_name IS NOT NULL"), keys)
    return _finding(df, "shared_cloud_resource", "info", F.col("members"), _key(*keys), F.concat(F.array_join("members", ", "), F.lit(" share "), "target_name", F.lit(".")), target_name=F.col("target_name"))


def k8s_key_mismatches(f: Facts) -> DataFrame:
    df = f.named(f.k8s_key_mismatches.filter("service_id IS NOT NULL"))
    return _finding(df, "possible_kubernetes_configuration_key_not_declared", "warning", _one(), _key("environment_key", "source_kind", "source_name", "source_key"), F.concat("source_name", F.lit(" has no key "), "source_key", F.lit(".")), 0.9, F.array("evidence", "declaration_evidence"), environment_key=F.col("environment_key"))


def k8s_source_unknowns(f: Facts) -> DataFrame:
    df = f.named(f.k8s_source_unknowns.filter("service_id IS NOT NULL"))
    return _finding(df, "possible_kubernetes_configuration_source_not_declared_locally", "info", _one(), _key("environment_key", "source_kind", "source_name", "source_key"), F.concat("source_name", F.lit(" is not declared here.")), 0.4, F.array("evidence"), environment_key=F.col("environment_key"))


def k8s_import_unknowns(f: Facts) -> DataFrame:
    rows = f.k8s_import_unknowns.filter("service_id IS NOT NULL")
    keys = ["service_id", "source_kind", "source_name"]
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("evidence")).alias("evidences"), F.sort_array(F.collect_set("prefix")).alias("prefixes"), F.sort_array(F.collect_set("container_role"), asc=False).alias("roles"), F.sort_array(F.collect_set(F.struct("workload_kind", "workload_name", "container_name"))).alias("workloads"), F.bool_or(F.col("prefix").isNull()).alias("unprefixed"))
    df = f.named(lists.join(relational.tri_state(rows, keys, "optional"), keys))
    return _finding(df, "possible_kubernetes_configuration_source_import_not_declared_locally", "info", _one(), _key("source_kind", "source_name"), F.concat("source_name", F.lit(" is imported but not declared here.")), 0.4, F.col("evidences"), availability=F.col("availability"), prefixes=F.col("prefixes"), includes_unprefixed_import=F.col("unprefixed"), container_roles=F.col("roles"), workloads=F.col("workloads"))


def _truthy(attributes: Column, key: str) -> Column:
    v = attributes[key]
    return F.coalesce(~F.lower(v).isin("", "false", "0", "null", "{}", "[]"), F.lit(False))


def _lacking(f: Facts, rules: dict[str, list[str]]) -> DataFrame:
    """Declared resources of the types with rules, none of whose attributes shows the setting."""
    lacking = F.lit(False)
    for kind, keys in rules.items():
        shown = reduce(lambda a, b: a | b, (_truthy(F.col("attributes"), k) for k in keys))
        lacking = lacking | ((F.col("iac_resource_type") == kind) & ~shown)
    return f.named(f.cloud_iac_resources.filter("service_id IS NOT NULL").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))).filter(lacking)).withColumn("resource", F.coalesce("physical_name", "logical_name"))


def missing_dead_letter_queue(f: Facts) -> DataFrame:
    return _finding(_lacking(f, constants.QUEUE_REDRIVE_KEYS), "possible_missing_dead_letter_queue", "warning", _one(), F.col("resource"), F.concat("resource", F.lit(" shows no dead-letter policy.")), 0.45, F.array("evidence"), resource=F.col("resource"))


def unencrypted(f: Facts) -> DataFrame:
    return _finding(_lacking(f, constants.ENCRYPTION_KEYS), "possible_unencrypted_cloud_resource", "info", _one(), F.col("resource"), F.concat("resource", F.lit(" shows no encryption at rest.")), 0.4, F.array("evidence"), resource=F.col("resource"))


def missing_versioning(f: Facts) -> DataFrame:
    return _finding(_lacking(f, constants.VERSIONING_KEYS), "possible_missing_bucket_versioning", "info", _one(), F.col("resource"), F.concat("resource", F.lit(" shows no versioning.")), 0.4, F.array("evidence"), resource=F.col("resource"))


def public_storage(f: Facts) -> DataFrame:
    rows = f.cloud_iac_resources.filter("resource_type = 'object_storage' AND service_id IS NOT NULL")
    public = F.map_filter("attributes", lambda k, v: reduce(lambda a, b: a | b, ((k == name) & v.isin(values) for name, values in constants.PUBLIC_VALUES.items())))
    df = f.named(rows.withColumn("entry", F.get(F.map_entries(public), 0)).filter("entry IS NOT NULL")).withColumn("resource", F.coalesce("physical_name", "logical_name"))
    return _finding(df, "possible_public_object_storage", "critical", _one(), F.col("resource"), F.concat("resource", F.lit(" sets "), "entry.key", F.lit(" to "), "entry.value", F.lit(".")), 0.85, F.array("evidence"), attribute=F.col("entry.key"), value=F.col("entry.value"))


DETECTORS: dict[str, Detector] = {f.__name__: f for f in (
    cycles, fan_imbalance, component_cycles, component_fan_imbalance, shared_database, ownership_overlap, duplicate_integrations, flow_hypotheses, read_side_effects, broad_handlers,
    broad_handlers_over_timeouts, policies_on_write_flows, retry_write_publish, retry_reaches_consumers, retry_reaches_persistent_consumers, retry_reaches_unrecovered_consumers,
    non_atomic_service_publish, error_semantics_lost, unhandled_endpoint_errors, internal_error_exposures, calls_without_policy, retries_on_non_idempotent_calls,
    retries_on_permanent_errors, retries_on_downstream_errors, timeouts_without_fallback, timeout_fallbacks_masking, timeouts_as_500, unmapped_downstream_errors,
    consumers_without_recovery, cloud_code_without_iac, cloud_iac_unused, shared_cloud_resource, k8s_key_mismatches, k8s_source_unknowns, k8s_import_unknowns,
    missing_dead_letter_queue, public_storage, unencrypted, missing_versioning,
)}


def all_findings(f: Facts) -> DataFrame:
    """The findings of all detectors, in one schema."""
    return reduce(DataFrame.unionByName, (d(f) for d in DETECTORS.values()))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(kind, services, subject, change, delta): new and resolved findings, and those whose count changed, by identity."""
    count = lambda df: df.withColumn("_count", F.coalesce(F.get_json_object("detail", "$.count").try_cast("long"), F.lit(0)))
    return relational.run_diff(count(previous), count(current), ["kind", "services", "subject"], "_count")


def to_page(findings: DataFrame) -> DataFrame:
    """Findings as they are listed: by severity in descending order of its text, then kind."""
    return relational.by_severity(findings, "kind", "services", "subject")


def detail_of(row) -> dict:
    return json.loads(row["detail"])
