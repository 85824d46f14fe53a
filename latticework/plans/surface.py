"""Change surfaces: which services a task touches, with context, dependencies, risks and freshness, all from indexed facts.

The one step that is not a computation, judging candidates, is an injected synthesizer: a function from a DataFrame of
(service, rank, score, degree) to (service, role, confidence, reason). The default ranks by score, then degree, so that results
are reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import relational, retrieval

Synthesizer = Callable[[DataFrame], DataFrame]
LEAST_FEEDBACK = 3
LIST_MOST, EVIDENCE_MOST = 8, 5


def by_rank(candidates: DataFrame) -> DataFrame:
    """The default judgement: the first candidate is primary, the others secondary, with confidence falling by rank."""
    role = F.when(F.col("rank") == 1, "primary").otherwise("secondary")
    return candidates.select("service", role.alias("role"), F.greatest(F.lit(0.1), F.lit(1.0) - 0.1 * (F.col("rank") - 1)).alias("confidence"), F.concat(F.lit("ranked "), F.col("rank").cast("string")).alias("reason"))


def candidates(documents: DataFrame, task: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 10) -> DataFrame:
    """(service, rank, score, degree): services whose documents match the task, and those within some hops of them.

    documents: (service, content_text); task: (query_id, query); edges: (source, target) by service name.
    """
    docs = documents.select("service", "content_text").distinct().withColumn("doc", F.xxhash64("service", "content_text"))
    hits = retrieval.bm25(docs, task, "doc", "content_text", limit=20)
    seeds = hits.join(docs.select("doc", "service"), "doc").groupBy("service").agg(F.max("score").alias("score"))
    around = retrieval.keyword_graph(seeds.select(F.col("service").alias("node")), edges, hops, limit).withColumnRenamed("node", "service")
    degree = edges.select(F.explode(F.array("source", "target")).alias("service")).groupBy("service").agg(F.count("*").alias("degree"))
    rows = around.join(seeds, "service", "left").join(degree, "service", "left").na.fill(0, ["score", "degree"])
    return relational.top_per_group(rows.withColumn("_g", F.lit(0)), ["_g"], [F.desc("score"), F.desc("degree"), "service"], limit).select("service", "rank", "score", "degree")


def context(services: DataFrame, apis: DataFrame, calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(service_id, apis, calls, callers, entities): at most eight of each, in order, for each candidate."""

    def firsts(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        lists = df.select(F.col(key).alias("service_id"), value.alias("_v")).groupBy("service_id").agg(F.sort_array(F.collect_set("_v")).alias("_l"))
        return lists.select("service_id", F.slice("_l", 1, LIST_MOST).alias(name))

    out = services.select(F.col("id").alias("service_id"))
    for df in (
        firsts(apis, "service_id", F.concat_ws(" ", "method", "path"), "apis"), firsts(calls, "from_service_id", F.concat_ws(" ", "to_service_name", "call_kind"), "calls"),
        firsts(calls.filter("to_service_id IS NOT NULL"), "to_service_id", F.col("from_service_id").cast("string"), "callers"), firsts(entities, "service_id", F.concat_ws(" ", "name", "engine"), "entities"),
    ):
        out = out.join(df, "service_id", "left")
    return out.select("service_id", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("apis", "calls", "callers", "entities")))


def cache_key(backend: Column, prompt: Column, schema: Column, repository: Column) -> Column:
    """A SHA-256 over the parts, each ended by a zero byte; a null repository is empty."""
    return F.sha2(F.concat(*(F.concat(F.coalesce(c, F.lit("")), F.lit("\0")) for c in (backend, prompt, schema, repository))), 256)


def recalibrated(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Confidences mixed, 7 to 3, with the share of confirmed outcomes of a service, where it has three or more; clipped to 0..1, four places."""
    n = feedback.groupBy("service").agg(F.count_if(F.col("outcome") == "confirmed").alias("_c"), F.count_if(F.col("outcome") == "rejected").alias("_r"))
    mixed = 0.7 * F.col("confidence") + 0.3 * F.col("_c") / (F.col("_c") + F.col("_r"))
    new = F.when(F.col("_c") + F.col("_r") >= LEAST_FEEDBACK, mixed).otherwise(F.col("confidence"))
    return findings.join(n, "service", "left").withColumn("confidence", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), new)), 4)).drop("_c", "_r")


def known_only(findings: DataFrame, services: DataFrame) -> DataFrame:
    """Findings on services that exist; invented names go."""
    return findings.join(services.select(F.col("name").alias("service")).distinct(), "service", "left_semi")


def static_dependencies(primary: DataFrame, edges: DataFrame, excluded: DataFrame, most: int = 3) -> DataFrame:
    """(service, role, confidence, reason): the first few targets of primary services that are not findings yet."""
    near = edges.join(primary.select(F.col("service").alias("source")).distinct(), "source", "left_semi").select(F.col("target").alias("service"), "source")
    near = relational.without(near, excluded.select("service").unionByName(primary.select("service")), ["service"])
    one = near.groupBy("service").agg(F.min("source").alias("source"))
    return one.orderBy("service").limit(most).select("service", F.lit("secondary").alias("role"), F.lit(0.6).alias("confidence"), F.concat(F.lit("called by "), "source").alias("reason"))


def contracts_at_risk(messages: DataFrame, relevant: DataFrame) -> DataFrame:
    """(channel, producer, consumers): channels that relevant services publish, their first producer and all their consumers elsewhere."""
    out = messages.filter("direction = 'publishes'").join(relevant.select("service").distinct(), "service", "left_semi").groupBy("channel").agg(F.min("service").alias("producer"))
    into = messages.filter("direction = 'consumes'").select("channel", F.col("service").alias("consumer")).distinct()
    rows = out.join(into, "channel", "left").filter("consumer IS NULL OR consumer <> producer")
    return rows.groupBy("channel", "producer").agg(F.sort_array(F.collect_set("consumer")).alias("consumers"))


def freshness(services: DataFrame, heads: DataFrame) -> DataFrame:
    """(service, stale): whether the indexed commit is not the head; null if either is unknown."""
    rows = services.select(F.col("name").alias("service"), "repository_id", "source_commit").join(heads.select("repository_id", "head"), "repository_id", "left")
    return rows.select("service", (F.col("source_commit") != F.col("head")).alias("stale"))


def stale_unknowns(fresh: DataFrame) -> DataFrame:
    return fresh.filter("stale").select("service", F.concat(F.lit("The index of "), "service", F.lit(" is older than its source.")).alias("unknown"))


def next_queries(apis: DataFrame, messages: DataFrame, unmapped: DataFrame, most: int = 5) -> DataFrame:
    """(tool, service, argument): for each service its first API and its messages, then unresolved calls; five at most."""
    first = apis.groupBy("service").agg(F.min(F.concat_ws(" ", "method", "path")).alias("argument")).select(F.lit(1).alias("_o"), F.lit("describe_api").alias("tool"), "service", "argument")
    msg = messages.select("service").distinct().select(F.lit(2).alias("_o"), F.lit("describe_messages").alias("tool"), "service", F.lit(None).cast("string").alias("argument"))
    gone = unmapped.select(F.lit(3).alias("_o"), F.lit("search").alias("tool"), "service", F.col("to_service_name").alias("argument")).distinct()
    rows = first.unionByName(msg).unionByName(gone)
    last = F.when(F.col("_o") == 3, 1).otherwise(0)
    return rows.orderBy(last, "service", "_o", "argument").limit(most).select("tool", "service", "argument")


def risks_for(cards: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings whose services overlap the cards'."""
    labels = cards.agg(F.collect_set("service").alias("_labels"))
    return findings.join(F.broadcast(labels), F.arrays_overlap("services", "_labels")).drop("_labels")


def interfaces(apis: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """(service_id, interface): APIs, then entrypoints that are not among them."""
    a = apis.select("service_id", F.concat_ws(" ", "method", "path").alias("interface")).distinct()
    e = entrypoints.select("service_id", F.concat_ws(" ", "method", "name").alias("interface")).distinct()
    return a.unionByName(relational.without(e, a, ["service_id", "interface"]))


def entrypoint_smells(entrypoints: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, smell): GraphQL operations that write or publish at all, and flows that do both, by their own edges."""
    ops = edges.filter("kind IN ('writes', 'publishes')").groupBy(F.col("entrypoint_id").alias("id")).agg(F.bool_or(F.col("kind") == "writes").alias("w"), F.bool_or(F.col("kind") == "publishes").alias("p"))
    rows = entrypoints.join(ops, "id")
    one = rows.filter(F.col("kind") == "graphql").select("id", F.lit("graphql_side_effect").alias("smell"))
    return one.unionByName(rows.filter("w AND p").select("id", F.lit("write_and_publish").alias("smell")))


def analyse(documents: DataFrame, task: DataFrame, edges: DataFrame, services: DataFrame, feedback: DataFrame, synthesizer: Synthesizer = by_rank) -> DataFrame:
    """(service, role, confidence, reason): candidates judged, invented names dropped, confidences recalibrated, dependencies added."""
    found = recalibrated(known_only(synthesizer(candidates(documents, task, edges)), services), feedback).select("service", "role", "confidence", "reason")
    more = static_dependencies(found.filter("role = 'primary'"), edges, found)
    return found.unionByName(more)


def findings_of_run(run_id: int, judged: DataFrame) -> DataFrame:
    return judged.withColumn("run_id", F.lit(run_id).cast("long")).select("run_id", "service", "role", "confidence", "reason")


def similar_tasks(vectors: DataFrame, task_vector: list[float], findings: DataFrame, outcomes: DataFrame, top: int = 3) -> DataFrame:
    """(run_id, score, primaries, outcome): the most similar past runs with what they predicted and how it went."""
    spark = vectors.sparkSession
    q = spark.createDataFrame([(0, [float(x) for x in task_vector])], "query_id int, vector array<double>")
    near = retrieval.nearest(vectors.select("run_id", F.col("vector").cast("array<double>").alias("vector")), q, "run_id", "vector", floor=-1.0, limit=top)
    primaries = findings.filter("role = 'primary'").groupBy("run_id").agg(F.sort_array(F.collect_set("service")).alias("primaries"))
    return near.join(primaries, "run_id", "left").join(outcomes, "run_id", "left").select("run_id", "score", "primaries", F.coalesce("outcome", F.lit("none")).alias("outcome"))


def outcomes(verifications: DataFrame, feedback: DataFrame) -> DataFrame:
    """(run_id, outcome): the latest verification if there is one, else the feedback counted."""
    v = verifications.groupBy("run_id").agg(F.max_by(F.format_string("precision %s, recall %s", "precision", "recall"), "id").alias("_v"))
    f = feedback.groupBy("run_id").agg(F.format_string("%d confirmed, %d rejected", F.count_if(F.col("outcome") == "confirmed"), F.count_if(F.col("outcome") == "rejected")).alias("_f"))
    return v.join(f, "run_id", "full").select("run_id", F.coalesce("_v", "_f").alias("outcome"))
