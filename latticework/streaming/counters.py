"""Run-time counters of flow edges: validated, added up, compared with the source, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.functions import constants
from latticework.sources.catalog import Catalog

#: What identifies a counter.
EDGE = ["service_id", "source", "from_symbol", "to_symbol", "kind"]
#: The keys that an observation must have, and no others.
OBSERVATION = ["from", "to", "kind", "count"]


def valid(observation: Column) -> Column:
    """Whether a JSON observation has just these keys, names of 1 to 256 characters, a known kind, and a whole count above 0."""
    keys = F.json_object_keys(observation)
    field = lambda k: F.get_json_object(observation, f"$.{k}")
    exact = (F.size(keys) == len(OBSERVATION)) & F.forall(F.array(*map(F.lit, OBSERVATION)), lambda k: F.array_contains(keys, k))
    named = F.length(field("from")).between(1, constants.LONGEST_NAME) & F.length(field("to")).between(1, constants.LONGEST_NAME)
    counted = field("count").rlike("^[0-9]+$") & (field("count").try_cast("long") > 0)
    return F.coalesce(exact & named & field("kind").isin(constants.FLOW_KINDS) & counted, F.lit(False))


def parsed(rows: DataFrame, observation: str = "observation") -> DataFrame:
    """Valid observations as columns; the others go. rows: service_id, source, observation, ts."""
    field = lambda k: F.get_json_object(observation, f"$.{k}")
    good = rows.filter(valid(F.col(observation)) & F.col("source").isin(constants.OBSERVATION_SOURCES))
    return good.select("service_id", "source", field("from").alias("from_symbol"), field("to").alias("to_symbol"), field("kind").alias("kind"), field("count").cast("long").alias("count"), "ts")


def accepted(rows: DataFrame, observation: str = "observation") -> DataFrame:
    """(accepted, rejected): how many observations are valid and how many are not."""
    ok = valid(F.col(observation)) & F.col("source").isin(constants.OBSERVATION_SOURCES)
    return rows.agg(F.count_if(ok).alias("accepted"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("rejected"))


def merged(rows: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """Counters: counts added up, the first and the last time seen. A replayed observation counts again."""
    return rows.groupBy(*keys).agg(F.sum("count").alias("observed_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def added(now: DataFrame, new: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """Counters so far and those of a batch as one."""
    both = now.select(*keys, "observed_count", "first_seen", "last_seen").unionByName(new.select(*keys, "observed_count", "first_seen", "last_seen"))
    return both.groupBy(*keys).agg(F.sum("observed_count").alias("observed_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def live(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A running table of counters, held as state of the stream."""
    return merged(parsed(stream)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def into_catalog(stream: DataFrame, catalog: Catalog, checkpoint: str, static: DataFrame | None = None, on_divergence=None) -> StreamingQuery:
    """Adds each micro-batch to the stored counters once, though it be retried; `on_divergence` gets the edges that only one side knows, after each."""

    def write(batch: DataFrame, number: int) -> None:
        mark = f"{checkpoint} {number}"
        if catalog.mark("runtime_flow_observations") != mark:  # else this batch is there already, and comes again after a failure
            catalog.overwrite("runtime_flow_observations", added(catalog.read("runtime_flow_observations"), merged(parsed(batch))), mark)
        if static is not None and on_divergence is not None:
            from latticework.operators.graph import divergence

            seen = catalog.read("runtime_flow_observations").withColumnRenamed("observed_count", "count")
            on_divergence(divergence(static, seen, ["service_id", "from_symbol", "to_symbol", "kind"]))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling event-time windows; rows later than the watermark go."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
