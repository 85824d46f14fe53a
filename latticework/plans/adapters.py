"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("repository_id"), F.col("n_name").alias("name"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): a customer's nation orders from a supplier's."""
    t = lambda name: table(spark, sf_dir, name)
    l = t("lineitem").select("l_orderkey", "l_suppkey")  # noqa: E741
    o = t("orders").select("o_orderkey", "o_custkey")
    c = t("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("source"))
    s = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("target"))
    return l.join(s, l["l_suppkey"] == s["s_suppkey"]).join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).select("source", "target").distinct()


def brand_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): brand and type share a part: from a brand to a type's name."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service calls between nations: a line of status R is external, one of A is not resolved."""
    t = lambda name: table(spark, sf_dir, name)
    l = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")  # noqa: E741
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("from_service_id"))
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("to"))
    rows = l.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").groupBy("from_service_id", "to", F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return rows.select("from_service_id", F.when(F.col("flag") == "N", F.col("to")).alias("to_service_id"), F.when(F.col("flag") == "R", "external").otherwise("internal").alias("target_kind"), F.col("to").alias("wanted"), "n")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nations publish the parts they supply; customer nations consume the parts they order."""
    t = lambda name: table(spark, sf_dir, name)
    l = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("channel"))  # noqa: E741
    s = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("service_id"))
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("service_id"))
    out = l.join(s, "l_suppkey").select("service_id", F.lit("publishes").alias("direction"), "channel").distinct()
    into = l.join(o, "l_orderkey").join(c, "o_custkey").select("service_id", F.lit("consumes").alias("direction"), "channel").distinct()
    return out.unionByName(into)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target) of all lines: from a supplier to a part for the flag A, back for R, and from a part to its brand for N."""
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("p"), F.col("l_returnflag").alias("flag"), "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = lines.join(brands, "l_partkey")
    source, target = F.when(F.col("flag") == "A", F.col("s")).otherwise(F.col("p")), F.when(F.col("flag") == "A", F.col("p")).when(F.col("flag") == "R", F.col("s")).otherwise(F.col("p_brand"))
    return rows.select(source.alias("source"), target.alias("target")).distinct()


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, kind, count): events by user and type as run-time counters."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("service"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("count"), "ts")


def line_facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Fact tables from order lines: suppliers are services, a part is a source symbol, the return flag tells what a line states.

    N: an HTTP call (POST if the line is open), A: a write, and a publication if of more than 30 pieces, R: a policy, a retry if of more than 25.
    """
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    evidence = F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line")).alias("evidence")
    at = [F.col("l_suppkey").alias("service_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source")]
    s = table(spark, sf_dir, "supplier")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    edge = [at[0], F.col("l_orderkey").alias("id"), at[1].alias("from_symbol"), F.lit("static").alias("origin"), evidence]
    written = l.filter("l_returnflag = 'A'")
    return {
        "services": s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("repository_id"), F.col("s_name").alias("name")),
        "repositories": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        "persistence_entities": l.join(p, "l_partkey").select(F.col("l_suppkey").alias("service_id"), F.col("p_name").alias("name"), F.when(F.col("p_type") == "SMALL", "unknown").otherwise(F.col("p_type")).alias("engine")).distinct(),
        "static_service_calls": l.filter("l_returnflag = 'N'").select(*at, F.lit("store").alias("target_service"), F.lit("http").alias("protocol"), F.when(F.col("l_linestatus") == "O", "POST").otherwise("GET").alias("target_method"), F.lit("/").alias("target_path"), evidence),
        "static_resilience_policies": l.filter("l_returnflag = 'R'").select(*at, F.when(F.col("l_quantity") > 25, "retry").otherwise("timeout").alias("kind"), evidence),
        "flow_edges": written.select(*edge, F.lit("table").alias("to_symbol"), F.lit("writes").alias("kind")).unionByName(written.filter("l_quantity > 30").select(*edge, F.lit("channel").alias("to_symbol"), F.lit("publishes").alias("kind"))),
    }
