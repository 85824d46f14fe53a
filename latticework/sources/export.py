"""Markdown pages and Mermaid diagrams of what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def topology(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(diagram): a flowchart of all services: calls are solid, messages dashed; services in cycles are marked.

    edges: (source, target, via); cyclic: (service).
    """
    nodes = edges.select(F.explode(F.array("source", "target")).alias("service")).distinct()
    node = nodes.select(F.lit(1).alias("o"), F.concat(F.lit("  "), _id(F.col("service")), F.lit('["'), "service", F.lit('"]')).alias("line"))
    arrow = F.when(F.col("via").startswith("channel:"), F.concat(F.lit(" -. "), F.substring_index("via", ":", -1), F.lit(" .-> "))).otherwise(F.concat(F.lit(" -->|"), "via", F.lit("| ")))
    edge = edges.distinct().select(F.lit(2).alias("o"), F.concat(F.lit("  "), _id(F.col("source")), arrow, _id(F.col("target"))).alias("line"))
    mark = cyclic.distinct().join(nodes, "service", "left_semi").select(F.lit(3).alias("o"), F.concat(F.lit("  style "), _id(F.col("service")), F.lit(" stroke:#c00")).alias("line"))
    lines = node.unionByName(edge).unionByName(mark)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n")
    return lines.agg(F.concat(F.lit("flowchart LR\n"), body).alias("diagram"))


def entities(persistence: DataFrame) -> DataFrame:
    """(service_id, diagram): an entity diagram for each service, from the fields in schema_json."""
    fields = F.from_json("schema_json", "array<struct<name:string,type:string>>")
    block = F.concat(F.lit("  "), _id(F.col("name")), F.lit(" {\n"), F.array_join(F.transform(F.coalesce(fields, F.array()), lambda f: F.concat(F.lit("    "), _id(F.coalesce(f["type"], F.lit("unknown"))), F.lit(" "), _id(f["name"]), F.lit("\n"))), ""), F.lit("  }"))
    return persistence.groupBy("service_id").agg(F.concat(F.lit("erDiagram\n"), F.array_join(F.array_sort(F.collect_set(block)), "\n")).alias("diagram"))


def pages(services: DataFrame, apis: DataFrame) -> DataFrame:
    """(path, page): an index page for each service, its APIs listed in order, and a page for each API."""
    row = F.concat(F.lit("- `"), "method", F.lit(" "), "path", F.lit("` "), F.coalesce("summary", F.lit("")))
    lists = apis.groupBy("service_id").agg(F.array_join(F.array_sort(F.collect_set(row)), "\n").alias("list"))
    index = services.join(lists, services["id"] == lists["service_id"], "left").select(F.concat(_id(F.col("name")), F.lit("/index.md")).alias("path"), F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce("short_desc", F.lit("")), F.lit("\n\n"), F.coalesce("list", F.lit(""))).alias("page"))
    named = apis.join(services.select(F.col("id").alias("service_id"), F.col("name").alias("service")), "service_id")
    each = named.select(F.concat(_id(F.col("service")), F.lit("/"), _id(F.concat_ws("_", "method", "path")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "method", F.lit(" "), "path", F.lit("\n\n"), F.coalesce("summary", F.lit(""))).alias("page"))
    return index.unionByName(each)


def written(pages_: DataFrame, folder: str) -> None:
    """One text file for each page, in a folder named by its path."""
    pages_.write.mode("overwrite").partitionBy("path").text(folder)
