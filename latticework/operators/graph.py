"""Graph operators on edge tables: bounded reachability, shortest paths, strong components, links and divergences.

Loops run one round for each hop, not for each node; each round is a join of a frontier with the edges, and its result is
checkpointed, so plans stay short. Every loop is bounded by the hops or edges asked for, or by the shrinking of the graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.sources.folders import checkpointed, workers_find_us


def reachable_edges(edges: DataFrame, roots: DataFrame, max_edges: int = 100, by: list[str] = (), source: str = "from_symbol", target: str = "to_symbol", order: str = "id") -> DataFrame:
    """The edges met in breadth-first order from each root, at most so many for each, with `depth` and `position` from 1.

    roots: (by, root). Edges come in the order of their depth, the place of the edge that led to them, and their own id; an edge
    is met once. `by` are keys that edges and roots share.
    """
    by = list(by)
    e = edges.select(*by, F.col(order).alias("edge"), F.col(source).alias("u"), F.col(target).alias("v"))
    frontier = roots.select(*by, "root", F.col("root").alias("u"), F.lit(0).cast("long").alias("parent")).distinct()
    met, depth = None, 0
    while True:
        depth += 1
        step = frontier.join(e, [*by, "u"]).groupBy(*by, "root", "edge", "u", "v").agg(F.min("parent").alias("parent"))
        if met is not None:
            step = step.join(met.select(*by, "root", "edge"), [*by, "root", "edge"], "left_anti")
        place = F.row_number().over(Window.partitionBy(*by, "root").orderBy("parent", "edge")).cast("long")
        if met is None:
            step = step.withColumn("position", place)
        else:
            so_far = met.groupBy(*by, "root").agg(F.max("position").alias("_so_far"))
            step = step.join(so_far, [*by, "root"]).withColumn("position", F.col("_so_far") + place).drop("_so_far")
        step = checkpointed(step.filter(F.col("position") <= max_edges).withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        met = step if met is None else checkpointed(met.unionByName(step))
        # A symbol is left once, at the first edge that reaches it.
        frontier = step.groupBy(*by, "root", F.col("v").alias("u")).agg(F.min("position").alias("parent"))
        known = met.filter(F.col("depth") < depth).select(*by, "root", F.col("v").alias("u")).unionByName(roots.select(*by, "root", F.col("root").alias("u"))).distinct()
        frontier = frontier.join(known, [*by, "root", "u"], "left_anti")
    return (met if met is not None else step).select(*by, "root", "depth", "position", "edge", F.col("u").alias(source), F.col("v").alias(target))


def reachable_nodes(edges: DataFrame, roots: DataFrame, max_hops: int, source: str = "source", target: str = "target") -> DataFrame:
    """(node, hops): all nodes within so many hops of any root, with the least hops."""
    e = edges.select(F.col(source).alias("u"), F.col(target).alias("v")).distinct()
    seen = roots.select(F.col("node"), F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        new = frontier.select(F.col("node").alias("u")).join(e, "u").select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = checkpointed(new.withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, start, goal, max_hops: int = 6, source: str = "source", target: str = "target", label: str | None = None) -> DataFrame:
    """(hops, path): one shortest directed path, as an array of (source, target, label); no row if the goal is not within reach.

    Ties go to the path of smaller labels and names. From a node to itself it is 0 hops and an empty path.
    """
    spark = edges.sparkSession
    hop = F.struct(F.col("u").alias("source"), F.col("v").alias("target"), F.col("label"))
    e = edges.select(F.col(source).alias("u"), F.col(target).alias("v"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"))
    e = e.groupBy("u", "v").agg(F.min("label").alias("label"))
    kind = e.schema["u"].dataType.simpleString()
    schema = f"hops int, path array<struct<source:{kind},target:{kind},label:string>>"
    if start == goal:
        return spark.createDataFrame([(0, [])], schema)
    frontier = spark.createDataFrame([(start,)], f"node {kind}").withColumn("path", F.array().cast(f"array<struct<source:{kind},target:{kind},label:string>>"))
    seen = frontier.select("node")
    for n in range(1, max_hops + 1):
        step = frontier.withColumnRenamed("node", "u").join(e, "u").join(seen.withColumnRenamed("node", "v"), "v", "left_anti")
        step = step.select(F.col("v").alias("node"), F.concat("path", F.array(hop)).alias("path")).groupBy("node").agg(F.min("path").alias("path"))
        frontier = checkpointed(step)
        found = frontier.filter(F.col("node") == F.lit(goal))
        if not found.isEmpty():
            return found.select(F.lit(n).alias("hops"), "path")
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier.select("node")))
    return spark.createDataFrame([], schema)


#: Edges up to which a group's components are found in one task, in memory: some 100 MB. Larger groups go by rounds of joins.
SMALL_GRAPH = 2_000_000


def strong_components(edges: DataFrame, by: list[str] = (), source: str = "source", target: str = "target", small: int = SMALL_GRAPH) -> DataFrame:
    """(by, node, component): strongly connected components of more than one node, named by their least node.

    Each graph, that is each group of `by`, is looked at as its counted edges allow: graphs of up to `small` edges whole, many
    of them side by side, and larger ones by rounds over tables.
    """
    by = list(by)
    e = checkpointed(edges.select(*by, F.col(source).alias("u"), F.col(target).alias("v")).filter("u <> v").distinct())
    if not by:
        large = e.count() > small
        return _components_in_rounds(e, by) if large else _components_at_once(e, by)
    sizes = checkpointed(e.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select(*by))
    if sizes.isEmpty():
        return _components_at_once(e, by)
    return _components_at_once(e.join(sizes, by, "left_anti"), by).unionByName(_components_in_rounds(checkpointed(e.join(sizes, by, "left_semi")), by))


def _components_at_once(e: DataFrame, by: list[str]) -> DataFrame:
    """One task for each graph; a graph's edges are known to be few."""
    workers_find_us(e.sparkSession)
    node = e.schema["u"].dataType
    names = [f.name for f in e.schema if f.name in by]
    schema = T.StructType([*(e.schema[c] for c in names), T.StructField("node", node), T.StructField("component", node)])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks], type=t.schema.field("u").type).combine_chunks()
        order = pc.array_sort_indices(ends.unique())
        nodes = ends.unique().take(order)
        at = pc.index_in(ends, nodes).to_numpy(zero_copy_only=False)
        root = tarjan(len(nodes), at[: t.num_rows], at[t.num_rows :])
        sizes = np.bincount(root, minlength=len(nodes))
        some = np.flatnonzero(sizes[root] > 1)
        columns = {c: pa.repeat(k.cast(t.schema.field(c).type), len(some)) for c, k in zip(names, key, strict=True)} if names else {}
        return pa.table({**columns, "node": nodes.take(pa.array(some)), "component": nodes.take(pa.array(root[some]))})

    groups = e.groupBy(*names) if names else e.groupBy()
    return groups.applyInArrow(run, schema)


def tarjan(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's strong component, for edges from u to v among 0..n-1; depth first without recursion."""
    order = np.argsort(u, kind="stable")
    heads = v[order].tolist()
    begin = np.searchsorted(u[order], np.arange(n + 1)).tolist()
    index, low, place = [-1] * n, [0] * n, begin[:-1]
    part, open_, count = list(range(n)), [], 0
    inside = [False] * n
    for start in range(n):
        if index[start] >= 0:
            continue
        path = [start]
        while path:
            x = path[-1]
            if index[x] < 0:
                index[x] = low[x] = count
                count += 1
                open_.append(x)
                inside[x] = True
            while place[x] < begin[x + 1]:
                y = heads[place[x]]
                if index[y] < 0:
                    path.append(y)
                    break
                if inside[y]:
                    low[x] = min(low[x], low[y])
                place[x] += 1
            else:
                path.pop()
                if low[x] == index[x]:
                    members = []
                    while True:
                        y = open_.pop()
                        inside[y] = False
                        members.append(y)
                        if y == x:
                            break
                    least = min(members)
                    for y in members:
                        part[y] = least
    return np.array(part, np.int64)


def _components_in_rounds(e: DataFrame, by: list[str]) -> DataFrame:
    """Forward and backward colouring: nodes take the least label that reaches them; those that their own label's node also
    reaches backwards are its component and leave the graph. Nodes without an edge in or out are trimmed first.
    """
    found = None
    while True:
        while True:  # trim: a node of a cycle has edges both ways
            n = e.count()
            heads = e.select(*by, F.col("v").alias("u")).distinct()
            tails = e.select(*by, F.col("u").alias("v")).distinct()
            e = checkpointed(e.join(heads, [*by, "u"], "left_semi").join(tails, [*by, "v"], "left_semi").select(*by, "u", "v"))
            if e.count() == n:
                break
        if e.isEmpty():
            break
        colour = _least_label(e, by, "u", "v")
        inside = e.join(colour.select(*by, F.col("node").alias("u"), F.col("label").alias("_a")), [*by, "u"]).join(colour.select(*by, F.col("node").alias("v"), F.col("label").alias("_b")), [*by, "v"])
        inside = checkpointed(inside.filter("_a = _b").select(*by, "u", "v", F.col("_a").alias("label")))
        # Backwards from each label's own node, along edges within its colour.
        reached = inside.select(*by, "label", F.col("label").alias("node")).distinct()
        frontier = reached
        while not frontier.isEmpty():
            new = frontier.select(*by, "label", F.col("node").alias("v")).join(inside, [*by, "label", "v"]).select(*by, "label", F.col("u").alias("node")).distinct()
            frontier = checkpointed(new.join(reached, [*by, "label", "node"], "left_anti"))
            reached = checkpointed(reached.unionByName(frontier))
        big = reached.groupBy(*by, "label").agg(F.count("*").alias("_n")).filter("_n > 1").select(*by, "label")
        part = reached.join(big, [*by, "label"], "left_semi").select(*by, "node", F.col("label").alias("component"))
        found = checkpointed(part if found is None else found.unionByName(part))
        gone = reached.select(*by, "node")
        e = e.join(gone.withColumnRenamed("node", "u"), [*by, "u"], "left_anti").join(gone.withColumnRenamed("node", "v"), [*by, "v"], "left_anti")
        e = checkpointed(e.select(*by, "u", "v"))
    if found is None:
        return e.select(*by, F.col("u").alias("node"), F.col("u").alias("component"))
    least = found.groupBy(*by, "component").agg(F.min("node").alias("_least"))
    return found.join(least, [*by, "component"]).select(*by, "node", F.col("_least").alias("component"))


def _least_label(e: DataFrame, by: list[str], u: str, v: str) -> DataFrame:
    """(by, node, label): the least node from which each node can be reached, itself included."""
    nodes = e.select(*by, F.explode(F.array(u, v)).alias("node")).distinct().withColumn("label", F.col("node"))
    nodes = checkpointed(nodes)
    while True:
        sent = e.join(nodes.select(*by, F.col("node").alias(u), "label"), [*by, u]).groupBy(*by, F.col(v).alias("node")).agg(F.min("label").alias("_in"))
        new = checkpointed(nodes.join(sent, [*by, "node"], "left").select(*by, "node", F.least("label", "_in").alias("label"), (F.col("_in") < F.col("label")).alias("_moved")))
        moved = not new.filter("_moved").isEmpty()
        nodes = new.select(*by, "node", "label")
        if not moved:
            return nodes


def relationship_edges(calls: DataFrame, links: DataFrame, services: DataFrame) -> DataFrame:
    """(source, target, via): resolved calls and message links by service name."""
    a = services.select(F.col("id").alias("from_service_id"), F.col("name").alias("source"))
    b = services.select(F.col("id").alias("to_service_id"), F.col("name").alias("target"))
    one = calls.filter("to_service_id IS NOT NULL").select("from_service_id", "to_service_id", F.col("call_kind").alias("via"))
    two = links.select("from_service_id", "to_service_id", F.concat(F.lit("channel:"), "channel").alias("via"))
    return one.unionByName(two).join(a, "from_service_id").join(b, "to_service_id").select("source", "target", "via").distinct()


def relationships(edges: DataFrame, service: str, direction: str = "both") -> DataFrame:
    """The edges at one service, outbound, inbound or both, with their direction."""
    if direction not in ("outbound", "inbound", "both"):
        raise ValueError("direction must be outbound, inbound or both")
    out = edges.filter(F.col("source") == service).withColumn("direction", F.lit("outbound"))
    into = edges.filter(F.col("target") == service).withColumn("direction", F.lit("inbound"))
    return out if direction == "outbound" else into if direction == "inbound" else out.unionByName(into)


def component_edges(flow_edges: DataFrame) -> DataFrame:
    """(service_id, source, target): calls between owners that are both local to the service, without links to themselves."""
    from latticework.functions.text import owner

    e = flow_edges.select("service_id", owner(F.col("from_symbol")).alias("source"), owner(F.col("to_symbol")).alias("target"))
    local = e.select("service_id", F.col("source").alias("target")).distinct()
    return e.join(local, ["service_id", "target"], "left_semi").filter("source <> target").select("service_id", "source", "target").distinct()


def divergence(static: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, count): edges seen at run time alone, with their counts, and edges in the source alone."""
    o = observed.groupBy(*keys).agg(F.sum("count").alias("count"))
    s = static.select(*keys).distinct()
    only_seen = o.join(s, keys, "left_anti").select(*keys, F.lit("observed_only").alias("state"), "count")
    return only_seen.unionByName(s.join(o, keys, "left_anti").select(*keys, F.lit("static_only").alias("state"), F.lit(None).cast("long").alias("count")))


def edges_among(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """The edges with both ends among the nodes; of equal ends one, static before inferred."""
    ends = lambda c: nodes.select(F.col(node).alias(c)).distinct()
    inside = edges.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")
    rank = F.when(F.col("origin") == "static", 0).otherwise(1)
    one = inside.groupBy("source", "target").agg(F.min(F.struct(rank.alias("rank"), "origin")).alias("_r"))
    return one.select("source", "target", F.col("_r.origin").alias("origin"))
