"""The operators over the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import constants, text
from latticework.operators import graph, relational, retrieval
from latticework.plans import adapters
from latticework.plans.adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(array) -> F.Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


_NATION_EDGES = """edges AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS source, CAST(s_nationkey AS BIGINT) AS target FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""

# --- lookups and joins ----------------------------------------------------------------------------------------------


@query(f"""WITH {_NATION_EDGES},
    f AS (SELECT source AS node, 'fan_out' AS kind, count(DISTINCT target) AS peers FROM edges GROUP BY 1
    UNION ALL SELECT target, 'fan_in', count(DISTINCT source) FROM edges GROUP BY 1) SELECT n_name AS service, kind, peers FROM f JOIN nation ON node = n_nationkey WHERE peers >= 4""")
def fan_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = adapters.services(spark, sf_dir).select(F.col("id").alias("node"), F.col("name").alias("service"))
    return relational.fan(adapters.nation_edges(spark, sf_dir)).join(names, "node").select("service", "kind", "peers")


@query(f"""WITH {_NATION_EDGES}, o AS (SELECT source AS node, count(DISTINCT target) AS ce FROM edges GROUP BY 1), i AS (SELECT target AS node, count(DISTINCT source) AS ca FROM edges GROUP BY 1)
    SELECT coalesce(o.node, i.node) AS node, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, round_even(CAST(coalesce(ce, 0) AS DOUBLE) / (coalesce(ce, 0) + coalesce(ca, 0)), 2) AS instability FROM o FULL JOIN i ON o.node = i.node""")
def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.instability(adapters.nation_edges(spark, sf_dir))


@query("SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1, 2")
def services_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.with_count(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier"), "n_nationkey", "s_nationkey")


@query("SELECT p_partkey, p_name, p_brand FROM (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) WHERE n = 1")
def unambiguous_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unambiguous(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicated(table(spark, sf_dir, "part"), "p_name")


@query("""WITH g AS (SELECT p_name, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1), l AS (SELECT p_name, p_brand, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1, 2)
    SELECT p.p_partkey, CASE WHEN g.n = 1 THEN g.id WHEN l.n = 1 THEN l.id END AS resolved_id FROM part p JOIN g USING (p_name) JOIN l ON p.p_name = l.p_name AND p.p_brand = l.p_brand""")
def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return relational.resolve_reference(parts, parts, "p_name", "p_brand", "p_name", "p_brand", "p_partkey").select("p_partkey", "resolved_id")


@query("SELECT n_nationkey AS id, CASE WHEN n > 1 THEN coalesce(r_name, 'standalone') || '/' || n_name ELSE n_name END AS display FROM (SELECT *, count(*) OVER (PARTITION BY n_name) AS n FROM nation) LEFT JOIN region ON n_regionkey = r_regionkey")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.display_names(adapters.services(spark, sf_dir), adapters.repositories(spark, sf_dir))


@query(f"WITH {_NATION_EDGES} SELECT a.n_name AS from_name, b.n_name AS to_name FROM edges JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey")
def internal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = adapters.nation_edges(spark, sf_dir).select(F.col("source").alias("from_service_id"), F.col("target").alias("to_service_id"))
    return relational.distinct_edges(edges, adapters.services(spark, sf_dir))


_CALLS = """calls AS (SELECT CAST(c_nationkey AS BIGINT) AS from_service_id, CAST(s_nationkey AS BIGINT) AS wanted, l_returnflag AS flag, count(*) AS n FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


@query(f"WITH {_CALLS} SELECT n_name AS from_name, wanted AS to_service_id, n FROM calls JOIN nation ON from_service_id = n_nationkey WHERE flag = 'N'")
def inbound_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.inbound(adapters.calls(spark, sf_dir), adapters.services(spark, sf_dir)).select("from_name", "to_service_id", "n")


@query(f"WITH {_CALLS} SELECT from_service_id, wanted, n FROM calls WHERE flag = 'A'")
def unmapped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unmapped(adapters.calls(spark, sf_dir)).select("from_service_id", "wanted", "n")


@query(f"""WITH {_CALLS} SELECT from_service_id, wanted, flag, CASE WHEN a.n_regionkey = b.n_regionkey THEN wanted END AS to_service_id,
    CASE WHEN a.n_regionkey = b.n_regionkey THEN 'internal' WHEN flag = 'R' THEN 'external' ELSE 'internal' END AS target_kind
    FROM calls JOIN nation a ON from_service_id = a.n_nationkey JOIN nation b ON wanted = b.n_nationkey""")
def reconciled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.services(spark, sf_dir)
    c = adapters.calls(spark, sf_dir).join(s.select(F.col("id").alias("wanted"), F.col("name").alias("to_service_name")), "wanted")
    c = c.withColumn("flag", F.when(F.col("target_kind") == "external", "R").when(F.col("to_service_id").isNotNull(), "N").otherwise("A"))
    return relational.reconciled(c, s).select("from_service_id", "wanted", "flag", "to_service_id", "target_kind")


_MESSAGES = """publishes AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS service_id, l_partkey AS channel FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    consumes AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS service_id, l_partkey AS channel FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {_MESSAGES} SELECT p.service_id AS from_service_id, c.service_id AS to_service_id, count(*) AS channels FROM publishes p JOIN consumes c ON p.channel = c.channel AND p.service_id <> c.service_id GROUP BY 1, 2")
def channel_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.channel_links(adapters.messages(spark, sf_dir)).groupBy("from_service_id", "to_service_id").agg(F.count("*").alias("channels"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = a.l_partkey AND r.l_suppkey = a.l_suppkey)")
def without_counterpart(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    return relational.without(l.filter("l_returnflag = 'A'").drop("l_returnflag").distinct(), l.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


@query("""WITH a AS (SELECT l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem WHERE l_linestatus <> 'F')
    SELECT a.l_partkey, a.l_suppkey, a.flag FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.l_partkey = b.l_partkey AND a.flag IS NOT DISTINCT FROM b.flag)""")
def without_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), "l_linestatus")
    return relational.without(rows.filter("l_linestatus = 'F'").drop("l_linestatus"), rows.filter("l_linestatus <> 'F'"), ["l_partkey"], ["flag"])


@query("""WITH n AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N') SELECT n.l_partkey, n.l_suppkey FROM n WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_partkey = n.l_partkey AND r.l_suppkey = n.l_suppkey AND r.l_returnflag = 'R')
    AND NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_partkey = n.l_partkey AND a.l_suppkey = n.l_suppkey AND a.l_returnflag = 'A')""")
def without_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")  # noqa: E741
    keys = ["l_partkey", "l_suppkey"]
    return relational.without_any(l.filter("l_returnflag = 'N'").select(*keys).distinct(), (l.filter("l_returnflag = 'R'"), keys), (l.filter("l_returnflag = 'A'"), keys))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def facts_for_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return relational.for_sources(l, l.filter("l_quantity >= 50"), "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("""SELECT DISTINCT a.p_partkey, a.p_brand, a.p_size FROM part a JOIN (SELECT p_brand AS file, p_size * 2 AS lo, p_size * 2 + 3 AS hi FROM part WHERE p_type = 'ECONOMY') r ON a.p_brand = r.file AND a.p_size <= r.hi AND r.lo <= a.p_size + 4""")
def overlapping_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    records = p.select("p_partkey", F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 4).alias("end_line"))
    ranges = p.filter("p_type = 'ECONOMY'").select(F.col("p_brand").alias("file"), (F.col("p_size") * 2).alias("start_line"), (F.col("p_size") * 2 + 3).alias("end_line"))
    return relational.overlapping(records, ranges).select("p_partkey", F.col("file").alias("p_brand"), F.col("start_line").alias("p_size"))


_PATHS = "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages"


@query(f"""WITH p AS ({_PATHS}), roots AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE path LIKE '%.org/%')
    SELECT page_id, (SELECT max(root) FILTER (WHERE length(root) = (SELECT max(length(root)) FROM roots WHERE path = root OR starts_with(path, root || '/'))) FROM roots WHERE path = root OR starts_with(path, root || '/')) AS owner,
    (SELECT count(*) FROM roots WHERE path = root OR starts_with(path, root || '/')) AS roots FROM p""")
def owners_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    hosts = p.select(F.substring_index("path", "/", 1).alias("root_path"))
    deeper = p.filter(F.col("path").like("%.org/%")).select(F.substring_index("path", "/", 2).alias("root_path"))
    roots = hosts.unionByName(deeper).distinct().withColumn("name", F.col("root_path"))
    return relational.owner_by_prefix(p, roots).select("page_id", "owner", "roots")


@query("""SELECT e.event_id, (SELECT m.value FROM events m WHERE m.event_type = 'view' AND m.user_id = e.user_id AND m.ts <= e.ts ORDER BY m.ts DESC LIMIT 1) AS last_view FROM events e WHERE e.event_type = 'purchase'""")
def last_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    marks = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return relational.nearest_before(rows, marks, ["user_id"], "ts", "last_view").select("event_id", "last_view")


@query("""SELECT DISTINCT a.s_suppkey, b.c_custkey FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS f, CAST(floor(s_acctbal / 10) AS BIGINT) AS s FROM supplier) a
    JOIN (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS f, CAST(floor(c_acctbal / 10) AS BIGINT) AS s FROM customer) b
    ON CASE WHEN a.f IS NOT NULL AND b.f IS NOT NULL THEN a.f = b.f ELSE a.s = b.s END""")
def same_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda df, k, n, b: df.select(k, F.when(F.col(b) >= 0, F.col(n).cast("string")).alias("first"), F.floor(F.col(b) / 10).alias("second"))
    return relational.same_identity(side(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal"), side(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_acctbal"), "first", "second", "s_suppkey", "c_custkey")


@query("""WITH a AS (SELECT o_custkey, min(o_orderpriority) AS before FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT o_custkey, min(o_orderpriority) AS after FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1 HAVING count(*) = 1)
    SELECT o_custkey, before, after FROM a JOIN b USING (o_custkey) WHERE before IS DISTINCT FROM after""")
def changed_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return relational.one_to_one(o.filter(F.year("o_orderdate") == 1995), o.filter(F.year("o_orderdate") == 1996), ["o_custkey"], "o_orderpriority")


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE upper(p_name) END AS name FROM part), f AS (SELECT lower(name) AS f, min(p_partkey) AS fi FROM r GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1), e AS (SELECT name, min(p_partkey) AS ei FROM r GROUP BY 1)
    SELECT p.p_partkey, coalesce(ei, fi) AS match_id, CASE WHEN ei IS NOT NULL THEN 'high' WHEN fi IS NOT NULL THEN 'medium' END AS match_confidence FROM part p LEFT JOIN e ON p.p_name = e.name LEFT JOIN f ON lower(p.p_name) = f""")
def exact_or_folded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    right = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"))
    left = p.select("p_partkey", F.col("p_name").alias("name"))
    return relational.exact_or_folded(left, right, "name", "p_partkey").select("p_partkey", "match_id", "match_confidence")


@query("""WITH l AS (SELECT l_partkey, array_agg(DISTINCT l_suppkey ORDER BY l_suppkey) AS a FROM lineitem GROUP BY 1) SELECT p_partkey, coalesce(array_to_string(a[1:3], ','), '') AS firsts, coalesce(len(a), 0) AS total FROM part LEFT JOIN l ON p_partkey = l_partkey""")
def first_three_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")  # noqa: E741
    out = relational.with_first_and_total(table(spark, sf_dir, "part").select("p_partkey"), l, "p_partkey", "l_suppkey")
    return out.select("p_partkey", joined("firsts").alias("firsts"), "total")


@query("SELECT c_custkey, coalesce(max(o_orderstatus), 'pending') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def status_or_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"))
    return relational.with_default(table(spark, sf_dir, "customer").select("c_custkey"), last, ["c_custkey"])


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'bolt') THEN 'queue' WHEN contains(lower(p_name), 'red') THEN 'storage' WHEN contains(lower(p_name), 'g') THEN 'saas' END AS kind FROM part""")
def keyword_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("red", "storage", 2), ("bolt", "queue", 1), ("g", "saas", 3)], "keyword string, kind string, priority int")
    return relational.keyword_kind(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), rules).select("p_partkey", "kind")


# --- aggregates, sets, pages ----------------------------------------------------------------------------------------


@query("SELECT l_partkey, array_to_string(array_agg(DISTINCT s_nationkey ORDER BY s_nationkey), ',') AS members, count(DISTINCT s_nationkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) >= 2")
def shared_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(s, "l_suppkey")
    return relational.shared(rows, [F.col("l_partkey")], "s_nationkey").select("l_partkey", joined("members").alias("members"), "n")


@query("SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n_A, count(*) FILTER (WHERE l_returnflag = 'N') AS n_N, count(*) FILTER (WHERE l_returnflag = 'R') AS n_R FROM lineitem GROUP BY 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.conditional_counts(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", ["A", "N", "R"])


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def pivoted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.pivoted(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT o_custkey, array_to_string(array_agg(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS items FROM orders GROUP BY 1")
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.grouped_lists(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], [])
    return out.select("o_custkey", joined(F.transform("items", lambda x: x["o_orderkey"])).alias("items"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_partkey, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE CASE min(l_returnflag) WHEN 'R' THEN 'optional' WHEN 'A' THEN 'required' ELSE 'unknown' END END AS availability FROM lineitem GROUP BY 1")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("flag"))
    return relational.tri_state(rows, ["l_partkey"], "flag")


@query("""WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'passed' ELSE 'pending' END AS status FROM lineitem), g AS (SELECT l_orderkey, count(*) FILTER (WHERE status = 'passed') AS n_passed, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'pending') AS n_pending FROM s GROUP BY 1)
    SELECT *, CASE WHEN n_failed > 0 THEN 'failed' WHEN n_pending > 0 THEN 'pending' ELSE 'passed' END AS status FROM g""")
def status_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "passed").otherwise("pending")
    return relational.status_roll_up(table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status")), ["l_orderkey"])


@query("""WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_quantity > 25), b AS (SELECT p.l_partkey AS x, a.l_partkey AS y FROM p FULL JOIN a ON p.l_suppkey = a.l_suppkey AND p.l_partkey = a.l_partkey),
    c AS (SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (WHERE y IS NULL) AS fp, count(*) FILTER (WHERE x IS NULL) AS fn FROM b) SELECT tp, fp, fn, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall FROM c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return relational.micro_precision_recall(l.filter("l_returnflag = 'R'"), l.filter("l_quantity > 25"), ["l_suppkey", "l_partkey"])


@query("""WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)
    SELECT l_partkey, 'left_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT l_partkey, 'right_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter("l_quantity > 45")  # noqa: E741
    return relational.key_difference(l.filter("l_returnflag = 'R'"), l.filter("l_returnflag = 'A'"), ["l_partkey"])


@query("""WITH m AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2, 3), p AS (SELECT * FROM m WHERE y = 1995), c AS (SELECT * FROM m WHERE y = 1996),
    d AS (SELECT coalesce(p.o_custkey, c.o_custkey) AS o_custkey, coalesce(p.o_orderpriority, c.o_orderpriority) AS o_orderpriority, CASE WHEN p.n IS NULL THEN 'new' WHEN c.n IS NULL THEN 'resolved' WHEN p.n <> c.n THEN 'changed' END AS change, coalesce(c.n, 0) - coalesce(p.n, 0) AS delta
    FROM p FULL JOIN c ON p.o_custkey = c.o_custkey AND p.o_orderpriority = c.o_orderpriority) SELECT * FROM d WHERE change IS NOT NULL""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return relational.run_diff(o.filter("y = 1995"), o.filter("y = 1996"), ["o_custkey", "o_orderpriority"], "n")


@query("SELECT s_suppkey, s_name, s_acctbal, (SELECT count(*) FROM supplier) AS total, (SELECT count(*) > 60 FROM supplier) AS truncated FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50 OFFSET 10")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"], 50, 10)


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 8")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 8).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""WITH r AS (SELECT l_suppkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS ratio FROM lineitem GROUP BY 1) SELECT round(avg(ratio), 9) AS mean, count(ratio) AS n FROM r""")
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.macro_mean(table(spark, sf_dir, "lineitem"), ["l_suppkey"], (F.col("l_returnflag") == "R").cast("int"), F.lit(1))
    return out.withColumn("mean", F.round("mean", 9))


@query("SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS DOUBLE) AS closed, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END), 9) AS urgent FROM orders GROUP BY 1")
def nullable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("closed", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("double")))
    return relational.nullable_totals(o, ["o_custkey"], ["closed"], {"urgent": F.col("o_orderpriority") == "1-URGENT"}).withColumn("urgent", F.round("urgent", 9))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def grouped_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.grouped_sets(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY flag ASC NULLS FIRST, l_linenumber NULLS FIRST, l_partkey NULLS FIRST, l_suppkey NULLS FIRST) AS place FROM (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag FROM lineitem)")
def nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return relational.nulls_first(rows, ["l_orderkey"], ["flag", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) > 50 FROM orders) AS more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.probed(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 50)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def latest_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 20, "o_orderkey")


@query("SELECT max(o_orderkey) AS latest, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders)) AS previous FROM orders")
def latest_and_previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    last = relational.latest(o, 1, "o_orderkey").collect()
    previous = relational.before(o, last[0]["o_orderkey"], "o_orderkey").agg(F.max("o_orderkey").alias("previous")) if last else o.agg(F.max("o_orderkey").alias("previous"))
    return o.agg(F.max("o_orderkey").alias("latest")).join(F.broadcast(previous))


@query("""WITH n AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS id FROM part), e AS (SELECT DISTINCT l_suppkey AS source, CAST(substr(p_brand, 7) AS BIGINT) AS target, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS rank FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT source, target, CASE min(rank) WHEN 0 THEN 'static' ELSE 'inferred' END AS origin FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY 1, 2""")
def edges_among_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends among the suppliers that brands are named after; static ones before inferred ones."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).cast("long").alias("target"))
    e = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "A", "static").otherwise("inferred").alias("origin")).join(parts, "l_partkey")
    return graph.edges_among(e, parts.select(F.col("target").alias("node")))


@query("""SELECT l_suppkey, l_linenumber, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1, 2""")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


@query(r"""SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'service') AS slug, len(html) - len(replace(html, chr(10), '')) + 1 AS lines FROM pages WHERE html IS NOT NULL AND url IS NOT NULL""")
def slugs_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").filter("html IS NOT NULL AND url IS NOT NULL")
    return p.select("page_id", text.slug(F.col("url")).alias("slug"), text.line_of(F.col("html"), F.length("html")).cast("long").alias("lines"))


# --- graphs ---------------------------------------------------------------------------------------------------------

_TRADE_EDGES = """edges AS (SELECT DISTINCT CASE l_returnflag WHEN 'A' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS source, CASE l_returnflag WHEN 'A' THEN 'P' || l_partkey WHEN 'R' THEN 'S' || l_suppkey ELSE p_brand END AS target
    FROM lineitem JOIN part ON l_partkey = p_partkey), walk(node, hops) AS (SELECT min(source), 0 FROM edges UNION SELECT target, hops + 1 FROM walk JOIN edges ON node = source WHERE hops < 6)"""


@query(f"WITH RECURSIVE {_TRADE_EDGES} SELECT node, min(hops) AS hops FROM walk WHERE node IS NOT NULL GROUP BY 1")
def reachable_within_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.trade_edges(spark, sf_dir)
    return graph.reachable_nodes(e, e.agg(F.min("source").alias("node")).filter("node IS NOT NULL"), 6)


@query(f"WITH RECURSIVE {_TRADE_EDGES} SELECT min(hops) AS hops FROM walk WHERE node = (SELECT max(target) FROM edges) HAVING min(hops) IS NOT NULL")
def shortest_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.trade_edges(spark, sf_dir)
    ends = e.agg(F.min("source").alias("a"), F.max("target").alias("b")).collect()[0]
    if ends["a"] is None:
        return spark.createDataFrame([], "hops int")
    return graph.shortest_path(e, ends["a"], ends["b"], 6).select("hops")


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT l_suppkey AS source, CAST(substr(p_brand, 7) AS BIGINT) AS target FROM lineitem JOIN part ON l_partkey = p_partkey), closure(source, target) AS (SELECT source, target FROM edges WHERE source <> target UNION SELECT c.source, e.target FROM closure c JOIN edges e ON c.target = e.source),
    mutual AS (SELECT a.source AS node, least(a.source, a.target) AS other FROM closure a JOIN closure b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target) SELECT node, min(other) AS component FROM mutual GROUP BY 1""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers lead to the suppliers whose numbers are those of their parts' brands."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 9).cast("long").alias("target"))
    return graph.strong_components(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("source")).join(parts, "l_partkey").select("source", "target"))


@query("""WITH o AS (SELECT user_id AS service, event_type AS kind, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS count FROM events WHERE value > 40 GROUP BY 1, 2), s AS (SELECT DISTINCT user_id AS service, event_type AS kind FROM events WHERE value < 10)
    SELECT service, kind, 'observed_only' AS state, CAST(count AS BIGINT) AS count FROM o ANTI JOIN s USING (service, kind) UNION ALL SELECT service, kind, 'static_only', NULL FROM s ANTI JOIN o USING (service, kind)""")
def runtime_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("count"), "value")
    return graph.divergence(e.filter("value < 10"), e.filter("value > 40"), ["service", "kind"])


@query("""WITH c AS (SELECT user_id AS service, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, ts FROM events) SELECT service, kind, CAST(sum(n) AS BIGINT) AS observed_count, min(ts) AS first_seen, max(ts) AS last_seen FROM c WHERE n > 0 GROUP BY 1, 2""")
def runtime_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.streaming import counters

    return counters.merged(adapters.observations(spark, sf_dir).filter("count > 0"), ["service", "kind"])


# --- detectors ------------------------------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, detector: str) -> DataFrame:
    from latticework.plans import detectors

    out = detectors.DETECTORS[detector](detectors.Facts(spark, adapters.line_facts(spark, sf_dir)))
    return out.select("kind", F.array_join("services", ",").alias("services"), "subject", F.size("evidence").alias("evidence"))


@query("""WITH e AS (SELECT DISTINCT s_name, lower(p_name) AS entity, p_type AS engine FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_type <> 'SMALL')
    SELECT 'shared_database' AS kind, string_agg(s_name, ',' ORDER BY s_name) AS services, entity || ' ' || engine AS subject, 0 AS evidence FROM e GROUP BY entity, engine HAVING count(*) > 1""")
def detected_shared_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "shared_database")


@query("""SELECT 'possible_missing_http_resilience_policy' AS kind, s_name AS services, 'P' || l_partkey || ' ' || CASE WHEN l_linestatus = 'O' THEN 'POST' ELSE 'GET' END || ' store/' AS subject, 1 AS evidence FROM lineitem c JOIN supplier ON l_suppkey = s_suppkey
    WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'R' AND p.l_suppkey = c.l_suppkey AND p.l_partkey = c.l_partkey)""")
def detected_calls_without_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "calls_without_policy")


@query("""WITH p AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25 GROUP BY 1, 2) SELECT 'possible_retry_on_non_idempotent_http_call' AS kind, s_name AS services, 'P' || c.l_partkey || ' POST store/' AS subject, 1 + least(n, 3) AS evidence
    FROM lineitem c JOIN p ON c.l_suppkey = p.l_suppkey AND c.l_partkey = p.l_partkey JOIN supplier ON c.l_suppkey = s_suppkey WHERE l_returnflag = 'N' AND l_linestatus = 'O'""")
def detected_retries_on_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "retries_on_non_idempotent_calls")


@query("""WITH g AS (SELECT l_suppkey, l_partkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS w, count(*) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 30) AS p FROM lineitem GROUP BY 1, 2)
    SELECT 'possible_retry_on_write_publish_flow' AS kind, s_name AS services, 'P' || l_partkey AS subject, least(r, 3) + least(w, 3) + least(p, 3) AS evidence FROM g JOIN supplier ON l_suppkey = s_suppkey WHERE r > 0 AND p > 0""")
def detected_retry_write_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "retry_write_publish")


@query("""WITH g AS (SELECT l_suppkey, l_partkey, count(*) AS w, count(*) FILTER (WHERE l_quantity > 30) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT 'possible_non_atomic_service_publish' AS kind, s_name AS services, 'P' || l_partkey AS subject, least(w, 3) + least(p, 3) AS evidence FROM g JOIN supplier ON l_suppkey = s_suppkey WHERE p > 0""")
def detected_non_atomic_publishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "non_atomic_service_publish")


# --- text and vectors -----------------------------------------------------------------------------------------------


@query("""WITH post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1),
    st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM len) AS words), q AS (SELECT DISTINCT item_id, lower(term) AS q FROM (SELECT item_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9]+')) AS term FROM benchmark)),
    sizes AS (SELECT DISTINCT length(q) AS k FROM q), words_ AS (SELECT DISTINCT q FROM q), hits AS (SELECT q, term FROM (SELECT term, substr(term, 1, k) AS q FROM (SELECT DISTINCT term FROM post) t, sizes WHERE length(term) >= k) JOIN words_ USING (q)),
    w AS (SELECT q, doc_id, sum(tf) AS tf FROM hits JOIN post USING (term) GROUP BY 1, 2), f AS (SELECT q, count(*) AS df FROM w GROUP BY 1),
    s AS (SELECT item_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl * n / words))), 6) AS score FROM q JOIN w USING (q) JOIN f USING (q) JOIN len USING (doc_id), st GROUP BY 1, 2)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 8""")
def full_text_top_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return retrieval.bm25(table(spark, sf_dir, "documents"), q, query_key="item_id", limit=8).select("item_id", "doc_id", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))), 6) AS score FROM embeddings, q)
    SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.35 QUALIFY rank <= 10""")
def semantic_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.nearest(e, q, "vec_id", "embedding").select("query_id", "vec_id", "rank")


@query("""WITH a AS (SELECT l_suppkey, CAST(l_partkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey),
    b AS (SELECT l_suppkey, CAST(l_partkey AS VARCHAR) AS name, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_suppkey, l_partkey),
    u AS (SELECT l_suppkey, name, min(rank * 2 + s) AS o FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1, 2) SELECT l_suppkey, name, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, name) AS rank FROM u QUALIFY rank <= 10""")
def hybrid_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    ranked = lambda c: g.select("l_suppkey", F.col("l_partkey").cast("string").alias("name"), F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc(c), "l_partkey")).alias("rank"))
    return retrieval.interleaved(ranked("q"), ranked("n"), 10, by=["l_suppkey"])


@query(f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM benchmark), d AS (SELECT item_id, w, min(i) AS i FROM w WHERE length(w) >= 3 AND w NOT IN ({", ".join(repr(x) for x in constants.STOP_WORDS)}) GROUP BY 1, 2)
    SELECT item_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS keywords FROM benchmark LEFT JOIN d USING (item_id) GROUP BY 1""")
def task_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), m AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '(?i)\b\w*(?:password|secret|token|api[_-]?key|credential)\w*\s*[:=]\s*[''"][^''"]+[''"]')) AS hit FROM l)
    SELECT doc_id, CAST(n AS INTEGER) AS line, 'hardcoded_secret' AS kind, 'warning' AS severity FROM m""")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from latticework.sources import scanning

    return scanning.secret_findings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), "path").select(F.col("path").alias("doc_id"), "line", "kind", "severity")


@query(r"""SELECT conv_id, turn, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS tokens, rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') AS fingerprint FROM conversations""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.estimated_tokens(F.col("text")).alias("tokens"), text.fingerprint(F.col("text")).alias("fingerprint"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\b(?:AKIA|ASIA)[0-9A-Z]{16}\b', '[REDACTED]', 'g'), '(\b\w*(?:password|secret|token|api[_-]?key|credential|private[_-]?key)\w*\s*[:=]\s*)([^\s#;,]+)', '\1[REDACTED]', 'gi'), '(Bearer\s+)[A-Za-z0-9._~+/=-]+', '\1[REDACTED]', 'gi')) AS redacted FROM documents""")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redacted(F.col("text"))).alias("redacted"))
