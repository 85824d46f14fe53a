"""Lookups, joins, aggregates, set operations, ordering and pages over fact tables: all plain DataFrame plans.

Keys that may be null are compared null-safely where the comment says so; sides that are small by nature (rule tables,
names) are left to the planner, which broadcasts them by size alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import constants

# --- lookups --------------------------------------------------------------------------------------------------------


def with_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str = "n") -> DataFrame:
    """Every parent with the number of its children, 0 if none: counted before the join."""
    n = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias(name))
    return parents.join(n, parents[parent_key] == n["_key"], "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def unambiguous(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key no other row has."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n = 1").drop("_n")


def duplicated(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def resolve_reference(references: DataFrame, services: DataFrame, name: str = "name", scope: str = "repository_id", service_name: str = "name", service_scope: str = "repository_id", service_id: str = "id") -> DataFrame:
    """Each reference with the id it resolves to: the only service of that name, else the only one of it in its own scope, else null."""
    everywhere = services.groupBy(F.col(service_name).alias("_g")).agg(F.count("*").alias("_gn"), F.min(service_id).alias("_gid"))
    local = services.groupBy(F.col(service_name).alias("_l"), F.col(service_scope).alias("_s")).agg(F.count("*").alias("_ln"), F.min(service_id).alias("_lid"))
    out = references.join(everywhere, references[name] == everywhere["_g"], "left")
    out = out.join(local, (out[name] == local["_l"]) & (out[scope] == local["_s"]), "left")
    found = F.when(F.col("_gn") == 1, F.col("_gid")).when(F.col("_ln") == 1, F.col("_lid"))
    return out.withColumn("resolved_id", found).drop("_g", "_gn", "_gid", "_l", "_s", "_ln", "_lid")


def display_names(services: DataFrame, repositories: DataFrame) -> DataFrame:
    """(id, display): the bare name, or repository/name where the name is not unique; `standalone` without a repository."""
    named = services.join(repositories.select(F.col("id").alias("_r"), F.col("name").alias("_repository")), F.col("repository_id") == F.col("_r"), "left")
    n = F.count("*").over(Window.partitionBy("name"))
    return named.select("id", F.when(n > 1, F.concat_ws("/", F.coalesce("_repository", F.lit("standalone")), "name")).otherwise(F.col("name")).alias("display"))


def for_sources(facts: DataFrame, sources: DataFrame, *keys: str) -> DataFrame:
    """The facts whose keys are among the sources; none for no sources."""
    return facts.join(sources.select(*keys).distinct(), list(keys), "left_semi")


def latest(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The n rows of largest order."""
    return rows.orderBy(F.desc(order)).limit(n)


def before(rows: DataFrame, value, order: str = "id") -> DataFrame:
    """(order): the largest below a value, null if there is none."""
    return rows.filter(F.col(order) < value).agg(F.max(order).alias(order))


def by_severity(rows: DataFrame, *then: str) -> DataFrame:
    """Rows by severity in descending order of its text (warning, info, critical), then the given columns."""
    return rows.orderBy(F.desc("severity"), *then)


# --- joins ----------------------------------------------------------------------------------------------------------


def distinct_edges(calls: DataFrame, services: DataFrame) -> DataFrame:
    """(from_name, to_name): resolved calls by name, once each."""
    a = services.select(F.col("id").alias("from_service_id"), F.col("name").alias("from_name"))
    b = services.select(F.col("id").alias("to_service_id"), F.col("name").alias("to_name"))
    return calls.join(a, "from_service_id").join(b, "to_service_id").select("from_name", "to_name").distinct()


def inbound(calls: DataFrame, services: DataFrame) -> DataFrame:
    """Every resolved call with its caller's name."""
    return calls.filter("to_service_id IS NOT NULL").join(services.select(F.col("id").alias("from_service_id"), F.col("name").alias("from_name")), "from_service_id")


def unmapped(calls: DataFrame) -> DataFrame:
    return calls.filter("target_kind = 'internal' AND to_service_id IS NULL")


def channel_links(messages: DataFrame) -> DataFrame:
    """(from_service_id, to_service_id, channel): a publisher and a consumer of one channel in two services, once each."""
    out = messages.filter("direction = 'publishes'").select(F.col("service_id").alias("from_service_id"), "channel").distinct()
    into = messages.filter("direction = 'consumes'").select(F.col("service_id").alias("to_service_id"), "channel").distinct()
    return out.join(into, "channel").filter("from_service_id <> to_service_id").select("from_service_id", "to_service_id", "channel")


def without(rows: DataFrame, others: DataFrame, keys: list[str], null_safe: list[str] = ()) -> DataFrame:
    """The rows with no counterpart; `null_safe` keys match null with null."""
    other = others.select(*(F.col(k).alias(f"_{k}") for k in [*keys, *null_safe])).distinct()
    on = [rows[k] == other[f"_{k}"] for k in keys] + [rows[k].eqNullSafe(other[f"_{k}"]) for k in null_safe]
    return rows.join(other, on, "left_anti")


def without_any(rows: DataFrame, *others: tuple[DataFrame, list[str]]) -> DataFrame:
    """The rows with no counterpart in any of the others."""
    for other, keys in others:
        rows = without(rows, other, keys)
    return rows


def reconciled(calls: DataFrame, services: DataFrame) -> DataFrame:
    """Calls with to_service_id resolved by name within the caller's repository; the least id where several match."""
    homes = services.select(F.col("id").alias("from_service_id"), F.col("repository_id").alias("_home"))
    targets = services.groupBy(F.col("name").alias("_name"), F.col("repository_id").alias("_repo")).agg(F.min("id").alias("_to"))
    out = calls.drop("to_service_id").join(homes, "from_service_id", "left")
    out = out.join(targets, (F.col("to_service_name") == F.col("_name")) & F.col("_home").eqNullSafe(F.col("_repo")), "left")
    kind = F.when(F.col("_to").isNotNull(), F.lit("internal")).otherwise(F.col("target_kind"))
    return out.withColumn("to_service_id", F.col("_to")).withColumn("target_kind", kind).drop("_home", "_name", "_repo", "_to")


def keyword_kind(names: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """(name, kind): the kind of the first rule, by priority, whose keyword the lower-case name contains. Rules are a short fixed list."""
    chain = None
    for r in rules.orderBy("priority").collect():
        hit = F.lower(name).contains(r["keyword"])
        chain = F.when(hit, r["kind"]) if chain is None else chain.when(hit, r["kind"])
    return names.withColumn("kind", F.lit(None).cast("string") if chain is None else chain)


def overlapping(records: DataFrame, ranges: DataFrame, file: str = "file", start: str = "start_line", end: str = "end_line", width: int = 64) -> DataFrame:
    """Records whose lines overlap a range of the same file: an equality join on buckets of lines, never a nested loop."""
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b)) / width))
    columns = records.columns
    # Equal records are looked up once, and come back as often as they were.
    left = records.groupBy(*columns).agg(F.count("*").alias("_times")).withColumn("_cell", F.explode(cells(start, end)))
    right = ranges.select(F.col(file).alias("_file"), F.col(start).alias("_from"), F.col(end).alias("_to")).withColumn("_range_cell", F.explode(cells("_from", "_to")))
    hit = (left[file] == right["_file"]) & (left["_cell"] == right["_range_cell"]) & (left[start] <= right["_to"]) & (right["_from"] <= left[end])
    found = left.join(right, hit, "left_semi").select(*columns, "_times").distinct()
    return found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(*columns)


def owner_by_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root_path", name: str = "name") -> DataFrame:
    """Each path with the name of the longest root that holds it, and how many roots do: paths are exploded into their ancestors, so the join is one of equality."""
    parts = F.split(path, "/")
    up = paths.select(path).distinct().withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    found = up.join(roots.select(F.col(root).alias("_up"), F.col(name).alias("_name")), "_up")
    best = found.groupBy(path).agg(F.max_by("_name", F.struct(F.length("_up"), "_name")).alias("owner"), F.count("*").alias("roots"))
    return paths.join(best, path, "left").withColumn("roots", F.coalesce("roots", F.lit(0)).cast("long"))


def nearest_before(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Rows with the value of the last mark at or before them, in each group: an as-of join by one sort of both."""
    a = rows.select(*by, F.col(at), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(marks.schema[value].dataType).alias("_value"), F.lit(1).alias("_side"))
    b = marks.select(*by, F.col(at), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    return out.select("_row.*", F.col("_last").alias(value))


def same_identity(left: DataFrame, right: DataFrame, first: str, second: str, left_id: str, right_id: str) -> DataFrame:
    """(left id, right id), once each: equal in `first` where both have it, else equal in `second`: two equality joins, not one with OR.

    A pair of rows meets in one of the joins at most, so a pair of ids can only repeat where one of them stands in several rows.
    Those pairs alone are made distinct; the others, which may be as many as the product of both tables, are never shuffled.
    """
    def side(df: DataFrame, i: str, f: str, s: str) -> DataFrame:
        rows = df.select(F.col(i), F.col(first).alias(f), F.col(second).alias(s))
        return rows.groupBy(i).agg(F.collect_set(F.struct(f, s)).alias("_rows")).select(i, (F.size("_rows") > 1).alias(f"{f}n"), F.explode("_rows").alias("_row")).select(i, f"{f}n", "_row.*")

    a, b = side(left, left_id, "_f", "_s"), side(right, right_id, "_g", "_t")
    several = F.col("_fn") | F.col("_gn")
    by_second = F.col("_s") == F.col("_t")

    def met(a: DataFrame, b: DataFrame, keep) -> DataFrame:
        one = a.join(b, (F.col("_f") == F.col("_g")) & keep).select(left_id, right_id)
        # Those that lack the first on either side meet by the second: the null rows of one side with all of the other.
        two = a.filter("_f IS NULL").join(b, by_second & keep).select(left_id, right_id)
        three = a.filter("_f IS NOT NULL").join(b.filter("_g IS NULL"), by_second & keep).select(left_id, right_id)
        return one.unionByName(two).unionByName(three)

    return met(a, b, ~several).unionByName(met(a, b, several).distinct())


def one_to_one(before_: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with one row on either side whose values differ: (keys, before, after)."""
    one = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias(name)).filter("_n = 1").drop("_n")
    return one(before_, "before").join(one(after, "after"), keys).filter(~F.col("before").eqNullSafe(F.col("after")))


def exact_or_folded(left: DataFrame, right: DataFrame, name: str, right_id: str) -> DataFrame:
    """Rows with the id they match by exact name (confidence high), else by the only name equal in lower case (medium)."""
    exact = right.groupBy(F.col(name).alias("_e")).agg(F.min(right_id).alias("_ei"))
    folded = right.groupBy(F.lower(name).alias("_f")).agg(F.min(right_id).alias("_fi"), F.countDistinct(right_id).alias("_fn")).filter("_fn = 1")
    out = left.join(exact, left[name] == exact["_e"], "left").join(folded, F.lower(left[name]) == folded["_f"], "left")
    confidence = F.when(F.col("_ei").isNotNull(), "high").when(F.col("_fi").isNotNull(), "medium")
    return out.withColumn("match_id", F.coalesce("_ei", "_fi")).withColumn("match_confidence", confidence).drop("_e", "_ei", "_f", "_fi", "_fn")


def with_first_and_total(left: DataFrame, right: DataFrame, key: str, value: str, first: int = 3) -> DataFrame:
    """Each row with the first few values joined to it, in order, and how many there are."""
    lists = right.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("_all"))
    out = left.join(lists, key, "left")
    return out.withColumn("firsts", F.coalesce(F.slice("_all", 1, first), F.array().cast(lists.schema["_all"].dataType))).withColumn("total", F.coalesce(F.size("_all"), F.lit(0)).cast("long")).drop("_all")


def with_default(rows: DataFrame, results: DataFrame, keys: list[str], status: str = "status", default: str = "pending") -> DataFrame:
    """Each row with its last recorded status, or the default."""
    return rows.join(results, keys, "left").withColumn(status, F.coalesce(status, F.lit(default)))


def key_mismatches(bindings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings whose only declaring source lacks their key, and those without any source: by (source_kind, source_name)."""
    by = ["source_kind", "source_name"]
    unknown = bindings.join(sources.select(*by).distinct(), by, "left_anti")
    one = sources.groupBy(*by).agg(F.count("*").alias("_n"), F.first("keys").alias("_keys")).filter("_n = 1")
    mismatch = bindings.join(one, by).filter(~F.array_contains("_keys", F.col("source_key"))).drop("_n", "_keys")
    return mismatch, unknown


# --- aggregates -----------------------------------------------------------------------------------------------------


def fan(edges: DataFrame, threshold: int = constants.FAN_THRESHOLD, by: list[str] = (), source: str = "source", target: str = "target") -> DataFrame:
    """(by, node, kind, peers): nodes with at least so many distinct peers, as fan_in or fan_out. Links to itself count."""
    out = edges.groupBy(*by, F.col(source).alias("node")).agg(F.countDistinct(target).alias("peers")).withColumn("kind", F.lit("fan_out"))
    into = edges.groupBy(*by, F.col(target).alias("node")).agg(F.countDistinct(source).alias("peers")).withColumn("kind", F.lit("fan_in"))
    return out.unionByName(into).filter(F.col("peers") >= threshold).select(*by, "node", "kind", "peers")


def instability(edges: DataFrame, by: list[str] = (), source: str = "source", target: str = "target") -> DataFrame:
    """(by, node, ce, ca, instability): outgoing over all distinct peers, to two places, halves to even; null without peers."""
    ce = edges.groupBy(*by, F.col(source).alias("node")).agg(F.countDistinct(target).alias("ce"))
    ca = edges.groupBy(*by, F.col(target).alias("node")).agg(F.countDistinct(source).alias("ca"))
    both = ce.join(ca, [*by, "node"], "full").na.fill(0, ["ce", "ca"])
    return both.withColumn("instability", F.bround(F.try_divide(F.col("ce").cast("double"), F.col("ce") + F.col("ca")), 2))


def shared(rows: DataFrame, keys: list[Column], member: str = "service_id", least: int = 2) -> DataFrame:
    """(keys, members, n): keys that at least so many members have in common, with their sorted members."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(member)).alias("members"), F.countDistinct(member).alias("n")).filter(F.col("n") >= least)


def conditional_counts(rows: DataFrame, by: list[str], value: str, choices: list[str]) -> DataFrame:
    """(by, one count for each choice): 0 where there is none."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(value) == c).alias(f"n_{c}") for c in choices))


def pivoted(rows: DataFrame, by: str, value: str, choices: list[str]) -> DataFrame:
    """Counts of each choice by key, as columns, 0 where there is none."""
    return rows.groupBy(by).pivot(value, choices).agg(F.count(F.lit(1))).na.fill(0, choices)


def grouped_lists(rows: DataFrame, keys: list[str], order: list[str], payload: list[str], name: str = "items") -> DataFrame:
    """(keys, items): the rows of each key as an ordered list."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *payload))).alias(name))


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: kept by a minimum, which is pre-aggregated, not by a window."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return one.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def tri_state(rows: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, availability): optional, required, unknown (null) or mixed."""
    state = F.when(F.col(flag).isNull(), "unknown").when(F.col(flag), "optional").otherwise("required")
    return rows.groupBy(*keys).agg(F.collect_set(state).alias("_s")).select(*keys, F.when(F.size("_s") > 1, "mixed").otherwise(F.col("_s")[0]).alias("availability"))


def status_roll_up(rows: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """(keys, n_passed, n_failed, n_pending, status): failed before pending before passed."""
    n = {s: F.count_if(F.col(status) == s) for s in ("passed", "failed", "pending")}
    total = F.when(n["failed"] > 0, "failed").when(n["pending"] > 0, "pending").otherwise("passed")
    return rows.groupBy(*keys).agg(*(v.alias(f"n_{k}") for k, v in n.items()), total.alias("status"))


def micro_precision_recall(predicted: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall) over all pairs; null where there is nothing to divide by."""
    p, a = predicted.select(*keys).distinct().withColumn("_p", F.lit(1)), actual.select(*keys).distinct().withColumn("_a", F.lit(1))
    both = p.join(a, keys, "full")
    tp, fp, fn = (F.count_if(F.expr(e)) for e in ("_p IS NOT NULL AND _a IS NOT NULL", "_a IS NULL", "_p IS NULL"))
    return both.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))


def macro_mean(rows: DataFrame, by: list[str], part: Column, whole: Column, name: str = "mean") -> DataFrame:
    """(mean, n): the mean of each key's ratio of sums, every key alike; keys with nothing to divide by are left out."""
    ratios = rows.groupBy(*by).agg(F.try_divide(F.sum(part).cast("double"), F.sum(whole)).alias("_ratio"))
    return ratios.agg(F.avg("_ratio").alias(name), F.count("_ratio").alias("n"))


def nullable_totals(rows: DataFrame, by: list[str], sums: list[str], flags: dict[str, Column]) -> DataFrame:
    """(by, sums, shares): sums that are null where no value is, and the share of each flag."""
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(f.cast("int")).alias(name) for name, f in flags.items()))


def grouped_sets(rows: DataFrame, by: list[str], *measures: Column) -> DataFrame:
    """(by, measures): the measures of all keys together, of each beginning of the keys, and of everything; keys summed over are null."""
    return rows.rollup(*by).agg(*measures)


def nulls_first(rows: DataFrame, by: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Places within a group in ascending order in which null comes first."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*(F.asc_nulls_first(c) for c in order))))


def probed(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first so many rows, with `more`: whether one beyond them was there, found by asking for one more and not by counting."""
    some = rows.orderBy(*order).limit(limit + 1)
    n = some.agg((F.count("*") > limit).alias("more"))
    return some.orderBy(*order).limit(limit).join(F.broadcast(n))


# --- sets and pages -------------------------------------------------------------------------------------------------


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys on one side alone, as left_only or right_only."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right_only")))


def run_diff(previous: DataFrame, current: DataFrame, identity: list[str], count: str | None = None) -> DataFrame:
    """(identity, change, delta): new, resolved, or changed in their count, by identity."""
    p = previous.groupBy(*identity).agg((F.max(count) if count else F.lit(1)).cast("long").alias("_p"))
    c = current.groupBy(*identity).agg((F.max(count) if count else F.lit(1)).cast("long").alias("_c"))
    both = p.join(c, identity, "full")
    change = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "resolved").when(F.col("_p") != F.col("_c"), "changed")
    return both.select(*identity, change.alias("change"), (F.coalesce("_c", F.lit(0)) - F.coalesce("_p", F.lit(0))).alias("delta")).filter("change IS NOT NULL")


def page(rows: DataFrame, order: list[Column | str], limit: int = constants.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page of ordered rows with `total` and `truncated`; limit from 1 to 500, offset from 0."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    limit = min(limit, constants.PAGE_MOST)
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    return cut.join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in an order; for short tables, such as the new services of one repository."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)
