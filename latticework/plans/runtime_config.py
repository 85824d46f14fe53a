"""Filters over runtime configuration facts: thirteen dimensions, all of which must hold, each by any of its choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators import relational

MOST_CHOICES = 500
MOST_DIMENSIONS = 4
SCOPE = ["workload_kind", "workload_name", "container_name"]
REFERENCE = ["environment_key", "source_kind", "source_name", "source_key"]
# What a declaration can be, and an import's availability.
STATUSES = ["key_mismatch", "source_unknown", "no_finding"]
AVAILABILITIES = ["optional", "required", "unknown"]
#: Dimensions in the order in which equal counts are settled: the most local evidence first.
LOCALITY = ["evidence_ranges", "evidence_files", "workloads", "source_kinds", "statuses", "availabilities", "container_roles", "prefixes"]


def choices(values: list[str] | None, name: str, allowed: list[str] | None = None) -> list[str] | None:
    """The distinct choices of a dimension; None leaves it out."""
    if values is None:
        return None
    if not isinstance(values, list) or not 1 <= len(values) <= MOST_CHOICES or any(not isinstance(v, str) or not v for v in values):
        raise ValueError(f"{name} takes 1 to {MOST_CHOICES} non-empty strings")
    if allowed is not None and (wrong := sorted(set(values) - set(allowed))):
        raise ValueError(f"{name} does not know {', '.join(wrong)}")
    return sorted(set(values))


def scopes(values: list[dict] | None, name: str = "workloads") -> list[tuple[str, str, str]] | None:
    """Workload scopes as (kind, name, container)."""
    if values is None:
        return None
    if not 1 <= len(values) <= MOST_CHOICES or any(set(v) != set(SCOPE) or not all(isinstance(x, str) and x for x in v.values()) for v in values):
        raise ValueError(f"{name} takes 1 to {MOST_CHOICES} scopes of {', '.join(SCOPE)}")
    return sorted({tuple(v[k] for k in SCOPE) for v in values})


def ranges(values: list[dict] | None, name: str = "evidence_ranges") -> list[tuple[str, int, int]] | None:
    """Line ranges as (file, first, last)."""
    if values is None:
        return None
    ok = lambda v: set(v) == {"file", "start_line", "end_line"} and v["file"] and 1 <= v["start_line"] <= v["end_line"]
    if not 1 <= len(values) <= MOST_CHOICES or not all(map(ok, values)):
        raise ValueError(f"{name} takes 1 to {MOST_CHOICES} ranges of file, start_line and end_line")
    return sorted({(v["file"], v["start_line"], v["end_line"]) for v in values})


def binding_status(bindings: DataFrame, mismatches: DataFrame, unknowns: DataFrame) -> DataFrame:
    """Bindings with `status`: a mismatch wins over an unknown source."""
    keys = ["service_id", *REFERENCE]
    m = mismatches.select(*keys).distinct().withColumn("_m", F.lit(1))
    u = unknowns.select(*keys).distinct().withColumn("_u", F.lit(1))
    out = bindings.join(m, keys, "left").join(u, keys, "left")
    return out.withColumn("status", F.when(F.col("_m").isNotNull(), "key_mismatch").when(F.col("_u").isNotNull(), "source_unknown").otherwise("no_finding")).drop("_m", "_u")


def import_status(imports: DataFrame, unknowns: DataFrame) -> DataFrame:
    """Imports with `status` and `availability`."""
    keys = ["service_id", "source_kind", "source_name"]
    u = unknowns.select(*keys).distinct().withColumn("_u", F.lit(1))
    out = imports.join(u, keys, "left").withColumn("status", F.when(F.col("_u").isNotNull(), "source_unknown").otherwise("no_finding")).drop("_u")
    return out.withColumn("availability", F.when(F.col("optional").isNull(), "unknown").when(F.col("optional"), "optional").otherwise("required"))


def conditions(workloads=None, source_kinds=None, evidence_files=None, evidence_ranges=None, statuses=None, availabilities=None, container_roles=None, prefixes=None, include_unprefixed: bool = False) -> dict[str, Column]:
    """A condition for each dimension in use; values are checked by `choices`, `scopes` and `ranges` first."""
    file, start, end = F.col("evidence.file"), F.col("evidence.start_line"), F.col("evidence.end_line")
    any_of = lambda cs: F.exists(F.array(*cs), lambda c: c)
    out: dict[str, Column] = {}
    if workloads is not None:
        out["workloads"] = any_of([(F.col(SCOPE[0]) == a) & (F.col(SCOPE[1]) == b) & (F.col(SCOPE[2]) == c) for a, b, c in workloads])
    if source_kinds is not None:
        out["source_kinds"] = F.col("source_kind").isin(source_kinds)
    if evidence_files is not None:
        out["evidence_files"] = file.isin(evidence_files)
    if evidence_ranges is not None:
        out["evidence_ranges"] = any_of([(file == f) & (start <= b) & (end >= a) for f, a, b in evidence_ranges])
    if statuses is not None:
        out["statuses"] = F.col("status").isin(statuses)
    if availabilities is not None:
        out["availabilities"] = F.col("availability").isin(availabilities)
    if container_roles is not None:
        out["container_roles"] = F.coalesce("container_role", F.lit("unknown")).isin(container_roles)
    if prefixes is not None or include_unprefixed:
        out["prefixes"] = F.coalesce(F.col("prefix").isin(prefixes or []), F.lit(False)) | (F.col("prefix").isNull() & F.lit(include_unprefixed))
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def check_complexity(dims: dict[str, Column]) -> list[list[str]] | None:
    """None if so many dimensions are allowed; else the groups that they should be asked in."""
    if len(dims) <= MOST_DIMENSIONS:
        return None
    order = sorted(dims, key=lambda d: LOCALITY.index(d))
    return [order[i : i + MOST_DIMENSIONS] for i in range(0, len(order), MOST_DIMENSIONS)]


def filtered(records: DataFrame, dims: dict[str, Column]) -> DataFrame:
    if check_complexity(dims):
        raise ValueError(f"at most {MOST_DIMENSIONS} dimensions at once; ask in groups: {check_complexity(dims)}")
    for c in dims.values():
        records = records.filter(c)
    return records


def totals(records: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(total, one count for each dimension, all): how many records each dimension keeps alone, and all together, in one pass."""
    every = F.lit(True)
    for c in dims.values():
        every = every & c
    return records.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in dims.items()), F.count_if(every).alias("all"))


def group_order(records: DataFrame, dims: dict[str, Column], groups: list[list[str]]) -> list[tuple[list[str], int]]:
    """The groups with the records each keeps: fewest first, then the most local evidence, then as they came."""
    counts = []
    for g in groups:
        c = F.lit(True)
        for d in g:
            c = c & dims[d]
        counts.append(F.count_if(c))
    n = records.agg(*(c.alias(f"g{i}") for i, c in enumerate(counts))).collect()[0]
    place = lambda i: min(LOCALITY.index(d) for d in groups[i])
    return [(groups[i], n[f"g{i}"]) for i in sorted(range(len(groups)), key=lambda i: (n[f"g{i}"], place(i), i))]


def ordered_workloads(records: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, workloads): the scopes of each key, sorted, with their evidence (at most so many, and how many there are)."""
    one = records.groupBy(*keys, *SCOPE).agg(F.sort_array(F.collect_set("evidence")).alias("all"))
    shown = F.slice("all", 1, most) if most else F.col("all")
    one = one.select(*keys, F.struct(*SCOPE, shown.alias("evidence"), F.size("all").alias("evidence_total")).alias("w"))
    return one.groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("workloads"))


def configuration_with_sources(code: DataFrame, bindings: DataFrame, first: int = 3) -> DataFrame:
    """Code keys with the first few runtime sources of the same name, and how many there are."""
    b = bindings.select("service_id", F.col("environment_key").alias("config_key"), F.concat_ws(":", "source_kind", "source_name", "source_key").alias("source"))
    left = code.withColumn("_k", F.concat_ws("\0", F.col("service_id").cast("string"), "config_key"))
    right = b.select(F.concat_ws("\0", F.col("service_id").cast("string"), "config_key").alias("_k"), "source")
    return relational.with_first_and_total(left, right, "_k", "source", first).drop("_k")
