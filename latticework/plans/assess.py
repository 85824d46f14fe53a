"""Assessment of working changes, verification of predictions, validation states and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import text
from latticework.operators import relational


def safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below its root."""
    return F.coalesce(~path.startswith("/") & ~F.array_contains(F.split(path, "/"), F.lit("..")) & (path != ""), F.lit(False))


def evidence_files(units: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, path): files of each unit's evidence, below its service's root; absolute paths and those that climb are left out."""
    rows = units.select("id", "service", F.explode("evidence").alias("e")).filter(safe_path(F.col("e.file"))).join(roots.select(F.col("name").alias("service"), "root_path"), "service")
    return rows.select("id", F.when(F.coalesce("root_path", F.lit("")) == "", F.col("e.file")).otherwise(F.concat_ws("/", "root_path", "e.file")).alias("path")).distinct()


def assessed_units(units: DataFrame, changed: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, state): covered if a file of its evidence changed, omitted if none did, unassessable without a usable file."""
    files = evidence_files(units, roots)
    hit = files.join(changed.select("path").distinct().withColumn("_c", F.lit(1)), "path", "left").groupBy("id").agg(F.max("_c").alias("_hit"), F.count("*").alias("_n"))
    state = F.when(F.col("_n").isNull(), "unassessable").when(F.col("_hit") == 1, "covered").otherwise("omitted")
    return units.select("id").join(hit, "id", "left").select("id", state.alias("state"))


def outside_roots(changed: DataFrame, roots: DataFrame) -> DataFrame:
    """Changed files that no service root holds."""
    return relational.owner_by_prefix(changed, roots).filter("owner IS NULL").select("path")


def touches_roots(changed: DataFrame, roots: DataFrame) -> DataFrame:
    """(touches): whether any changed file lies below a service root."""
    return relational.owner_by_prefix(changed, roots).agg(F.coalesce(F.bool_or(F.col("owner").isNotNull()), F.lit(False)).alias("touches"))


def changed_services(changed: DataFrame, roots: DataFrame) -> DataFrame:
    """(service): owners, by their longest root, of changed files."""
    return relational.owner_by_prefix(changed, roots).filter("owner IS NOT NULL").select(F.col("owner").alias("service")).distinct()


def is_public(contract_role: Column, protocol: Column) -> Column:
    return (contract_role == "maps") & protocol.isin("http", "grpc", "graphql") | (contract_role == "raises") & (protocol == "graphql")


def contracts_at_risk(contracts: DataFrame, changed: DataFrame, roots: DataFrame) -> DataFrame:
    """Public error contracts whose file changed, once each."""
    public = contracts.filter(is_public(F.col("role"), F.col("protocol")) & safe_path(F.col("evidence.file"))).join(roots.select(F.col("name").alias("service"), "root_path"), "service")
    path = F.when(F.coalesce("root_path", F.lit("")) == "", F.col("evidence.file")).otherwise(F.concat_ws("/", "root_path", "evidence.file"))
    return public.withColumn("path", path).join(changed.select("path").distinct(), "path", "left_semi").select("service", "source", "role", "protocol", "transport_code", "public_code", "path").distinct()


def contract_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(service, source, role, protocol, before, after): contracts that were alone of their kind before and are now, with other codes."""
    code = lambda df: df.withColumn("code", F.concat_ws("/", F.coalesce("transport_code", F.lit("")), F.coalesce("public_code", F.lit(""))))
    return relational.one_to_one(code(before), code(after), ["service", "source", "role", "protocol"], "code")


def closure(assessed: DataFrame, validation: DataFrame, most: int = 3) -> DataFrame:
    """(state, n_covered, n_omitted, n_unassessable, first_open): open units or failed checks keep a change from being closed."""
    n = {s: F.count_if(F.col("state") == s) for s in ("covered", "omitted", "unassessable")}
    one = assessed.agg(*(v.alias(f"n_{k}") for k, v in n.items()), F.slice(F.sort_array(F.collect_set(F.when(F.col("state") != "covered", F.col("id")))), 1, most).alias("first_open"))
    v = validation.agg(F.count_if(F.col("status") == "failed").alias("_failed"), F.count_if(F.col("status") == "pending").alias("_pending"))
    state = F.when((F.col("n_omitted") > 0) | (F.col("_failed") > 0), "attention_required").when((F.col("n_unassessable") > 0) | (F.col("_pending") > 0), "incomplete").otherwise("ready_for_review")
    return one.join(F.broadcast(v)).select(state.alias("state"), *(f"n_{k}" for k in n), "first_open")


def verified(predicted: DataFrame, actual: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(true_positives, false_positives, false_negatives, precision, recall, omission_rate); rates are null where there is nothing to divide by."""
    p, a = predicted.select("service").distinct().withColumn("_p", F.lit(1)), actual.select("service").distinct().withColumn("_a", F.lit(1))
    if known is not None:
        a = a.join(known.select("service").distinct(), "service", "left_semi")
    both = p.join(a, "service", "full")
    names = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("service"))))
    tp, fp, fn = names(F.col("_p").isNotNull() & F.col("_a").isNotNull()), names(F.col("_a").isNull()), names(F.col("_p").isNull())
    out = both.agg(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"))
    n = {c: F.size(c).cast("double") for c in out.columns}
    rate = lambda a, b: F.try_divide(n[a], n[a] + n[b])
    return out.withColumn("precision", rate("true_positives", "false_positives")).withColumn("recall", rate("true_positives", "false_negatives")).withColumn("omission_rate", rate("false_negatives", "true_positives"))


# --- validation -----------------------------------------------------------------------------------------------------


def ci_commands_to_run(commands: DataFrame, most: int = 3) -> DataFrame:
    """The first few distinct test and build commands of each repository."""
    one = relational.first_per_key(commands.filter("kind IN ('test', 'build')"), ["repository_id", "command"], ["workflow_path", "start_line"])
    return relational.top_per_group(one, ["repository_id"], ["workflow_path", "start_line"], most).drop("rank")


def ci_states(commands: DataFrame, results: DataFrame) -> DataFrame:
    """Commands with the last status recorded for their place, or pending."""
    last = results.groupBy("repository_id", "workflow_path", "start_line").agg(F.max_by("status", "seq").alias("status"))
    return relational.with_default(commands, last, ["repository_id", "workflow_path", "start_line"])


def manual_states(units: DataFrame, results: DataFrame) -> DataFrame:
    """(id, check_index, status) of every check of every unit, pending unless recorded."""
    checks = units.select(F.col("id").alias("change_unit_id"), F.posexplode("validation").alias("check_index", "check"))
    last = results.groupBy("change_unit_id", "check_index").agg(F.max_by("status", "seq").alias("status"))
    return relational.with_default(checks, last, ["change_unit_id", "check_index"]).select(F.col("change_unit_id").alias("id"), "check_index", "status")


def manual_roll_up(states: DataFrame) -> DataFrame:
    return relational.status_roll_up(states, ["id"])


# --- telemetry ------------------------------------------------------------------------------------------------------


def feedback_stats(feedback: DataFrame) -> DataFrame:
    return relational.conditional_counts(feedback, ["service"], "outcome", ["confirmed", "rejected"])


def usage_totals(runs: DataFrame) -> DataFrame:
    """Sums of tokens and cost; null where no run tells any."""
    return runs.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"), F.sum("llm_calls").alias("llm_calls"))


def budget_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), F.avg(F.col("truncated").cast("double")).alias("truncated_rate"), F.avg(F.col("response_bytes").cast("double")).alias("mean_bytes"), F.avg(F.col("estimated_tokens").cast("double")).alias("mean_tokens"), F.coalesce(F.sum(F.size("omitted_ids")), F.lit(0)).alias("omitted"))


def by_budget(runs: DataFrame) -> DataFrame:
    return runs.groupBy("requested_budget").agg(F.count("*").alias("runs")).orderBy("requested_budget")


def outcomes_by_epic(runs: DataFrame, feedback: DataFrame) -> DataFrame:
    """(epic_type, sufficient, insufficient, excessive)"""
    rows = feedback.join(runs.select(F.col("id").alias("run_id"), "epic_type"), "run_id")
    return relational.pivoted(rows, "epic_type", "outcome", ["sufficient", "insufficient", "excessive"])


def missing_services(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.coalesce(F.sum(F.size("missing_service_ids")), F.lit(0)).alias("missing"))


def verification_means(verifications: DataFrame) -> DataFrame:
    return verifications.agg(F.bround(F.avg("precision"), 4).alias("precision"), F.bround(F.avg("recall"), 4).alias("recall"), F.bround(F.avg("omission_rate"), 4).alias("omission_rate"))


def telemetry_row(candidates: DataFrame, included: DataFrame, payload: Column) -> DataFrame:
    """(included_ids, omitted_ids, response_bytes, estimated_tokens): candidates in their rank, and what the answer holds of them."""
    one = candidates.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "service_id"))), lambda x: x["service_id"]).alias("_all"))
    inc = included.agg(F.collect_set("service_id").alias("_in"))
    both = one.join(F.broadcast(inc))
    return both.select(F.array_intersect("_all", "_in").alias("included_ids"), F.array_except("_all", "_in").alias("omitted_ids"), F.octet_length(payload).cast("long").alias("response_bytes"), text.estimated_tokens(payload).alias("estimated_tokens"))


def trace_id(plan_id: Column, unit_id: Column) -> Column:
    """A short name of a unit of a plan: sixteen bytes of a digest."""
    return text.fingerprint(F.concat_ws(":", plan_id.cast("string"), unit_id), 16)
