"""Which folders are services, and of which stack: rules on marker files, the first stack that fits wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.operators.relational import keyword_kind
from latticework.sources import scanning

# Stacks in the order in which they are tried.
STACKS = ["node", "python", "jvm", "go"]
# Parts of vendor names and the kind of resource each tells, the first that fits.
VENDOR_KINDS = [
    ("stripe", "saas"), ("twilio", "saas"), ("sendgrid", "saas"), ("mailgun", "saas"), ("paypal", "saas"), ("braintree", "saas"), ("plaid", "saas"), ("slack", "saas"), ("github", "saas"), ("gitlab", "saas"),
    ("salesforce", "saas"), ("hubspot", "saas"), ("zendesk", "saas"), ("shopify", "saas"), ("datadog", "saas"), ("segment", "saas"), ("mixpanel", "saas"), ("sentry", "saas"), ("auth0", "saas"), ("okta", "saas"),
    ("cloudflare", "saas"), ("algolia", "saas"), ("openai", "saas"), ("anthropic", "saas"), ("amazon s3", "storage"), ("s3", "storage"), ("firebase", "db_managed"), ("elasticsearch cloud", "db_managed"),
    ("aws", "compute"), ("azure", "compute"), ("gcp", "compute"), ("google cloud", "compute"),
]


def markers(files: DataFrame) -> DataFrame:
    """(path, stack, priority): files that make their folder a service; of main packages below cmd/, the folder above counts."""
    name = F.substring_index("path", "/", -1)
    has = lambda *words: F.lower("text").rlike("|".join(words))
    node = (name == "package.json") & F.get_json_object("text", "$.scripts.start").isNotNull() & has('"express"', '"fastify"', '"@nestjs/')
    python = name.isin("requirements.txt", "pyproject.toml") & has("fastapi", "flask", "django")
    jvm = name.isin("pom.xml", "build.gradle", "build.gradle.kts") & has("spring-boot")
    go = name == "go.mod"
    chain = F.when(node, STACKS[0]).when(python, STACKS[1]).when(jvm, STACKS[2]).when(go, STACKS[3])
    found = files.withColumn("stack", chain).filter("stack IS NOT NULL")
    # A Go module is a service only with a main package at its root or below cmd/.
    main = files.filter(F.col("path").rlike(r"(^|/)(cmd/[^/]+/)?main\.go$")).select(F.regexp_replace("path", r"(cmd/[^/]+/)?main\.go$", "").alias("_root")).distinct()
    found = found.withColumn("_root", F.regexp_replace("path", r"[^/]*$", "")).join(main.withColumn("_main", F.lit(True)), "_root", "left").filter("stack <> 'go' OR _main")
    priority = F.array_position(F.array(*map(F.lit, STACKS)), F.col("stack"))
    return found.select("path", "stack", priority.alias("priority"))


def discovered(files: DataFrame) -> DataFrame:
    """(root, stack, name) of every service in a tree."""
    return scanning.services(markers(files))


def resource_type(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, kind): what a vendor's name tells about the resource; `unknown` if nothing."""
    rules = names.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(VENDOR_KINDS)], "keyword string, kind string, priority int")
    return keyword_kind(names, rules, name).withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def suffix(name: Column) -> Column:
    """The last word of a name, in lower case, where a hyphen or underscore stands before it and only letters are in it; null otherwise."""
    return F.nullif(F.regexp_extract(F.lower(name), "[-_]([a-z]+)$", 1), F.lit(""))


def target_kinds(names: DataFrame, services: DataFrame, name: str = "name") -> DataFrame:
    """Names with their `target_kind`: internal for the name of a service, whatever its case, external for a vendor's, internal for one that ends like a service's, else unknown."""
    known = services.select(F.lower("name").alias("_known")).distinct()
    ends = services.select(suffix(F.col("name")).alias("_end")).filter("_end IS NOT NULL").distinct()
    vendor = reduce(lambda a, b: a | b, (F.lower(name).contains(k) for k, _ in VENDOR_KINDS))
    out = names.join(known, F.lower(name) == F.col("_known"), "left").join(ends, suffix(F.col(name)) == F.col("_end"), "left")
    blank = F.coalesce(F.trim(name) == "", F.lit(True))
    kind = F.when(blank, "unknown").when(F.col("_known").isNotNull(), "internal").when(vendor, "external").when(F.col("_end").isNotNull(), "internal").otherwise("unknown")
    return out.withColumn("target_kind", kind).drop("_known", "_end")


def prefixed_owner(files: DataFrame, services: DataFrame) -> DataFrame:
    """Files with the one service whose root holds them; null if none does, or several roots are nested around it."""
    from latticework.operators.relational import owner_by_prefix

    out = owner_by_prefix(files, services.select(F.col("root").alias("root_path"), "name"))
    return out.withColumn("owner", F.when(F.col("roots") == 1, F.col("owner")))
