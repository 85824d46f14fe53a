"""Scans of source trees: (path, text) tables in, typed facts out. Files are read by Spark alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import constants, text

LONGEST_FILE = 300_000
# Folders that are never scanned.
SKIPPED = [".git", ".gradle", ".idea", ".mypy_cache", ".next", ".pytest_cache", ".turbo", ".venv", "__pycache__", "bin", "build", "coverage", "dist", "env", "node_modules", "obj", "target", "vendor", "venv"]


def files(spark: SparkSession, root: str, extensions: list[str] | None = None, hidden: tuple[str, ...] = (".github",)) -> DataFrame:
    """(path, text): files under a root, relative to it, by extension; skipped folders and files of more than 300 000 bytes stay out.

    Spark leaves out names that start with a dot; the folders in `hidden` are read if they are there.
    """
    root = root.rstrip("/")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{root}/{h}") for h in hidden]
    there = [root, *(p.toString() for p in paths if p.getFileSystem(conf).exists(p))]
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(there).filter(F.col("length") <= LONGEST_FILE)
    path = F.regexp_replace("path", "^.*?" + re.escape(root.split("://")[-1]) + "/", "")
    skipped = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))
    df = df.select(path.alias("path"), F.decode("content", "utf-8").alias("text"), skipped.alias("skipped")).filter("NOT skipped").drop("skipped")
    return df.filter(F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1))).isin(extensions)) if extensions else df


def lines(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, content): one row for each line, from 1."""
    return df.select(*keys, F.posexplode(F.split("text", "\n")).alias("_p", "content")).select(*keys, (F.col("_p") + 1).alias("line"), "content")


def matches(df: DataFrame, pattern: str, *keys: str, group: int = 0) -> DataFrame:
    """(keys, line, match): all matches of a pattern within lines."""
    found = lines(df, *keys).filter(F.col("content").rlike(pattern))
    return found.select(*keys, "line", F.explode(F.regexp_extract_all("content", F.lit(pattern), group)).alias("match"))


def secret_findings(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, kind, severity): secret-like literals and credentials by their format; values are never kept."""
    one = matches(df, constants.SECRET_LITERAL, *keys).select(*keys, "line", F.lit("hardcoded_secret").alias("kind"), F.lit("warning").alias("severity"))
    return one.unionByName(matches(df, constants.CREDENTIAL_LITERAL, *keys).select(*keys, "line", F.lit("cloud_credential_literal").alias("kind"), F.lit("error").alias("severity")))


def excerpt(df: DataFrame, line: Column, context: int = 15) -> DataFrame:
    """Each row with `excerpt`: the lines around one, as far as the file goes."""
    all_ = F.split("text", "\n")
    start = F.greatest(line - context, F.lit(1))
    end = F.least(line + context, F.size(all_))
    return df.withColumn("excerpt", F.array_join(F.slice(all_, start, F.greatest(end - start + 1, F.lit(0))), "\n"))


def config_excerpts(df: DataFrame, names: list[str]) -> DataFrame:
    """(path, excerpt): configuration files at the root by name, redacted, the first 4000 characters."""
    return df.filter(~F.col("path").contains("/") & F.col("path").isin(names)).select("path", F.substring(text.redacted(F.col("text")), 1, 4000).alias("excerpt"))


def engine_hint(manifests: DataFrame, drivers: DataFrame) -> DataFrame:
    """(path, engine): the first driver keyword, by priority, that a manifest holds. Keywords are a short fixed list."""
    hits = manifests.join(F.broadcast(drivers), F.lower(F.col("text")).contains(F.col("keyword")))
    return hits.groupBy("path").agg(F.min_by("engine", "priority").alias("engine"))


def component_of(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """Hits with the class that was last defined at or above them in their file, else the file's stem."""
    from latticework.operators.relational import nearest_before

    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    return nearest_before(hits, classes, ["path"], "line", "component").withColumn("component", F.coalesce("component", stem))


def services(markers: DataFrame) -> DataFrame:
    """(root, stack, name): the topmost folders with a marker file are services; names are made unique by their parents, then by numbers.

    markers: (path, stack, priority), one row for each marker file that a stack's rule accepts.
    """
    from pyspark.sql import Window

    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    m = markers.select(folder.alias("root"), "stack", "priority").groupBy("root").agg(F.min_by("stack", "priority").alias("stack"))
    parts = F.split("root", "/")
    up = m.select("root", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array())).alias("above"))
    nested = up.join(m.select(F.col("root").alias("above")), "above").select("root").distinct()
    top = m.join(nested, "root", "left_anti")
    name = text.slug(F.substring_index("root", "/", -1))
    parent = F.when(F.size(parts) > 1, text.slug(F.element_at(parts, -2)))
    named = top.select("root", "stack", name.alias("_n"), parent.alias("_p")).withColumn("_c", F.count("*").over(Window.partitionBy("_n")))
    named = named.withColumn("_m", F.when((F.col("_c") > 1) & F.col("_p").isNotNull(), F.concat_ws("-", "_p", "_n")).otherwise(F.col("_n")))
    k = F.row_number().over(Window.partitionBy("_m").orderBy("root"))
    return named.select("root", "stack", F.when(k > 1, F.concat_ws("-", "_m", k.cast("string"))).otherwise(F.col("_m")).alias("name"))


def digest(df: DataFrame, version: str, *keys: str) -> DataFrame:
    """(keys, digest): a versioned SHA-256 over the sorted paths and contents of each key's files."""
    one = df.select(*keys, F.struct("path", F.sha2("text", 256).alias("sha")).alias("_f"))
    whole = F.concat_ws("\n", F.lit(version), F.transform(F.sort_array(F.collect_list("_f")), lambda f: F.concat_ws(" ", f["path"], f["sha"])))
    return one.groupBy(*keys).agg(F.sha2(whole, 256).alias("digest"))


# Whole words that tell what a command is for, the first kind that fits.
COMMAND_KINDS = {
    "migration": ["migrate", "migration", "flyway", "liquibase"],
    "client_generation": ["generate", "codegen", "protoc"],
    "test": ["test", "pytest", "jest", "vitest"],
    "build": ["build", "compile", "package"],
}
# Commands that tell a secret, and block marks that are no command.
SECRET_COMMAND = r"(?i)\$\{\{\s*secrets\.|\b(?:password|token|api[_-]?key|secret)\b"
BLOCK_MARKS = ["|", ">", "|-", ">-"]


def command_kind(command: Column) -> Column:
    """The kind of a command by whole words; null if none fits."""
    chain = None
    for kind, words in COMMAND_KINDS.items():
        hit = command.rlike(rf"(?i)\b(?:{'|'.join(words)})\b")
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain


def workflow_commands(df: DataFrame) -> DataFrame:
    """(path, line, command, kind): literal one-line run commands of workflow files; those with expressions or secrets stay out."""
    rows = lines(df.filter(F.col("path").rlike(r"(^|/)\.github/workflows/(.*/)?[^/]+\.ya?ml$")), "path")
    command = F.regexp_replace(F.regexp_extract("content", r"^\s*(?:-\s*)?run:\s*(\S.*?)\s*$", 1), "^[\"']+|[\"']+$", "")
    rows = rows.select("path", "line", command.alias("command")).filter("command <> ''")
    rows = rows.filter(~F.col("command").contains("${{") & ~F.col("command").rlike(SECRET_COMMAND) & ~F.col("command").isin(BLOCK_MARKS))
    return rows.withColumn("kind", command_kind(F.col("command"))).filter("kind IS NOT NULL")


def with_helm_marks(files: DataFrame) -> DataFrame:
    """Files with `helm`: whether each is a template of a chart not yet rendered, by its marks or by a templates/ folder beside a Chart.yaml."""
    charts = files.filter(F.substring_index("path", "/", -1) == "Chart.yaml").select(F.regexp_replace("path", "Chart\\.yaml$", "").alias("_chart")).distinct()
    parts = F.split("path", "/")
    # Every folder above a folder named templates.
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.when(F.get(parts, n - 1) == "templates", F.concat_ws("/", F.slice(parts, 1, n - 1), F.lit("")))))
    spots = files.select("path", F.explode(F.filter(above, lambda x: x.isNotNull())).alias("_chart"))
    inside = spots.join(charts, "_chart", "left_semi").select("path").distinct().withColumn("_inside", F.lit(True))
    return files.join(inside, "path", "left").withColumn("helm", F.coalesce(F.col("text").contains("{{"), F.lit(False)) | F.coalesce("_inside", F.lit(False))).drop("_inside")
