"""Fact tables as Parquet in a warehouse folder, with the life cycles that they need.

A table is a folder of immutable versions beside a pointer file that names the current one; a write makes a new version and
then moves the pointer, so a reader sees the old rows or the new ones, and a job that dies halfway leaves the old. Replacing
the rows of some owners is an anti join with the owners and a union; upserts keep the last row of a key by a maximum, which
is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework import schemas


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # The pointer is a one-row table of its own, so that any file system that Spark knows will do.
    def _versions(self, table: str) -> str:
        return f"{self.root}/{table}/versions"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _latest(self, table: str):
        """The newest version's number, path and mark, or None."""
        if not self._exists(self._versions(table)):
            return None
        rows = self.spark.read.schema("n long, path string, mark string").json(self._versions(table)).orderBy(F.desc("n"), "path").limit(1).collect()
        return rows[0] if rows else None

    def current(self, table: str) -> str | None:
        found = self._latest(table)
        return found["path"] if found else None

    def mark(self, table: str) -> str | None:
        """What the newest version says it came of, if it says so."""
        found = self._latest(table)
        return found["mark"] if found else None

    def read(self, table: str) -> DataFrame:
        """The current rows in the declared schema; columns added since a version was written are null."""
        schema = schemas.struct(table)
        path = self.current(table)
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def overwrite(self, table: str, rows: DataFrame, mark: str | None = None) -> None:
        """A new version; `mark` is stored in the same write that makes it the current one."""
        schema = schemas.struct(table)
        rows = rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        path = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        last = self._latest(table)
        self.spark.createDataFrame([((last["n"] if last else 0) + 1, path, mark)], "n long, path string, mark string").coalesce(1).write.mode("append").json(self._versions(table))

    def vacuum(self, table: str, keep: int = 1) -> int:
        """Data of all but the newest versions goes, once nobody reads it any more; how many versions went."""
        if not self._exists(self._versions(table)):
            return 0
        rows = self.spark.read.schema("n long, path string, mark string").json(self._versions(table)).orderBy(F.desc("n"), "path").collect()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = [r["path"] for r in rows[max(1, keep) :]]
        for path in gone:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        return len(gone)

    def append(self, table: str, rows: DataFrame) -> None:
        self.overwrite(table, self.read(table).unionByName(self._shaped(table, rows)))

    def _shaped(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*(rows[f.name].cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.struct(table)))

    def replace(self, table: str, owners: DataFrame, rows: DataFrame, by: str = "service_id") -> None:
        """All rows of the owners go, and these come; owners without new rows end up with none."""
        kept = self.read(table).join(owners.select(by).distinct(), by, "left_anti")
        self.overwrite(table, kept.select(*schemas.struct(table).names).unionByName(self._shaped(table, rows)))

    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        self.overwrite(table, upserted(self.read(table), self._shaped(table, rows), keys))

    def prune(self, table: str, keep: DataFrame, keys: list[str], within: DataFrame | None = None, by: str = "service_id") -> None:
        """Rows whose key is not kept go; only those of the owners in `within`, if given."""
        now = self.read(table)
        self.overwrite(table, pruned(now, keep, keys, within, by))

    def delete(self, table: str, gone: DataFrame, keys: list[str]) -> int:
        """Rows with these keys go; how many there were."""
        now = self.read(table)
        n = now.join(gone.select(*keys).distinct(), keys, "left_semi").count()
        self.overwrite(table, now.join(gone.select(*keys).distinct(), keys, "left_anti").select(*now.columns))
        return n

    def delete_services(self, ids: DataFrame) -> None:
        """Services and all that they own go; soft references to them become null."""
        for table, ddl in schemas.TABLES.items():
            if self.current(table) is None:
                continue
            if table == "services":
                self.delete(table, ids.select(F.col("id")), ["id"])
            elif table == "service_calls":
                now = self.read(table).join(ids.select(F.col("id").alias("from_service_id")), "from_service_id", "left_anti")
                gone = ids.select(F.col("id").alias("_gone")).distinct()
                now = now.join(gone, now["to_service_id"] == gone["_gone"], "left").withColumn("to_service_id", F.when(F.col("_gone").isNull(), F.col("to_service_id"))).drop("_gone")
                self.overwrite(table, now)
            elif "service_id long" in ddl:
                self.delete(table, ids.select(F.col("id").alias("service_id")), ["service_id"])

    def backup(self, to: str) -> None:
        """A copy of the current rows of every table under another root."""
        other = Catalog(self.spark, to)
        for table in schemas.TABLES:
            if self.current(table) is not None:
                other.overwrite(table, self.read(table))

    def restore(self, source: str) -> None:
        other = Catalog(self.spark, source)
        tables = [t for t in schemas.TABLES if other.current(t) is not None]
        if not tables:
            raise FileNotFoundError(f"no backup at {source}")
        for table in tables:
            self.overwrite(table, other.read(table))


def upserted(now: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The union in which a new row takes the place of an old one of its key; of several new rows of one key the last by its columns as JSON."""
    rest = [c for c in now.columns if c not in keys]
    both = now.withColumn("_v", F.lit(0)).unionByName(rows.withColumn("_v", F.lit(1)))
    one = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_v", F.to_json(F.struct(*rest)))).alias("_row"))
    return one.select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in now.columns))


def pruned(now: DataFrame, keep: DataFrame, keys: list[str], within: DataFrame | None = None, by: str = "service_id") -> DataFrame:
    """Rows whose key is kept, and all rows of owners outside of `within`; rows that repeat stay repeated."""
    kept = keep.select(*keys).distinct()
    if within is None:
        return now.join(kept, keys, "left_semi").select(*now.columns)
    owners = within.select(by).distinct()
    inside = now.join(owners, by, "left_semi").join(kept, keys, "left_semi").select(*now.columns)
    return inside.unionByName(now.join(owners, by, "left_anti").select(*now.columns))


def find_or_create(now: DataFrame, rows: DataFrame, first: str, second: str) -> DataFrame:
    """Rows with the id that they have by one key, else by the other, else a new one beyond the largest."""
    from pyspark.sql import Window

    a = now.groupBy(F.col(first).alias("_a")).agg(F.min("id").alias("_ai"))
    b = now.groupBy(F.col(second).alias("_b")).agg(F.min("id").alias("_bi"))
    top = now.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    out = rows.join(a, rows[first] == a["_a"], "left").join(b, rows[second] == b["_b"], "left").withColumn("_known", F.coalesce("_ai", "_bi"))
    new = F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)).over(Window.orderBy(first, second).rowsBetween(Window.unboundedPreceding, 0))
    return out.join(F.broadcast(top)).withColumn("id", F.coalesce("_known", F.col("_top") + new)).drop("_a", "_ai", "_b", "_bi", "_top", "_known")


def changed_files(known: DataFrame, found: DataFrame, key: str = "file_path", digest: str = "content_hash") -> DataFrame:
    """(key, change): new, changed or removed files by content hash."""
    a = known.select(F.col(key), F.col(digest).alias("_old"))
    both = a.join(found.select(F.col(key), F.col(digest).alias("_new")), key, "full")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def search_documents(services: DataFrame, apis: DataFrame, entities: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """The five kinds of documents of each service: their text is all their filled fields, joined by spaces."""
    doc = lambda df, service, kind, ref, *fields: df.select(F.col(service).alias("service_id"), F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), F.col(fields[-1]).alias("snippet"), F.concat_ws(" ", *fields).alias("content_text"))
    return (
        doc(services, "id", "service", "name", "name", "stack", "long_desc", "short_desc")
        .unionByName(doc(apis, "service_id", "api", "path", "method", "path", "description", "summary"))
        .unionByName(doc(entities, "service_id", "persistence", "name", "kind", "engine", "name"))
        .unionByName(doc(messages, "service_id", "message", "channel", "direction", "channel", "description"))
        .unionByName(doc(calls, "from_service_id", "relationship", "to_service_name", "to_service_name", "call_kind", "reason"))
    )
