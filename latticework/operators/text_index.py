"""A full-text index kept as tables, by owner: one owner's documents are indexed anew without touching the others' postings.

Postings and lengths lie in Parquet folders partitioned by owner, postings sorted by term within an owner's files. A search reads
the rows of its own words alone: filters on the beginnings of terms reach the scan, where sorted files skip what cannot match.
Results equal `retrieval.bm25` over all documents of the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import retrieval
from latticework.sources.folders import checkpointed

#: Distinct words of a search up to which their beginnings are filters of the scan; with more, the join alone restricts it.
FILTERS = 200


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, owner: str = "service_id bigint", key: str = "doc string"):
        """owner, key: names and types of the columns that tell whose a document is, and which."""
        self.spark, self.root = spark, root.rstrip("/")
        (self.owner, owner_kind), (self.key, key_kind) = owner.split(" ", 1), key.split(" ", 1)
        self.schemas = {"postings": f"`{self.key}` {key_kind}, term string, tf bigint, `{self.owner}` {owner_kind}", "lengths": f"`{self.key}` {key_kind}, dl bigint, `{self.owner}` {owner_kind}"}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        """postings (key, term, tf, owner) or lengths (key, dl, owner)."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(self.schemas[name]).parquet(self._path(name)) if there else self.spark.createDataFrame([], self.schemas[name])

    def put(self, docs: DataFrame, body: str = "text") -> None:
        """Index the documents (owner, key, body) in place of all that their owners have; keys are unique. Other owners' files stay as they are.

        A document without words counts among the documents. An owner that has none left is dropped by `drop`.
        """
        docs = docs.filter(F.col(self.owner).isNotNull() & F.col(self.key).isNotNull())
        terms = docs.select(self.owner, self.key, F.explode(F.regexp_extract_all(F.lower(body), F.lit("[a-z0-9]+"), 0)).alias("term"))
        postings = checkpointed(terms.groupBy(self.owner, self.key, "term").agg(F.count("*").alias("tf")))
        counted = postings.groupBy(self.owner, self.key).agg(F.sum("tf").alias("dl"))
        lengths = docs.select(self.owner, self.key).join(counted, [self.owner, self.key], "left").withColumn("dl", F.coalesce("dl", F.lit(0)).cast("long"))
        # An owner's terms are dealt by their first letters, so that a large owner is many files, each with a part of the alphabet.
        postings = postings.repartition(self.owner, F.substring("term", 1, 2)).sortWithinPartitions(self.owner, "term")
        for name, rows in (("lengths", lengths), ("postings", postings)):
            own = self.spark.createDataFrame([], self.schemas[name]).columns
            rows.select(*own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.owner).parquet(self._path(name))
        # An owner whose documents have no words left keeps no postings: dynamic overwriting does not see it.
        silent = docs.select(self.owner).distinct().join(postings.select(self.owner).distinct(), self.owner, "left_anti")
        self.drop([r[0] for r in silent.toLocalIterator()], ("postings",))

    def drop(self, owners: list, tables: tuple[str, ...] = ("postings", "lengths")) -> None:
        """Take owners out of the index."""
        jvm = self.spark.sparkContext._jvm
        for owner in owners:
            for name in tables:
                path = jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/{self.owner}={owner}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def search(self, queries: DataFrame, query_key: str = "query_id", query: str = "query", owners: DataFrame | None = None, prefix: bool = True, limit: int = 20) -> DataFrame:
        """(query key, key, score, rank), as `retrieval.bm25` over the documents of the index, or of some owners only.

        With `owners` the index is as if it held no others.
        """
        asked = retrieval.asked_words(queries, query_key, query)
        postings, lengths = self.read("postings"), self.read("lengths")
        if owners is not None:
            some = owners.select(self.owner).distinct()
            postings, lengths = (t.join(some, self.owner, "left_semi") for t in (postings, lengths))
        few = [r["q"] for r in asked.select("q").distinct().limit(FILTERS + 1).collect()]
        if few and len(few) <= FILTERS:
            begins = F.col("term").startswith if prefix else F.col("term").eqNullSafe
            postings = postings.filter(reduce(lambda a, b: a | b, (begins(w) for w in few)))
        stats = lengths.agg(F.count("*").alias("n"), F.sum("dl").alias("words"))
        return retrieval.scored(asked, postings.select(self.key, "term", "tf"), lengths.select(self.key, "dl"), stats, self.key, query_key, prefix, limit)
