"""Bounded, balanced samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y, weight): at most about `most` documents of each label, chosen by a hash of the id, weighted to stand for all.

    Ids with no label of 0 or 1, with both, or outside `usable`, are left out. What is broadcast is the sample's ids: at
    most about 2 * `most` rows, whatever the size of the tables.
    """
    ids = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y"), (F.lit(True) if usable is None else usable).alias("use"))
    ids = ids.filter("use AND key IS NOT NULL AND y IN (0, 1)").groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    sizes = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = {y: min(1.0, most / max(1, sizes.get(y, 0))) for y in (0, 1)}
    of = lambda what: F.when(F.col("y") == 1, F.lit(what(1))).otherwise(F.lit(what(0)))
    chosen = ids.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < of(lambda y: share[y]) * (1 << 40)).withColumn("weight", of(lambda y: 1.0 / share[y]))
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return texts.join(F.broadcast(chosen), "key")
