"""How filters interact: what each removes, finds already removed, or alone would remove, in every order of all filters.

Method. Each document is marked by the set of filters that it fails, as the bits of a mask. Per part, three histograms over the
masks (all documents, good ones, toxic ones) are stacked as rows of an incidence matrix. For k filters there are k! orders of k
steps, and a matrix of integers with a row for each mask and a column for each (order, step) for every outcome: kept, removed,
redundant, failing this filter alone, and the Shapley sum. The product of both gives all outcomes of all orders at once; five
filters have 32 masks and 600 columns.

The texts are read once, by workers; what is shuffled of a document is its id, mask and a SHA-256 of its text, and counts by
(part, mask) are summed before they meet. The smallest id of each text is joined as a written table, so that one text in a third
of all rows is a skewed join that can be split, and rows without an id go past the joins.

The five filters of `FILTERS` fail a document: A with under 200 words; B if under half of its words are distinct; C if over 3 % of
its code points are A to Z; D if it holds one of # $ % & * |; E if a smaller id has the identical text, table-wide.

Defined results: a null text is an empty one (and the copy of any other empty one). A row with a null id is no copy and has no
labels, and is nobody's original. Rows that repeat an id are documents of their own and share its labels; they are not copies of
each other. An id with several labels is good if any of them says quality 1, and toxic if any says toxic 1. A null part is the
empty string. Further columns are ignored. Parts without documents do not appear; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SIGNS = "#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"
#: Bytes of a text that are split into words at a time, and parts whose outcomes are one batch.
PIECE, PARTS = 1 << 20, 16
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "shapley")
_SPACE = re.compile(rb"[ \t-\r]")


# --- marks ----------------------------------------------------------------------------------------------------------


def mask_of(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    data, n, distinct, at = text.encode(), 0, set(), 0
    while at < len(data):
        m = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = m.start() if m else len(data)
        some = data[at:end].split()  # of bytes: at space and 9 to 13 alone
        n += len(some)
        distinct.update(some)
        at = end
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (n < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * len(text), any(c in text for c in SIGNS))
    return sum(1 << i for i, fail in enumerate(fails) if fail)


def marked(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(key, part, digest, mask) of every row: the filters that its text alone decides."""
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value.as_py() or "" for value in batch.column(2)]
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(map(mask_of, texts), pa.int32())], ["key", "part", "digest", "mask"])

    given = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("part", T.StringType()),
        T.StructField("digest", T.BinaryType()), T.StructField("mask", T.IntegerType()),
    ])
    return docs.select(docs[key].alias("key"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), docs[text].alias("text")).mapInArrow(run, given)


def histograms(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just these filters, copies included, and how many of them are good and toxic."""
    rows = shared.cut(marked(spark, docs, key, text, part))
    first = rows.filter("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    first = shared.cut(first.filter("first <> last").select("digest", "first"))
    said = labels.filter(labels[key].isNotNull()).groupBy(labels[key].alias("key"))
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    said = shared.cut(said.agg(F.coalesce(one("quality"), F.lit(0)).alias("good"), F.coalesce(one("toxic"), F.lit(0)).alias("toxic")))
    copy = 1 << FILTERS.index(COPY)
    known = rows.filter("key IS NOT NULL").join(first, "digest", "left").withColumn("copy", F.when(F.col("key") > F.col("first"), copy).otherwise(0))
    known = known.select("key", "part", F.col("mask").bitwiseOR(F.col("copy")).alias("mask")).join(said, "key", "left")
    known = known.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unknown = rows.filter("key IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


# --- the product ----------------------------------------------------------------------------------------------------


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(o) for o in itertools.permutations(sorted(filters))]


def outcome_matrices(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """For each outcome a matrix of integers: a row for each mask, a column for each (order, step), orders first."""
    bits = {f: 1 << i for i, f in enumerate(filters)}
    masks = np.arange(1 << len(filters))[:, None]
    own = np.array([[bits[f] for f in o] for o in orders(filters)])
    before = np.cumsum(own, axis=1) - own
    own, before = own.reshape(1, -1), before.reshape(1, -1)
    fails, gone = masks & own > 0, masks & before > 0
    removed = (fails & ~gone).astype(np.int64)
    return {
        "kept": (~fails & ~gone).astype(np.int64),
        "removed": removed,
        "redundant": (fails & gone).astype(np.int64),
        "unique_fails": (masks == own).astype(np.int64),
        "shapley": removed @ (own.T == own).astype(np.int64),  # over all columns of the same filter
    }


def outcomes(spark: SparkSession, counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from (part, mask, n, good, toxic)."""
    names = orders(filters)
    steps = len(filters)
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins"))  # 2 ** k bins at most
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = outcome_matrices(filters)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                rows = np.zeros((3, some.num_rows, 1 << steps), np.int64)
                for i, bins in enumerate(some.column(1).to_pylist()):
                    for b in bins:
                        rows[:, i, b["mask"]] = b["n"], b["good"], b["toxic"]
                every, good, toxic = rows
                values = [every @ m["kept"], every @ m["removed"], every @ m["redundant"], every @ m["unique_fails"], good @ m["removed"], toxic @ m["removed"], every @ m["shapley"]]
                wide = len(names) * steps
                part = pa.array(np.repeat(np.array(some.column(0).to_pylist(), object), wide), pa.string())
                order = pa.array(np.tile(np.repeat(np.array(names, object), steps), some.num_rows), pa.string())
                step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names) * some.num_rows))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(v.ravel()) for v in values)], ["part", "filter_order", "step", *columns])

    return stacked.select("part", "bins").mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in columns))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What each of the five filters does at each step of all 120 orders, in each part."""
    return outcomes(spark, histograms(spark, docs, labels, key, text, part))
