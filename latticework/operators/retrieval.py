"""Full-text, vector and mixed retrieval over document tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions import constants, text
from latticework.operators import graph
from latticework.sources.folders import checkpointed, workers_find_us

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, tf): how often each lower-case run of letters and digits occurs in each document."""
    terms = docs.select(key, F.explode(F.regexp_extract_all(F.lower(body), F.lit("[a-z0-9]+"), 0)).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", body: str = "text", query_key: str = "query_id", query: str = "query", prefix: bool = True, limit: int = 20) -> DataFrame:
    """(query key, key, score, rank): documents that match any term of the query, or begin a word with it, best first.

    Scores are rounded to six digits, and ties go to the smaller key. A query without terms matches nothing. Each document is
    read once: it becomes its length and its counted words, and only words that some query asks for go on, pre-aggregated by
    query word. With `prefix` a word is tried by its beginnings of the lengths that query words have, a short list; so every
    join is one of equality. Scores are summed up over the distinct query words, which documents and queries share.
    """
    index = checkpointed(postings(docs, key, body))
    lengths = index.groupBy(key).agg(F.sum("tf").alias("dl"))
    stats = docs.agg(F.count("*").alias("n")).join(index.agg(F.sum("tf").alias("words")))
    return scored(asked_words(queries, query_key, query), index, lengths, stats, key, query_key, prefix, limit)


def asked_words(queries: DataFrame, query_key: str, query: str) -> DataFrame:
    """(query key, q): the distinct lower-case words of every query."""
    return checkpointed(queries.select(query_key, F.explode(F.array_distinct(F.transform(text.query_terms(F.col(query)), F.lower))).alias("q")))


def scored(asked: DataFrame, index: DataFrame, lengths: DataFrame, stats: DataFrame, key: str, query_key: str, prefix: bool, limit: int) -> DataFrame:
    """`bm25` of asked words over postings (key, term, tf), lengths (key, dl) and one row of totals (n, words)."""
    words = asked.select("q").distinct()
    if prefix:
        sizes = words.agg(F.sort_array(F.collect_set(F.length("q"))).alias("sizes"))
        tried = index.join(F.broadcast(sizes)).withColumn("k", F.explode("sizes")).filter(F.length("term") >= F.col("k")).select(key, F.substring("term", F.lit(1), F.col("k")).alias("q"), "tf")
    else:
        tried = index.withColumnRenamed("term", "q")
    matched = checkpointed(tried.join(words, "q", "left_semi").groupBy("q", key).agg(F.sum("tf").alias("tf")))
    df = matched.groupBy("q").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") * F.col("n") / F.col("words")))
    found = matched.join(df, "q").join(lengths, key).join(F.broadcast(stats)).select("q", key, part.alias("part"))
    out = asked.join(found, "q").groupBy(query_key, key).agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit)


#: Vectors, and queries, that meet at once.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "id", vector: str = "vector", query_key: str = "query_id", floor: float = constants.SEMANTIC_FLOOR, limit: int = 10) -> DataFrame:
    """(query key, key, score, rank): vectors with cosine at or above the floor, best first.

    Scores are rounded to six digits before they are ranked, and ties go to the smaller key. Both sides are cut into blocks by
    hash; a task multiplies two blocks and keeps the best `limit` of each query, so neither side is sent whole to anyone.
    Vectors that are null, empty, zero or hold a null have cosine 0 with all; of two lengths, the longer one's rest adds to its norm alone.
    """
    spark = vectors.sparkSession
    workers_find_us(spark)
    kinds = [df.schema[c].dataType for df, c in ((queries, query_key), (vectors, key))]
    n = [max(1, -(-df.count() // size)) for df, size in ((queries, BLOCK_QUERIES), (vectors, BLOCK_VECTORS))]
    dealt = lambda df, k, v, n, out: df.select(F.col(k).alias("k"), F.col(v).cast("array<double>").alias("v"), F.pmod(F.xxhash64(k), F.lit(n)).alias(out))
    q = dealt(queries, query_key, vector, n[0], "qb").withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n[1] - 1)))).withColumn("vb", F.col("vb").cast("long"))
    x = dealt(vectors, key, vector, n[1], "vb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n[0] - 1)))).withColumn("qb", F.col("qb").cast("long"))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        rows = column.to_pylist()
        out = np.zeros((len(rows), max([1, *(len(r) for r in rows if r)])))
        for i, r in enumerate(rows):
            if r and None not in r:
                out[i, : len(r)] = r
        return out

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = matrix(left.column("v")), matrix(right.column("v"))
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
        norms = [np.sqrt((m * m).sum(axis=1)) for m in (a, b)]
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = (a @ b.T) / (norms[0][:, None] * norms[1][None, :])
        raw = np.where(np.isfinite(raw), raw, 0.0)
        score = np.round(raw, 6)
        order = np.argsort(np.argsort(np.array(right.column("k").to_pylist(), object), kind="stable"), kind="stable")  # places by key, for ties
        i_out, j_out = [], []
        for i in range(len(a)):
            some = np.flatnonzero(raw[i] >= floor)
            some = some[np.lexsort((order[some], -score[i, some]))[:limit]]
            i_out.append(np.full(len(some), i))
            j_out.append(some)
        i, j = (np.concatenate([np.empty(0, np.int64), *o]).astype(np.int64) for o in (i_out, j_out))
        return pa.table({query_key: left.column("k").take(pa.array(i)), key: right.column("k").take(pa.array(j)), "score": score[i, j]})

    schema = T.StructType([T.StructField(query_key, kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())])
    scored = q.groupBy("qb", "vb").cogroup(x.groupBy("qb", "vb")).applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def keyword_graph(seeds: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 10) -> DataFrame:
    """(node): the seeds and all within so many hops of them, either way, the first so many in the order of their names."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return graph.reachable_nodes(both, seeds, hops).select("node").orderBy("node").limit(limit)


def with_hints(hints: DataFrame, found: DataFrame, limit: int = 10) -> DataFrame:
    """(name, rank): hints first, then what was found, each name once."""
    both = hints.select("name", F.lit(0).alias("_s"), F.col("rank").alias("_r")).unionByName(found.select("name", F.lit(1).alias("_s"), F.col("rank").alias("_r")))
    one = both.groupBy("name").agg(F.min(F.struct("_s", "_r")).alias("_o")).orderBy("_o", "name").limit(limit)
    return one.select("name", F.row_number().over(Window.orderBy("_o", "name")).alias("rank")).filter(F.col("rank") <= limit)


def interleaved(first: DataFrame, second: DataFrame, limit: int = 10, by: list[str] = ()) -> DataFrame:
    """(by, name, rank): rank by rank from both lists, the first list first, each name at its first place."""
    both = first.select(*by, "name", "rank", F.lit(0).alias("_s")).unionByName(second.select(*by, "name", "rank", F.lit(1).alias("_s")))
    one = both.groupBy(*by, "name").agg(F.min(F.struct("rank", "_s")).alias("_o"))
    # A list without keys is cut to its first rows by a sort for the few first, not by a window over all of it.
    one = one if by else one.orderBy("_o", "name").limit(limit)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return one.select(*by, "name", F.row_number().over(w.orderBy("_o", "name")).alias("rank")).filter(F.col("rank") <= limit)


def fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The first result, or the second where the first has no row at all."""
    none = primary.limit(1).agg((F.count("*") == 0).alias("_none"))
    return primary.unionByName(secondary.join(F.broadcast(none), F.col("_none")).drop("_none"))
