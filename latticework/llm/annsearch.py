"""Nearest neighbours by inner product, with additive quantisation and proven bounds.

A vector is its length times its direction, and a direction is the sum of one full-dimensional codeword from each of `BOOKS`
codebooks, plus a rest. The codebooks are fitted on the directions of a bounded sample, in one task: each to the residuals of
those before it, and then all of them together by least squares. Every direction is encoded by a beam search over the sums,
and kept with its angle to the sum. A query guesses its products with a block of vectors by adding up entries of its lookup
table (its products with all codewords). Guess and angle bound the true product from above, whatever the rows are like. The
best guesses, `RERANK` of the whole table, are scored exactly, in double precision, on the original vectors; the least of the
best exact scores is a threshold, and every other vector whose bound reaches it is scored exactly as well. So no vector is
missed: where codes tell vectors apart few are scored, and where they do not (near copies, many dimensions) up to all of them.

A block holds vectors by a hash, so its share of the best `RERANK` is as large as its share of all vectors, but for chance;
it gives six standard deviations more than that. One task meets several blocks with the same queries, one after the other; its
thresholds rise on the way, and it puts out one answer for all its blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part. Rows that repeat an
id count once, with the least of their vectors. Queries only meet vectors of their own length; lengths that the sample lacks
are scored exactly. Equal vectors in a block are ranked once and all counted, so copies displace nothing. Ties go to the
smaller id; a query with fewer candidates gets them all. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import embdup, shared

BOOKS, WORDS, BEAM = 12, 256, 4
#: Vectors that the codebooks are fitted on, at most; vectors and queries of a block; vectors scored exactly for each query, at least.
SAMPLE, BLOCK, QUERIES, RERANK = 8192, 8192, 4096, 512


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, width)

    @cached_property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])

    @cached_property
    def gram(self) -> np.ndarray:
        return self.flat.astype(np.float32) @ self.flat.astype(np.float32).T

    @cached_property
    def squares(self) -> np.ndarray:
        return np.einsum("ij,ij->i", self.flat, self.flat)

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 2048) -> np.ndarray:
        """The codes of each row: the best of `beam` partial sums is followed through all books."""
        return np.concatenate([np.empty((0, len(self.words)), np.uint8), *(self._encode(x[i : i + rows], beam) for i in range(0, len(x), rows))])

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, books, words = len(x), *self.words.shape[:2]
        cross = x.astype(np.float32) @ self.flat.T.astype(np.float32)
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for b in range(books):
            part = slice(b * words, (b + 1) * words)
            step = (self.squares[part].astype(np.float32) - 2 * cross[:, part])[:, None, :] + cost[:, :, None]
            for k in range(codes.shape[2]):
                step = step + 2 * self.gram[codes[:, :, k] + k * words, part]
            flat = step.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if b + 1 < books else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
            came, word = best // words, best % words
            cost = np.take_along_axis(flat, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], axis=1), word[:, :, None]], axis=2)
        return codes[:, 0, :].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words)))


def _means(x: np.ndarray, k: int, random: np.random.Generator, rounds: int = 5) -> np.ndarray:
    """k-means; empty cells start again at random rows."""
    centres = x[random.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = np.argmin(np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[random.choice(len(x), k)])
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, joint: int = 2, seed: int = 5) -> Codebooks:
    """Codebooks by residual k-means, then `joint` rounds of encoding and least squares over all books."""
    random = np.random.default_rng(seed)
    x = x.astype(np.float32)
    rest, made = x.copy(), []
    for _ in range(books):
        made.append(_means(rest, words, random))
        near = np.argmin(np.einsum("ij,ij->i", made[-1], made[-1]) - 2 * (rest @ made[-1].T), axis=1)
        rest = rest - made[-1][near]
    found = Codebooks(np.array(made, np.float64))
    for _ in range(joint):
        at = found.encode(x).astype(np.int64) + np.arange(books) * words
        normal, right = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for a in range(books):
            np.add.at(right, at[:, a], x)
            for b in range(books):
                np.add.at(normal, (at[:, a], at[:, b]), 1.0)
        normal += np.eye(books * words) * 0.05
        right += 0.05 * found.flat
        found = Codebooks(np.linalg.solve(normal, right).reshape(books, words, -1))
    return found


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows at length one, and their lengths; no component is so large or small that its square is lost."""
    most = np.abs(x).max(axis=1, initial=0)
    unit = x / most[:, None]
    length = np.linalg.norm(unit, axis=1)
    with np.errstate(over="ignore"):
        return unit / length[:, None], length * most


def coded(unit: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The codes of each direction, and (inverse length of the sum, cosine and sine between both, bound on rounding) for each."""
    codes = books.encode(unit)
    made = books.decode(codes)
    length = np.linalg.norm(made, axis=1)
    inverse = np.where(length > 1e-6, 1 / np.maximum(length, 1e-6), 0.0)
    cos = np.einsum("ij,ij->i", unit, made) * inverse
    sin = np.linalg.norm(unit - (cos * inverse)[:, None] * made, axis=1)
    added = sum(np.sqrt(books.squares.reshape(len(books.words), -1)[b][codes[:, b]]) for b in range(len(books.words)))
    # Tables and their sums are float32: an error of 2 ** -24 for each step, over all components and books.
    rounding = (unit.shape[1] + 4 * len(books.words)) * 2.0**-24 * added * inverse + 1e-6
    return codes, np.stack([inverse, cos, sin, rounding])


def bounded_guesses(q: np.ndarray, codes: np.ndarray, angles: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Guesses of the products of all directions (rows) with those of queries (columns), by lookup tables, and upper bounds of them.

    A direction at angle a from its sum, which lies at angle b from the query, is at angle b - a from the query at least.
    """
    table = (q.astype(np.float32) @ books.flat.T.astype(np.float32)).T.copy()
    rows = codes.astype(np.int64) + np.arange(codes.shape[1]) * len(books.words[0])
    inverse, cos, sin, rounding = (a.astype(np.float32)[:, None] for a in angles)
    guess = table[rows[:, 0]]
    for b in range(1, rows.shape[1]):
        guess += table[rows[:, b]]
    guess *= inverse
    off = np.maximum(np.abs(guess) - rounding, 0)
    bound = np.sqrt(np.maximum(1 - off * off, 0)) * (sin + 1e-6)
    guess *= cos
    bound += guess
    bound += rounding
    return guess, bound


def exact_best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: list[np.ndarray], at_q: np.ndarray, at_x: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): the best of the shortlisted vectors of one block for each query; ids are the rows that have each vector."""
    order = np.argsort(at_q, kind="stable")
    at_q, at_x = at_q[order], at_x[order]
    score = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", q[at_q[a : a + 65536]], x[at_x[a : a + 65536]]) for a in range(0, len(at_q), 65536))])
    found_q, found_v, scores = [], [], []
    for i, a, b in zip(*(z.tolist() for z in (np.unique(at_q), np.searchsorted(at_q, np.unique(at_q)), np.searchsorted(at_q, np.unique(at_q), side="right"))), strict=True):
        rows, exact = at_x[a:b], score[a:b]
        # One more than `top` vectors: the query's own row may be among them, alone in its vector.
        if len(rows) > top + 1:
            least = np.partition(exact, len(exact) - top - 1)[len(exact) - top - 1]
            rows, exact = rows[exact >= least], exact[exact >= least]
        v = np.concatenate([ids[r][: top + 1] for r in rows])
        s = np.repeat(exact, [min(len(ids[r]), top + 1) for r in rows])
        s, v = s[v != q_ids[i]], v[v != q_ids[i]]
        order = np.lexsort((v, -s))[:top]
        found_q.append(np.full(len(order), q_ids[i]))
        found_v.append(v[order])
        scores.append(s[order])
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + found_q), np.concatenate(none + found_v), np.concatenate([np.empty(0), *scores])


class Answer:
    """The best `top` rows found so far for each query of a part."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, top: int):
        self.q, self.q_ids, self.top = q, q_ids, top
        self.unit, self.length = directions(q)
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        self.least = np.full(len(q), -np.inf)

    def meet(self, x: np.ndarray, ids: list[np.ndarray], length: np.ndarray, codes: np.ndarray, angles: np.ndarray, books: Codebooks | None, most: int, step: int = 128) -> None:
        """Score the vectors of a block that may be among the best: the `most` best guesses, and all whose bound reaches the threshold."""
        at_q, at_x = [], []
        for a in range(0, len(self.q), step):
            i, j = self._shortlist(slice(a, min(a + step, len(self.q))), x, length, codes, angles, books, most)
            at_q.append(i + a)
            at_x.append(j)
        made = exact_best(self.q, self.q_ids, x, ids, np.concatenate(at_q), np.concatenate(at_x), self.top)
        who, ids, score = (np.concatenate(z) for z in zip(self.found, made, strict=True))
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        self.found = [who[rank < self.top], ids[rank < self.top], score[rank < self.top]]
        full = rank == self.top - 1
        self.least[np.searchsorted(self.q_ids, who[full])] = score[full]

    def _shortlist(self, part: slice, x, length, codes, angles, books, most) -> tuple[np.ndarray, np.ndarray]:
        q, size = self.q[part], self.length[part]
        least, most = self.least[part].copy(), min(most, len(x))
        # Two ways to add up one product in double precision differ by less than this times both lengths.
        loss = 1e-15 * (x.shape[1] + 8)
        with np.errstate(over="ignore", invalid="ignore"):
            if books is None:  # a length that the sample lacks: every vector may be near
                most, reach = len(x), np.ones((len(x), len(q)), bool)
                best = np.broadcast_to(np.arange(most), (len(q), most))
            else:
                guess, bound = bounded_guesses(self.unit[part], codes, angles, books)
                best = np.argpartition(-(guess * length[:, None]), most - 1, axis=0)[:most].T
            if most > self.top:
                # One more than `top` vectors: the query's own row may be among them, alone in its vector.
                score = np.stack([x[j] @ one - loss * length[j] * n for j, one, n in zip(best, q, size, strict=True)])
                least = np.fmax(least, np.partition(score, most - self.top - 1, axis=1)[:, most - self.top - 1])
            if books is not None:
                limit = np.where(np.isfinite(size), least / size, -np.inf)
                reach = ~(bound * length[:, None] < limit[None, :]) | ~np.isfinite(length)[:, None]
            rows = np.flatnonzero(reach.any(axis=1))
            # The product of all at once tells which of them are near enough to be scored one by one.
            score = x[rows] @ q.T + loss * length[rows][:, None] * size[None, :]
            j, i = np.nonzero(reach[rows] & ~(score < least[None, :]))
        return i, rows[j]


def _answers(books, most, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answer = None, None
        for batch in batches:
            for *key, q_data, q_ids, data, starts, ids, length, codes, angles in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                width = key[0]
                if key != at:
                    if answer is not None:
                        yield _rows(answer)
                    at, answer = key, Answer(np.frombuffer(q_data, np.float64).reshape(-1, width), np.frombuffer(q_ids, np.int64), top)
                x = np.frombuffer(data, np.float64).reshape(-1, width)
                own = np.split(np.frombuffer(ids, np.int64), np.frombuffer(starts, np.int64)[1:])
                answer.meet(x, own, np.frombuffer(length, np.float64), np.frombuffer(codes, np.uint8).reshape(len(x), -1), np.frombuffer(angles, np.float64).reshape(4, -1), books.value.get(width), most[width])
        if answer is not None:
            yield _rows(answer)

    return run


def _rows(answer: Answer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in answer.found], ["query_id", "vec_id", "score"])


def _fitted(key, t):
    """The codebooks of the sampled directions of one length."""
    width = key[0].as_py()
    x = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, width)
    unit, _ = directions(x[np.lexsort((*x.T[::-1], np.array(t.column("id"))))])
    words = fit(unit, words=min(WORDS, len(unit))).words
    return pa.table({"width": pa.array([width], pa.int32()), "words": [words.tobytes()]})


def search(spark: SparkSession, table: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of every query row among all other rows."""
    shared.small_batches(spark)
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("v"), is_query.alias("query")).filter(F.col("id").isNotNull() & embdup.usable("v"))
    rows = rows.withColumn("width", F.size("v"))
    sizes = {r["width"]: (r["n"], r["queries"]) for r in rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if("query").alias("queries")).collect()}
    taken = shared.bounded(rows, "id", sum(n for n, _ in sizes.values()), sample).groupBy("id", "width").agg(F.min("v").alias("v"))
    made = taken.groupBy("width").applyInArrow(_fitted, "width int, words binary").collect()
    books = spark.sparkContext.broadcast({r["width"]: Codebooks(np.frombuffer(r["words"], np.float64).reshape(BOOKS, -1, r["width"])) for r in made})
    blocks = F.create_map([F.lit(k) for w, (n, _) in sizes.items() for k in (w, -(-n // BLOCK))]) if sizes else F.lit(None).cast("map<int,int>")
    parts = F.create_map([F.lit(k) for w, (_, n) in sizes.items() for k in (w, max(1, -(-n // QUERIES)))]) if sizes else F.lit(None).cast("map<int,int>")
    h = F.xxhash64("id")

    def packed(key, t):
        """A block of vectors: distinct ones, the rows that have each, lengths, codes, and the angles to what they stand for."""
        width, block = (k.as_py() for k in key)
        x = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, width)
        ids = np.array(t.column("id"))
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        first = np.append(True, ids[1:] != ids[:-1])
        x, ids = x[first], ids[first]
        _, at, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        same = same.reshape(-1)
        order = np.lexsort((ids, same))
        starts = np.searchsorted(same[order], np.arange(len(at)))
        x, model = x[at], books.value.get(width)
        unit, length = directions(x)
        codes, angles = coded(unit, model) if model else (np.empty((len(x), 0), np.uint8), np.empty((4, 0)))
        return pa.table({"width": pa.array([width], pa.int32()), "block": pa.array([block], pa.int32()), "data": [x.tobytes()], "starts": [starts.astype(np.int64).tobytes()], "ids": [ids[order].tobytes()], "length": [length.tobytes()], "codes": [codes.tobytes()], "angles": [angles.tobytes()]})

    def asked(key, t):
        width, block = (k.as_py() for k in key)
        x = np.array(t.column("v").combine_chunks().flatten()).reshape(-1, width)
        ids = np.array(t.column("id"))
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        first = np.append(True, ids[1:] != ids[:-1])
        return pa.table({"width": pa.array([width], pa.int32()), "part": pa.array([block], pa.int32()), "q_data": [x[first].tobytes()], "q_ids": [ids[first].tobytes()]})

    block = F.pmod(h, blocks[F.col("width")]).cast("int").alias("block")
    part = F.pmod(h, parts[F.col("width")]).cast("int").alias("part")
    stored = shared.cut(rows.select("id", "v", "width", block).groupBy("width", "block").applyInArrow(packed, "width int, block int, data binary, starts binary, ids binary, length binary, codes binary, angles binary"))
    queries = shared.cut(rows.filter("query").select("id", "v", "width", part).groupBy("width", "part").applyInArrow(asked, "width int, part int, q_data binary, q_ids binary"))
    # How many of the best `rerank` a block may hold.
    most = {}
    for w, (n, _) in sizes.items():
        share = rerank * min(1.0, BLOCK / n)
        most[w] = min(rerank, int(share + 6 * share**0.5 + 8))
    # So many tasks meet each part of the queries, each with its own share of the blocks.
    cores = spark.sparkContext.defaultParallelism
    shares = {w: max(1, min(-(-n // BLOCK), -(-4 * cores // max(1, -(-m // QUERIES))))) for w, (n, m) in sizes.items()}
    shares = F.create_map([F.lit(k) for kv in shares.items() for k in kv]) if sizes else F.lit(None).cast("map<int,int>")
    every = lambda n: F.explode(F.sequence(F.lit(0), n[F.col("width")] - 1))
    asking = queries.withColumn("share", every(shares))
    met = stored.withColumn("share", F.pmod("block", shares[F.col("width")])).withColumn("part", every(parts))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        # The join sorts both sides by its keys, so the blocks of one answer come one after the other.
        work = met.hint("merge").join(asking.hint("merge"), ["width", "part", "share"])
        columns = ["width", "part", "share", "q_data", "q_ids", "data", "starts", "ids", "length", "codes", "angles"]
        found = shared.cut(work.select(*columns).mapInArrow(_answers(books, most, top), "query_id long, vec_id long, score double"))
    finally:
        shared.small_batches(spark)
    shared.forget(stored, queries)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
