"""Near duplicates among embeddings: all pairs of one label, by int8 tile products with proven error bounds.

A vector x of length one is stored as its int8 image q with a scale s, and the length e of what the image misses. For two
vectors |x.y - s q.t r| <= e_y + e_x (|y| + e_y), so a product of the int8 images tells which pairs can reach the threshold;
only those are computed again in double precision from the original vectors. Tiles hold vectors of one label that lie near
one pivot; two tiles whose centres are so far apart, for their radii, that no pair can reach the threshold are not
multiplied. Equal vectors are one row with a count, and a tile pair returns counts and a spanning forest of its links, so
nothing grows with the square of a group of copies.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links
with nothing. Vectors of different lengths do not link. Rows that repeat an id are one vector if they are equal, and the
first in order of its components is taken if they are not. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, shared

#: Vectors of a tile, and the pivots (a bounded sample of the vectors) that order them.
TILE, PIVOTS = 2048, 48
THRESHOLD = 0.98


def usable(vector: str = "embedding"):
    """Whether a vector takes part: not null, and all components finite, not all zero."""
    v = F.col(vector)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, number) & F.exists(v, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The int8 image of each row, its scale, and a bound on the length of the difference."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - scale[:, None] * q, axis=1) * (1 + 1e-9) + 1e-12


def product(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with cosine >= threshold, exactly: bounds first, then doubles for those that may reach it."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    qx, sx, ex = quantised(x / nx[:, None])
    qy, sy, ey = quantised(y / ny[:, None])
    fy = qy.astype(np.float32).T  # products of int8 images are whole numbers below 2 ** 24: exact in float32 up to 1000 components
    if x.shape[1] > 1000:
        fy = fy.astype(np.float64)
    for a in range(0, len(x), rows):
        b = min(a + rows, len(x))
        near = (qx[a:b].astype(fy.dtype) @ fy) * sx[a:b, None] * sy[None, :]
        near += ey[None, :] + ex[a:b, None] * (1 + ey)[None, :]
        i, j = np.nonzero(near >= threshold - 1e-6)
        for part in range(0, len(i), 1 << 17):
            s, t = i[part : part + (1 << 17)] + a, j[part : part + (1 << 17)]
            keep = np.einsum("ij,ij->i", x[s], y[t]) / (nx[s] * ny[t]) >= threshold
            yield s[keep], t[keep]


class Forest:
    """Union-find over the rows of two tiles; gives back each link that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        made = []
        roots = self.roots()
        differ = roots[a] != roots[b]
        pairs = np.unique(np.column_stack([roots[a[differ]], roots[b[differ]]]), axis=0)
        up = self.up

        def top(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for p, q in pairs.tolist():
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                made.append((p, q))
        return made


def _multiplied(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, da, db, ids_a, ids_b, n_a, n_b, width in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                x = np.frombuffer(da, np.float64).reshape(-1, width)
                y = x if same else np.frombuffer(db, np.float64).reshape(-1, width)
                ia, na = np.frombuffer(ids_a, np.int64), np.frombuffer(n_a, np.int64)
                ib, nb = (ia, na) if same else (np.frombuffer(ids_b, np.int64), np.frombuffer(n_b, np.int64))
                ids = ia if same else np.concatenate([ia, ib])
                links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
                for i, j in product(x, y, threshold):
                    if same:
                        off = i != j
                        i, j = i[off], j[off]
                        links += np.bincount(i, nb[j], len(ids)).astype(np.int64)
                        edges += forest.join(i, j)
                    else:
                        links += np.bincount(i, nb[j], len(ids)).astype(np.int64) + np.bincount(j + len(ia), na[i], len(ids)).astype(np.int64)
                        edges += forest.join(i, j + len(ia))
                some = np.flatnonzero(links)
                e = np.array(edges, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[e[:, 0]]])), pa.array(np.concatenate([links[some], np.zeros(len(e), np.int64)])), pa.array([None] * len(some) + ids[e[:, 1]].tolist(), pa.int64())], ["id", "n", "other"])

    return run


def near_duplicates(spark: SparkSession, table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of the table."""
    shared.small_batches(spark)
    rows = table.select(table[key].cast("long").alias("id"), table[vector].cast("array<double>").alias("v"), table[label].alias("label"))
    every = rows.select("id").filter("id IS NOT NULL").distinct()
    good = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v")).groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.v", "r.label")
    # Equal vectors of one label are one row with a count.
    heads = shared.cut(good.groupBy("label", "v").agg(F.min("id").alias("head"), F.count("*").alias("n")))
    copies = shared.cut(good.join(heads.hint("merge"), ["label", "v"]).select("id", "head", "n"))
    n = heads.count()
    taken = shared.bounded(heads, "head", n, PIVOTS * 2).select("head", "v").orderBy(F.xxhash64("head"), "head").limit(PIVOTS * 4).collect()
    by_width: dict[int, list] = {}
    for r in taken:
        by_width.setdefault(len(r.v), []).append(np.array(r.v) / np.linalg.norm(r.v))
    pivots = spark.sparkContext.broadcast({w: np.array(p[:PIVOTS]) for w, p in by_width.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest pivot of each vector."""
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            lists = batch.column(3)
            width = np.array(lists.value_lengths())
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                if w in pivots.value:
                    x = np.array(lists.take(pa.array(at)).flatten()).reshape(-1, w)
                    out[at] = np.argmax(x @ pivots.value[w].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(width.astype(np.int64)), pa.array(out)], [*batch.schema.names, "width", "pivot"])

    kind = heads.schema["label"].dataType.simpleString()
    near = shared.cut(heads.select("label", "head", "n", "v").mapInArrow(placed, f"label {kind}, head long, n long, v array<double>, width long, pivot long"))
    cell = ["label", "width", "pivot"]
    # Cells of many vectors are dealt into tiles by a hash: no group larger than about two tiles meets in one task.
    deals = near.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).cast("long").alias("deals"))
    near = near.join(deals, cell).withColumn("deal", F.pmod(F.xxhash64("head"), "deals"))

    def packed(key, t):
        x = np.array(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = unit.mean(axis=0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-12 else unit[0]
        radius = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) + 1e-9
        label, width, pivot, deal = (k.as_py() for k in key)
        return pa.table({"label": pa.array([label], t.schema.field("label").type), "width": [width], "tile": [pivot * (1 << 32) + deal], "centre": [centre.tolist()], "radius": [radius], "data": [x.tobytes()], "ids": [np.array(t.column("head")).astype(np.int64).tobytes()], "ns": [np.array(t.column("n")).astype(np.int64).tobytes()]})

    tiles = near.select(*cell, "deal", "head", "n", "v").groupBy(*cell, "deal").applyInArrow(packed, f"label {kind}, width long, tile long, centre array<double>, radius double, data binary, ids binary, ns binary")
    tiles = shared.cut(tiles)
    a = tiles.select("label", "width", F.col("tile").alias("tile_a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
    b = tiles.select("label", "width", F.col("tile").alias("tile_b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
    dot = F.aggregate(F.zip_with("ca", "cb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    gap = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) - F.col("ra") - F.col("rb")
    pairs = a.join(b, ["label", "width"]).filter((F.col("tile_a") <= F.col("tile_b")) & ((F.col("tile_a") == F.col("tile_b")) | (gap <= float(np.arccos(threshold)) + 1e-6))).select("label", "width", "tile_a", "tile_b")
    load = lambda side: tiles.select("label", "width", F.col("tile").alias(f"tile_{side}"), F.col("data").alias(f"data_{side}"), F.col("ids").alias(f"ids_{side}"), F.col("ns").alias(f"ns_{side}")).hint("merge")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.repartition(parts, F.xxhash64("label", "tile_a", "tile_b")).join(load("a"), ["label", "width", "tile_a"]).join(load("b"), ["label", "width", "tile_b"])
    work = work.select((F.col("tile_a") == F.col("tile_b")).alias("same"), "data_a", "data_b", "ids_a", "ids_b", "ns_a", "ns_b", "width")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        done = shared.cut(work.mapInArrow(_multiplied(threshold), "id long, n long, other long"))
    finally:
        shared.small_batches(spark)
    linked = done.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("linked"))
    parts = components.connected_components(done.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_head = copies.join(linked.withColumnRenamed("id", "head").hint("merge"), "head", "left").join(parts.withColumnRenamed("id", "head").hint("merge"), "head", "left")
    of_head = of_head.select("id", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "head").alias("component_id"))
    out = every.join(of_head.hint("merge"), "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
