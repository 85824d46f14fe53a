"""Near duplicates among texts by order MinHash, checked by banded alignment.

A text's words (runs of letters and digits, in lower case) give three-word shingles, each labelled with how often it came
before in the text. A sketch takes the `SEVERAL` labelled shingles of least hash and keeps them in the order of the text;
`SKETCHES` of them, by different hashes, stand for the text. Texts of up to `EXACT` words have all their shingles stand for
them, as one of them at least is left in any text that is alike. Two texts that share a sketch are a candidate pair, and linked
if the alignment of their words, in a band as wide as the similarity allows, costs at most 1 - similarity of the longer one.
Shingles are of three words, not of five, because an edit in every fifth word leaves a similarity of 0.8 and no shingle of five.

The job is done on classes of equal word sequences, so exact copies cost nothing more. It has two steps, and neither caps or
drops a candidate pair. First each class is compared with the least and the largest id of every bucket (the texts that share
one sketch); links found so make parts. Then, in every bucket that still holds several parts, all classes of different parts meet in
tiles: a tile is a bounded number of classes, two tiles are compared as matrices of word counts, which rule nearly all pairs
out, and only classes that have a possible partner meet again with their words, to be aligned. Pairs that one part already
holds are not compared, and what a pair of tiles gives back is a spanning forest of its links.

Defined results: null and empty texts, and texts without a word, are alone: each is its own class (they are not copies of
each other). Rows that repeat an id count once: the row of the least text that is not null is taken. Rows with a null id have
no result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, shared, textscan

SHINGLE, SEVERAL, SKETCHES, SIMILARITY = 3, 2, 48, 0.8
#: Up to how many words a text stands for all its shingles; from EXACT * SIMILARITY words on, texts have sketches.
EXACT = 30
#: Classes of words that are counted to rule pairs out.
BINS = 128
#: About how many classes make a tile when counts are compared, and how many bytes of words when words are.
TILE, TILE_BYTES = 1024, 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words, in order."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for chunk in textscan.chunks(texts):
        kind = textscan.classes()[chunk.cp]
        starts, ends = textscan.runs((kind == textscan.LETTER) | (kind == textscan.NUMBER), chunk.bounds[:-1])
        h = textscan.span_hashes(textscan.folded()[chunk.cp], starts, ends)
        cuts = np.searchsorted(starts, chunk.bounds)
        for i, row in enumerate(chunk.rows.tolist()):
            parts[row].append(h[cuts[i] : cuts[i + 1]])
    return [p[0] if len(p) == 1 else np.concatenate([np.empty(0, np.uint64), *p]) for p in parts]


def shingles(words: np.ndarray) -> np.ndarray:
    """The occurrence-labelled hashes of all runs of SHINGLE words, in order."""
    if not len(words):
        return words
    k = min(SHINGLE, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = textscan.mix(h * np.uint64(31) + words[j : j + len(h)])
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    if new.all():
        return h
    first = np.flatnonzero(new)
    seen = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    label = np.empty(len(h), np.uint64)
    label[order] = seen
    return np.where(label > 0, textscan.mix(h + label * _STEP), h)


_SEEDS = textscan.mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def sketches(words: np.ndarray, count: int = SKETCHES) -> np.ndarray:
    """`count` order sketches, as 64-bit values."""
    h = shingles(words)
    if not len(h):
        return h
    take = min(SEVERAL, len(h))
    at = np.empty((count, take), np.int64)
    rows = max(1, (1 << 16) // len(h))
    for t in range(0, count, rows):
        seeds = np.arange(t, min(t + rows, count))
        value = (h[None, :] ^ _SEEDS[seeds][:, None]) * (_SEEDS[255 - seeds] | np.uint64(1))[:, None]
        value ^= value >> np.uint64(32)
        for k in range(take):
            at[seeds, k] = least = np.argmin(value, axis=1)
            value[np.arange(len(seeds)), least] = ~np.uint64(0)
    at.sort(axis=1)
    out = np.arange(1, count + 1, dtype=np.uint64)
    for k in range(take):
        out = textscan.mix(out * np.uint64(31) + h[at[:, k]])
    return out


def meetings(words: np.ndarray) -> np.ndarray:
    """Where a text meets others: its sketches, and for a short one its plain shingles.

    If the longer of two texts has n words, at most n / 5 edits leave a run of 3 equal words up to n = 30, but for n = 5: there of 2.
    """
    out = [sketches(words)] if len(words) >= EXACT * SIMILARITY else []
    for k in (2, SHINGLE):
        if k <= len(words) <= (5 if k == 2 else EXACT):
            h = np.full(len(words) - k + 1, k, np.uint64)
            for j in range(k):
                h = textscan.mix(h * np.uint64(31) + words[j : j + len(h)])
            out.append(np.unique(h))
    return np.concatenate([np.empty(0, np.uint64), *out])


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the edit distance of two word sequences is at most (1 - similarity) of the longer one's length.

    Diagonals within the band advance together: after e edits each holds the furthest place it reaches; those whose next words
    are equal slide on along them. Two bounds on the distance, from lengths and from word counts, come first.
    """
    longer = max(len(a), len(b))
    band = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > band:
        return False
    if not longer:
        return True
    both, n = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(n[: len(a)], minlength=len(both)), np.bincount(n[len(a) :], minlength=len(both))
    if max(np.maximum(ca - cb, 0).sum(), np.maximum(cb - ca, 0).sum()) > band:
        return False
    la, lb = len(a), len(b)
    x, y = np.append(n[:la], -1), np.append(n[la:], -2)

    def slide(i: int, j: int) -> int:
        """The place in a where equal words end that start at places i and j."""
        width = 32
        while True:
            differ = x[i : i + width] != y[j : j + width] if i + width <= la and j + width <= lb else x[i : min(la, i + lb - j)] != y[j : min(lb, j + la - i)]
            at = int(differ.argmax()) if len(differ) else 0
            if len(differ) and differ[at]:
                return i + at
            i, j = i + len(differ), j + len(differ)
            if i >= la or j >= lb:
                return i
            width *= 4

    goal, none = lb - la, -(1 << 60)
    reach = np.full(2 * band + 3, none, np.int64)  # the furthest place in a, by diagonal j - i, shifted by band + 1
    mid = band + 1
    reach[mid] = slide(0, 0)
    if goal == 0 and reach[mid] >= la:
        return True
    ends = np.minimum(la, lb - np.arange(-band, band + 1))
    for e in range(1, band + 1):
        k = np.arange(-e, e + 1)
        i = np.maximum(reach[mid - e : mid + e + 1] + 1, reach[mid - e - 1 : mid + e])
        np.maximum(i, reach[mid - e + 1 : mid + e + 2] + 1, out=i)
        np.minimum(i, ends[band - e : band + e + 1], out=i)
        i[(i < 0) | (i + k < 0)] = none
        at = np.maximum(i, 0)
        for r in np.flatnonzero((i >= 0) & (x[at] == y[np.clip(at + k, 0, lb)])).tolist():
            i[r] = slide(int(i[r]), int(i[r]) + r - e)
        reach[mid - e : mid + e + 1] = i
        if abs(goal) <= e and reach[mid + goal] >= la:
            return True
    return False


#: Texts of up to so many words are aligned many pairs at a time, and how many cells of their bands advance together.
BATCHED, CELLS = 1024, 1 << 17


def aligned_pairs(a: list[np.ndarray], b: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """`aligned` for each pair of word sequences; short ones in batches of like lengths."""
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    longer = np.maximum(la, lb)
    band = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    open_ = abs(la - lb) <= band
    for i in np.flatnonzero(open_ & (longer > BATCHED)).tolist():
        out[i] = aligned(a[i], b[i], similarity)
    rest = np.flatnonzero(open_ & (longer <= BATCHED))
    rest = rest[np.lexsort((abs(la - lb)[rest], longer[rest] >> 6))]
    while len(rest):
        some = rest[: max(1, CELLS // (int(band[rest[min(len(rest), 2048) - 1]]) + 1))]
        out[some] = _banded([min(a[i], b[i], key=len) for i in some], [max(b[i], a[i], key=len) for i in some], band[some])
        rest = rest[len(some) :]
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], band: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance, a's sequence not being the longer one, is within its band: the rows of all tables advance together.

    A line of the arrays is a diagonal.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # A path that leaves the diagonals between its two ends by k must come back, so it costs 2 k more than they differ.
    beyond = (band - (lb - la)) // 2
    left, right = int(beyond.max()), int((beyond + lb - la).max())
    x = np.full((int(la.max()), len(a)), -1, np.int32)
    y = np.full((max(int(lb.max()), len(x)) + left + right + 1, len(a)), -1, np.int32)  # what lies outside never counts
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[: len(p), i] = p.view(np.int32)
        y[left : left + len(q), i] = q.view(np.int32)
    step = np.arange(-left, right + 1, dtype=np.int16)[:, None]
    cost = np.repeat(np.where(step >= 0, step, 20_000).astype(np.int16), len(a), axis=1)
    shifts = [1 << k for k in range((len(step) - 1).bit_length())]
    out, row = np.zeros(len(a), bool), np.arange(len(a))
    ended = la == 0
    out[ended] = lb[ended] <= band[ended]
    for i in range(1, len(x) + 1):
        new = (y[i - 1 : i + left + right] != x[i - 1]).view(np.int8) + cost
        np.minimum(new[:-1], cost[1:] + np.int16(1), out=new[:-1])
        new -= step
        for k in shifts:  # running minima by doubling; numpy's own accumulation is slower by far
            np.minimum(new[k:], new[:-k], out=new[k:])
        new += step
        cost = new
        ended = np.flatnonzero(la[row] == i)
        if len(ended):
            who = row[ended]
            out[who] = cost[lb[who] - la[who] + left, ended] <= band[who]
        if i % 16 == 0:
            alive = (la[row] > i) & (cost.min(axis=0) <= band[row])
            if alive.sum() < 0.7 * len(row):
                row, x, y, cost = row[alive], x[:, alive], y[:, alive], cost[:, alive]
            if not len(row):
                break
    return out


_COUNTS = np.dtype([("n", "<u4"), ("bins", np.uint8, BINS)])


def counted(words: np.ndarray) -> bytes:
    """The number of words (32-bit hashes) and, for each of BINS classes of words, how many there are, 255 at most."""
    bins = np.minimum(np.bincount(words.astype(np.int64) % BINS, minlength=BINS), 255)
    return len(words).to_bytes(4, "little") + bins.astype(np.uint8).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, name, sketches, counts, words); all but the id are null for a text without words.

    The name is two 64-bit hashes and the length of the word sequence; words are told apart by 32 bits from there on.
    """
    for batch in batches:
        names, found, counts, stored = [], [], [], []
        for words in word_hashes(batch.column(1).to_pylist()):
            if not len(words):
                for column in (names, found, counts, stored):
                    column.append(None)
                continue
            place = np.arange(1, len(words) + 1, dtype=np.uint64) * _STEP
            sums = (int(textscan.mix(words + place * np.uint64(s)).sum(dtype=np.uint64)) for s in (1, 7))
            short = (words >> np.uint64(32)).astype(np.uint32)
            names.append(b"".join(x.to_bytes(8, "big") for x in (*sums, len(words))))
            found.append(meetings(words).astype(np.int64))
            counts.append(counted(short))
            stored.append(short.tobytes())
        columns = [batch.column(0), pa.array(names, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.binary()), pa.array(stored, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "name", "sketches", "counts", "words"])


def possible(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether lengths and counts leave it open that a's and b's word sequences, one by one, are alike; false is certain."""
    nx, ny = a["n"].astype(np.int64), b["n"].astype(np.int64)
    band = ((1 - similarity) * np.maximum(nx, ny) + 1e-9).astype(np.int64)
    more = a["bins"].astype(np.int16) - b["bins"]
    return (abs(nx - ny) <= band) & (np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1)) <= band)


def possible_of_all(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The matrix of `possible` for every one of a with every one of b."""
    nx, ny = (x["n"].astype(np.int64) for x in (a, b))
    band = ((1 - similarity) * np.maximum(nx[:, None], ny[None, :]) + 1e-9).astype(np.int64)
    out = abs(nx[:, None] - ny[None, :]) <= band
    if len(a) * len(b) <= 1 << 12:
        same = np.minimum(a["bins"][:, None, :], b["bins"][None, :, :]).sum(axis=2, dtype=np.int64)
    else:
        same = np.zeros((len(a), len(b)), np.uint16)
        left, right = np.ascontiguousarray(a["bins"].T), np.ascontiguousarray(b["bins"].T)
        for x, y in zip(left, right, strict=True):
            same += np.minimum.outer(x, y)
    for sums in (a["bins"].sum(axis=1, dtype=np.int64)[:, None], b["bins"].sum(axis=1, dtype=np.int64)[None, :]):
        out &= sums - same <= band
    return out


def _possible(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), _COUNTS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(possible(a, b, similarity)))

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(w, np.uint32) for w in batch.column(i).to_pylist()] for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(aligned_pairs(left, right, similarity)))

    return run


def _side(batch: pa.RecordBatch, column: int, row: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The ids, parts and contents of one tile."""
    items = batch.column(column)[row].values
    return items.field("id").to_numpy(), items.field("part").to_numpy(), items.field("content").to_pylist()


def _flagged(similarity: float):
    """(bucket, id, part, bytes) of each class of two tiles that may be like one of another part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, same = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row in range(batch.num_rows):
                ids, parts, content = _side(batch, 2, row)
                ids_b, parts_b, content_b = (ids, parts, content) if same[row] else _side(batch, 3, row)
                a, b = (np.frombuffer(b"".join(c), _COUNTS) for c in (content, content_b))
                in_b, found = np.zeros(len(b), bool), []
                for i in range(0, len(a), 256):
                    open_ = possible_of_all(a[i : i + 256], b, similarity)
                    open_ &= parts[i : i + 256, None] != parts_b[None, :]
                    found.append(open_.any(axis=1))
                    in_b |= open_.any(axis=0)
                in_a = np.concatenate(found)
                out = [np.concatenate([x[in_a], y[in_b & (not same[row])]]) for x, y in ((ids, ids_b), (parts, parts_b), (a["n"].astype(np.int64) * 4, b["n"].astype(np.int64) * 4))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(out[0]), buckets[row])), *map(pa.array, out)], ["bucket", "id", "part", "bytes"])

    return run


def _first_met(a: list[np.ndarray], b: list[np.ndarray], bucket: int) -> np.ndarray:
    """The matrix of pairs that share no sketch less than this bucket: all others meet in another one too, and are compared there."""
    less = [[x[x < bucket] for x in side] for side in (a, b)]
    both = np.intersect1d(*(np.concatenate([np.empty(0, np.int64), *side]) for side in less))
    there = []
    for side in less:
        m = np.zeros((len(side), len(both)), np.float32)
        for i, x in enumerate(side):
            m[i, np.searchsorted(both, x[np.isin(x, both)])] = 1
        there.append(m)
    return there[0] @ there[1].T == 0


def _linked(similarity: float):
    """(a, b): links between classes of different parts of two tiles; those that only repeat what others join are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, same, made = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for row in range(batch.num_rows):
                sides = []
                for column in (2,) if same[row] else (2, 3):
                    ids, parts, content = _side(batch, column, row)
                    words = [np.frombuffer(c["words"], np.uint32) for c in content]
                    counts = np.frombuffer(b"".join(c["counts"] for c in content), _COUNTS)
                    sides.append((ids, parts, words, counts, [np.array(c["sketches"], np.int64) for c in content]))
                (ids, parts, words, a, met), (ids_b, parts_b, words_b, b, met_b) = sides[0], sides[-1]
                open_ = possible_of_all(a, b, similarity) & (parts[:, None] != parts_b[None, :])
                if same[row]:
                    open_ = np.triu(open_)
                if open_.any():
                    open_ &= _first_met(met, met_b, buckets[row])
                for i, j in _joining(parts, words, parts_b, words_b, open_, similarity):
                    made.append((int(ids[i]), int(ids_b[j])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _joining(parts: np.ndarray, words: list[np.ndarray], parts_b: np.ndarray, words_b: list[np.ndarray], open_: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs among the open ones that are alike and join two parts: a few of each two parts are aligned at a time, ever more of them."""
    names, at = np.unique(np.concatenate([parts, parts_b]), return_inverse=True)
    up, few = np.arange(len(names)), 1

    def top(p: int) -> int:
        while up[p] != p:
            up[p] = p = up[up[p]]
        return p

    i, j = np.nonzero(open_)
    while len(i):
        roots = np.array([top(p) for p in range(len(names))])
        p, q = roots[at[i]], roots[at[len(parts) + j]]
        apart = p != q
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        pair = np.minimum(p, q) * len(names) + np.maximum(p, q)
        order = np.argsort(pair, kind="stable")
        i, j, pair = i[order], j[order], pair[order]
        start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
        rank = np.arange(len(pair)) - np.repeat(start, np.diff(np.append(start, len(pair))))
        now = rank < few
        some = np.flatnonzero(now)
        for k in some[aligned_pairs([words[x] for x in i[some]], [words_b[x] for x in j[some]], similarity)].tolist():
            p, q = top(int(at[i[k]])), top(int(at[len(parts) + j[k]]))
            if p != q:
                up[max(p, q)] = min(p, q)
                yield int(i[k]), int(j[k])
        i, j = i[~now], j[~now]
        few *= 8


def _in_tiles(members: DataFrame, contents: DataFrame, most: int, work, schema: str) -> DataFrame:
    """`work` on every two tiles of a bucket that hold different parts, once; written as a table.

    members are (bucket, id, part, weight), contents (id, content). A part heavier than a tile has tiles of its own, dealt by
    the hash of the id, which need not meet each other; all other parts of a bucket are dealt whole, by their hash.
    """
    spark = members.sparkSession
    of_part = members.groupBy("bucket", "part").agg(F.sum("weight").alias("w"))
    of_bucket = of_part.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("w") <= most, F.col("w"))).alias("rest"))
    heavy = F.col("w") > most
    deals = of_part.join(of_bucket.filter("parts > 1"), "bucket")
    deals = deals.select("bucket", "part", F.when(heavy, F.col("part")).alias("own"), F.ceil(F.when(heavy, F.col("w")).otherwise(F.col("rest")) / most).cast("long").alias("deals"))
    placed = members.join(deals, ["bucket", "part"]).withColumn("deal", F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("part")).otherwise(F.col("id"))), "deals"))
    placed = placed.select("id", "part", "bucket", "own", F.xxhash64("bucket", "own", "deal").alias("tile")).join(contents, "id")
    tiles = placed.groupBy("tile", "bucket", "own").agg(F.collect_list(F.struct("id", "part", "content")).alias("items"))
    tiles = shared.cut(tiles)
    a, b = (tiles.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("tile", "own"))) for x in "ab")
    apart = F.col("own_a").isNull() | F.col("own_b").isNull() | (F.col("own_a") != F.col("own_b"))
    pairs = a.join(b.hint("merge"), "bucket").filter((F.col("tile_a") <= F.col("tile_b")) & apart).select("bucket", "tile_a", "tile_b")
    left, right = (tiles.select(F.col("tile").alias(f"tile_{x}"), F.col("items").alias(f"items_{x}")).hint("merge") for x in "ab")
    same = F.col("tile_a") == F.col("tile_b")
    met = pairs.join(left, "tile_a").join(right, "tile_b").select("bucket", same.alias("same"), "items_a", F.when(~same, F.col("items_b")).alias("items_b"))
    out = shared.cut(met.mapInArrow(work, schema))
    shared.forget(tiles)
    return out


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """(id, text) with the least text that is not null for every id that repeats."""
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    repeated = shared.cut(repeated)
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, "id", "left_anti").unionByName(rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


def near_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, component_id, kept): the least id of equal word sequences, that of all texts reached by links, and whether the row is the one kept."""
    shared.small_batches(spark)
    rows = one_row_an_id(docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).filter("id IS NOT NULL"))
    signed = shared.cut(rows.mapInArrow(_signed, "id long, name binary, sketches array<long>, counts binary, words binary"))
    first = signed.filter("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("class_id"))
    classes = shared.cut(signed.select("id", "name").join(first, "name", "left").select("id", F.coalesce("class_id", "id").alias("class_id")))
    # Only the first of each class goes on.
    heads = classes.filter("id = class_id").select("id")
    sketched = signed.filter("name IS NOT NULL").select("id", "sketches").join(heads, "id", "left_semi").select("id", F.explode("sketches").alias("bucket"))
    # A class's sketches need to meet only where a bucket holds another class too.
    buckets = sketched.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("most")).filter("leader < most")
    members = shared.cut(sketched.join(buckets, "bucket").filter("id <> leader"))
    shared.release(spark)

    # First step: every class with the two leaders of each of its buckets.
    pairs = members.select("id", F.explode(F.array("leader", "most")).alias("leader")).filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    of = lambda c, side: signed.select(F.col("id").alias(side), F.col(c).alias(f"{c}_{side}"))
    pairs = pairs.join(of("counts", "b"), "b").join(of("counts", "a"), "a").select("a", "b", "counts_a", "counts_b")
    pairs = shared.cut(pairs.mapInArrow(_possible(similarity), "a long, b long"))
    alike = pairs.join(of("words", "b"), "b").join(of("words", "a"), "a").select("a", "b", "words_a", "words_b")
    alike = shared.cut(alike.mapInArrow(_verified(similarity), "a long, b long"))
    parts = shared.cut(components.connected_components(alike).withColumnRenamed("component_id", "part"))
    shared.forget(pairs, alike)

    # Second step: in buckets of several parts, all classes of different parts; leaders have met all others.
    placed = members.select("id", "bucket").join(parts, "id", "left").select("id", "bucket", F.coalesce("part", "id").alias("part"), F.lit(1).cast("long").alias("weight"))
    placed = shared.cut(placed)
    flagged = _in_tiles(placed, signed.select("id", F.col("counts").alias("content")), TILE, _flagged(similarity), "bucket long, id long, part long, bytes long")
    again = shared.cut(flagged.groupBy("bucket", "id", "part").agg(F.max("bytes").alias("weight")))
    links = _in_tiles(again, signed.select("id", F.struct("words", "counts", "sketches").alias("content")), TILE_BYTES, _linked(similarity), "a long, b long")
    # What was a part so far is one vertex now.
    fresh = links.join(_part(parts, "a"), "a", "left").join(_part(parts, "b"), "b", "left")
    fresh = fresh.select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    merged = shared.cut(components.connected_components(fresh))
    shared.forget(signed, members, placed, flagged, again, links)
    shared.release(spark)

    out = classes.join(parts.select(F.col("id").alias("class_id"), "part"), "class_id", "left").select("id", "class_id", F.coalesce("part", "class_id").alias("part"))
    out = out.join(merged.select(F.col("id").alias("part"), "component_id"), "part", "left")
    component = F.coalesce("component_id", "part")
    return out.select(F.col("id").alias(key), "class_id", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _part(parts: DataFrame, name: str) -> DataFrame:
    return parts.select(F.col("id").alias(name), F.col("part").alias(f"{name}_part"))


def deduplicated(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, that of the least id, with its columns; rows with a null id stay, uncompared.

    Of rows that repeat an id the one that was compared stays, that of the least text that is not null; of several with that
    text, the least one by its columns as JSON.
    """
    kept_name, row_name = shared.free_names(docs, "kept", "row")
    compared = near_duplicates(spark, docs, key, text, similarity).filter("kept").select(F.col(key).alias(kept_name))
    rows = docs.join(compared, docs[key].cast("long") == compared[kept_name], "left_semi")
    order = F.struct(docs[text].isNull(), docs[text], F.to_json(F.struct(*(docs[c] for c in docs.columns))))
    one = rows.groupBy(docs[key]).agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), order).alias(row_name)).select(f"{row_name}.*")
    return one.unionByName(docs.filter(docs[key].isNull()))
