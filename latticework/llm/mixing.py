"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source's documents, in an order by a hash of the id, lie end to end and are cut into blocks of `block_words`
(the last one shorter). The mix has as many slots for a source as its target needs; the very last slot takes only the words
still missing. Slots are dealt to output shards by multinomial draws: at each node of a binary tree over the shards the
slots left for each source are drawn for its left half, so a shard finds its own counts, and the ranks of its slots within
each source, by walking from the root, without a table of all shards. Slot k of a source stands for the block that a keyed
pseudorandom permutation of the block indices (a Feistel network with cycle walking; another key for each pass over the
source) maps k to, and blocks are joined by index. All of it depends on hashes alone, so reruns agree.

Defined results: a null text has size 0, and documents of size 0 are never taken. A null source is a source of its own, the
last. A source without words has target 0. Rows that repeat an id are documents of their own for `mix` and `taken`; for
`mixed_documents` see there. Further columns are ignored.
The table of sources, one row each, is the only thing that is collected; it is as long as the list of weights to be set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textscan

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 256
#: Slots of an output shard, and documents of a group within which word offsets are summed up.
SHARD_SLOTS, GROUP = 1 << 14, 4096
#: Sources up to which their table is sent to every task; beyond, it is joined like any other.
MOST_SENT = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def size(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- targets --------------------------------------------------------------------------------------------------------


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """Each source's words in the mix: its weight's share of all, at most cap * size, the excess shared anew by weight."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    most = cap * np.array(sizes, float)
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = float(sum(sizes))
    while open_.any():
        out[open_] = left * w[open_] / w[open_].sum()
        over = open_ & (out > most)
        if not over.any():
            break
        out[over] = most[over]
        open_ &= ~over
        left = float(sum(sizes)) - out[~open_].sum()
    return out.tolist()


@dataclass
class Source:
    """One source's share of the mix: `slots` blocks, the last of which gives only `last` words."""

    size: int
    target: float
    blocks: int
    slots: int
    last: int


def planned(size_: int, target: float, block_words: int, seed: int) -> Source:
    blocks = -(-size_ // block_words)
    if not blocks:
        return Source(size_, target, 0, 0, 0)
    whole, rest = divmod(round(target), size_)
    if not rest:
        return Source(size_, target, blocks, whole * blocks, block_words)
    short = block_words - (size_ - (blocks - 1) * block_words)  # words that the last block lacks
    at = int(permuted(np.array([blocks - 1]), blocks, np.array([whole]), seed, back=True)[0])
    if rest > at * block_words:
        rest += short if rest > (at + 1) * block_words - short else 0
    n = -(-rest // block_words)
    return Source(size_, target, blocks, whole * blocks + n, rest - (n - 1) * block_words)


# --- pseudorandom permutations --------------------------------------------------------------------------------------


def _round(x: np.ndarray, key: np.ndarray, i: int, mask: np.uint64) -> np.ndarray:
    return textscan.mix(x + key + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask


def permuted(index: np.ndarray, n: int, turn: np.ndarray, seed: int, back: bool = False) -> np.ndarray:
    """The image of each index under a permutation of 0..n-1 that is keyed by seed and turn; or where it comes from."""
    half = np.uint64(max(1, (max(2, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    key = textscan.mix(turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed & (1 << 63) - 1))
    x = index.astype(np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        a, b, k = x[todo] >> half, x[todo] & mask, key[todo]
        for i in range(4):
            if back:
                a, b = b ^ _round(a, k, 3 - i, mask), a
            else:
                a, b = b, a ^ _round(b, k, i, mask)
        x[todo] = a << half | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


# --- draws ----------------------------------------------------------------------------------------------------------


def drawn(counts: np.ndarray, take: int, random: np.random.Generator) -> np.ndarray:
    """How many of the `take` slots go to each source: a multinomial draw, set right where a source has fewer left."""
    total = int(counts.sum())
    if take >= total:
        return counts.copy()
    out = np.minimum(random.multinomial(take, counts / total), counts)
    while (missing := take - int(out.sum())) > 0:
        room = counts - out
        out += np.minimum(random.multinomial(missing, room / room.sum()), room)
    return out


def shard_counts(counts: np.ndarray, slots: int, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of the first slot, number of slots) of each source in one shard of `slots` slots each."""
    first, left, lo, hi = np.zeros_like(counts), counts.copy(), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        half = drawn(left, min((mid - lo) * slots, int(left.sum())), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            left, hi = half, mid
        else:
            first, left, lo = first + half, left - half, mid
    return first, left


def seed_of(source: int, seed: int) -> int:
    return int(textscan.mix(np.array([source + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[0] >> np.uint64(1))


def slots(spark: SparkSession, plan: list[Source], block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """(shard, place, source_at, block, words): every slot of the mix and the block that fills it."""
    shared.small_batches(spark)
    counts = np.array([p.slots for p in plan], np.int64)
    shards = max(1, -(-int(counts.sum()) // SHARD_SLOTS))
    sent = spark.sparkContext.broadcast((plan, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, counts = sent.value
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, n = shard_counts(counts, SHARD_SLOTS, shards, shard, seed)
                source, block, words = [], [], []
                for i in np.flatnonzero(n).tolist():
                    p, k = plan[i], np.arange(first[i], first[i] + n[i])
                    turn = k // p.blocks
                    at = permuted(k % p.blocks, p.blocks, turn, seed_of(i, seed))
                    source.append(np.full(len(k), i))
                    block.append(at)
                    words.append(np.where(k == p.slots - 1, p.last, block_words))
                if source:
                    order = np.random.default_rng([seed, shard]).permutation(sum(map(len, source)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order))), *(pa.array(np.concatenate(x).astype(np.int64)[order]) for x in (source, block, words))], ["shard", "place", "source_at", "block", "words"])

    parts = max(1, min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, shards, 1, parts).mapInArrow(run, "shard long, place long, source_at long, block long, words long")


# --- documents ------------------------------------------------------------------------------------------------------


@dataclass
class Mix:
    """docs: (id, source_at, size, start), the place of each document in its source; slots; and the plan of each source."""

    docs: DataFrame
    slots: DataFrame
    plan: list[Source]
    sources: list


def mix(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = 0) -> Mix:
    rows = shared.cut(docs.select(docs[key].alias("id"), docs[source].alias("source"), size(docs[text]).alias("size")))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    wanted = targets([r["size"] for r in found], weights, cap)
    plan = [planned(r["size"], t, block_words, seed_of(i, seed)) for i, (r, t) in enumerate(zip(found, wanted, strict=True))]
    kind = rows.schema["source"].dataType.simpleString()
    table = spark.createDataFrame([(r["source"], i, -(-r["n"] // GROUP)) for i, r in enumerate(found)], f"name {kind}, source_at long, groups long")
    if len(found) <= MOST_SENT:
        table = F.broadcast(table)
    placed = rows.join(table, rows["source"].eqNullSafe(table["name"])).drop("name", "source")
    placed = placed.withColumn("h", F.xxhash64("id", "size")).withColumn("group", F.pmod("h", "groups")).drop("groups")
    of_group = placed.groupBy("source_at", "group").agg(F.sum("size").alias("words"))
    # Sums over groups, one row for each GROUP documents; within a group a running sum over its documents.
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source_at").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_group = of_group.select("source_at", "group", before.alias("before"))
    within = Window.partitionBy("source_at", "group").orderBy("h", "id", "size")
    start = F.col("before") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(of_group, ["source_at", "group"]).select("id", "source_at", "size", start.alias("start"))
    return Mix(placed, slots(spark, plan, block_words, seed), plan, [r["source"] for r in found])


def pieces(m: Mix, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, source_at, size, start, lo, hi, times): how often the mix takes words lo to hi of each document; size 0: one row of nulls."""
    first, last = F.col("start"), F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(first / block_words), F.floor((last - 1) / block_words)))
    parts = m.docs.select("*", F.explode_outer(blocks).alias("block"))
    taken = m.slots.groupBy("source_at", "block").agg(F.count_if(F.col("words") >= block_words).alias("full"), F.max(F.when(F.col("words") < block_words, F.col("words"))).alias("part"))
    # Slots look few to the planner, which sees only the shards; they grow with the words, so they are never broadcast.
    parts = parts.join(taken.hint("merge"), ["source_at", "block"], "left")
    at = F.col("block") * block_words
    lo, hi = F.greatest(first, at), F.least(last, at + block_words)
    middle = F.least(F.greatest(at + F.coalesce("part", F.lit(0)), lo), hi)
    cut = F.array(F.struct((lo - first).alias("lo"), (middle - first).alias("hi"), (F.coalesce("full", F.lit(0)) + F.when(F.col("part").isNotNull(), 1).otherwise(0)).alias("times")), F.struct((middle - first).alias("lo"), (hi - first).alias("hi"), F.coalesce("full", F.lit(0)).cast("long").alias("times")))
    return parts.select("id", "source_at", "size", "start", F.inline_outer(F.when(F.col("block").isNotNull(), F.filter(cut, lambda c: c["hi"] > c["lo"]))))


def taken(spark: SparkSession, m: Mix, key: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, size, source_size, target, taken) for every document."""
    sums = pieces(m, block_words).groupBy("id", "source_at", "start", "size").agg(F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("times")), F.lit(0)).cast("long").alias("taken"), F.count("*").alias("rows"))
    # Documents of size 0 that share an id and a place are told once each.
    empty = m.docs.filter("size = 0").select("id", "source_at", "size", F.lit(0).cast("long").alias("taken"))
    sums = sums.filter("size > 0").select("id", "source_at", "size", "taken").unionByName(empty)
    table = spark.createDataFrame([(i, p.size, float(p.target)) for i, p in enumerate(m.plan)], "source_at long, source_size long, target double")
    if len(m.plan) <= MOST_SENT:
        table = F.broadcast(table)
    return sums.join(table, "source_at").select(F.col("id").alias(key), "size", "source_size", "target", "taken")


_SPACE = np.array([32, 9, 10, 11, 12, 13])


def _sliced(text: str, cuts: list[tuple[int, int, int]]) -> Iterator[str]:
    """The texts of each turn: the words that the mix takes at least so often, with what stands between them."""
    if not cuts:
        return
    starts, ends = textscan.runs(~np.isin(textscan.codepoints(text), _SPACE), np.empty(0, np.int64))
    for turn in range(1, max(t for _, _, t in cuts) + 1):
        some = sorted((lo, hi) for lo, hi, t in cuts if t >= turn)
        joined: list[list[int]] = []
        for lo, hi in some:
            if joined and joined[-1][1] == lo:
                joined[-1][1] = hi
            else:
                joined.append([lo, hi])
        if joined == [[0, len(starts)]]:
            yield text
        else:
            yield "\n".join(text[starts[lo] : ends[hi - 1]] for lo, hi in joined)


def _named_rows(docs: DataFrame, key: str, text: str, row_name: str, n_name: str) -> DataFrame:
    """The rows that are mixed, each with a name: one row for each id, the least, and every row without an id.

    Names are the ids; a row without one is named by a hash of all its columns, and by a number where rows are equal.
    """
    whole = F.struct(*(docs[c] for c in docs.columns))
    least = F.min_by(whole, F.struct(docs[text].isNull(), docs[text], F.to_json(whole)))
    named = lambda rows, id_, hash_, copy: rows.withColumn(row_name, F.struct(id_.alias("id"), hash_.alias("hash"), copy.cast("long").alias("copy")))
    none = F.lit(None).cast("string")  # nulls leave a hash as it is, so rows with an id are ordered by it alone
    with_id, no_id = docs.filter(docs[key].isNotNull()), docs.filter(docs[key].isNull())
    repeated = shared.cut(with_id.groupBy(docs[key].alias(n_name)).agg(F.count("*").alias(row_name)).filter(F.col(row_name) > 1).select(n_name))
    if not repeated.isEmpty():
        of_id = docs[key] == repeated[n_name]
        with_id = with_id.join(repeated, of_id, "left_anti").unionByName(with_id.join(repeated, of_id, "left_semi").groupBy(docs[key]).agg(least.alias(row_name)).select(f"{row_name}.*"))
    out = named(with_id, F.col(key), none, none)
    if no_id.isEmpty():
        return out
    hashed = no_id.groupBy(F.sha2(F.to_json(whole), 256).alias(n_name)).agg(F.first(whole).alias(row_name), F.count("*").alias(f"{n_name}s"))
    hashed = hashed.select(n_name, f"{row_name}.*", F.explode(F.sequence(F.lit(1).cast("long"), f"{n_name}s")).alias(f"{n_name}s"))
    return out.unionByName(named(hashed, F.col(key), F.col(n_name), F.col(f"{n_name}s")).drop(n_name, f"{n_name}s"))


def mixed_documents(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents: a row for each turn in which words of a document are taken, with those words as its text.

    Of rows that repeat an id the one with the least text that is not null is mixed, and of those the least by its columns as
    JSON; every row with a null id is a document of its own. The length column, if there is one, is set to the new text's.
    Further columns stay, whatever their names.
    """
    shared.small_batches(spark)
    columns, schema = docs.columns, docs.schema
    row_name, cuts_name, id_name = shared.free_names(docs, "row", "cuts", "mixed_row")
    docs = _named_rows(docs, key, text, row_name, id_name)
    m = mix(spark, docs, row_name, text, source, **options)
    plan = pieces(m, options.get("block_words", BLOCK_WORDS)).filter("times > 0").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias(cuts_name))
    plan = plan.withColumnRenamed("id", id_name)
    joined = docs.join(plan, docs[row_name].eqNullSafe(plan[id_name])).select(*columns, cuts_name)
    at, n = columns.index(text), columns.index(length) if length in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for i, (t, cuts) in enumerate(zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                for part in _sliced(t, [(c["lo"], c["hi"], c["times"]) for c in cuts]):
                    rows.append(i)
                    texts.append(part)
            columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            if n is not None:
                columns[n] = pa.array([len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, schema)
