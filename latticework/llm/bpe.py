"""Byte-level BPE: encoding and decoding of whole texts against a given vocabulary.

Boundaries of pre-tokens are found without a regular expression: code points become classes, rules over neighbouring
classes mark where a token starts, and the contractions ('s 't 're 've 'm 'll 'd), which swallow letters, are followed
by an automaton of four states whose transition functions are composed by an associative scan. The slices are hashed,
made distinct within a chunk, and looked up in a cache; slices that it lacks are merged together, in lock step.

Null counts as the empty text; an empty text has no ids. Texts of any length are handled in pieces, cut only where a
token ends: before white space, or, where there is none for long, between a letter and a digit. Repeated rows give repeated results. Further columns are ignored unless they are asked for by `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import shared, textscan

#: Slices kept with their ids by each worker; beyond it new ones are merged again when they return.
CACHE = 300_000
#: Code points of one chunk, within which equal slices are looked up once.
CHUNK = 1 << 18
#: Slices of more bytes are merged one at a time, with a heap.
LONG = 192
NONE = np.int32(2**31 - 1)
#: Between a letter and a digit a token always ends: where a text without white space may be cut.
_SAFE_CUT = re.compile(r"(?<=[A-Za-z])(?=[0-9])")
# Letters that one or two further letters complete to a contraction, after an apostrophe.
ONE_LETTER = "stmd"
TWO_LETTERS = ["re", "ve", "ll"]


def read_ranks(path: str) -> bytes:
    """The vocabulary file as it is; small (a few MB), so it can be sent to all executors."""
    with open(path, "rb") as f:
        return f.read()


# --- boundaries -----------------------------------------------------------------------------------------------------
# A function of the four states is one byte: two bits for the image of each state. States: 0 nothing special,
# 1 and 2 so many letters of a contraction to come, 3 a contraction has just ended.


def _function(image: list[int]) -> int:
    return sum(to << (2 * state) for state, to in enumerate(image))


PLAIN, ONE, TWO = _function([0, 3, 1, 0]), _function([1, 3, 1, 1]), _function([2, 3, 1, 2])


def _compositions() -> np.ndarray:
    first, then = np.arange(256)[:, None], np.arange(256)[None, :]
    return sum((((then >> (2 * ((first >> (2 * s)) & 3))) & 3) << (2 * s)) for s in range(4)).astype(np.uint8).ravel()


COMPOSE = _compositions()


def scan(functions: np.ndarray) -> np.ndarray:
    """The composition of all functions up to each place, by pairwise combining (an up-sweep and a down-sweep)."""
    n = len(functions)
    if n <= 1:
        return functions.copy()
    pairs = COMPOSE[functions[0 : n - 1 : 2].astype(np.uint16) << 8 | functions[1::2]]
    done = scan(pairs)
    out = np.empty(n, np.uint8)
    out[0] = functions[0]
    out[1::2] = done
    rest = (n - 1) // 2
    out[2::2] = COMPOSE[done[:rest].astype(np.uint16) << 8 | functions[2::2]]
    return out


def token_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; `bounds` are the ends of the texts that lie end to end in cp, from 0 to len(cp)."""
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = textscan.classes()[cp]
    space = kind == textscan.SPACE
    blank = cp == 32
    start = np.empty(n, bool)
    start[0] = True
    # A run of one class starts a token, unless a single blank before it belongs to it.
    start[1:] = (kind[1:] != kind[:-1]) & ~blank[:-1]
    start[1:] |= space[1:] & ~space[:-1]
    # The last white space before something else stands alone or belongs to what follows.
    ends_text = np.zeros(n, bool)
    ends_text[bounds[1:] - 1] = True
    before_other = np.zeros(n, bool)
    before_other[:-1] = space[:-1] & ~space[1:]
    before_other &= ~ends_text
    start |= before_other
    start[bounds[:-1][bounds[:-1] < n]] = True
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        quote = quote[~ends_text[quote]]
        a = cp[quote + 1]
        there = ~ends_text[quote + 1]
        b = cp[np.minimum(quote + 2, n - 1)]
        functions = np.full(n, PLAIN, np.uint8)
        functions[quote[np.isin(a, [ord(c) for c in ONE_LETTER])]] = ONE
        two = np.zeros(len(quote), bool)
        for x, y in TWO_LETTERS:
            two |= (a == ord(x)) & (b == ord(y)) & there
        functions[quote[two]] = TWO
        state = np.zeros(n, np.uint8)
        state[1:] = scan(functions)[:-1] & 3
        start &= (state != 1) & (state != 2)
        start |= state == 3
    return np.flatnonzero(start)


# --- merging --------------------------------------------------------------------------------------------------------


class Vocabulary:
    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.ranks = ranks
        self.tokens = sorted(ranks, key=ranks.get)
        ids = sorted(ranks.values())
        self.size = ids[-1] + 1
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, made = np.array(pairs, np.int64).T
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.int64(2**62)), np.append(made[order].astype(np.int32), NONE)
        self.pair_of = dict(zip(keys.tolist(), made.tolist(), strict=True))
        lengths = np.zeros(self.size, np.int64)
        lengths[ids] = [len(t) for t in self.tokens]
        self.lengths = lengths
        self.at = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or NONE."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost first, with a heap over a linked list."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, size = self.pair_of.get, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := get(r * size + ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[after[i]]))
            if (k := before[i]) >= 0 and (s := get(ids[k] * size + r)) is not None:
                heapq.heappush(heap, (s, k, ids[k], r))
        return tuple(x for x in ids if x >= 0)

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """All pieces at once: each round merges, in every piece, its leftmost pair of lowest rank."""
        out: list = [None] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= LONG]
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self.merge_long(p)
        if not short:
            return out
        ids = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)]
        owner = np.repeat(np.array(short), [len(pieces[i]) for i in short])
        rank = np.full(len(ids), NONE, np.int32)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self.pair_ids(ids[:-1][same], ids[1:][same])
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            going = least < NONE
            sizes = np.diff(np.append(first, len(ids)))
            if not going.all():
                over = np.repeat(~going, sizes)
                flat = ids[over].tolist()
                at = 0
                for who, size in zip(owner[first[~going]].tolist(), sizes[~going].tolist(), strict=True):
                    out[who] = tuple(flat[at : at + size])
                    at += size
                ids, owner, rank = ids[~over], owner[~over], rank[~over]
                if not len(ids):
                    break
                least, sizes = least[going], sizes[going]
                first = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            ids[at] = least
            rank[at + 1] = NONE
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            rank[at] = NONE
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            right = at[at < len(ids) - 1]
            right = right[owner[right] == owner[right + 1]]
            near = np.concatenate([left, right])
            rank[near] = self.pair_ids(ids[near], ids[near + 1])
        return out

    def ids_of(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, from the cache or by merging."""
        get, ranks = self.cache.get, self.ranks
        out = [(r,) if (r := ranks.get(p)) is not None else get(p) for p in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            for i, x in zip(missing, self.merge_many([pieces[i] for i in missing]), strict=True):
                out[i] = x
                if len(self.cache) < CACHE and len(pieces[i]) <= LONG:
                    self.cache[pieces[i]] = x
        return out

    def encode_chunk(self, chunk: textscan.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a chunk, end to end, and how many each of its pieces has."""
        cp = chunk.cp
        starts = token_starts(cp, chunk.bounds)
        ends = np.append(starts[1:], len(cp))
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        data = chunk.text.encode("utf-8")
        _, at, which = np.unique(textscan.span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        found = self.ids_of([data[a:b] for a, b in zip(offset[starts[at]].tolist(), offset[ends[at]].tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        taken = sizes[which]
        ids = flat[textscan.ragged((np.cumsum(sizes) - sizes)[which], taken)]
        counts = np.add.reduceat(taken, np.searchsorted(starts, chunk.bounds[:-1]))
        if self.decode(ids) != data:  # two slices of one hash; not seen in practice, yet the ids must be right
            found = self.ids_of([data[a:b] for a, b in zip(offset[starts].tolist(), offset[ends].tolist(), strict=True)])
            taken = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(taken.sum()))
            counts = np.add.reduceat(taken, np.searchsorted(starts, chunk.bounds[:-1]))
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[textscan.ragged(self.at[ids], self.lengths[ids])].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id start in the decoded text, and at last where they end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) for each piece of a text, in order; texts without ids give nothing."""
        for chunk in textscan.chunks(texts, CHUNK, _SAFE_CUT):
            ids, counts = self.encode_chunk(chunk)
            ends = np.cumsum(counts)
            for row, a, b in zip(chunk.rows.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                yield row, ids[a:b]

    def encode(self, text: str | None) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *(ids for _, ids in self.encode_batch([text]))])


_known: dict[int, Vocabulary] = {}


def vocabulary(sent) -> Vocabulary:
    """The vocabulary that was broadcast, built once in each worker."""
    name = hash(sent.value)
    if name not in _known:
        _known.clear()
        _known[name] = Vocabulary(sent.value)
    return _known[name]


# --- on tables ------------------------------------------------------------------------------------------------------


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, offsets array<long>): the ids of each whole text and the byte offsets of their starts, with the end."""
    sent = spark.sparkContext.broadcast(read_ranks(path))
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for row, ids in vocab.encode_batch(batch.column(1).to_pylist()):
                parts[row].append(ids)
            whole = [np.concatenate(p) if p else np.empty(0, np.uint32) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in whole], pa.list_(pa.int32())), pa.array([vocab.offsets(x) for x in whole], pa.list_(pa.int64()))], ["key", "ids", "offsets"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, offsets array<long>").withColumnRenamed("key", key)


def decode_documents(spark: SparkSession, encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts that ids stand for; null ids count as none."""
    sent = spark.sparkContext.broadcast(read_ranks(path))
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent)
        for batch in batches:
            texts = [vocab.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(encoded[key].alias("key"), encoded[ids].alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def digest_documents(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False, keep: list[str] = ()) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), ids if asked for, and the columns in `keep`: encodes, decodes the ids, and digests both.

    A kept column with the name of one of these follows under its own name, with as many marks before it as it takes.
    """
    sent = spark.sparkContext.broadcast(read_ranks(path))
    shared.small_batches(spark)
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kept: list[str] = []
    for c in keep:
        while c.lower() in (x.lower() for x in names + kept):
            c = f"_{c}"
        kept.append(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent)
        for batch in batches:
            n = [0] * batch.num_rows
            sums = [(hashlib.sha256(), hashlib.sha256()) for _ in n]
            parts: list[list[np.ndarray]] = [[] for _ in n]
            for row, ids in vocab.encode_batch(batch.column(1).to_pylist()):
                n[row] += len(ids)
                sums[row][0].update(ids.astype("<u4").tobytes())
                sums[row][1].update(vocab.decode(ids))
                if with_ids:
                    parts[row].append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([a.hexdigest() for a, _ in sums], pa.string()), pa.array([b.hexdigest() for _, b in sums], pa.string())]
            if with_ids:
                columns.append(pa.array([np.concatenate(p) if p else np.empty(0, np.int32) for p in parts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], [*names, *kept])

    given = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        given.add("ids", T.ArrayType(T.IntegerType()))
    for c, name in zip(keep, kept, strict=True):
        given.add(name, docs.schema[c].dataType)
    return docs.select(docs[key], docs[text], *(docs[c].alias(name) for c, name in zip(keep, kept, strict=True))).mapInArrow(run, given)
