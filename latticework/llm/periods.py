"""Periodic runs of words: stretches that repeat with some period, found by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q and a length of at least max(min_length, 2 * q) that no
neighbouring word extends with that period. Words are split at spaces and the controls 9 to 13, and nowhere else.

Method. The ids of words are cut into bit planes, each one big integer with a bit for every word. For a lag q each plane is
XORed with itself shifted by q, and the results are ORed: the zeros are the words that equal the one q further on. A run of
period q is a stretch of at least max(min_length - q, q) zeros; ANDs with shifts that double leave the first words of those
alone. Lags are taken in ascending order, and a stretch that a smaller lag has found between the same bounds has a smaller
period, which divides this lag. Two runs of different periods p and q overlap in fewer than p + q words, so the search in a
part of a text ends when one run covers it all.

A run of period q repeats at least max(min_length - q, q) words in a row, so each of its words lies in a window of
ceil(min_length / 2) words that occurs at least twice in the text; only the stretches of such words are searched, and a run lies
within one of them. A text without such windows costs a sort of its windows' hashes. Within one part of m words the work is m * m / 128 machine words
for a plane at most; a lag without a stretch ends after the first planes, which hold mixed bits.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text. A null id is an id as any
other; rows that repeat an id are texts of their own. Further columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, textscan

MIN_LENGTH = 12
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_BASE = np.uint64(0xD6E8FEB86659FD93)


# --- words ----------------------------------------------------------------------------------------------------------


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, some at a time; no word is cut."""
    at = 0
    while at < len(data):
        m = _SPACE.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = m.start() if m else len(data)
        yield data[at:end].split()  # of bytes: at space and 9 to 13 alone
        at = end


def word_ids(data: bytes) -> np.ndarray:
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in some), np.int64, len(some)) for some in words(data)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


# --- runs -----------------------------------------------------------------------------------------------------------


def parts_with_repeats(ids: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Bounds of the maximal stretches of words that lie in windows, of so many words, which occur at least twice in the text."""
    n = len(ids) - window + 1
    if n < 2:
        return
    random = textscan.mix(ids.astype(np.uint64) + np.uint64(1))
    hashes = np.zeros(n, np.uint64)
    for k in range(window):
        hashes = hashes * _BASE + random[k : k + n]
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    change = np.zeros(len(ids) + 1, np.int32)
    again = (twice[at] == hashes).astype(np.int32)
    change[:n] += again
    change[window : window + n] -= again
    starts, ends = textscan.runs(np.cumsum(change[:-1]) > 0, np.empty(0, np.int64))
    yield from zip(starts.tolist(), ends.tolist(), strict=True)


def bit_planes(ids: np.ndarray) -> list[int]:
    """Numbers of the distinct ids, dealt at random so that each bit tells about half of all pairs apart, as one integer a bit."""
    _, ranks = np.unique(ids, return_inverse=True)
    kinds = int(ranks.max()) + 1
    dealt = np.random.default_rng(kinds).permutation(kinds)[ranks]
    planes = range(max(1, (kinds - 1).bit_length()))
    return [int.from_bytes(np.packbits((dealt >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in planes]


def long_stretches(ones: int, least: int) -> int:
    """The bits that begin `least` ones in a row, by ANDs with shifts that double."""
    have = 1
    while have < least and ones:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def equal_stretches(planes: list[int], n: int, lag: int, least: int) -> int:
    """The bits that begin at least `least` words in a row which equal those one lag further on."""
    whole = (1 << n - lag) - 1
    wrong, begun = 0, 0
    for k, plane in enumerate(planes, 1):
        wrong |= plane ^ plane >> lag
        if k & (k - 1) == 0 or k == len(planes):  # 1, 2, 4 ... planes, and all
            begun = long_stretches(whole & ~wrong, least)
            if not begun:
                return 0
    return begun


def _bits(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def runs_in(ids: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    n = len(ids)
    planes = bit_planes(ids)
    seen: set[tuple[int, int]] = set()
    out = []
    for lag in range(1, n // 2 + 1):
        least = max(min_length - lag, lag)
        begun = equal_stretches(planes, n, lag, least) if n - lag >= least else 0
        if not begun:
            continue
        firsts, lasts = _bits(begun & ~(begun << 1), n), _bits(begun & ~(begun >> 1), n)
        for start, end in zip(firsts.tolist(), (lasts + least + lag).tolist(), strict=True):
            if (start, end) not in seen:
                seen.add((start, end))
                out.append((start, end - start, lag))
        if (0, n) in seen:
            break
    return out


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = []
    for lo, hi in parts_with_repeats(ids, -(-min_length // 2)):
        if hi - lo >= min_length:
            found += [(lo + start, length, period) for start, length, period in runs_in(ids[lo:hi], min_length)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: one goes if any run holds it after that run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapsed(data: bytes, keep: np.ndarray) -> bytes:
    out, at = [], 0
    for some in words(data):
        kept = b" ".join(itertools.compress(some, keep[at : at + len(some)].tolist()))
        at += len(some)
        if kept:
            out.append(kept)
    return b" ".join(out)


# --- tables ---------------------------------------------------------------------------------------------------------


def find_runs(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(key, n_words, runs, collapsed): every row's runs by start, then period, and its text without their repeats, words joined by blanks."""
    if min_length < 2:
        raise ValueError("a run has at least two words")
    shared.small_batches(spark)
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, texts = [], [], []
            for value in batch.column(1):
                data = (value.as_py() or "").encode()
                ids = word_ids(data)
                found = runs_of(ids, min_length)
                n.append(len(ids))
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                texts.append(collapsed(data, kept_words(len(ids), found)).decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, arrow), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "collapsed"])

    given = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", kind), T.StructField("collapsed", T.StringType())])
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, given).withColumnRenamed("key", key)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a text: its runs counted, the longest one (ties: smallest start, then period), and hashes of all runs and of the collapsed text."""
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    milli = F.floor(1000 * length / F.col("best.period")).cast("long")
    return out.select(
        key, "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the texts, every tenth of them, by a hash of the id, with its end replaced by repeats of a few of its own words.

    Let h be the crc32 of the id in decimal and g = floor(h / 10). Where 10 divides h and the text has n > 0 words, word i, from
    a = g % n on, becomes the former word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). Null ids stay as they are.
    """
    h = F.crc32(docs[key].cast("string"))
    df = docs.select(docs[key].alias("key"), docs[text].alias("text"), h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    df = df.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    df = df.withColumn("n", F.when(F.size("words") > 0, F.size("words").cast("long")))
    df = df.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    df = df.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long"))
    whole = lambda c: F.expr(c).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", whole("a + 1"), whole("p")), whole("ceil((n - a) / p)")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), whole("a")), F.slice(again, F.lit(1), whole("n - a"))), " ")
    return df.select(F.col("key").alias(key), F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
