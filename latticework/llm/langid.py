"""Language identification by words first, with a backoff to ever shorter character n-grams.

Words are runs of letters in lower case. A word that the model knows is scored by its log frequency in each language; a
word that it lacks by the mean log frequencies of its longest n-grams (with marks for its two ends) of which any is
known. A text's language is that of the largest sum; its score is the softmax of the sums over the square root of the
number of words, so that short and mixed texts get less certain scores.

Defined results: null texts, empty texts and texts without a letter get `und` and score 0. A text of which nothing at all
is known, or that ties, gets the first language in order. Without any labelled row every text is `und`. Repeated rows
give repeated results; further columns are ignored.

The model is fitted on a bounded sample (`most_docs` labelled documents of each language, chosen by a hash of the id), of
which it holds all words and all n-grams; every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textscan

UNKNOWN = "und"
GRAMS = 5
#: Words whose scores a worker keeps.
CACHE = 60_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    """How often each word occurs; long texts are taken piece by piece."""
    out: Counter = Counter()
    for part in textscan.split_long(text.lower(), 1 << 20) if text else ():
        out.update(_WORD.findall(part))
    return out


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Terms:
    """Terms with the log frequencies of each in each language; a worker looks them up by their hashes, some bytes a term."""

    def __init__(self, terms: pa.Array, logs: np.ndarray):
        self.terms, self.logs = terms, logs
        self._sorted: np.ndarray | None = None

    def rows(self, terms: list[str]) -> np.ndarray:
        """The row of each term, -1 for one that is not known."""
        if self._sorted is None:
            chunks = (self.terms[i : i + 65536].to_pylist() for i in range(0, len(self.terms), 65536))
            h = np.fromiter((hash(t) for c in chunks for t in c), np.int64, len(self.terms))
            order = np.argsort(h)
            self._sorted, self.logs, self.terms = h[order], self.logs[order], None
        h = np.fromiter(map(hash, terms), np.int64, len(terms))
        if not len(self._sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self._sorted, h), len(self._sorted) - 1)
        return np.where(self._sorted[at] == h, at, -1)

    def __getstate__(self):
        return self.terms, self.logs

    def __setstate__(self, state):
        self.__init__(*state)


@dataclass
class Model:
    langs: list[str]
    words: Terms
    grams: list[Terms]


def _counted(rows: Iterator[tuple[str, Counter]]) -> pa.RecordBatch:
    lang, term, n = [], [], []
    for name, counts in rows:
        lang += [name] * len(counts)
        term += counts.keys()
        n += counts.values()
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(words_of(text))
        yield _counted(iter(by.items()))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts = by.setdefault(lang, Counter())
            for size in range(1, GRAMS + 1):
                for g in grams_of(word, size):
                    counts[g] += n
        yield _counted(iter(by.items()))


def _counts(rows: DataFrame, langs: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Each term once, and its counts in all languages, as compact arrays on the driver."""
    of = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    t = rows.groupBy("term").agg(*of).toArrow()
    counts = np.zeros((t.num_rows, len(langs)), np.float32)
    for i in range(len(langs)):
        counts[:, i] = t.column(i + 1).to_numpy()
    return pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in t.column("term").chunks)]), counts


def _terms(terms: pa.Array, counts: np.ndarray) -> Terms:
    """Smoothed log frequencies."""
    totals = counts.sum(axis=0, dtype=np.float64) + 0.5 * max(1, len(terms))
    return Terms(terms, np.log((counts + np.float32(0.5)) / totals.astype(np.float32)))


def train(docs: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", most_docs: int = 2000) -> Model:
    """Fit on the rows with a language (and `usable`), about `most_docs` of each language."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[lang].alias("lang"), docs[text].alias("text"), (F.lit(True) if usable is None else usable).alias("use")).filter("use AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], _terms(pa.array([], pa.string()), np.zeros((0, 0), np.float32)), [])
    share = F.create_map([F.lit(x) for k in langs for x in (k, min(1.0, most_docs / sizes[k]))])
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40))
    schema = "lang string, term string, n long"
    words = shared.cut(sample.select("lang", "text").mapInArrow(_count_words, schema).groupBy("lang", "term").agg(F.sum("n").alias("n")))
    grams, counts = _counts(words.mapInArrow(_count_grams, schema), langs)
    size = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
    model = Model(langs, _terms(*_counts(words, langs)), [_terms(grams.filter(pa.array(size == k)), counts[size == k]) for k in range(GRAMS + 1)])
    shared.forget(words)
    return model


class Scorer:
    """Scores texts in one worker, with the vectors of words seen so far."""

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        self.vectors = np.zeros((1 << 14, len(model.langs)), np.float32)

    def backed_off(self, word: str) -> np.ndarray:
        """The mean of a word's longest n-grams of which any is known; zeros if none is."""
        for n in range(GRAMS, 0, -1):
            table = self.model.grams[n]
            rows = table.rows(grams_of(word, n))
            if (rows >= 0).any():
                return table.logs[rows[rows >= 0]].mean(axis=0)
        return np.zeros(len(self.model.langs), np.float32)

    def rows_of(self, words: list[str]) -> list[int]:
        if len(self.at) > CACHE:
            self.at.clear()
        at, get = self.at, self.at.get
        rows = [get(w, -1) for w in words]
        new = [i for i, r in enumerate(rows) if r < 0]
        if new:
            known = self.model.words.rows([words[i] for i in new])
            while len(at) + len(new) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            for i, k in zip(new, known.tolist(), strict=True):
                r = rows[i] = at.setdefault(words[i], len(at))
                self.vectors[r] = self.model.words.logs[k] if k >= 0 else self.backed_off(words[i])
        return rows

    def score(self, text: str | None) -> tuple[str, float]:
        counts = words_of(text)
        if not counts or not self.model.langs or not any(any(map(str.isalpha, w)) for w in counts):
            return UNKNOWN, 0.0
        n = np.fromiter(counts.values(), np.float64, len(counts))
        rows = self.rows_of(list(counts))
        sums = n @ self.vectors[rows].astype(np.float64)
        at = int(np.argmax(sums))
        return self.model.langs[at], float(1 / np.exp((sums - sums[at]) / np.sqrt(n.sum())).sum())


def predict(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """(key, keep..., lang_pred, score) for every row."""
    sent = spark.sparkContext.broadcast(model)
    shared.small_batches(spark)
    (text_name,) = shared.free_names(docs, "text_")
    kept = [docs[key].alias("key"), docs[text].alias(text_name), *(docs[c].alias(c) for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["key", *keep, "lang_pred", "score"])

    schema = ", ".join([f"key {docs.schema[key].dataType.simpleString()}", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    return docs.select(*kept).mapInArrow(run, schema).withColumnRenamed("key", key)


def identified(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose language is told with at least this score, unchanged; those that are `und` go."""
    sent = spark.sparkContext.broadcast(model)
    shared.small_batches(spark)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
