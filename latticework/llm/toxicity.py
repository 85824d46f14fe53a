"""A toxicity classifier by weak supervision.

Twelve voters look at each text: fixed lexicons, lexicons of words and word beginnings learned from a bounded sample of
labelled rows, and patterns of signs and letter case. Each fires or stays silent, so a text's votes are one of 4096
patterns, and the votes of all texts are their counts. A generative label model explains these counts by a hidden label:
expectation-maximisation finds how often each voter fires under either label, and voters that still depend on each other,
given the label, are tied in a tree, each to one parent, so that echoes do not count twice. Known labels only say where the
search starts, that is which hidden label is which; the model is fitted to the votes of all texts and to nothing else.

Its posteriors are the labels on which a linear classifier over hashed words and word beginnings is trained, on a bounded
sample of all texts, labelled or not. At last the known labels place the classifier's threshold: its offset is moved to
where a score of `threshold` parts them best.

Defined results: null and empty texts fire no voter, have no features and score what the classifier's intercept gives.
Without labelled rows the fixed lexicons and patterns vote alone, and the offset stays. Rows with the same text get the same
score; ids, languages, sources and further columns are never looked at.

Bounded samples: `most` labelled documents of each label teach the lexicons, and `most` documents of either posterior label
(above or below one half) the classifier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, shared, textscan

BUCKETS = 1 << 18
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Labelled documents of each label that lexicons are learned from, and documents of either posterior for the classifier.
MOST_ROWS = 2000
#: Words, and word beginnings, that the learned lexicons hold, at most.
LEXICON = 400
#: The score above which a text counts as toxic.
THRESHOLD = 0.3
VOTERS = 12
INSULT, SLUR_HEAVY, WORDS_A, WORDS_B, BEGIN_A, BEGIN_B, BEGIN_DENSE, WORDS_MANY, SHOUTING, MASKED, EXCLAIMING, CLEAN = range(VOTERS)
# English words of abuse.
ABUSE = ["clown", "coward", "creep", "cretin", "disgusting", "dumb", "dumbass", "fool", "garbage", "idiot", "idiots", "imbecile", "jerk", "liar", "loser", "losers", "moron", "morons", "pathetic", "pig", "retard", "scum", "shameful", "sucker", "stupid", "trash", "ugly", "useless", "vermin", "weirdo", "worthless"]
# Which bit of the lexicon table stands for which list.
_ABUSE, _WA, _WB, _BA, _BB = 1, 2, 4, 8, 16


def _buckets(h: np.ndarray, length: int) -> np.ndarray:
    return (textscan.mix(h + np.uint64(length)) >> np.uint64(46)).astype(np.int64)


def features(chunk: textscan.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each feature of a chunk, and whether it is a whole word, and the text of each word."""
    cp = textscan.folded()[chunk.cp]
    starts, ends = textscan.runs(textscan.classes()[chunk.cp] == textscan.LETTER, chunk.bounds[:-1])
    row = chunk.row_of(starts)
    buckets, rows = [_buckets(textscan.span_hashes(cp, starts, ends), 0)], [row]
    for n in BEGINNINGS:
        some = ends - starts >= n
        buckets.append(_buckets(textscan.span_hashes(cp, starts[some], starts[some] + n), n))
        rows.append(row[some])
    whole = np.zeros(sum(map(len, rows)), bool)
    whole[: len(row)] = True
    return np.concatenate(buckets), np.concatenate(rows), whole, row


def _abuse_buckets() -> np.ndarray:
    chunk = textscan.Chunk(list(range(len(ABUSE))), ABUSE)
    cp = textscan.folded()[chunk.cp]
    return _buckets(textscan.span_hashes(cp, chunk.bounds[:-1], chunk.bounds[1:]), 0)


@dataclass
class Lexicons:
    """Bits for each bucket: which lists its word, or word beginning, is on."""

    words: np.ndarray
    beginnings: np.ndarray


@dataclass
class Seen:
    """What a batch of texts shows: votes as bits, words, and the classifier's sum and norm."""

    votes: np.ndarray
    words: np.ndarray
    sums: np.ndarray


class Signs:
    """Counts of letter case and signs over the chunks of some texts, and the votes that they give."""

    def __init__(self, n: int):
        self.letters, self.upper, self.shouts, self.masked = (np.zeros(n) for _ in range(4))

    def add(self, chunk: textscan.Chunk) -> None:
        n = len(self.letters)
        letter = textscan.classes()[chunk.cp] == textscan.LETTER
        at = np.repeat(chunk.rows, np.diff(chunk.bounds))
        self.letters += np.bincount(at[letter], minlength=n)
        self.upper += np.bincount(at[letter & (textscan.folded()[chunk.cp] != chunk.cp)], minlength=n)
        bang = chunk.cp == ord("!")
        self.shouts += np.bincount(at[:-1][bang[1:] & bang[:-1]], minlength=n)
        sign = np.isin(chunk.cp, [ord(c) for c in "*@#$"])
        self.masked += np.bincount(at[1:-1][letter[:-2] & sign[1:-1] & letter[2:]], minlength=n)

    def votes(self) -> np.ndarray:
        fires = {SHOUTING: self.upper > 0.5 * np.maximum(self.letters, 1), MASKED: self.masked > 0, EXCLAIMING: self.shouts >= 3}
        return sum(f.astype(np.int64) << v for v, f in fires.items())


def sign_votes(texts: list[str | None]) -> np.ndarray:
    signs = Signs(len(texts))
    for chunk in textscan.chunks(texts):
        signs.add(chunk)
    return signs.votes()


def look(texts: list[str | None], lexicons: Lexicons, weights: np.ndarray | None = None) -> Seen:
    n = len(texts)
    hits = np.zeros((5, n))
    words, sums, signs = np.zeros(n), np.zeros(n), Signs(n)
    for chunk in textscan.chunks(texts):
        bucket, row, whole, word_row = features(chunk)
        words += np.bincount(word_row, minlength=n)
        if weights is not None:
            sums += np.bincount(row, weights[bucket], n)
        bits = np.where(whole, lexicons.words[bucket], lexicons.beginnings[bucket])
        some = np.flatnonzero(bits)
        for i in range(5):
            hits[i] += np.bincount(row[some[(bits[some] & (1 << i)) > 0]], minlength=n)
        signs.add(chunk)
    some = np.maximum(words, 1)
    learned = hits[1] + hits[2] + hits[3] + hits[4]
    fires = {
        INSULT: hits[0] > 0, SLUR_HEAVY: hits[0] >= 3, WORDS_A: hits[1] > 0, WORDS_B: hits[2] > 0, BEGIN_A: hits[3] / some > 0.004, BEGIN_B: hits[4] / some > 0.004,
        BEGIN_DENSE: (hits[3] + hits[4]) / some > 0.012, WORDS_MANY: hits[1] + hits[2] >= 3, CLEAN: (learned + hits[0] == 0) & (words >= 5),
    }
    return Seen(sum(f.astype(np.int64) << v for v, f in fires.items()) | signs.votes(), words, sums)


# --- the sample: lexicons -------------------------------------------------------------------------------------------


@dataclass
class Sample:
    """Counted features of the sampled texts, as one sparse matrix, with labels and weights."""

    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    whole: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    votes: np.ndarray
    #: The votes of sign patterns, which no lexicon changes.
    signs: np.ndarray


def _pack(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The distinct features of each text with their counts as bytes, four for either, and its number of words."""
    parts, words = [[np.empty(0, np.int64)] for _ in texts], np.zeros(len(texts), np.int64)
    for chunk in textscan.chunks(texts):
        bucket, row, whole, word_row = features(chunk)
        words += np.bincount(word_row, minlength=len(texts))
        key = row << 19 | whole.astype(np.int64) << 18 | bucket
        key.sort()
        cuts = np.searchsorted(key, np.arange(len(texts) + 1) << 19)
        for i in np.unique(chunk.rows).tolist():
            parts[i].append(key[cuts[i] : cuts[i + 1]] & ((1 << 19) - 1))
    out = []
    for p in parts:
        term, n = np.unique(np.concatenate(p), return_counts=True)
        out.append(term.astype(np.int32).tobytes() + n.astype(np.int32).tobytes())
    return out, words


_SAMPLED = "y double, weight double, words long, signs long, x binary"


def _sample_of(packed: DataFrame) -> Sample:
    """Rows of the columns in _SAMPLED as one sparse matrix on the driver, in an order that depends on them alone."""
    t = packed.orderBy("x", "y").toArrow()
    n = t.num_rows
    x = pa.concat_arrays([pa.array([], pa.binary()), *t.column("x").chunks]).cast(pa.large_binary())
    bounds = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.int32) if bounds[-1] > bounds[0] else np.empty(0, np.int32)
    starts, ends = (bounds[:-1] - bounds[0]) // 4, (bounds[1:] - bounds[0]) // 4
    sizes = (ends - starts) // 2
    term = data[textscan.ragged(starts, sizes)]
    column = lambda c, kind: t.column(c).to_numpy().astype(kind)
    return Sample(np.repeat(np.arange(n, dtype=np.int32), sizes), term & (BUCKETS - 1), data[textscan.ragged(starts + sizes, sizes)], (term >> 18) > 0, column("y", float), column("weight", float), column("words", float), np.zeros(n, np.int64), column("signs", np.int64))


def _packed_batch(texts: list[str | None], y, weight) -> pa.RecordBatch:
    packed, words = _pack(texts)
    return pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array(weight, pa.float64()), pa.array(words, pa.int64()), pa.array(sign_votes(texts), pa.int64()), pa.array(packed, pa.binary())], ["y", "weight", "words", "signs", "x"])


def _sampled(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None, most: int, key: str, text: str) -> Sample:
    """The labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed_batch(batch.column(0).to_pylist(), batch.column(1).cast(pa.float64()), batch.column(2))

    chosen = labelled.sample(docs, labels, label, usable, most, key, text)
    return _sample_of(chosen.select("text", "y", "weight").mapInArrow(run, _SAMPLED))


def _with_posteriors(docs: DataFrame, lexicons: Lexicons, generative: LabelModel, patterns: np.ndarray, counts: np.ndarray, most: int, key: str, text: str) -> Sample:
    """A sample of all texts, about `most` with a posterior of at least one half and as many below it; y is the posterior."""
    high = generative.posterior(patterns) >= 0.5
    share = [min(1.0, most / max(1, int(counts[high == h].sum()))) for h in (False, True)]
    sent = docs.sparkSession.sparkContext.broadcast((lexicons, generative, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons, generative, share = sent.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            p = generative.posterior(look(texts, lexicons).votes)
            own = np.where(p >= 0.5, share[1], share[0])
            some = np.flatnonzero(batch.column(1).to_numpy() < own * (1 << 40))
            yield _packed_batch([texts[i] for i in some.tolist()], p[some], 1 / own[some])

    at = F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(1 << 40))
    rows = docs.select(docs[text].alias("text"), at.alias("at")).filter(F.col("at") < int(max(share) * (1 << 40)))
    return _sample_of(rows.mapInArrow(run, _SAMPLED))


def learn_lexicons(sample: Sample) -> Lexicons:
    """Words and word beginnings that labelled texts of either kind use at very different rates, dealt into two lists each."""
    out = Lexicons(np.zeros(BUCKETS, np.uint8), np.zeros(BUCKETS, np.uint8))
    out.words[_abuse_buckets()] |= _ABUSE
    bad = (sample.y == 1)[sample.row]
    n1, n0 = max(1, int((sample.y == 1).sum())), max(1, int((sample.y == 0).sum()))
    for table, whole, lists in ((out.words, True, (_WA, _WB)), (out.beginnings, False, (_BA, _BB))):
        of = sample.whole == whole
        d1 = np.bincount(sample.bucket[of & bad], minlength=BUCKETS)
        d0 = np.bincount(sample.bucket[of & ~bad], minlength=BUCKETS)
        r1, r0 = (d1 + 0.1) / (n1 + 1), (d0 + 0.5) / (n0 + 1)
        ratio = np.where((d1 >= 4) & (r1 > 4 * r0), np.log(r1 / r0) * d1, 0)
        best = np.argsort(-ratio, kind="stable")[:LEXICON]
        best = best[ratio[best] > 0]
        for i, bit in enumerate(lists):
            table[best[i::2]] |= bit
    return out


def votes_of(sample: Sample, lexicons: Lexicons) -> np.ndarray:
    """The lexicon votes of the sampled texts, from their counted features, and those of their sign patterns."""
    n = len(sample.y)
    bits = np.where(sample.whole, lexicons.words[sample.bucket], lexicons.beginnings[sample.bucket])
    hits = [np.bincount(sample.row, sample.count * ((bits >> i) & 1), n) for i in range(5)]
    some = np.maximum(sample.words, 1)
    fires = {INSULT: hits[0] > 0, SLUR_HEAVY: hits[0] >= 3, WORDS_A: hits[1] > 0, WORDS_B: hits[2] > 0, BEGIN_A: hits[3] / some > 0.004, BEGIN_B: hits[4] / some > 0.004, BEGIN_DENSE: (hits[3] + hits[4]) / some > 0.012, WORDS_MANY: hits[1] + hits[2] >= 3, CLEAN: (sum(hits) == 0) & (sample.words >= 5)}
    return sum(f.astype(np.int64) << v for v, f in fires.items()) | sample.signs


def cross_votes(sample: Sample) -> np.ndarray:
    """The votes of each half of the sampled texts by the lexicons that the other half teaches: no text votes on itself."""
    out = np.zeros(len(sample.y), np.int64)
    for half in (0, 1):
        mine = np.arange(len(sample.y)) % 2 == half
        of = ~mine[sample.row]
        place = np.cumsum(~mine) - 1
        other = Sample(place[sample.row[of]], sample.bucket[of], sample.count[of], sample.whole[of], sample.y[~mine], sample.weight[~mine], sample.words[~mine], sample.votes[~mine], sample.signs[~mine])
        out[mine] = votes_of(sample, learn_lexicons(other))[mine]
    return out


# --- the label model ------------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    prior: float
    parent: np.ndarray
    #: fires[y, parent's vote, voter]: the chance that the voter fires.
    fires: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = (np.asarray(votes)[:, None] >> np.arange(VOTERS)) & 1
        given = np.where(self.parent >= 0, v[:, self.parent], 0)
        log = np.zeros((len(v), 2))
        for y in (0, 1):
            p = self.fires[y, given, np.arange(VOTERS)]
            log[:, y] = np.log(np.where(v == 1, p, 1 - p)).sum(axis=1) + np.log(self.prior if y else 1 - self.prior)
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def _maximised(v: np.ndarray, n: np.ndarray, p: np.ndarray, parent: np.ndarray) -> LabelModel:
    fires = np.full((2, 2, VOTERS), 0.5)
    for y, w in ((0, n * (1 - p)), (1, n * p)):
        for j in range(VOTERS):
            for g in (0, 1) if parent[j] >= 0 else (0,):
                of = w if parent[j] < 0 else w * (v[:, parent[j]] == g)
                fires[y, g, j] = (of @ v[:, j] + 0.5) / (of.sum() + 1)
    return LabelModel(float(np.clip(n @ p / max(n.sum(), 1e-9), 1e-4, 1 - 1e-4)), parent, np.clip(fires, 1e-4, 1 - 1e-4))


def _tree(v: np.ndarray, n: np.ndarray, p: np.ndarray, least: float = 0.002) -> np.ndarray:
    """The parent of each voter: a maximal spanning forest of the dependence left given the label."""
    gain = np.zeros((VOTERS, VOTERS))
    for w in (n * (1 - p), n * p):
        total = w.sum() + 1e-9
        for a in range(VOTERS):
            for b in range(a):
                for x in (0, 1):
                    for y in (0, 1):
                        joint = (w @ ((v[:, a] == x) & (v[:, b] == y)) + 1e-9) / total
                        alone = ((w @ (v[:, a] == x) + 1e-9) / total) * ((w @ (v[:, b] == y) + 1e-9) / total)
                        gain[a, b] += total / n.sum() * joint * np.log(joint / alone)
    parent, group = np.full(VOTERS, -1), np.arange(VOTERS)
    links: list[list[int]] = [[] for _ in range(VOTERS)]
    for a, b in sorted(zip(*np.nonzero(gain > least), strict=True), key=lambda e: -gain[e]):
        if group[a] != group[b]:
            group[group == group[a]] = group[b]
            links[a].append(int(b))
            links[b].append(int(a))
    seen: set[int] = set()
    for root in range(VOTERS):
        stack = [root] if root not in seen else []
        while stack:
            a = stack.pop()
            seen.add(a)
            for b in links[a]:
                if b not in seen:
                    parent[b] = a
                    stack.append(b)
    return parent


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, start: LabelModel | None = None, rounds: int = 25) -> LabelModel:
    """From the counts of all vote patterns; `start` says what the hidden label means, or else the fixed lexicons do."""
    v = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
    n = counts.astype(float)
    telling = 1 << INSULT | 1 << WORDS_A | 1 << WORDS_B | 1 << BEGIN_DENSE
    expected = np.where((patterns & telling) > 0, 0.8, 0.05) if start is None else start.posterior(patterns)
    parent = np.full(VOTERS, -1)
    model = _maximised(v, n, expected, parent)
    for step in range(rounds if len(n) else 0):
        if step in (2, rounds // 2):  # early, before echoes have drawn the hidden label to themselves; then once more
            parent = _tree(v, n, expected)
        model = _maximised(v, n, expected, parent)
        expected = model.posterior(patterns)
    return model


def known_start(votes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> LabelModel | None:
    """Where the search starts: how voters fire on rows of known labels; None unless both labels are there."""
    if not ((y == 1).any() and (y == 0).any()):
        return None
    v = ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
    return _maximised(v, weight, y.astype(float), np.full(VOTERS, -1))


# --- the classifier -------------------------------------------------------------------------------------------------


@dataclass
class Model:
    lexicons: Lexicons
    labels: LabelModel
    weights: np.ndarray
    vote_weights: np.ndarray
    offset: float

    def probability(self, seen: Seen) -> np.ndarray:
        votes = (seen.votes[:, None] >> np.arange(VOTERS)) & 1
        z = seen.sums / np.sqrt(np.maximum(seen.words, 1)) + votes @ self.vote_weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Features of the sample that are worked on at once.
_STEP = 1 << 20


def _sums(sample: Sample, w: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Each text's weighted sum of features over the root of its number of words."""
    z = np.zeros(len(sample.y))
    for a in range(0, len(sample.row), _STEP):
        part = slice(a, a + _STEP)
        row = sample.row[part]
        z[row[0] : row[-1] + 1] += np.bincount(row - row[0], sample.count[part] * w[sample.bucket[part]])
    return z / root


def fit_linear(sample: Sample, target: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on counts over the root of the words and on votes, by adaptive full-batch steps, to soft labels."""
    w, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    vw, vsquares = np.zeros(VOTERS), np.full(VOTERS, 1e-6)
    if not len(target):
        return w.astype(np.float32), vw, -2.0
    root = np.sqrt(np.maximum(sample.words, 1))
    votes = ((sample.votes[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    g = sample.weight / sample.weight.sum()
    offset = float(np.log((g @ target + 1e-4) / (1 - g @ target + 1e-4)))
    for _ in range(rounds):
        z = _sums(sample, w, root) + votes @ vw + offset
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * g
        slope, by_text = 1e-7 * w, error / root
        for a in range(0, len(sample.row), _STEP):
            part = slice(a, a + _STEP)
            slope += np.bincount(sample.bucket[part], sample.count[part] * by_text[sample.row[part]], BUCKETS)
        squares += slope**2
        w -= 0.1 * slope / np.sqrt(squares)
        vote_slope = votes.T @ error + 1e-5 * vw
        vsquares += vote_slope**2
        vw -= 0.4 * vote_slope / np.sqrt(vsquares)
        offset -= 2.0 * error.sum()
    return w.astype(np.float32), vw, offset


def placed_offset(z: np.ndarray, y: np.ndarray, weight: np.ndarray, offset: float, threshold: float = THRESHOLD) -> float:
    """The offset at which scores of `threshold` part rows of known labels with the largest F1; the middle of the best gap."""
    if not ((y == 1).any() and (y == 0).any()):
        return offset
    order = np.argsort(-z, kind="stable")
    z, hit, w = z[order], (y == 1)[order], weight[order]
    caught, told = np.cumsum(w * hit), np.cumsum(w)
    f1 = np.where(np.append(z[1:] < z[:-1], True), 2 * caught / (told + caught[-1]), 0)
    best = int(np.argmax(f1))
    cut = (z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1
    return offset + float(np.log(threshold / (1 - threshold)) - cut)


def count_votes(docs: DataFrame, lexicons: Lexicons, text: str = "text") -> DataFrame:
    """(votes, n) over all rows: at most 2 ** VOTERS rows."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << VOTERS, np.int64)
        for batch in batches:
            n += np.bincount(look(batch.column(0).to_pylist(), sent.value).votes, minlength=1 << VOTERS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["votes", "n"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_ROWS) -> Model:
    """Lexicons from labelled rows, the label model from the votes of all texts, the classifier from its posteriors."""
    shared.small_batches(spark)
    known = _sampled(docs, labels, label, usable, most, key, text)
    lexicons = learn_lexicons(known)
    known.votes = cross_votes(known)
    counted = count_votes(docs, lexicons, text).orderBy("votes").toPandas()
    patterns, counts = counted.votes.to_numpy(np.int64), counted.n.to_numpy(np.int64)
    generative = fit_label_model(patterns, counts, known_start(known.votes, known.y, known.weight))
    sample = _with_posteriors(docs, lexicons, generative, patterns, counts, most, key, text)
    sample.votes = votes_of(sample, lexicons)
    weights, vote_weights, offset = fit_linear(sample, sample.y)
    if len(known.y):
        votes = ((known.votes[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        z = _sums(known, weights, np.sqrt(np.maximum(known.words, 1))) + votes @ vote_weights + offset
        offset = placed_offset(z, known.y, known.weight, offset)
    return Model(lexicons, generative, weights, vote_weights, offset)


def score(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, posterior): what the classifier and the label model make of every row."""
    sent = spark.sparkContext.broadcast(model)
    shared.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            seen = look(batch.column(1).to_pylist(), model.lexicons, model.weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(seen), pa.float64()), pa.array(model.labels.posterior(seen.votes), pa.float64())], ["key", "score", "posterior"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, score double, posterior double").withColumnRenamed("key", key)
