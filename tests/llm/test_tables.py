"""Near duplicates, neighbours, archives, mixing and the pipeline against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import annsearch, components, embdup, mixing, neardup, queries, shared, textscan, warc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_equals_edit_distance():
    r, pairs, want = random.Random(5), [], []
    for _ in range(400):
        a = [r.randrange(r.choice([3, 50])) for _ in range(r.randint(0, 40))]
        b = list(a)
        for _ in range(r.randint(0, 12)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.randrange(50)] * r.randint(0, 1)
        x, y = (textscan.mix(np.array(z, np.uint64) + np.uint64(9)) for z in (a, b))
        pairs.append((x, y))
        want.append(distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    assert [neardup.aligned(x, y) for x, y in pairs] == want
    assert neardup.aligned_pairs(*([(z >> np.uint64(32)).astype(np.uint32) for z in side] for side in zip(*pairs, strict=True))).tolist() == want
    assert 40 < sum(want) < 360


def text_of(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(6)
    texts = []
    for _ in range(40):
        words = text_of(r, r.choice([30, 80, 300]))
        texts.append(" ".join(words))
        for _ in range(r.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(len(copy) // 25):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    texts += [texts[0], None, "", "!!!", "one two", "One, two!", "x " * 100_000]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(0, texts[0], "c"), (None, "lost", "c")], "doc_id long, text string, kept string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark, docs).collect()}
    words = [re.findall(r"[a-z0-9]+", (t or "").lower()) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and (a == b or (len(a) < 1000 and len(set(a) & set(b)) > 0.5 * len(set(a)) and distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))):
                up = [up[j] if u == up[i] else u for u in up] if up[i] != up[j] else up
    least = {u: min(k for k, v in enumerate(up) if v == u) for u in set(up)}
    assert got == {i: least[u] for i, u in enumerate(up)}
    assert neardup.near_duplicates(spark, docs.limit(0)).collect() == []
    kept = neardup.deduplicated(spark, docs)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect() if x["doc_id"] is not None) == sorted(set(got.values()))


def test_near_duplicates_are_candidates_down_to_the_threshold():
    r = random.Random(13)
    for n in [*range(5, 36), 60, 200]:
        for share in (0.2, 0.15, 0.1):
            met = 0
            for _ in range(30):
                words = text_of(r, n)
                copy = list(words)
                for at in r.sample(range(n), int(n * share + 1e-9)):
                    copy[at] = f"new{r.randrange(10**9)}"
                a, b = neardup.word_hashes([" ".join(words), " ".join(copy)])
                assert neardup.aligned(a, b)
                met += len(np.intersect1d(neardup.meetings(a), neardup.meetings(b))) > 0
            assert met == 30 if n <= 30 else met >= 29


def test_near_duplicates_of_few_words_are_found(spark):
    words = "a b c d e f g h i".split()
    assert parts_of(spark, [" ".join(words), " ".join([*words[:4], "x", *words[5:]]), "k l m n o", "k l x n o"]) == [0, 0, 2, 2]


def in_one_bucket(monkeypatch):
    """All texts with words share their only sketch, so every pair is a candidate."""
    signed = neardup._signed

    def run(batches):
        for b in signed(batches):
            one = [None if x is None else [1] for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(one, pa.list_(pa.int64())), *b.columns[3:]], b.schema.names)

    monkeypatch.setattr(neardup, "_signed", run)


def parts_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [x["component_id"] for x in neardup.near_duplicates(spark, docs).orderBy("doc_id").collect()]


def test_near_duplicates_go_on_after_a_round_without_links(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    r = random.Random(11)
    some = [text_of(r, 40) for _ in range(12)]
    texts = [" ".join(w) for w in [*some, *([*w[:-1], "else"] for w in some[6:])]]
    assert parts_of(spark, texts) == [*range(12), *range(6, 12)]


def test_near_duplicates_link_through_members_that_joined_a_leader(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    chain = [text_of(random.Random(12), 40)]
    for k in range(8):  # each is like the one before it alone
        chain.append([*chain[-1]])
        chain[-1][5 * k : 5 * k + 5] = [f"new{k}x{i}" for i in range(5)]
    assert parts_of(spark, [" ".join(w) for w in chain]) == [0] * 9


def test_near_duplicates_in_many_small_tiles(spark, monkeypatch):
    in_one_bucket(monkeypatch)
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "TILE_BYTES", 400)
    r = random.Random(14)
    bases = [text_of(r, 40) for _ in range(12)]
    texts = [[*w[:k], f"new{k}", *w[k + 1 :]] for w in bases for k in range(r.choice([1, 2, 9]))]
    texts = [texts[0], *(" ".join(t) for t in r.sample(texts, len(texts)))]
    texts[0] = " ".join(text_of(r, 40))
    words = [t.split() for t in texts]
    want = [min(j for j, b in enumerate(words) if distance(a, b) <= 8) for a in words]
    assert parts_of(spark, texts) == want


def test_two_copies_among_unlike_texts_with_a_shared_passage(spark):
    """Ten unlike texts share a passage with two copies of each other; the copies have the highest ids."""
    r = random.Random(15)
    shared_words = text_of(r, 120)
    texts = [" ".join([*shared_words, *text_of(r, 160)]) for _ in range(10)]
    copy = [*shared_words, *text_of(r, 10)]
    texts += [" ".join(copy), " ".join([*copy[:50], "other", *copy[51:]])]
    assert parts_of(spark, texts) == [*range(10), 10, 10]


def test_repeated_ids_with_different_texts_are_one_row(spark):
    rows = [(1, "b a text that stands alone here", "x"), (1, "zz yy xx ww vv uu", "y"), (2, "zz yy xx ww vv uu", "z"), (3, None, "n"), (3, "some words of a third", "s"), (3, "some words of a third", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark, docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    kept = sorted(map(tuple, neardup.deduplicated(spark, docs).collect()))
    assert kept == [(1, "b a text that stands alone here", "x"), (2, "zz yy xx ww vv uu", "z"), (3, "some words of a third", "a")]


def test_counts_never_rule_out_what_is_alike():
    r = random.Random(16)
    some = [textscan.mix(np.array([r.randrange(30) for _ in range(r.randint(1, 60))], np.uint64)) for _ in range(80)]
    short = [(w >> np.uint64(32)).astype(np.uint32) for w in some]
    a = np.frombuffer(b"".join(map(neardup.counted, short)), neardup._COUNTS)
    every = neardup.possible_of_all(a, a)
    for i in range(len(a)):
        row = neardup.possible(np.repeat(a[i : i + 1], len(a)), a)
        assert (row == every[i]).all()
        assert all(every[i, j] for j in range(len(a)) if neardup.aligned(short[i], short[j]))
    big = np.concatenate([a] * 2)
    assert (neardup.possible_of_all(big, big)[: len(a), : len(a)] == every).all()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(10, 40)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 7 for k in [7, *range(10, 40)]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark, extra=True):
    r = np.random.default_rng(7)
    x = r.normal(size=(260, 16))
    x[200:230] = x[:30] + 0.02 * r.normal(size=(30, 16))
    x[230:260] = x[5]
    rows = [(i, v.tolist(), int(i % 3) if i < 200 else int(i - 200) % 3 if i < 230 else 2, "c") for i, v in enumerate(x.astype(np.float32))]
    odd = [(900, None, 1, "c"), (901, [0.0] * 16, 1, "c"), (902, [float("nan")] * 16, 1, "c"), (903, [None] * 16, 1, "c"), (904, [], 1, "c"), (905, x[5].tolist(), None, "c"), (906, [1.0, 2.0], 1, "c"), (5, rows[5][1], 2, "c")]
    return spark.createDataFrame(rows + odd * extra, "vec_id long, embedding array<float>, label int, score string")


def usable_rows(df):
    out = {}
    for r in df.collect():
        v = r["embedding"]
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            out[r["vec_id"]] = (np.array(v, np.float64), r["label"])
    return out


def test_embedding_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdup, "TILE", 32)
    df = vectors(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdup.near_duplicates(spark, df).collect()}
    good = {i: v for i, v in usable_rows(df).items() if v[1] is not None}
    link = lambda a, b: a != b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98
    near = {a: {b for b in good if link(a, b)} for a in good}
    part = {i: i for i in got}
    for _ in range(10):
        part |= {a: min([part[a], *(part[b] for b in near[a])]) for a in near}
    assert set(got) == {r["vec_id"] for r in df.collect()}
    assert got == {i: (len(near.get(i, ())), part[i], part[i] == i) for i in got}
    assert embdup.near_duplicates(spark, df.limit(0)).collect() == []


def test_quantised_bounds_hold():
    r = np.random.default_rng(8)
    x = r.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = embdup.quantised(x)
    y = s[:, None] * q
    exact, guess = x @ x.T, y @ y.T
    assert (np.abs(exact - guess) <= e[None, :] + e[:, None] * (1 + e)[None, :]).all()


def test_neighbours_reach_brute_force(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "BLOCK", 100)
    df = vectors(spark)
    got = {}
    for r in annsearch.search(spark, df, F.col("vec_id") % 20 == 0, top=5, rerank=60).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    good = usable_rows(df)
    hits = n = 0
    for q in [i for i in good if i % 20 == 0]:
        want = sorted((-(good[q][0] @ v), i) for i, (v, _) in good.items() if i != q and len(v) == len(good[q][0]))[:5]
        assert all(s == pytest.approx(good[q][0] @ good[i][0], abs=1e-12) for i, s in got.get(q, []))
        hits += len({i for _, i in want} & {i for i, _ in got.get(q, [])})
        n += len(want)
    assert hits >= 0.9 * n
    assert annsearch.search(spark, df.limit(0), F.lit(True)).collect() == []


def test_neighbours_by_two_in_a_hundred(spark, monkeypatch):
    """20 nearest of 6000 vectors, of which 120 are scored exactly; and of a table of one block as of many."""
    r = np.random.default_rng(12)
    x = (r.normal(size=(6000, 24)) * np.linspace(0.5, 1.5, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {q: np.argsort(-np.where(np.arange(6000) == q, -np.inf, x.astype(np.float64) @ x[q].astype(np.float64)), kind="stable")[:20] for q in range(0, 6000, 200)}
    for block in (500, 8192):
        monkeypatch.setattr(annsearch, "BLOCK", block)
        got = {}
        for row in annsearch.search(spark, df, F.col("vec_id") % 200 == 0, rerank=120).collect():
            got.setdefault(row["query_id"], set()).add(row["vec_id"])
        assert all(len(got[q]) == 20 for q in want)
        assert sum(len(got[q] & set(w.tolist())) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_neighbours_that_codes_cannot_tell_apart(spark, monkeypatch):
    """Tight clusters, many dimensions, lengths of many magnitudes and one direction shared by all: no true neighbour is missed."""
    r = np.random.default_rng(21)
    tight = r.normal(size=(3, 32))[r.integers(0, 3, 3000)] + r.normal(size=(3000, 32)) * 1e-3
    wide = r.normal(size=(3000, 200))
    long = r.normal(size=(3000, 16)) * 10.0 ** r.integers(-30, 30, (3000, 1))
    shared_direction = r.normal(size=(3000, 24)) + 1000
    monkeypatch.setattr(annsearch, "BLOCK", 1000)
    x = [*tight, *wide, *long, *shared_direction]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in annsearch.search(spark, df, F.col("vec_id") % 300 == 0, rerank=60, sample=2000).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    for kind in range(4):
        v = np.array(x[kind * 3000 : kind * 3000 + 3000])
        for q in range(0, 3000, 300):
            score = np.where(np.arange(3000) == q, -np.inf, np.einsum("ij,j->i", v, v[q]))
            want = np.argsort(-score, kind="stable")[:20] + kind * 3000
            assert [got[kind * 3000 + q][k + 1] for k in range(20)] == want.tolist()


def test_bounds_of_guesses_hold():
    r = np.random.default_rng(22)
    x, _ = annsearch.directions(np.concatenate([r.normal(size=(400, 24)), r.normal(size=(1, 24)) + r.normal(size=(200, 24)) * 1e-4]) * 1e200)
    books = annsearch.fit(x[::2], words=32)
    guess, bound = annsearch.bounded_guesses(x, *annsearch.coded(x, books), books)
    assert (x @ x.T <= bound).all()
    assert np.corrcoef(guess.ravel(), (x @ x.T).ravel())[0, 1] > 0.9


def test_neighbours_with_few_candidates_and_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (40, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in annsearch.search(spark, df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 40)]


def test_archives_round_trip(spark):
    big = "<p>hello world</p>" * 100
    rows = [(i, f"http://a/{i}", f"<html>{i} some shared boilerplate text {i * 7}</html>" * 3, "c") for i in range(60)]
    rows += [(100, None, big, "c"), (101, "http://b\r\nX: y", big, "c"), (102, "u", big + "x", "c"), (103, "u", None, "c"), (104, "u", "", "c"), (None, "u", big, "c"), (105, "u", "é" * 600_000, "c"), (100, None, big, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = shared.new_folder(spark, "warc-test")
    archives = warc.write(spark, pages, folder)
    got = warc.read(spark, archives).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"] or -1, (r["payload"] or b"").decode()) for r in got if r["type"] == "response") == sorted((p or -1, h or "") for p, _, h, _ in rows if not (h == big and p != 101))
    assert [(r["page_id"], r["refers_to"]) for r in got if r["type"] == "revisit" and r["page_id"]] == [(100, 101), (100, 101)]
    assert all(r["length"] == len(big) for r in got if r["type"] == "revisit")
    first = open(archives.collect()[0]["path"].removeprefix("file://"), "rb").read(4)
    assert int.from_bytes(first, "little") == warc.DICTIONARY_FRAME
    assert warc.read(spark, warc.write(spark, pages.limit(0))).collect() == []


def test_permutations_are_permutations():
    for n in (1, 2, 5, 64, 1000):
        x, turn = np.arange(n), np.full(n, 3)
        y = mixing.permuted(x, n, turn, 11)
        assert sorted(y.tolist()) == x.tolist() and (mixing.permuted(y, n, turn, 11, back=True) == x).all()


def test_targets_fill_up_to_the_cap():
    t = mixing.targets([100, 1000, 10, 0])
    assert t[0] == 300 and t[2] == 30 and t[3] == 0 and sum(t) == pytest.approx(1110)
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_shards_deal_out_all_slots():
    counts = np.array([1000, 50, 333])
    parts = [mixing.shard_counts(counts, 100, 14, s, 0) for s in range(14)]
    assert sum(n for _, n in parts).tolist() == counts.tolist()
    assert all(n.sum() == 100 for _, n in parts[:13])


def test_mix(spark):
    r = random.Random(9)
    docs = [(i, " ".join(text_of(r, r.choice([0, 3, 40, 400]))), r.choice(["a", "b", "c", None]), 1) for i in range(200)]
    docs += [(500, None, "a", 1), (501, "", None, 1), (502, "long " * 60_000, "b", 1), (3, docs[3][1], docs[3][2], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    got = mixing.taken(spark, mixing.mix(spark, df)).collect()
    assert sorted((x["doc_id"], x["size"]) for x in got) == sorted((d[0], len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))) for d in docs)
    by = {}
    for x in got:
        assert x["taken"] <= 3 * x["size"]
        by.setdefault((x["source_size"], x["target"]), []).append(x["taken"])
    assert all(abs(sum(v) - t) <= 0.5 for (_, t), v in by.items())
    again = mixing.taken(spark, mixing.mix(spark, df.repartition(3))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    made = mixing.mixed_documents(spark, df)
    words = {x["doc_id"]: x["n"] for x in made.groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    alone = {x["doc_id"]: x["taken"] for x in mixing.taken(spark, mixing.mix(spark, df.dropDuplicates(["doc_id"]))).collect() if x["taken"]}
    assert made.columns == df.columns and words == alone
    assert mixing.taken(spark, mixing.mix(spark, df.limit(0))).collect() == []


def test_mix_keeps_every_row_without_an_id(spark):
    rows = [(None, f"text{i} " * 300, "a") for i in range(5)] + [(None, "same words " * 150, "a")] * 2 + [(1, "one " * 300, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(spark, df).collect()
    assert sum(len(x["text"].split()) for x in got) == 8 * 300
    assert sorted(map(str, mixing.mixed_documents(spark, df.repartition(3)).collect())) == sorted(map(str, got))


CLASHING = ["id", "row", "_row", "cuts", "mixed_row", "mixed_rows", "kept", "key", "h", "n", "bucket", "part", "hash", "copy", "size", "start", "source_at", "ids", "n_tokens", "use", "score"]


def test_every_stage_carries_columns_named_like_its_own(spark):
    r = random.Random(17)
    rows = [(i, " ".join(r.choices(["the", "house", "and", "water", "of", "stone"], k=300)), "en", "ab"[i % 2], 9, *([i] * len(CLASHING)), {"a": i}) for i in range(8)]
    rows += [rows[0], (None, *rows[1][1:]), (None, *rows[1][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING) + ", m map<string,int>")
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.cut(stage(spark, docs, ""))
        assert set(CLASHING) <= set(docs.columns) or name == "tokens"
        got = docs.collect()
        assert got and all(x["part"] == x["id"] == x["row"] == x["m"]["a"] and (x["doc_id"] is None or x["doc_id"] == x["part"]) for x in got), name


def test_the_mix_of_slots_by_hand(spark):
    """`taken` is what the slots say, word by word, when documents are laid end to end in their order."""
    r = random.Random(18)
    docs = [(i, " ".join(text_of(r, r.choice([0, 1, 30, 700]))), r.choice(["a", "b", None])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    m = mixing.mix(spark, df)
    owner = {}
    for x in m.docs.collect():
        for k in range(x["size"]):
            owner[x["source_at"], x["start"] + k] = x["id"]
    n = {}
    for x in m.slots.collect():
        for k in range(x["words"]):
            word = (x["source_at"], x["block"] * mixing.BLOCK_WORDS + k)
            if word in owner:
                n[owner[word]] = n.get(owner[word], 0) + 1
    assert len(owner) == sum(len(t.split()) for _, t, _ in docs)
    assert {x["doc_id"]: x["taken"] for x in mixing.taken(spark, m).collect()} == {i: n.get(i, 0) for i, _, _ in docs}


def test_pipeline_stages(spark):
    r = random.Random(10)
    base = [" ".join(r.choices(["the", "of", "house", "and", "water", "stone", "green", "river"], k=60)) + " " + " ".join(text_of(r, 60)) for _ in range(12)]
    rows = [(i, t, "en", "ab"[i % 2], len(t), "more") for i, t in enumerate(base)]
    rows += [(50, base[0], "en", "a", 9, "more"), (51, base[1] + " tail", "en", "b", 9, "more"), (52, None, "en", "a", 0, "more"), (53, "12 34", None, None, 5, "more"), (54, base[2][:200] + " token = 'abcdef123456' the", "en", "a", 9, "more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        folder = shared.new_folder(spark, f"test-{name}")
        stage(spark, docs, "").write.parquet(folder)
        docs = spark.read.parquet(folder)
        seen.append(docs)
    ids = [sorted(x["doc_id"] for x in s.select("doc_id").collect()) for s in seen]
    assert 52 not in ids[0] and 53 not in ids[0] and 50 in ids[0]
    assert set(ids[0]) - set(ids[1]) == {50, 51}
    assert ids[1] == ids[2]
    text = seen[2].filter("doc_id = 54").collect()[0]
    assert "[REDACTED]" in text["text"] and "abcdef123456" not in text["text"] and text["n_chars"] == len(text["text"])
    assert set(ids[3]) <= set(ids[2])
    assert all(s.columns == list(seen[0].columns) for s in seen[:4])
    assert sorted(x["n_tokens"] for x in seen[4].collect()) == sorted(len(x["ids"]) for x in seen[4].collect())


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 14))
