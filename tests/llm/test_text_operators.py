"""BPE, secrets and language ID against the library, plain versions and hand-made cases."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.llm import bpe, langid, secrets, textscan

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
VOCAB = bpe.Vocabulary(bpe.read_ranks(PATH))
TEXTS = [None, "", " ", "it's they'll 'tis ''s", "a" * 5000, "x " * 300_000, "ünï 漢字 \n\n  tab\t🙂 12³", "it's they'll 'tis ''s"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZé1²'stremvdl \n\t .!\u0085 漢🙂́")), max_size=40))
def test_bpe_equals_the_library(text):
    assert VOCAB.encode(text).tolist() == LIBRARY.encode_ordinary(text)
    assert VOCAB.decode(VOCAB.encode(text)) == text.encode()


def test_classes_equal_the_library_s_for_all_common_planes():
    # A letter, digit or sign next to its like is one pre-token: tokens tell the classes apart.
    for c in random.Random(1).sample([c for c in range(0x20000) if not 0xD800 <= c < 0xE000], 4000):
        s = f"x{chr(c)} 1{chr(c)} .{chr(c)}"
        assert VOCAB.encode(s).tolist() == LIBRARY.encode_ordinary(s), hex(c)


def test_bpe_scan_composes_in_any_grouping():
    r = np.random.default_rng(2)
    f = r.choice([bpe.PLAIN, bpe.ONE, bpe.TWO], 1000).astype(np.uint8)
    state, out = 0, []
    for x in f.tolist():
        state = x >> (2 * state) & 3
        out.append(state)
    assert (bpe.scan(f) & 3).tolist() == out


def test_bpe_on_tables(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    for r in bpe.digest_documents(spark, docs, PATH).collect():
        ids = LIBRARY.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    encoded = bpe.encode_documents(spark, docs.drop("ids"), PATH)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(spark, encoded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.digest_documents(spark, docs.limit(0), PATH).collect() == []


def plain_base(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("tokenTOKEN=:\"' abcdef0123AKIAZ%41\\u0é\n")), max_size=80))
def test_base_secrets_equal_a_plain_scan(t):
    spans = secrets.scan(t)
    assert [(a, secrets.KINDS.index(k), b) for k, a, b, via in spans if not via] == plain_base(t)


SECRET = "token = '04dbebab91ab85687d33eeaa'"


@pytest.mark.parametrize("encode, via", [
    (quote, "url"), (lambda s: quote(quote(s)), "url>url"), (lambda s: "".join(f"\\u{ord(c):04x}" for c in s), "unicode"), (lambda s: base64.b64encode(s.encode()).decode(), "base64"),
    (lambda s: base64.urlsafe_b64encode(gzip.compress(s.encode())).decode(), "base64>gzip"), (lambda s: quote(base64.b64encode(base64.b64encode(zlib.compress(s.encode()))).decode(), safe=""), None), (lambda s: base64.b64encode(s.encode("utf-16-le")).decode(), "base64"),
    (lambda s: base64.encodebytes((s + " " * 80).encode()).decode().strip(), "base64"),
])
def test_secrets_under_encodings_map_to_the_text(encode, via):
    inside = encode(SECRET)
    text = f"é {inside} end"
    found = [(k, a, b, v) for k, a, b, v in secrets.scan(text) if v and k == "assign"]
    assert found, text
    k, a, b, v = found[0]
    assert 2 <= a < b <= 2 + len(inside) and (via is None or v == via)
    assert SECRET[:12] not in secrets.redact(text, secrets.scan(text))


def test_secrets_end_on_cycles(monkeypatch):
    assert secrets.scan("%2525252541" * 100) == []
    seen = []

    def to_itself(chunks, kind):  # as a compressed file that unpacks to itself would
        data = b"".join(chunks)
        seen.append(kind)
        assert len(seen) < 100
        yield data if kind == "gzip" else data[::-1]

    monkeypatch.setattr(secrets, "unpacked", to_itself)
    assert secrets.scan(base64.b64encode(gzip.compress(b"x" * 30)).decode()) == []
    assert seen


def test_secrets_in_data_of_any_size(monkeypatch):
    """What is unpacked is read in windows; a secret at a window's end is found too, and in the last one."""
    monkeypatch.setattr(secrets, "WINDOW", 3000)
    monkeypatch.setattr(secrets, "OVERLAP", 300)
    r = random.Random(1)
    for pack in (gzip.compress, zlib.compress, bz2.compress, lambda d: gzip.compress(bz2.compress(d)), lambda d: d):
        for at in (0, 2990, 3280, 3300, 20_000):
            filler = bytes(r.choices(b" \n.,;", k=20_000))
            text = base64.b64encode(pack(filler[:at] + b" " + SECRET.encode() + b" " + filler[at:])).decode()
            assert any(k == "assign" and v for k, _, _, v in secrets.scan(text)), (pack, at)


def test_secrets_in_a_large_archive():
    data = b"\x00" * (80 << 20) + b" " + SECRET.encode()
    text = base64.b64encode(gzip.compress(data, 1)).decode()
    assert any(k == "assign" and v == "base64>gzip" for k, _, _, v in secrets.scan(text))


def test_truncated_archives_count_as_far_as_they_go():
    data = gzip.compress((SECRET + " ").encode() + bytes(random.Random(2).randbytes(9000)))
    assert any(k == "assign" for k, *_ in secrets.scan(base64.b64encode(data[:6000]).decode()))


@pytest.mark.parametrize("size", [20, 40, 64, 76])
def test_secrets_in_lines_of_any_length(size):
    letters = base64.b64encode((SECRET + "; " + "some more text here").encode()).decode().rstrip("=")
    text = "\n".join(letters[i : i + size] for i in range(0, len(letters), size))
    got = [s for s in secrets.scan(text) if s[0] == "assign"]
    assert any(b - a >= len(SECRET) for _, a, b, _ in got)


def test_secrets_under_equal_encodings_are_told_at_each_place():
    blob = base64.b64encode(SECRET.encode()).decode()
    outer = base64.b64encode(f"see {blob} there".encode()).decode()
    packed = base64.b64encode(zlib.compress(SECRET.encode() * 3)).decode()
    for parts in ([blob, blob], [blob, outer], [outer, blob, outer], [packed, blob, packed]):
        text = " and\n".join(parts)
        spans = secrets.scan(text)
        at = 0
        for part in parts:
            at = text.index(part, at)
            assert any(k == "assign" and at <= a < b <= at + len(part) for k, a, b, _ in spans)
            at += len(part)
        assert not secrets.scan(secrets.redact(text, spans))


@pytest.mark.parametrize("data", [SECRET.encode() + b" ", b"caf\xe9 " + SECRET.encode() + b" ", b"\x00" * 300 + SECRET.encode() + b" ", gzip.compress(b"\x00" * 300 + SECRET.encode()), gzip.compress(b"first member") + gzip.compress(SECRET.encode()), bz2.compress(b"first member") + bz2.compress(SECRET.encode())])
@pytest.mark.parametrize("before", ["", "/blob/", "id-", "KEY_", "x", "xy", "xyz"])
def test_secrets_in_glued_or_odd_base64(data, before):
    text = before + base64.b64encode(data).decode()
    spans = secrets.scan(text)
    assert any(k == "assign" and a >= 0 and b <= len(text) for k, a, b, _ in spans)
    assert not [s for s in secrets.scan(secrets.redact(text, spans)) if s[0] == "assign"]


def test_secrets_on_tables(spark):
    texts = [None, "", "nothing", f"x {SECRET}", f"x {SECRET}", "y " * 200_000 + SECRET, "a" * 100_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_documents(spark, docs).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in got[i] if not s["via"]] == plain_base(t or "")
    clean = {r["doc_id"]: r for r in secrets.redact_documents(spark, docs.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert clean[0]["text"] is None and clean[2]["text"] == "nothing" and clean[3]["text"] == "x [REDACTED]'" and clean[3]["n_chars"] == 13
    assert secrets.scan_documents(spark, docs.limit(0)).collect() == []


def test_language_id(spark):
    r = random.Random(3)
    words = {"en": ["the", "of", "house", "and", "water"], "de": ["der", "und", "haus", "nicht", "wasser"]}
    rows = [(i, " ".join(r.choices(words[lang], k=30)), lang, 5) for i, lang in enumerate(["en", "de"] * 30)]
    docs = spark.createDataFrame([*rows, (100, None, "en", 5), (101, "", None, 5), (102, "123 ² !", "de", 5), (103, "the houses " * 60_000, None, 5), (104, "hausen", None, 5)], "doc_id long, text string, lang string, score int")
    model = langid.train(docs, usable=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(spark, docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang, _ in rows)
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0] == "en" and got[104][0] == "de" and all(0 <= s <= 1 for _, s in got.values())
    kept = langid.identified(spark, docs, model)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == set(got) - {100, 101, 102}
    empty = langid.train(docs.filter("lang IS NULL"))
    assert {x["lang_pred"] for x in langid.predict(spark, docs, empty).collect()} == {"und"}
    assert langid.predict(spark, docs.limit(0), model).collect() == []


def test_span_hashes_depend_on_content_alone():
    cp = textscan.codepoints("abcabcxabc")
    h = textscan.span_hashes(cp, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
