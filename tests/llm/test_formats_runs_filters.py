"""Chat formatting, periodic runs and the filter audit against brute force and odd tables."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import chatformat, filteraudit, periods, queries, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- templates ------------------------------------------------------------------------------------------------------


def rendered(source, filters=None, **values):
    return "".join(text for text, _ in templates.compiled(source, filters)(**values))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# no #}b {{- ' c' }}", "ab c"),
        ("{{ 1 + 2 * 3 }} {{ (1 + 2) * 3 }} {{ 7 // 2 }}{{ 7 % 2 }} {{ -2 }}", "7 9 31 -2"),
        ("{% for x in [1, 2, 3] %}{{ loop.index }}{{ loop.index0 }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", "101,212,323"),
        ("{% for x in [] %}x{% else %}none{% endfor %}", "none"),
        ("{% for x in xs %}{% if x.a == 'p' %}P{% elif x['a'] in ['q', 'r'] %}Q{% else %}-{% endif %}{% endfor %}", "PQ-"),
        ("{% set a = 'x' %}{% for x in [1] %}{% set a = 'y' %}{{ a }}{% endfor %}{{ a }}", "yx"),
        ("{{ 'yes' if n is defined and n is not none else 'no' }}{{ m | default('d') }}", "yesd"),
        ("{{ ' A ' | trim | lower }}{{ 'a' ~ 1 }}{{ 'abc'[1] }}{{ xs | length }}{{ ['a', 'b'] | join('+') }}", "aa1b3a+b"),
        ("{% for x in xs %}{{ '^' if loop.first else loop.previtem.a }}{{ '$' if loop.last else loop.nextitem.a }} {% endfor %}", "^q ps q$ "),
        ("{{ \"it's\" if false else 'a\\'b\\n' }}", "a'b\n"),
        ("{% if not not n and 2 > 1 and 'a' < 'b' and 'x' not in 'abc' %}ok{% endif %}", "ok"),
    ],
)
def test_templates_render(source, want):
    assert rendered(source, xs=[{"a": "p"}, {"a": "q"}, {"a": "s"}], n=1) == want


@pytest.mark.parametrize(
    "source",
    [
        "{% for %}", "{% if a %}", "{{ a", "{{ }}", "{% end %}", "{{ a b }}", "{{ a | nothing }}", "{{ a is odd }}", "{# open", "{% set loop = 1 %}",
        "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{% if a %}" * 60 + "{% endif %}" * 60, "{{ 99999999999999999999 }}", "{{ a.b() }}", "{{ 'a }}",
    ],
)
def test_templates_refuse(source):
    with pytest.raises(templates.TemplateError):
        templates.compiled(source)


@pytest.mark.parametrize("source", ["{{ a }}", "{{ 'a' * 9 }}", "{{ 1 // 0 }}", "{{ x.__class__ }}", "{{ a.b.c }}", "{{ 4611686018427387904 * 4 }}", "{{ [1] }}", "{% for c in x %}{% endfor %}", "{{ 'a' < 1 }}"])
def test_rendering_refuses(source):
    with pytest.raises(templates.TemplateError):
        rendered(source, x="text")


def test_constants_are_folded():
    body = templates.folded_body(templates.parsed("a{{ 'b' ~ (1 + 1) }}{% if 1 > 2 %}x{{ y }}{% else %}c{% endif %}{% for x in [] %}z{% endfor %}{{ 1 // 0 if y else 2 }}"))
    assert body[0] == templates.Text("ab2c") and len(body) == 2 and isinstance(body[1], templates.Out)
    assert templates.folded_body(templates.parsed("{% generation %}{{ 'a' if true else b }}{% endgeneration %}")) == (templates.Generation((templates.Text("a"),)),)


def test_streams_are_read_once_and_cut_after_rounds():
    stream = templates.Stream(iter([1, 2]))
    assert stream.first() == 1 and list(stream) == [1, 2]
    with pytest.raises(templates.TemplateError):
        list(stream)
    pieces = list(templates.compiled("{% for x in xs %}{{ x }}{% generation %}!{% endgeneration %}{% endfor %}")(xs=[1, 2]))
    assert pieces == [("1", False), ("!", True), templates.CUT, ("2", False), ("!", True), templates.CUT]


# --- conversations --------------------------------------------------------------------------------------------------

FORM = chatformat.Format()
said = st.text(alphabet=st.sampled_from(list("</s>[INST]\\ROLEXY aé🙂\n")), max_size=30) | st.sampled_from([*chatformat.CONTROLS, "<\\/s>", "[\\\\INST]", "<", "[", "</", "s>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/INST]"]) | said, said), max_size=6), st.integers(1, 60))
def test_formatting_comes_back(turns, most):
    read = []
    for text, spans in FORM.parts([{"role": a, "text": b} for a, b in turns], most):
        read += FORM.turns(text, spans)
    assert [(t.role, t.text) for t in read] == turns
    assert [t.loss or "" for t in read if t.role == "assistant"] == [b for a, b in turns if a == "assistant"]
    assert all(t.loss is None for t in read if t.role != "assistant")


@settings(max_examples=200, deadline=None)
@given(said)
def test_escapes_hide_control_strings(text):
    hidden = FORM.escaped(text)
    assert FORM.unescaped(hidden) == text and not any(c in hidden for c in chatformat.CONTROLS)


def test_bad_controls_are_refused():
    for bad in ("x", "<\\s>", "<a<"):
        with pytest.raises(ValueError):
            chatformat.Format(controls=(*chatformat.CONTROLS, bad))


def test_conversations_on_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a</s>"), (1, None, "system", None), (1, 1, "assistant", "b"), (None, 0, None, "x"), (None, 0, "user", ""), (2, 5, "tool[INST]", "t" * 5000)]
    rows += [(3, i, "assistant" if i % 2 else "user", f"word{i} " * 50) for i in range(3000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, part string")
    first = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    found = {r["conv_id"]: r for r in chatformat.digests(spark, chatformat.format_conversations(spark, df), in_order=True).collect()}
    parts = chatformat.format_conversations(spark, df)
    assert parts.filter("conv_id = 3").count() == 2  # 1.1 M code points
    again = {r["conv_id"]: r for r in chatformat.digests(spark, parts.repartition(7)).collect()}
    assert found == again and len(found) == 4
    for one, r in found.items():
        own = sorted((r for r in rows if r[0] == one), key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == sum(len(p["text"]) for p in parts.filter(f"conv_id <=> {one if one is not None else 'null'}").collect())
    back = chatformat.read_back(spark, parts)
    assert back.count() == len(rows) and {r["loss"] for r in back.filter("conv_id = 1").collect()} == {None, "b"}
    assert chatformat.digests(spark, chatformat.format_conversations(spark, df.limit(0))).count() == 0


# --- periodic runs --------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    """By definition: every stretch whose smallest period is q, long enough, that cannot be extended."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                own = words[i : i + length]
                if not any(all(own[k] == own[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(3)
    some = 0
    for _ in range(1500):
        kinds = r.choice([1, 2, 3, 50, 50])
        words = [r.randrange(kinds) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            block = [r.randrange(kinds) for _ in range(r.randint(1, 20))]
            at = r.randint(0, len(words))
            words[at:at] = (block * 9)[: r.randint(1, 5 * len(block))]
        want = plain_runs(words)
        some += len(want)
        assert periods.runs_of(np.array(words, np.int64)) == want
        assert periods.runs_of(np.array(words, np.int64), 5) == plain_runs(words, 5)
    assert some > 300


def test_long_texts_end_soon():
    began = time.time()
    n = 300_000
    assert periods.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periods.runs_of(np.arange(n) % 2) == [(0, n, 2)]
    assert periods.runs_of(np.random.default_rng(1).integers(0, 5000, n)) == []
    block = np.random.default_rng(2).integers(0, 5000, 2000)
    assert periods.runs_of(np.concatenate([np.arange(10_000, 90_000), np.tile(block, 3), np.arange(10_000, 20_000)])) == [(80_000, 6000, 2000)]
    assert time.time() - began < 20


def repeated(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_on_tables(spark):
    r = random.Random(4)
    texts = [None, "", " \t\n", "x " * 40, "a b c d e f " * 3, "\u0085   " * 8, "é漢 " * 7 + "z"]
    texts += [" ".join(f"w{r.randrange(r.choice([3, 400]))}" for _ in range(r.choice([5, 80, 300]))) for _ in range(300)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "x " * 20, "c"), (3, "y " * 30, "c"), (3, "x " * 40, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(map(tuple, periods.digests(periods.find_runs(spark, periods.with_repeats(docs))).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        words = repeated(doc_id, text)
        runs = plain_runs(words)
        gone = {i for start, length, q in runs for i in range(start + q, start + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert got == sorted(want, key=str) and sum(w[1] for w in want) >= 20
    assert periods.find_runs(spark, docs.limit(0)).count() == 0
    assert periods.find_runs(spark, docs).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_runs_of_all_documents_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["n_runs"], r["runs_sha256"]) for r in queries.op12_periodic_runs(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = repeated(r["doc_id"], r["text"])
        if len(words) > 1500:
            continue
        runs = plain_runs(words)
        assert got[r["doc_id"]] == (len(runs), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)))


# --- filters --------------------------------------------------------------------------------------------------------


def fails(text, copy):
    words = WORD.findall(text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": copy,
    }


def test_filter_audit_equals_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(r.choice(["a", "B", "c%", f"w{r.randrange(500)}"]) for _ in range(r.choice([3, 150, 260]))) for _ in range(25)] + [None, "", "é漢  "]
    rows = [(i, r.choice(pool), r.choice(["en", "de", None, ""]), "x", "y") for i in range(150)]
    rows += [(None, pool[0], "en", "x", "y"), (None, None, None, "x", "y"), (7, pool[1], "de", "x", "y"), (7, pool[1], "en", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask string, digest string")
    labels = spark.createDataFrame([(i, r.randrange(2), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(7, 0, 0), (7, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in filteraudit.audit(spark, docs, labels).collect()}
    said = {}
    for x in labels.collect():
        if x["doc_id"] is not None:
            q, t = said.get(x["doc_id"], (False, False))
            said[x["doc_id"]] = (q or x["quality"] == 1, t or x["toxic"] == 1)
    marks = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in rows)
        marks.append((lang or "", fails(text, copy), *said.get(doc_id, (False, False))))
    want = {}
    for part in {m[0] for m in marks}:
        own = [m for m in marks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = order[: step - 1]
                removed = [m for m in own if m[1][f] and not any(m[1][b] for b in before)]
                kept = sum(not any(m[1][b] for b in order[:step]) for m in own)
                redundant = sum(m[1][f] and any(m[1][b] for b in before) for m in own)
                alone = sum(m[1][f] and sum(m[1].values()) == 1 for m in own)
                shapley[f] += len(removed)
                want[part, order, step] = [kept, len(removed), redundant, alone, sum(m[2] for m in removed), sum(m[3] for m in removed), f]
        for (p, _, _), v in want.items():
            if p == part:
                v[6] = shapley[v[6]]
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == 3 * 600
    assert filteraudit.audit(spark, docs.limit(0), labels).count() == 0
    assert filteraudit.audit(spark, docs, labels.limit(0)).count() == 1800


def test_outcomes_add_up():
    m = filteraudit.outcome_matrices()
    assert {k: v.shape for k, v in m.items()} == dict.fromkeys(filteraudit.OUTCOMES, (32, 600))
    columns = m["kept"].reshape(32, 120, 5), m["removed"].reshape(32, 120, 5)
    assert (columns[0][:, :, 4] + columns[1].sum(axis=2) == 1).all()
    assert (m["unique_fails"] <= m["removed"]).all() and not (m["redundant"] & m["removed"]).any()
