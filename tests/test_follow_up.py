"""Packing under budgets, pages with tokens, and checks of what a page has answered."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import packing
from latticework.plans import follow_up
from latticework.plans.api import Api
from latticework.sources.catalog import Catalog
from tests.conftest import rows


def test_packing_equals_brute_force(spark):
    r = random.Random(15)
    items = [(r.choice("abc"), i, r.choice([None, 0, 3, 20, 50]), r.choice([None, 1, 2, 9, 70])) for i in range(90)] + [("d", 1000, 500, 400), (None, 1001, 5, 1)]
    df = spark.createDataFrame(items, "response string, id int, full_bytes int, short_bytes int")
    for budget in (0, 1, 60, 10_000):
        want = {}
        for response in {i[0] for i in items}:
            left, short = budget, False
            told = []
            own = sorted((i for i in items if i[0] == response), key=lambda i: i[1])
            sizes = [(i[1], max(i[2] or 1, 1), min(max(i[3] or 1, 1), max(i[2] or 1, 1))) for i in own]
            for number, full, brief in sizes:
                if not short and full <= left:
                    told.append((number, "full", full))
                    left -= full
                    continue
                short = True
                if brief > left:
                    break
                told.append((number, "short", brief))
                left -= brief
            want[response] = told
        got = packing.packed(df, ["response"], ["id"], budget)
        assert {k: [x[1:] for x in sorted(t for t in rows(got, "response", "id", "level", "bytes") if t[0] == k)] for k in want} == want
        total = {x["response"]: x for x in packing.summary(df, got, ["response"]).collect()}
        for response, told in want.items():
            n = sum(i[0] == response for i in items)
            # A null response has no counts to join with, as nulls meet nothing.
            if response is not None:
                assert (total[response]["items"], total[response]["omitted"], total[response]["bytes"]) == (n, n - len(told), sum(t[2] for t in told))
                assert total[response]["truncated"] == any(t[1] == "short" for t in told) or n > len(told)


def test_pages_are_disjoint_and_complete(spark):
    data = [(i % 3 if i % 7 else None, f"k{i:02d}", i) for i in range(23)]
    df = spark.createDataFrame(data, "a int, b string, v int")
    found, token, pages = [], None, 0
    while True:
        part, token = follow_up.page(df, ["a", "b"], {"x": 1}, "v1", 5, token)
        found += [tuple(x) for x in part]
        pages += 1
        if token is None:
            break
    assert pages == 5 and found == sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    _, token = follow_up.page(df, ["a", "b"], {"x": 1}, "v1", 5)
    for asked, keys, version, told in (({"x": 2}, ["a", "b"], "v1", token), ({"x": 1}, ["b"], "v1", token), ({"x": 1}, ["a", "b"], "v2", token), ({"x": 1}, ["a", "b"], "v1", token[:-3] + "AAA"), ({"x": 1}, ["a", "b"], "v1", "%")):
        with pytest.raises(follow_up.Refused):
            follow_up.page(df, keys, asked, version, 5, told)
    with pytest.raises(ValueError):
        follow_up.page(df, ["a"], {}, "v", 501)
    days = df.withColumn("d", F.timestamp_seconds(F.col("v") * 86400))
    first, token = follow_up.page(days, ["d"], {}, "v", 20)
    rest, end = follow_up.page(days, ["d"], {}, "v", 20, token)
    assert len(first) == 20 and [x["v"] for x in rest] == [20, 21, 22] and end is None


def test_walks_end_when_the_catalog_changes(spark, tmp_path):
    shop = Catalog(spark, f"file://{tmp_path}/catalog")
    shop.overwrite("services", spark.createDataFrame([(1, 1, "web")], "id long, repository_id long, name string"))
    apis = lambda n: spark.createDataFrame([(i, 1, "GET", f"/{i}") for i in range(n)], "id long, service_id long, method string, path string")
    shop.overwrite("apis", apis(7))
    api = Api(shop)
    first, token = api.walk("apis", "web", ["path", "method"], 4)
    rest, end = api.walk("apis", "web", ["path", "method"], 4, token)
    assert [x["path"] for x in first + rest] == [f"/{i}" for i in range(7)] and end is None
    shop.overwrite("apis", apis(8))
    with pytest.raises(follow_up.Refused):
        api.walk("apis", "web", ["path", "method"], 4, token)


def test_follow_ups(spark):
    schema = "kind string, name string, container string"
    want = spark.createDataFrame([("Deployment", "web", "app"), ("Deployment", "web", "app"), ("Job", "clean", None), (None, "x", "y")], schema)
    some = spark.createDataFrame([("Deployment", "web", "app"), ("Deployment", "other", "app")], schema)
    one = lambda *a: follow_up.checked_follow_up(*a).collect()[0]
    first = one(want, some, True)
    assert (first["status"], first["matched"], first["continue_pagination"]) == ("needs_next_page", 1, True)
    assert [tuple(m) for m in first["missing"]] == [("Job", "clean", "")] and len(first["fingerprint"]) == 43
    assert one(want, some, True, first["fingerprint"])["status"] == "stalled"
    assert one(want, some, False)["status"] == "incomplete" and one(want, want, True)["status"] == "complete"
    assert one(want.limit(0), some, True)["status"] == "complete" and one(want, some.limit(0), False)["matched"] == 0
