"""The stream of diverging edges: state that goes, late rows, restarts."""

import json
from datetime import datetime, timedelta

import pytest

from latticework.streaming import divergence
from tests.conftest import rows

START = datetime(2024, 1, 1)


def test_edges_appear_fall_silent_and_come_back(spark, tmp_path):
    schema = "service_id long, source string, observation string, ts timestamp"
    sent = iter(range(100))

    def send(*observed):
        made = [(1, "otel", json.dumps({"from": "a", "to": to, "kind": "invokes", "count": n}), START + timedelta(minutes=m)) for to, n, m in observed]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{next(sent)}")

    declared = spark.createDataFrame([(1, "a", "known", "invokes")], divergence._EDGE)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        divergence.live(stream, declared, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "60 minutes", "10 minutes").awaitTermination()
        return sorted((r["to_symbol"], r["state"], r["event"], r["observed_count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    send(("known", 1, 0), ("new", 2, 0))
    send(("known", 4, 20), ("new", 3, 5))
    assert run() == [("new", "observed_only", "appeared", 2)]
    # A new run of the same checkpoint: counts go on; the late row is not counted, and both edges fall silent.
    send(("other", 1, 200))
    send(("known", 100, 30), ("other", 1, 201))
    first = run()
    assert ("known", "static_unobserved", "silent", 5) in first and ("other", "observed_only", "appeared", 1) in first
    # What was silent appears anew, with a new count.
    send(("new", 7, 210))
    assert ("new", "observed_only", "appeared", 7) in run()
    left = [r for r in spark.read.format("statestore").load(f"{tmp_path}/checkpoint").collect()]
    assert {r["key"]["to_symbol"] if "to_symbol" in r["key"].asDict() else tuple(r["key"])[2] for r in left} == {"other", "new"}


def test_diverging_as_a_batch(spark):
    events = spark.createDataFrame([(1, "a", "x", "invokes", "appeared"), (1, "a", "y", "invokes", "appeared"), (1, "a", "x", "invokes", "silent"), (1, "a", "y", "invokes", "silent")], f"{divergence._EDGE}, event string")
    declared = spark.createDataFrame([(1, "a", "x", "invokes"), (1, "a", "x", "invokes")], divergence._EDGE)
    assert rows(divergence.diverging(events, declared), "to_symbol", "state") == [("x", "static_unobserved"), ("y", "observed_only")]


def test_intervals():
    assert [divergence.seconds(x) for x in ("1 second", "10 minutes", "2 hours", "1 day")] == [1, 600, 7200, 86400]
    with pytest.raises(KeyError):
        divergence.seconds("1 fortnight")
