"""The kept full-text index against scoring all documents."""

import random
from pathlib import Path

from latticework.operators import retrieval
from latticework.operators.text_index import TextIndex
from tests.conftest import rows


def files_of(root, owner):
    return sorted((str(p), p.stat().st_mtime_ns) for p in Path(root).rglob("*.parquet") if f"service_id={owner}/" in str(p))


def test_index_equals_full_scoring_and_changes_one_owner_only(spark, tmp_path):
    r = random.Random(14)
    words = ["pay", "payment", "order", "orders", "ship", "x1", "late"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 12)))
    docs = [(o, f"{o}-{i}", text()) for o in (1, 2, 3) for i in range(15)] + [(3, "3-empty", ""), (3, "3-null", None)]
    schema = "service_id long, doc string, text string"
    queries = spark.createDataFrame([(1, "PAY orders"), (2, "ship, late!"), (3, "zzz"), (4, "' OR '1'='1"), (5, "pa")], "query_id int, query string")
    index = TextIndex(spark, f"file://{tmp_path}/index")
    assert index.search(queries).count() == 0
    index.put(spark.createDataFrame(docs, schema))
    full = lambda some, **how: rows(retrieval.bm25(spark.createDataFrame(some, schema), queries, "doc", **how), "query_id", "doc", "score", "rank")
    found = lambda **how: rows(index.search(queries, **how), "query_id", "doc", "score", "rank")
    assert found() == full(docs) and found(prefix=False, limit=3) == full(docs, prefix=False, limit=3) and len(found()) > 40
    before = files_of(tmp_path, 1)
    docs = [d for d in docs if d[0] != 2] + [(2, "2-new", "pay pay ship"), (2, "2-other", "late")]
    index.put(spark.createDataFrame([d for d in docs if d[0] == 2], schema))
    assert found() == full(docs) and before and files_of(tmp_path, 1) == before
    some = spark.createDataFrame([(1,), (3,)], "service_id long")
    assert found(owners=some) == full([d for d in docs if d[0] != 2])
    index.put(spark.createDataFrame([(2, "2-silent", "!!!")], schema))
    docs = [d for d in docs if d[0] != 2] + [(2, "2-silent", "!!!")]
    assert found() == full(docs)
    index.drop([2])
    assert found() == full([d for d in docs if d[0] != 2])
