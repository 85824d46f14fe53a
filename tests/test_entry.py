import importlib.util

import __spark_entry__


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    spec = importlib.util.find_spec("latticework.llm")
    assert ("op1_secret_scan" in __spark_entry__.queries()) == bool(spec and spec.origin)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["service", "kind", "peers"] and df.count() > 0
