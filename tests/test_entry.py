import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 40


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r["p_incident"], r["entity"]))
