import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_work_scope_leaves_nothing(spark, tmp_path):
    import os

    from querylens.sources.work import stored, work_scope

    with work_scope(spark) as path:
        assert stored(spark.range(3), "numbers").count() == 3 and os.path.isdir(path)
        with work_scope(spark) as inner:
            stored(spark.range(3), "numbers")
        assert os.path.isdir(path) and not os.path.exists(inner)
    assert not os.path.exists(path)
