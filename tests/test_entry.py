import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["site", "n_pages", "digital", "codes"]
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) >= 60
