import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} <= {"train", "val", "test"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_agrees_on_a_few(spark, data):
    import duckdb

    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for name in "events documents pages labels conversations benchmark".split():
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    for name in ("unlabelled_topk", "url_canonical", "text_normalize", "rouge1", "crawl_run_status"):
        got = entry.queries()[name](spark, data).toPandas()
        want = db.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
        as_text = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
        assert as_text(got) == as_text(want), name
