"""Small cases of the findings of round 4."""

import duckdb


def test_bound_inputs_equals_its_sql_on_odd_rows(spark, tmp_path):
    from photospark.checks import load_checks

    langs = ["en", "de", "fr", "EN", "De", "x.en", ".de", "en.", "", "en ", "de\n", "656e", "\u0130", None]
    sizes = [None, -(2**31), -1, 0, 1, 2, 1999, 2000, 2001, 5000, 5001, 2**40]
    rows = [(1000 * i + k, a, n) for i, a in enumerate(langs) for k, n in enumerate(sizes)]
    spark.createDataFrame(rows + [(None, "en", 0)] * 2, "doc_id long, lang string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    item = load_checks()["p11_bound_inputs"]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(item.sql).fetchall()
    assert sorted(map(tuple, item.run(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
