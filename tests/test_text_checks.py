"""The checks of texts equal their SQL at every length around their limits, and for missing texts."""

import duckdb

from quarry.plans import catalogue


def test_lengths_around_the_limits_equal_the_sql(spark, tmp_path):
    rows = [(10 * i + key, "é" * length) for i, length in enumerate([0, 1, *range(180, 202), *range(380, 402), 5000, 5001]) for key in range(10)]
    rows += [(100_000 + key, None) for key in range(10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {tuple(r) for r in catalogue.QUERIES["text_checks"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = set(db.execute(catalogue.ORACLE_SQL["text_checks"]).fetchall())
    assert found == wanted and len(found) == len(rows)
