"""Every document has a row of verdicts, labelled or not."""

import pytest

from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["failed_by_all", "failed_by_all_missing_fails"])
def test_no_document_is_left_out(spark, name):
    ids = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["id"] for r in catalogue.QUERIES[name](spark, SF).collect()} == ids
