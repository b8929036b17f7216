"""Drawn pages grow with the tables."""

import pytest

from foliograph.plans import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_one_form_for_each_page(spark, sf):
    ids = [r.page_id for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").select("page_id").collect()]
    pages = queries.drawn(spark, f"/root/testdata/{sf}").select("document_id")
    assert sorted(r.document_id for r in pages.collect()) == sorted(f"page{i}" for i in ids)
    assert pages.rdd.getNumPartitions() * queries.TASK_PAGES >= len(ids)


def test_every_drawn_page_is_measured(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert queries.warp_synthetic(spark, sf).count() == n
