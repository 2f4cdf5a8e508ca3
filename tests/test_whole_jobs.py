"""Queries that take all rows where others stop early or take a part."""

from freshet.plans import flows


def test_all_records_in_order(spark, sf):
    f = spark.read.parquet(f"{sf}/flows.parquet").where("first_ms is not null")
    got = [(r.first_ms, r.rec_no) for r in flows.sort_records(spark, sf).collect()]
    assert len(got) > 200 and got == sorted((r.first_ms, r.rec_no) for r in f.select("first_ms", "rec_no").collect())
