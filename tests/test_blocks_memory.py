"""A Python worker holds the elements of few pages at once."""

from ragmill.operators import extract


def test_elements_of_long_pages_come_in_parts(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 10_000)
    try:
        pages = spark.createDataFrame([(i, "<div><p>" + "word " * 200_000 + "</p></div>") for i in range(6)], "page_id long, html string").coalesce(1)
        out = extract.blocks(pages)
        assert int(spark.conf.get(key)) <= 100
        assert sorted((r.page_id, r.tag) for r in out.select("page_id", "tag").collect()) == [(i, t) for i in range(6) for t in ("div", "p")]
    finally:
        spark.conf.set(key, before)
