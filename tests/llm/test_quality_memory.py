"""Training holds rows and pairs of row numbers on the driver, not the pairs' differences."""

import tracemalloc

from pyspark.sql import functions as F

from ragmill.llm import quality


def test_training_is_small_on_the_driver(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text of its own "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "!!!").otherwise("")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    tracemalloc.start()
    try:
        model = quality.fit(docs, labels)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # 200,000 differences of 52 doubles are 83 MB
    assert most < 70e6
    assert quality.score(docs.limit(50), model).where((F.col("doc_id") % 2) != F.col("predicted")).isEmpty()
