"""The labelled sample: contradicting, repeated and missing labels."""

from pyspark.sql import functions as F

from tickertide.llm.common import label_sample


def test_contradicting_labels_have_one_defined_value(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)] + [(None, "none"), (1, "again")], "doc_id long, text string")
    rows = [(1, 1), (1, 0), (1, 1), (2, 1), (2, 1), (3, None), (3, 1), (4, None), (None, 1), (9, 0)]
    for labels in (rows, rows[::-1]):
        df = spark.createDataFrame(labels, "doc_id long, quality int").repartition(4)
        got = label_sample(docs, df, "quality", F.lit(True), 100).collect()
        assert sorted(tuple(r) for r in got) == [(1, "again", 0), (1, "text 1", 0), (2, "text 2", 1), (3, "text 3", 1)]
    none = label_sample(docs, df.limit(0), "quality", F.lit(True), 100)
    assert none.count() == 0
