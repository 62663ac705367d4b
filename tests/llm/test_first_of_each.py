"""The near-duplicate stage decides by row: ids that are null or repeated take no unlinked text along."""

import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    a, b, c = "one two three four five six", "a quite different clean text stands here", "yet another text that links with nothing else"
    rows = [(1, a), (1, a), (None, a), (None, b), (None, None), (7, c), (7, a), (8, "x y z"), (8, "p q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    wanted = [(1, a), (None, b), (None, None), (7, c), (8, "x y z"), (8, "p q r s t u v")]
    assert sorted(kept, key=str) == sorted(wanted, key=str)


def test_a_group_without_ids_keeps_one(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "ONE two three four five six")], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 1
