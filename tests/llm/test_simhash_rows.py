"""Documents are kept by component, whatever their ids."""

from catalogweave.llm import simhash


def test_one_row_of_every_component(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (5, "v w x y z"), (None, "k l m n o"), (None, "k l m n o"), (None, "a b c d e")]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(map(tuple, kept), key=str) == [(1, "a b c d e"), (1, "v w x y z"), (None, "k l m n o")]


def test_odd_rows(spark, odd_docs, no_docs):
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # Texts without words are one group, and so are copies and texts that differ in letter case only.
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4, 5, 7, 8, 9, 10, 11]
    assert simhash.drop_near_duplicates(no_docs).count() == 0
