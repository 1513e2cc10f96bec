"""Every pipeline stage on edge cases, and the whole on the smallest tables."""

import corpus_pipeline as pipeline

from twincheck.llm.exact_dedup import drop_copies

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "same text here", "en", "s", 1), (4, "same  text here", "en", "s", 1), (5, "x" * 3000, "en", "s", 3000), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = {r.doc_id for r in pipeline.drop_copies(spark, docs, SF).collect()}
    assert 3 not in kept and 4 in kept and 5 in kept


def test_run(spark):
    pieces = pipeline.run(spark, SF).collect()
    assert pieces and all(p.length > 0 for p in pieces)


def test_copies_go_under_any_column_names(spark):
    rows = [(1, "a b", 5, "x"), (1, "a  b", 6, "y"), (1, "a\tb ", 7, "z"), (2, "ab", 8, "w"), (3, None, 9, "v"), (3, "", 9, "v"), (None, "q", 1, None), (None, "q", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha int, __n string").withColumnRenamed("__n", "row")
    got = drop_copies(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("__sha = 7 OR text = '' OR doc_id IS NULL").distinct().collect()))
    wide = spark.createDataFrame([(1, "a", 1, 2, 3)], "doc_id long, text string, __n int, sha int, k int")
    assert [tuple(r) for r in drop_copies(wide).collect()] == [(1, "a", 1, 2, 3)]
