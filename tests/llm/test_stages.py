"""The pipeline's stages on awkward rows, one after another, and on an empty table; the classifier's fit on repeated ids."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from pairlake.llm import quality_model

LONG = " ".join(f"w{i * i % 4999} the of and" for i in range(6000))
ROWS = [(1, "the cat of the house and the man in it " * 6), (1, "the cat of the house and the man in it " * 6), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, LONG), (None, LONG), (None, None), (7, "a"), (7, "b of the other text"), (8, "é" * 400), (9, "<|endoftext|>")]


def test_stages_on_awkward_rows(spark, sf):
    docs = spark.createDataFrame([(d, t, None if d == 3 else "en", None if d == 4 else "src1", len(t or "")) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ("score", "row", "raw", "n", "h", "epoch", "spans", "digest", "first", "y", "of", "kept", "token", "range", "before", "pairlake")
    docs = docs.withColumns({c: F.lit(7) for c in clashing}).repartition(3)
    names = docs.columns
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, sf)
        rows = got.collect()
        if name != "pack":
            assert got.columns == names, name
            assert all(tuple(r)[5:] == (7,) * len(clashing) for r in rows)
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in rows if r.text == LONG) in ([0, 5], [])
        if name == "mix":
            assert all(r.doc_id is not None and r.text for r in rows)
        docs = spark.createDataFrame(rows, got.schema) if rows else docs
    assert rows and {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(got.columns)


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_fit_takes_one_text_of_a_repeated_id(spark):
    """Whatever the partitions, the same scores."""
    rows = [(i, f"{'good words of the text ' if i % 2 else 'zz qq 11 ## '}{i} {k}" * 20) for i in range(40) for k in range(3)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda d: sorted((r.doc_id, r.score) for r in quality_model.classified(d, labels).collect())
    assert run(df.repartition(1)) == run(df.repartition(7, "text")) == run(df.orderBy(F.desc("text")))
