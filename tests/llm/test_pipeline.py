"""The pipeline's stages: what they keep and that their decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from bourseline.llm import decontaminate, langid, near_dup

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        at[name] = (docs, out.cache())
        docs = at[name][1]
    before, after = at["language_id"]
    assert after.count() == before.count()  # every document here is in a known language
    junk = spark.createDataFrame([(1, "123 456", None, "s", 7), (2, None, "en", "s", None)], before.schema)
    assert corpus_pipeline.language_id(spark, before.unionByName(junk), SMALL).count() == before.count()
    before, after = at["line_dedup"]
    assert after.count() == before.count()
    assert after.filter("n_chars <> length(text)").count() == 0
    before, after = at["near_dedup"]
    classes = {r["class_id"] for r in near_dup.near_duplicates(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == classes
    before, after = at["decontamination"]
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - leaked
    before, after = at["packing"]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert langid.UNKNOWN == "und"


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_stages_keep_odd_rows_and_columns(spark):
    text = "The quick brown fox that was in the house and then jumped over the lazy dog of the town. " * 3
    schema = "doc_id long, text string, lang string, n_chars int, score double, lang_pred string, t_ int, lines int, words int, id int"
    rows = [(1, text, "en", 270, 7.0, "zz", 1, 2, 3, 4), (1, text, "en", 270, 7.0, "zz", 1, 2, 3, 4), (1, "a wholly other text of the same number that says nothing more than this", "en", 70, None, None, None, None, None, None), (2, text + " end", "en", 274, None, "q", 1, 2, 3, 4), (None, "no number here but a text", "en", 25, None, None, 1, 1, 1, 1), (3, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        own = {(r["doc_id"], r["score"], r["lang_pred"]) for r in out.collect()}
        assert own <= {(r[0], r[4], r[5]) for r in rows}, name
        assert stage(spark, docs.filter("false"), "/root/testdata/sf0.001").count() == 0, name
    near = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r["text"][:8] if r["text"] else "" for r in near) == ["", "The quic", "a wholly", "no numbe"]


def test_stages_take_columns_of_any_name(spark):
    text = "The quick brown fox that was in the house and then jumped over the lazy dog of the town. " * 3
    docs = spark.createDataFrame([(1, text, "en"), (2, text + " end", "en"), (3, None, None)], "doc_id long, text string, lang string")
    for name in ("my col", "a:b", "x,y", "dot.ted", "removed_lines__"):
        docs = docs.withColumn(name, F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert {r["my col"] for r in out.collect()} <= {"kept"}, name
    assert corpus_pipeline.pack(spark, docs, SMALL).count() > 0
