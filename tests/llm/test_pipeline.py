import corpus_pipeline

from .conftest import prose


def test_stages_on_the_test_table(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    from vertexloom.llm.common import written

    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "quality":
            assert sum(labels[i].quality == 0 for i in now if i in labels) <= 2 and sum(labels[i].quality == 1 for i in ids - now if i in labels) <= 2
        if name == "toxicity":
            assert sum(labels[i].toxic == 1 for i in now if i in labels) <= 2 and sum(labels[i].toxic == 0 for i in ids - now if i in labels) <= 1
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == docs.count()
        if name in ("secret_scans", "packing"):
            assert now == ids
        if name == "secret_scans":
            assert docs.filter("text rlike '[0-9a-f]{24,}'").isEmpty()
        if name != "packing":
            assert docs.columns == columns
        ids = now


def test_stages_on_odd_tables(odd, none, odd_labels, spark, tmp_path):
    odd_labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            n = out.count()
            if name == "near_duplicates" and docs is odd:
                assert n == docs.count() - 3  # the two rows of 4, 5 and one of the empty texts
            if name == "secret_scans":
                assert n == docs.count()


def test_toxic_copies_and_clean_rows(spark, tmp_path):
    rows = [(i, prose(i, 60) + (" nitwit dolt" if i % 5 == 0 else ""), "en", "s", 0) for i in range(100)]
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(100) if i % 5}


def test_one_id_with_two_texts(spark, tmp_path):
    """Of equal rows one stays; another text under the same id isn't dropped for that."""
    rows = [(1, prose(1, 60), "en", "s", 0), (1, prose(1, 60), "en", "s", 0), (1, prose(2, 60), "en", "s", 0), (2, prose(3, 60), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert kept == sorted({(r[0], r[1]) for r in rows})
