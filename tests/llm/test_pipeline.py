import corpus_pipeline
from usagelens.llm import decontaminate, pii, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after.cache()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    bench = decontaminate.Benchmark([tuple(r) for r in spark.read.parquet(
        f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    for r in docs.collect():
        assert not any(f[3] >= 0.5 for f in bench.found(r.text))
        assert not [s for s in pii.spans_of(r.text) if s[0] in pii.BASE] and r.n_chars == len(r.text)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1] and last.where("not round_trip").count() == 0


def test_whole_run_equals_its_stages(spark):
    ids = [r.doc_id for r in corpus_pipeline.run(spark, SF).collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(ids) == sorted(r.doc_id for r in docs.collect())


def test_awkward_documents_pass(spark, documents, no_documents):
    for docs in (documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.where("not round_trip").count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [len(corpus_pipeline.STAGES)] == [5] and set(queries.ORACLES) <= set(queries.QUERIES)
