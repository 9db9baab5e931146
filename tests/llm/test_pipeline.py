import pyarrow as pa

import corpus_pipeline
from nymora.llm.common import BATCH_BYTES, small_batches, written
from test_near_duplicates import brute_similar
from test_text_operators import brute_contamination, brute_lines


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("source", "score")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables).cache()
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name != "packing":
            assert out.columns == docs.columns and len(after) == out.count()
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == brute_lines([(d, r.text) for d, r in before.items()])
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == brute_similar([(d, r.text) for d, r in before.items()])
        elif name == "decontamination":
            assert set(after) == {d for d, r in before.items() if not brute_contamination(r.text, bench)[4]}
        else:
            assert {r.doc_id for r in out.collect()} == set(before)
        docs = out


def test_run_equals_its_stages(spark, tables):
    assert corpus_pipeline.run(spark, tables).select("doc_id").distinct().count() > 100


def test_stages_on_odd_tables(spark, tables):
    """Null and empty texts, null ids, repeated rows, a very long text, columns that clash with the operators' own."""
    prose = spark.read.parquet(f"{tables}/documents.parquet").where("lang = 'en' and length(text) between 500 and 2000").orderBy("doc_id").limit(30).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1.0, "x") for r in prose]
    rows += [(None, None, None, None, None, None, None), (None, "", None, None, 0, None, None), (7_000_001, " ".join(r.text for r in prose) * 20, "en", None, 1, 2.0, "y"), rows[0], rows[0], (None, prose[1].text, "en", "s", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _hashed string"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tables)
            n = len(out.collect())
            assert n <= docs.count() or name == "packing"
            if name != "packing":
                assert out.columns == docs.columns
                docs = written(out, "odd")


def test_texts_reach_python_in_small_batches(spark):
    """15 MB of text in one partition of 3,000 rows: one batch by default; a session's own size stays."""
    session, own = spark.newSession(), spark.newSession()
    docs = session.range(3000).selectExpr("id as doc_id", "repeat('word ', 1000) as text").coalesce(1)
    sizes = lambda df: [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    assert len(sizes(docs)) == 1
    plain, _, _ = corpus_pipeline._plain(docs)
    assert len(found := sizes(plain)) >= 3 and max(found) < 5 << 20
    own.conf.set(BATCH_BYTES, "1m")
    small_batches(own)
    assert own.conf.get(BATCH_BYTES) == "1m"
